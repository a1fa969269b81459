"""Text normalisation.

Every function takes and returns a Column. The only Python code is the NFKC fold,
which Spark lacks; it receives nulls for plain-ASCII values, so no text travels to
Python unless it can change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters an ECMAScript regex treats as white space.
SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


@F.pandas_udf(T.StringType())
def _nfkc_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_fold_all(values: pd.Series) -> pd.Series:
    def fold(items):
        return [i if i is None else unicodedata.normalize("NFKC", i) for i in items]

    return values.map(fold, na_action="ignore")


def nfkc_all(c: Column) -> Column:
    """``nfkc`` over an array of texts; arrays of plain ASCII bypass Python."""
    odd = F.exists(c, lambda t: F.coalesce(t.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    return F.coalesce(_nfkc_fold_all(F.when(odd, c)), c)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; ASCII values bypass Python."""
    return F.coalesce(_nfkc_fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def by_script(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows that hold plain ASCII or null in all ``columns``, and the others: together ``df``, which is read twice.

    For many short values, of which hardly any need the fold: bypassing it row by row still sends a null to Python for each.
    """
    odd = F.lit(False)
    for c in columns:
        odd = odd | F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.filter(~odd), df.filter(odd)


def strip(c: Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Trim, then turn each run of white space into one blank.

    Java's Unicode class is several times faster than the spelled-out one and differs from
    it in two characters; texts holding either take the spelled-out one.
    """
    exact = F.regexp_replace(c, f"{SPACE}+", " ")
    quick = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(F.when(c.rlike(r"[\x{85}\x{FEFF}]"), exact).otherwise(quick))


def is_blank(c: Column) -> Column:
    """Null, or nothing left after trimming blanks."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def norm_space(c: Column) -> Column:
    """Lower-cased text with collapsed white space; punctuation stays."""
    return F.lower(squeeze(c))


def norm_evidence(c: Column) -> Column:
    """``norm_space`` over the NFKC form: the form quotes are looked up in."""
    return norm_space(nfkc(c))


def _words(c: Column) -> Column:
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def norm_name(c: Column) -> Column:
    """Comparable name: NFKC, lower case, ``&`` spelled out, letters and digits only."""
    return _words(nfkc(c))


def norm_name_ascii(c: Column) -> Column:
    """``norm_name`` for columns known to hold ASCII: no Python stage in the plan."""
    return _words(c)


def norm_slug(c: Column) -> Column:
    return norm_slug_ascii(nfkc(c))


def norm_slug_ascii(c: Column) -> Column:
    """``norm_slug`` for columns known to hold ASCII: no Python stage in the plan."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def slugify(c: Column) -> Column:
    """Normalised name with hyphens between words."""
    return F.replace(norm_name(c), F.lit(" "), F.lit("-"))


def slug_text(c: Column) -> Column:
    """ASCII slug: other characters become single hyphens, none at the ends."""
    hyphened = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(hyphened, "^-+|-+$", "")


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c.cast("string"), "UTF-8")))


def unique_slug(name: Column, identifier: Column, fallback: str) -> Column:
    """Readable prefix plus the full id in hex, which alone makes it unique."""
    readable = slug_text(name)
    prefix = F.when(readable == "", F.lit(fallback)).otherwise(readable)
    return F.concat(prefix, F.lit("--"), hex_text(identifier))


def search_text(c: Column, longest: int = 100) -> Column:
    """Query text as accepted by search: trimmed, collapsed, cut to the accepted length."""
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, longest)


def squash(c: Column) -> Column:
    """Lower-case ASCII letters and digits, nothing between them."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def text_or_null(c: Column) -> Column:
    """The value itself unless blank."""
    return F.when(strip(c) != "", c)


def member_or_null(c: Column, members: list[str]) -> Column:
    return F.when(c.isin(*members), c)


def timestamp_or_null(c: Column) -> Column:
    """The text itself if it reads as a timestamp."""
    return F.when(F.try_to_timestamp(c).isNotNull(), c)


# Fixed value: date-time with seconds and an explicit zone.
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def iso_ts_ok(c: Column) -> Column:
    """ISO date-time that names its zone and denotes a real instant."""
    well_formed = F.coalesce(c.rlike(ISO_WITH_ZONE), F.lit(False))
    return well_formed & F.try_to_timestamp(F.when(well_formed, c)).isNotNull()
