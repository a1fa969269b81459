"""URL rules as regular expressions over the text of an address.

Hosts are compared in lower case. ``standard`` first gives hosts outside ASCII their ASCII form and
resolves dot segments; other addresses, nearly all, never leave the JVM. Python cannot be called within
an array function: there ``standard_all`` prepares the array, and the rules are told ``plain=True``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.rules import once
from shelfmark.functions.text import SPACE, strip

LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
DOTTED_HOST = rf"{LABEL}(?:\.{LABEL})*\.[a-z]{{2,63}}"
# Anything a host may not contain, credentials and ports included.
PLAIN_HOST = r"[^/?#@:\\\s<>^|%\[\]\x00-\x1f\x7f-\x{10FFFF}]+"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group, or null when the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _without_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _tidy_path(path: Column) -> Column:
    cut = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    return once(cut, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


# An address that ``standard`` changes: something outside ASCII, or a dot segment.
_UNUSUAL = r"(?i)[^\x00-\x7f]|^https?://[^/?#]+(?:/[^?#]*)?/(?:\.|%2e){1,2}(?:[/?#]|$)"
_PARTS = re.compile(r"(?is)(https?://)([^/?#\\]*)([^?#]*)(.*)")
_DOT, _DOTS = re.compile(r"(?i)\.|%2e"), re.compile(r"(?i)(?:\.|%2e){2}")
_ASCII = "".join(map(chr, range(128)))
# Characters a host may be written with that stand for nothing.
_IGNORED = dict.fromkeys(map(ord, "\xad\u200b\u2060\ufeff"))


def _ascii_host(host: str) -> str:
    """Compatibility composition in lower case, then Punycode for each label outside ASCII."""
    folded = unicodedata.normalize("NFKC", host.translate(_IGNORED).lower()).replace("\u3002", ".")
    labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in folded.split(".")]
    return ".".join(labels)


def _resolved(path: str) -> str:
    """A path without ``.`` and ``..``, what is outside ASCII percent-encoded."""
    out: list[str] = []
    steps = path.split("/")[1:]
    for i, step in enumerate(steps):
        up = bool(_DOTS.fullmatch(step))
        if up:
            out = out[:-1]
        elif not _DOT.fullmatch(step):
            out.append(step)
            continue
        if i == len(steps) - 1:
            out.append("")
    return quote("/" + "/".join(out), safe=_ASCII) if steps else path


def _standard(address: str) -> str:
    found = _PARTS.fullmatch(address)
    if not found or "@" in found[2]:
        return address
    host, colon, port = found[2].partition(":")
    try:
        return found[1] + _ascii_host(host) + colon + port + _resolved(found[3]) + quote(found[4], safe=_ASCII)
    except UnicodeError:
        return address


@F.pandas_udf(T.StringType())
def _standard_each(addresses: pd.Series) -> pd.Series:
    return addresses.map(_standard, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _standard_lists(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda items: [i if i is None else _standard(i) for i in items], na_action="ignore")


def standard(c: Column) -> Column:
    """An http(s) address with an ASCII host and without dot segments; anything else as it is."""
    return F.coalesce(_standard_each(once(c, lambda a: F.when(a.rlike(_UNUSUAL), a))), c)


def _read(written: Column, use: Callable[[Column, Column], Column], plain: bool = False) -> Column:
    """``use(written, its standard form)``, so that the plan holds ``written`` twice however often ``use`` refers to it."""
    if plain:
        return once(written, lambda a: use(a, a))
    both = F.struct(written.alias("written"), standard(written).alias("standard"))
    return once(both, lambda a: use(a["written"], a["standard"]))


def standard_all(c: Column) -> Column:
    """``standard`` over an array; arrays it does not change bypass Python."""
    unusual = F.exists(c, lambda a: F.coalesce(a.rlike(_UNUSUAL), F.lit(False)))
    return F.coalesce(_standard_lists(F.when(unusual, c)), c)


def with_https(c: Column) -> Column:
    """Trimmed; a bare host becomes an https address."""
    return once(strip(c), _with_https)


def _with_https(raw: Column) -> Column:
    return F.when(raw.rlike("(?i)^https://") | (raw == ""), raw).otherwise(F.concat(F.lit("https://"), raw))


def safe_url(c: Column, plain: bool = False) -> Column:
    """True for an https URL that is fit to be shown: dotted host, no credentials, no blanks."""
    return _read(c, _safe, plain)


def _safe(written: Column, address: Column) -> Column:
    host = F.regexp_extract(address, "(?i)^https://([^/?#:]+)", 1)
    port = F.regexp_extract(address, "(?i)^https://[^/?#:]+:([0-9]+)", 1)
    return F.coalesce(
        (F.length(written) <= 2048)
        & ~written.rlike(rf"{SPACE}|[\\\x00-\x1f\x7f]")
        & address.rlike(rf"(?i)^https://{DOTTED_HOST}(?::[0-9]{{0,5}})?(?:[/?#].*)?$")
        & (F.length(host) <= 253)
        & ((port == "") | (F.lpad(port, 5, "0") <= "65535")),
        F.lit(False),
    )


def canon_http_url(c: Column) -> Column:
    """Comparable form of a safe URL: no fragment, parameters sorted by key, no trailing slash."""
    return _read(strip(c), lambda written, address: F.when(_safe(written, address), _http_form(address)))


def _http_form(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, "(?i)^https://([^/?#:]+)", 1))
    port = F.regexp_extract(url, "(?i)^https://[^/?#:]+(:[0-9]+)", 1)
    path = F.regexp_extract(url, "(?i)^https://[^/?#]+(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"(?i)^https://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.regexp_extract(p, "^[^=]*", 0).alias("key"),
            i.alias("position"),
            F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("pair"),
        ),
    )
    ordered = F.array_join(F.transform(F.array_sort(keyed), lambda k: k["pair"]), "&")
    return F.concat(
        F.lit("https://"),
        host,
        F.when(port == ":443", F.lit("")).otherwise(port),
        _tidy_path(path),
        once(ordered, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))),
    )


def canon_https_url(c: Column, plain: bool = False) -> Column:
    """Official-site form: https, dotted host, no port; query and fragment dropped."""
    shape = rf"(?i)^https://({PLAIN_HOST})(?::(?:443)?)?(?:[/?#].*)?$"

    def form(_: Column, url: Column) -> Column:
        host = F.lower(F.regexp_extract(url, shape, 1))
        path = F.replace(F.regexp_extract(url, "(?i)^https://[^/?#]+(/[^?#]*)", 1), F.lit(" "), F.lit("%20"))
        whole = F.concat(F.lit("https://"), host, _tidy_path(path))
        return F.when(url.rlike(shape) & F.contains(host, F.lit(".")), whole)

    return _read(strip(c), form, plain)


def canon_url_text(c: Column) -> Column:
    """Scheme and host in lower case, trailing slashes cut, everything else as written."""
    url = F.trim(c)
    scheme = _found(url, "^([^:]+)://")
    host = _found(url, "^[^:]+://([^/?#]+)")
    rest = F.coalesce(_found(url, "(?s)^[^:]+://[^/?#]+(.*)$"), F.lit(""))
    return F.concat(
        F.lower(scheme), F.lit("://"), F.lower(host), F.regexp_replace(rest, r"/+\z", "")
    )


def domain_text(c: Column) -> Column:
    """Host of an http(s) URL without ``www.``; null for anything else."""
    return F.regexp_replace(_found(F.lower(c), "^https?://([^/:?#]+)"), r"^www\.", "")


def norm_domain(c: Column, form: str = "identity", plain: bool = False) -> Column:
    """Bare comparable domain.

    ``identity`` accepts http or https and refuses an explicit port; ``discovery``
    accepts safe https URLs only and ignores the port. Both accept a bare host.
    """
    if form == "discovery":

        def bare_host(written: Column, address: Column) -> Column:
            host = _without_www(F.regexp_extract(address, "(?i)^https://([^/?#:]+)", 1))
            return F.when((written != "") & _safe(written, address), host)

        return _read(with_https(c), bare_host, plain)
    if form != "identity":
        raise ValueError(f"unknown domain form {form!r}")
    shape = rf"(?i)^(?:http://({PLAIN_HOST})(?::(?:80)?)?|https://({PLAIN_HOST})(?::(?:443)?)?)(?:[/?#].*)?$"

    def host_of(_: Column, address: Column) -> Column:
        host = F.concat(F.regexp_extract(address, shape, 1), F.regexp_extract(address, shape, 2))
        return once(_without_www(host), lambda bare: F.when(address.rlike(shape) & (bare != ""), bare))

    raw = once(strip(c), lambda r: F.when(r.rlike("(?i)^https?://"), r).otherwise(F.concat(F.lit("https://"), r)))
    return _read(raw, host_of, plain)


def host_without_www(c: Column) -> Column:
    return _without_www(_found(c, "(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)"))


def _octet(host: Column, position: int) -> Column:
    return F.try_element_at(F.split(host, r"\."), F.lit(position)).try_cast("int")


def public_url(c: Column) -> Column:
    """https URL of a host on the public network."""
    host = F.lower(F.regexp_extract(c, r"(?i)^https://(\[[^\]]*\]|[^/?#:@\s]+)(?::[0-9]*)?(?:[/?#]|$)", 1))
    numeric = host.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    first, second = _octet(host, 1), _octet(host, 2)
    private = numeric & (
        first.isin(0, 10, 127)
        | ((first == 169) & (second == 254))
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
    )
    inner = host.rlike(r"^\[(?:::1|fc.*|fd.*)\]$")
    return F.coalesce(
        (host != "") & (host != "localhost") & ~host.endswith(".local") & ~private & ~inner,
        F.lit(False),
    )


def outbound_slug_ok(c: Column) -> Column:
    return F.coalesce((F.length(c) <= 200) & c.rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False))


# The shapes of a verification source and of a redirect destination.
EVIDENCE_SHAPE = (
    r"(?i)^https://[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+"
    r"(:[0-9]{1,5})?([/?#][^\s]*)?$"
)
OUTBOUND_SHAPE = (
    r"(?i)^https://([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}([/?#][^\s\\]*)?$"
)


def evidence_url_ok(c: Column) -> Column:
    """https URL with a dotted host, at most 2048 characters."""
    return F.coalesce((F.length(c) <= 2048) & c.rlike(EVIDENCE_SHAPE), F.lit(False))


def outbound_url_ok(c: Column) -> Column:
    """Destination a visitor may be sent to: no port, no credentials, no control characters."""
    return F.coalesce(
        (F.length(c) <= 2048) & c.rlike(OUTBOUND_SHAPE) & ~c.rlike(r"[\x00-\x1f\x7f]"),
        F.lit(False),
    )


def official_source(source_domain: Column, official_domain: Column) -> Column:
    """Same domain, or one is a subdomain of the other."""
    return F.coalesce(
        (source_domain == official_domain)
        | source_domain.endswith(F.concat(F.lit("."), official_domain))
        | official_domain.endswith(F.concat(F.lit("."), source_domain)),
        F.lit(False),
    )


# Fixed value: punctuation a path keeps as written; anything else is percent-encoded.
PATH_KEPT = "/%!$&'()*+,-.:;=@[]_|~"


@F.pandas_udf(T.StringType())
def _joined(reference: pd.Series, base: pd.Series) -> pd.Series:
    def one(ref: str | None, page: str | None) -> str | None:
        if not ref or not page or ref.startswith(("data:", "blob:")):
            return None
        try:
            absolute = urlsplit(urljoin(page, ref.strip()))
            return absolute._replace(
                netloc=absolute.netloc.lower().removesuffix(":443"),
                path=quote(absolute.path or "/", safe=PATH_KEPT),
                query=quote(absolute.query, safe=PATH_KEPT + "?"),
                fragment="",
            ).geturl()
        except ValueError:
            return None

    return pd.Series([one(r, b) for r, b in zip(reference, base)], dtype="object")


# Declared so that the optimiser keeps the call where it stands and runs it once per row.
_absolute = _joined.asNondeterministic()


def resolve_asset_url(df: DataFrame, into: str, reference: Column, page_url: Column) -> DataFrame:
    """Adds the absolute public URL of an asset named on a page, without fragment, or null."""
    located = df.withColumn("_absolute", _absolute(reference, page_url))
    public = F.when(public_url(F.col("_absolute")), F.col("_absolute"))
    return located.withColumn(into, public).drop("_absolute")
