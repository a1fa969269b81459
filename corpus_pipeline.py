"""Five stages from raw documents to a training mix, each written as Parquet and read back by the next.

Columns that stages work on: doc_id, text, lang, source. All stages but the last return the columns of their input
(``n_chars`` follows the text); other columns are carried along. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontamination, language, mixing, shingles, substrings
from shelfmark.llm.common import written
from shelfmark.session import table

#: Bytes from which ``remove_repeats`` takes a repeated string. Of the 51-word stretches of the supplied texts 99 % have more.
REPEATED = 240


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near some language; null texts and texts without a letter go.

    The languages are learned from the rows that name theirs.
    """
    model = language.fit(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kept = language.predict(rows, model, "row.text").filter(~F.col("rejected"))
    return kept.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Near copies share at least 0.8 of their five-word shingles, checked pair by pair; a group is what such pairs connect.
    Each row goes by its own text; rows without an id come after all others, and equal rows stay once.
    """
    return shingles.first_of_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of ``REPEATED`` bytes that come up more than once, so that passages of over 50 words go too.

    Null texts become empty.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row"), "doc_id", "text")
    left = substrings.without_repeats(rows, keep=("row",), length=REPEATED, with_text=True)
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return left.select(*[made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    marked = decontamination.with_matches(rows, table(spark, sf_dir, "benchmark"), "row.text")
    return marked.filter(F.size("matches") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say, numbered by ``copy``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    copies = mixing.repeated(mixing.mix(rows, keep=("row",)), ["row"])
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL states neither centroids nor suffix arrays. Tests hold the near-copy stage against brute force and run the others
#: on odd rows and planted cases; the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
