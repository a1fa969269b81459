"""Which texts contain which quotes, without comparing every text with every quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as norm
from shelfmark.session import cut_lineage

LONGEST_GRAM = 5


def _runs(tokens: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` tokens, each once. ``tokens`` should be a stored column."""
    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    hashes = F.transform(
        starts, lambda i: F.xxhash64(F.lit(n), *[F.get(tokens, i + k) for k in range(n)])
    )
    return F.when(F.size(tokens) >= n, F.array_distinct(hashes)).otherwise(
        F.array().cast("array<bigint>")
    )


# Key kinds: runs of one to five words, or of three characters (kind 0).
CHARACTER_RUN = 3


def _tokens(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("_words", F.split(value, " ")).withColumn("_chars", F.split(value, ""))


def _of_kind(kind: int) -> Column:
    return _runs(F.col("_chars"), CHARACTER_RUN) if kind == 0 else _runs(F.col("_words"), kind)


def containment_join(
    quotes: DataFrame,
    texts: DataFrame,
    quote_id: str,
    quote: str,
    text_id: str,
    text: str,
    unicode: bool = True,
) -> DataFrame:
    """Per quote: how many texts contain it after normalisation, and the first of them.

    Quotes under three characters support nothing; quotes found nowhere are left out. Each
    quote is looked up by the one of its word runs that occurs in the fewest texts (by a
    run of three characters if it has no inner word), so a run shared by a third of all
    texts is used only by quotes that have no rarer one, and every candidate is verified.
    Equal quotes and equal texts are compared once and counted, never paired with each
    other.
    """
    normal = norm.norm_evidence if unicode else norm.norm_space
    named = quotes.select(
        F.col(quote_id).alias("_id"), normal(F.col(quote)).alias("_quote")
    ).filter(F.length("_quote") >= CHARACTER_RUN)
    asked = _tokens(named.select("_quote").distinct(), "_quote")
    # The first and last word of a quote may be parts of longer words in a text.
    inner = F.when(F.size("_words") > 2, F.slice("_words", F.lit(2), F.size("_words") - 2)).otherwise(
        F.array().cast("array<string>")
    )
    asked = asked.withColumn("_words", inner).withColumn(
        "_kind", F.least(F.lit(LONGEST_GRAM), F.size("_words"))
    )
    # Which kinds of key occur is at most six small numbers.
    kinds = sorted(r["_kind"] for r in asked.select("_kind").distinct().collect())
    keys = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for kind in kinds:
        keys = keys.when(F.col("_kind") == kind, _of_kind(kind))
    wanted = asked.select("_quote", F.explode(keys).alias("_gram"))

    body = texts.select(F.col(text_id).alias("_t"), normal(F.col(text)).alias("_text"))
    emitted = F.flatten(F.array(F.array().cast("array<bigint>"), *[_of_kind(k) for k in kinds]))
    # Texts are split into runs once; what is kept are the few runs some quote asks for,
    # one row for all texts that are equal.
    runs = cut_lineage(
        _tokens(body, "_text")
        .select("_t", F.sha2("_text", 256).alias("_hash"), F.explode(emitted).alias("_gram"))
        .join(wanted.select("_gram").distinct(), "_gram", "left_semi")
        .groupBy("_gram", "_hash")
        .agg(F.min("_t").alias("_t"), F.count(F.lit(1)).alias("_copies"))
    )
    spread = runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = (
        wanted.join(spread, "_gram")
        .groupBy("_quote")
        .agg(F.min(F.struct("_texts", "_gram"))["_gram"].alias("_gram"))
    )
    found = (
        rarest.join(runs, "_gram")
        .select("_quote", "_t", "_copies")
        .join(body, "_t")
        .filter(F.contains("_text", "_quote"))
        .groupBy("_quote")
        .agg(F.sum("_copies").alias("texts"), F.min("_t").alias("first_text"))
    )
    return named.join(found, "_quote").select(F.col("_id").alias(quote_id), "texts", "first_text")
