"""Mixing sources to target weights: repetition rates per source, whole copies plus a seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import broadcast_up_to, written

WEIGHTS = (5, 2, 1)
TOKEN = r"[^\x20\x09-\x0D]+"
#: Sources of which the table of rates is broadcast; beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, most: int = 2
) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order, null last, take ``weights`` in turn. Together they are to give
    ``share_percent`` of all words, in proportion to weight, but none more than ``most`` times its
    own size; what is cut off goes to the others by weight, until none is above.

    A source is capped iff its weight's part of what the sources with a smaller size per weight
    leave over exceeds its cap, so one pass in that order finds all of them. Both windows run
    over one row per source, not over documents. Counts are exact integers up to the last division.
    """
    whole = "decimal(38,0)"
    per_source = sizes.groupBy("source").agg(F.sum("size").cast(whole).alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    )
    scaled = F.col("source_size") / F.col("weight")
    order = W.orderBy(scaled, F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    total = W.partitionBy()
    everything = F.sum("source_size").over(total)
    left = F.lit(share_percent) * everything - F.lit(100 * most) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    capped = left.cast("double") * F.col("weight") > F.lit(100 * most) * F.col("source_size").cast(
        "double"
    ) * F.sum("weight").over(rest)
    marked = ranked.select("source", "source_size", "weight", everything.alias("_all"), capped.alias("_capped"))
    uncapped = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(total)
    taken = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size"))).over(total), F.lit(0))
    free = F.lit(share_percent) * F.col("_all") - F.lit(100 * most) * taken
    return marked.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("_capped"), F.col("source_size").cast("double") * F.lit(float(most)))
        .otherwise((free * F.col("weight")).cast("double") / (F.lit(100) * uncapped).cast("double"))
        .alias("target"),
    )


def draw(identifier: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the identifier and the seed only; null counts as ''."""
    text = F.concat(F.coalesce(F.col(identifier).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = 150,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per document with ``size``, ``source_size``, ``target`` and ``copies``.

    A source's rate is its target over its size. Each document is taken floor(rate) times, and once
    more if its draw is below the rate's fraction, so reruns and any partitioning agree and no
    document is taken more than ``most`` times. Returned columns: the identifier, the source, those
    named by ``keep``, then the four above; other columns are left out, and a kept column of the
    same name as one of the four is replaced by it.

    Null and empty texts have size 0, and a source of such texts gets target 0 and no copies. A null
    source is a source of its own. Rows with one identifier, repeated or null, share a draw. Equal
    sizes per weight are settled by source. An empty table gives an empty table.
    """
    made = ["size", "source_size", "target", "copies"]
    kept = [c for c in dict.fromkeys([identifier, source, *keep]) if c not in made]
    sized = docs.select(
        *[F.col(c) for c in kept], F.col(source).alias("_source"), size_of(text).alias("size")
    )
    narrow = docs.select(F.col(source).alias("source"), size_of(text).alias("size"))
    targets = written(source_targets(narrow, weights, share_percent, most), "mix-targets")
    rates = targets.withColumnRenamed("source", "_of")
    joined = sized.join(
        broadcast_up_to(rates, BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("_of"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(identifier, seed) < rate - whole).cast("long")
    return joined.select(*kept, "size", "source_size", "target", (whole + extra).alias("copies"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as often as ``copies`` says, numbered by ``copy`` from 1."""
    numbers = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[c for c in columns if c != "copy"], numbers.alias("copy"))
