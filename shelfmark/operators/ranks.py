"""Order over a whole table, from ranges of it: previous values, positions and pages without one long sort.

``in_ranges`` splits rows into ranges that follow an order, whatever key holds most of them. What needs the order then
works inside ranges, and one row per range, or per key and range, carries on what comes from the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import stored


def in_ranges(df: DataFrame, order: Sequence[str], folders: bool = False) -> DataFrame:
    """``df`` as a stored table with ``_range``: a row of a later range is never before one of an earlier range in ``order``.

    Equal rows in ``order`` share a range, so the order should end in a column that tells rows apart. Bounds come from a sample, so
    the table is stored: all that reads it sees the same ranges, after a lost executor too. With ``folders`` each range is a
    folder, and a filter on it reads no other.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return stored(ranged, "ranges", ["_range"] if folders else [])


def _same(left: str, right: str, columns: Sequence[str]) -> list:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in columns]


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, null keys being one. A key with any number of rows, at one instant too, is spread over ranges."""
    held = in_ranges(df, [*keys, *order])
    last = held.groupBy(*keys, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_range"))).drop("_last")
    looked = held.withColumn("_seen", F.lag(F.struct(value)).over(W.partitionBy(*keys, "_range").orderBy(*order)))
    joined = looked.alias("l").join(carried.alias("r"), _same("l", "r", [*keys, "_range"]), "left")
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], F.coalesce("_seen", "_carry")[value].alias(into))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "position") -> DataFrame:
    """``df`` with the place of each row among those of its key in ``order``, from 1; null keys are one.

    Rows are counted inside ranges, and one count per key and range carries the numbers on.
    """
    held = in_ranges(df, [*keys, *order])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = held.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = held.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    joined = placed.alias("l").join(before.alias("r"), _same("l", "r", [*keys, "_range"]))
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("_before") + F.col("_at")).alias(into))


class SortedIndex:
    """A table in ranges of an order, with the rows that each key has in each: a page is read from the ranges it lies in."""

    def __init__(self, df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()):
        self.order, self.keys, self.columns = list(order), list(keys), df.columns
        self.table = in_ranges(df, [*keys, *order], folders=True)
        self.counts = stored(self.table.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")), "range-counts")

    def page(self, number: int, size: int, *key: object) -> DataFrame:
        """One page of the rows of ``key``, in order. A page past the end shows the last one.

        The driver reads one count per range of the key; rows are read from the one or two ranges that hold the page.
        """
        if number < 1 or size < 1:
            raise ValueError("page and size count from 1")
        if len(key) != len(self.keys):
            raise ValueError(f"one value for each of {self.keys}")
        chosen = F.lit(True)
        for name, value in zip(self.keys, key):
            chosen = chosen & F.col(name).eqNullSafe(F.lit(value))
        counts = [(r["_range"], r["_n"]) for r in self.counts.filter(chosen).orderBy("_range").collect()]
        total = sum(n for _, n in counts)
        first = (min(number, max(1, -(-total // size))) - 1) * size
        wanted, skipped, before = [], 0, 0
        for place, n in counts:
            if before + n <= first:
                skipped = before + n
            elif before < first + size:
                wanted.append(place)
            before += n
        rows = self.table.filter(chosen & F.col("_range").isin(wanted)).select(*self.columns)
        return rows.orderBy(*self.order).offset(first - skipped).limit(size)
