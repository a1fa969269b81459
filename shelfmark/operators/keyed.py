"""Per-key building blocks that stay safe when one key holds a third of the rows.

Spark sends all rows of a window or list aggregate with one key to one task. The
operators here avoid that: they reduce map-side to a fixed-size state per key
(``first_per_key``, ``sole_match``), cut each task to its own best rows before the
exchange (``top_per_key``), or split a long key into time buckets (``previous_in_order``).
``asof.best_at`` answers "which interval wins at this instant".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.operators.asof import best_at as best_at

SALTS = 32


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key. ``order`` must be free of ties.

    One struct per key travels through the exchange, however long the key is.
    """
    rest = [c for c in df.columns if c not in keys]
    chosen = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "position"
) -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1. ``order`` must be free of ties.

    Two rounds: the best ``n`` per (key, group of input tasks), then the best ``n`` of
    those. Spark cuts each input task to ``n`` rows per key before the first exchange, so
    the last round sees at most ``n * SALTS`` rows of a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_n", F.row_number().over(part))
        .filter(F.col("_n") <= n)
        .drop("_n", "_salt")
        .withColumn(rank, F.row_number().over(whole).cast("long"))
        .filter(F.col(rank) <= n)
    )


def sole_match(df: DataFrame, keys: Sequence[str], identifier: str, *carried: str) -> DataFrame:
    """Per key: whether it names one distinct ``identifier``, and the smallest one.

    Two identifiers differ exactly if the least and the greatest differ, so no list and no
    distinct count is needed, and a lookup on the result never multiplies rows.
    """
    return df.groupBy(*keys).agg(
        F.min(identifier).alias(f"min_{identifier}"),
        F.max(identifier).alias(f"max_{identifier}"),
        *[F.min_by(c, identifier).alias(c) for c in carried],
    )


def spread_nulls(key: Column, row: Column) -> Column:
    """``key``, or a value no lookup holds that differs per row.

    Rows without a key would otherwise meet in one task of an outer join.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), row.cast("string")))


def left_lookup(df: DataFrame, lookup: DataFrame, key: Column, row: str) -> DataFrame:
    """Left join with a lookup whose column ``_key`` is unique; keys may be null."""
    keyed = df.withColumn("_key", spread_nulls(key, F.col(row)))
    return keyed.join(lookup, "_key", "left").drop("_key")


def _same(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in columns]


def fold_sorted(df: DataFrame, keys: Sequence[str], entry: Column, into: str) -> DataFrame:
    """One row per key with its entries as a sorted array; null entries are left out.

    An array is one value of one row, so this is for keys whose entries fit in one: the caller
    folds what a person reads, such as the categories of a product. Use ``top_per_key`` for the
    first entries of keys without a limit.
    """
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(into))


def previous_in_order(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, into: str
) -> DataFrame:
    """``lag(value)`` per key, bucket by bucket, so that a long key is not sorted in one task.

    ``bucket`` must not decrease along ``order`` (a minute, say). Rows look back inside their
    bucket; the first row of a bucket takes the last value of the nearest earlier bucket of
    its key, found in a table with one row per (key, bucket). Rows of one bucket meet in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    within = W.partitionBy(*keys, "_bucket").orderBy(*order)
    along = W.partitionBy(*keys).orderBy("_bucket")
    last = (
        keyed.groupBy(*keys, "_bucket")
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(along))
        .drop("_last")
    )
    looked = keyed.withColumn("_seen", F.lag(F.struct(value)).over(within))
    joined = looked.alias("l").join(last.alias("r"), _same([*keys, "_bucket"]), "left")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns],
        F.coalesce("_seen", "_carry")[value].alias(into),
    )

