"""Changing tables: each operator returns the next version, which the caller writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keyed import first_per_key
from shelfmark.session import scratch_path


def insert_ignore(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``existing`` plus the new rows whose key it lacks; repeated new keys keep their first."""
    return existing.unionByName(new_rows(existing, new, keys, order))


def new_rows(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The rows ``insert_ignore`` adds. Rows with a null in the key are never duplicates."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    keyed = first_per_key(new.filter(complete), keys, order)
    return keyed.join(existing.select(*keys), list(keys), "left_anti").select(
        *new.columns
    ).unionByName(new.filter(~complete))


def update_from(
    df: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    guard: Column,
    changes: dict[str, Column],
    touched: tuple[str, Column] | None = None,
) -> DataFrame:
    """Rows that find their ``source`` row and pass ``guard`` take the ``changes``.

    ``source`` must hold a key at most once. Source columns appear with the prefix ``new_``
    in ``guard`` and ``changes``; ``touched`` names a column that is set, to the given value,
    where a change alters the row.
    """
    rest = [c for c in source.columns if c not in keys]
    renamed = source.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("_hit"))
    joined = df.join(renamed, list(keys), "left")
    fires = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(guard, F.lit(False))
    altered = F.lit(False)
    for name, value in changes.items():
        altered = altered | ~F.col(name).eqNullSafe(value)
    values = {name: F.when(fires, value).otherwise(F.col(name)) for name, value in changes.items()}
    if touched is not None:
        name, value = touched
        values[name] = F.when(fires & altered, value).otherwise(F.col(name))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in df.columns])


def snapshot_table(df: DataFrame, drop: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Write a before-image without the columns that may change, and read it back."""
    target = path or scratch_path(df.sparkSession, "snapshot")
    df.drop(*drop).write.parquet(target)
    return df.sparkSession.read.schema(df.drop(*drop).schema).parquet(target)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows found on one side only; empty when nothing changed."""
    return _signed(before, after).select(
        *before.columns,
        F.when(F.col("_after") == 0, "removed").when(F.col("_before") == 0, "added").alias("change"),
    ).filter(F.col("change").isNotNull())


def snapshot_diff_all(before: DataFrame, after: DataFrame) -> DataFrame:
    """As ``snapshot_diff`` counting copies: how many more of a row one side holds."""
    surplus = F.col("_before") - F.col("_after")
    return (
        _signed(before, after)
        .filter(surplus != 0)
        .select(
            *before.columns,
            F.when(surplus > 0, "removed").otherwise("added").alias("change"),
            F.abs(surplus).alias("copies"),
        )
    )


def _signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Copies of each row on both sides: one aggregation that combines before the exchange."""
    both = before.withColumn("_side", F.lit(1)).unionByName(after.withColumn("_side", F.lit(0)))
    return both.groupBy(*before.columns).agg(
        F.count_if(F.col("_side") == 1).alias("_before"),
        F.count_if(F.col("_side") == 0).alias("_after"),
    )


def change_log(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per changed key with both images as JSON; a missing side is null."""
    rest = [c for c in before.columns if c not in key]
    left = before.select(*key, F.struct(*rest).alias("_b"))
    right = after.select(*key, F.struct(*rest).alias("_a"))
    joined = left.join(right, list(key), "full_outer").filter(
        ~F.col("_b").eqNullSafe(F.col("_a"))
    )
    return joined.select(
        *key,
        F.when(F.col("_b").isNull(), "insert")
        .when(F.col("_a").isNull(), "delete")
        .otherwise("update")
        .alias("action"),
        F.to_json("_b").alias("before_data"),
        F.to_json("_a").alias("after_data"),
    )


def not_exists_or(
    new: DataFrame, existing: DataFrame, first: Sequence[str], second: Sequence[str]
) -> DataFrame:
    """New rows matching ``existing`` on neither key: two anti-joins instead of an OR."""
    return new.join(existing.select(*first), list(first), "left_anti").join(
        existing.select(*second), list(second), "left_anti"
    )


def either_key_join(
    df: DataFrame,
    lookup: DataFrame,
    mode: Column,
    left_key: tuple[str, str],
    right_key: tuple[str, str],
) -> DataFrame:
    """Join on one key where ``mode`` holds and on the other elsewhere.

    Each key is a pair (column of ``df``, column of ``lookup``). Rows are split by mode and
    joined on equality: an OR in one join condition would compare all pairs.
    """
    chosen = F.coalesce(mode, F.lit(False))

    def one_side(rows: DataFrame, key: tuple[str, str]) -> DataFrame:
        return rows.join(lookup, rows[key[0]] == lookup[key[1]], "inner")

    return one_side(df.filter(chosen), left_key).unionByName(
        one_side(df.filter(~chosen), right_key)
    )
