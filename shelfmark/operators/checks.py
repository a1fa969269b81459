"""Data-quality checks: duplicates, orphans, profiles, row rules, guards and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rules, text
from shelfmark.operators.keyed import fold_sorted
from shelfmark.operators.ranks import positions
from shelfmark.session import cut_lineage


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return counted.filter(F.col("duplicate_count") > 1)


def members_of_repeated(marked: DataFrame, key: str, identifier: str) -> DataFrame:
    """Rows whose key repeats, with the number of copies and the first of them.

    Members stay rows: a group holding a third of the table is never collected. ``marked``
    is computed once and kept, as a key is usually a digest of something large.
    """
    kept = cut_lineage(marked)
    groups = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(identifier).alias("first_copy")
    )
    return kept.join(groups.filter("copies > 1"), key)


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    named = df.filter(~text.is_blank(F.col(name)))
    normal = named.select(F.lower(F.trim(name)).alias("normalized_name"))
    return duplicate_keys(normal, ["normalized_name"])


def orphan_count(
    child: DataFrame, foreign_key: str, parent: DataFrame, key: str, relationship: str
) -> DataFrame:
    """Child rows whose parent is missing; null keys do not count.

    Children are counted per key before the join, so a key repeated by a third of the rows
    travels as one row per task.
    """
    held = (
        child.filter(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    missing = held.join(parent.select(F.col(key).alias("_key")), "_key", "left_anti")
    return missing.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("issue_count")).select(
        F.lit(relationship).alias("check_name"), "issue_count"
    )


def tree_orphans(tree: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Nodes that name a missing parent or themselves."""
    parents = tree.select(F.col(key).alias("_parent")).distinct()
    lost = (
        tree.filter(F.col(parent_key).isNotNull())
        .join(parents, F.col(parent_key) == F.col("_parent"), "left_anti")
        .select(key, parent_key, F.lit("orphan_parent").alias("problem"))
    )
    own = tree.filter(F.col(parent_key) == F.col(key)).select(
        key, parent_key, F.lit("self_parent").alias("problem")
    )
    return lost.unionByName(own)


def value_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, count) of several fields in one pass."""
    texts = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    return (
        texts.unpivot([], list(fields), "field", "observed_value")
        .groupBy("field", "observed_value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def json_type_profile(df: DataFrame, json: str, expected: str) -> DataFrame:
    """(type, value, count, verdict) of a JSON field against the expected type."""
    kind = F.when(F.col(json).isNull(), F.lit(None).cast("string")).otherwise(
        F.lower(F.schema_of_variant(F.try_parse_json(F.col(json))))
    )
    return (
        df.select(kind.alias("json_type"), F.col(json).alias("observed_value"))
        .groupBy("json_type", "observed_value")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn(
            "verdict",
            F.when(F.col("json_type").isNull(), "absent_or_null")
            .when(F.col("json_type") == expected, "compatible")
            .otherwise("STOP_unexpected_type"),
        )
    )


def check_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, issue_count): the rows that meet each condition, in one pass."""
    row = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return row.unpivot([], list(checks), "check_name", "issue_count")


def group_check(df: DataFrame, name: str) -> DataFrame:
    """One report row: how many groups ``df`` holds."""
    return df.agg(F.count(F.lit(1)).alias("issue_count")).select(
        F.lit(name).alias("check_name"), "issue_count"
    )


def one_primary(relations: DataFrame) -> DataFrame:
    """Products without exactly one primary category, or with a repeated category."""
    grouped = relations.groupBy("software_id").agg(
        F.count_if("primary_category").alias("primaries"),
        F.count(F.lit(1)).alias("relations"),
        F.countDistinct("category_id").alias("categories"),
    )
    return grouped.filter("primaries <> 1 or relations <> categories")


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys used with more than one value; the least and greatest of them show the conflict."""
    held = df.groupBy(key).agg(
        F.min(value).alias("first_value"), F.max(value).alias("last_value")
    )
    return held.filter(F.col("first_value") != F.col("last_value"))


def ordered_array(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Distinct values of each key in ascending order, joined by commas."""
    distinct = df.select(*keys, F.col(value).cast("string").alias(value)).distinct()
    folded = fold_sorted(distinct, keys, F.col(value), into)
    return folded.withColumn(into, F.array_join(into, ","))


def ordered_entries(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What ``ordered_array`` joins, as rows (keys, value, position), for keys with any number of values."""
    return positions(df.filter(F.col(value).isNotNull()).select(*keys, value).distinct(), keys, [value])


def count_by_class(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Rows per class in the given order; classes without rows count zero."""
    known = df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(classes)], f"{column} string, position int"
    )
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return known.join(F.broadcast(counted.filter(F.col(column).isin(*classes))), column, "left").select(
        column, "position", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def schema_compat(
    expected: Sequence[tuple[str, str, str]], actual: Mapping[str, DataFrame]
) -> DataFrame:
    """Expected (table, column, type) against the tables' schemas.

    Both sides are schemas, so they are as small as a hand-written list.
    """
    spark = next(iter(actual.values())).sparkSession
    found = [
        (name, f.name, f.dataType.simpleString()) for name, df in actual.items() for f in df.schema
    ]
    wanted = spark.createDataFrame(
        list(expected), "table_name string, column_name string, expected_type string"
    )
    have = spark.createDataFrame(found, "table_name string, column_name string, actual_type string")
    return wanted.join(F.broadcast(have), ["table_name", "column_name"], "left").withColumn(
        "compatibility",
        F.when(F.col("actual_type").isNull(), "will_be_added")
        .when(F.col("actual_type") == F.col("expected_type"), "compatible")
        .otherwise("STOP_incompatible_existing_column"),
    )


class GuardFailed(RuntimeError):
    """A count, a gate or a load expectation does not hold."""


def count_guard(before: int, after: DataFrame, grown_by: int = 0, what: str = "rows") -> None:
    """Raise unless ``after`` holds exactly the expected number of rows."""
    found = after.count()
    if found != before + grown_by:
        raise GuardFailed(f"{what}: expected {before + grown_by}, found {found}")


def constraint_gate(report: DataFrame) -> None:
    """Raise on the first failing check of a report, in name order."""
    bad = report.filter("issue_count > 0").orderBy("check_name").limit(1).collect()
    if bad:
        raise GuardFailed(f"{bad[0]['check_name']}: {bad[0]['issue_count']} issues")


def check_rules(df: DataFrame, row_rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken ones."""
    return df.withColumn("failed_rules", rules.failed_rules(dict(row_rules))).filter(
        F.size("failed_rules") > 0
    )


def coverage_report(outcomes: DataFrame) -> DataFrame:
    """One row of counters over acquisition outcomes.

    Needs ``status``, ``source_kind``, ``reason``, ``page_http_status`` and
    ``invalid_candidates``.
    """
    won = F.col("status") == "success"
    lost = F.col("status") == "fallback"

    def kind(value: str) -> Column:
        return F.count_if(won & (F.col("source_kind") == value))

    def reason(value: str) -> Column:
        return F.count_if(lost & (F.col("reason") == value))

    total = F.count(F.lit(1))
    return outcomes.agg(
        total.alias("products_considered"),
        F.count_if(won).alias("successful"),
        F.round(F.count_if(won) * 100.0 / F.greatest(total, F.lit(1)), 1).alias("coverage_percent"),
        kind("product").alias("product_specific"),
        kind("vendor").alias("vendor_logos"),
        kind("favicon").alias("favicon_derived"),
        F.count_if(lost).alias("fallbacks"),
        reason("ambiguous_identity").alias("ambiguous"),
        reason("blocked").alias("blocked"),
        reason("http_failure").alias("http_failures"),
        F.coalesce(F.sum(F.when(lost, F.col("invalid_candidates"))), F.lit(0))
        .cast("long")
        .alias("invalid_candidates"),
        F.count_if(lost & (F.col("page_http_status") == 403)).alias("http_403"),
        F.count_if(lost & (F.col("page_http_status") == 429)).alias("http_429"),
    )
