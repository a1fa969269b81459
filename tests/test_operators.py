import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import checks, listing, versions
from shelfmark.session import cut_lineage


@pytest.fixture(scope="module")
def software(spark):
    rows = [(i, f"Item {i:02}", "published" if i % 4 else "draft", f"item-{i}") for i in range(40)]
    return spark.createDataFrame(
        rows, "software_id int, software_name string, publication_status string, slug string"
    )


def ids(df):
    return [r["software_id"] for r in df.collect()]


def test_a_page_past_the_end_is_the_last_one(software):
    public = listing.published_only(software)
    order = ["software_name", "software_id"]
    assert ids(listing.page_by_name(public, 3, 12, order)) == ids(
        listing.page_by_name(public, 99, 12, order)
    )
    assert ids(listing.page_by_name(public, 1, 4, order)) == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        listing.page_by_name(public, 0, 4, order)


def test_an_empty_list_selects_nothing(software):
    assert ids(listing.id_in_list(software, software.filter("false"), "software_id")) == []


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("100%",), ("100x",), ("a_b",), ("A\\B",), (None,)], "n string")
    assert [r["n"] for r in listing.search_any(df, "0%", ["n"]).collect()] == ["100%"]
    assert [r["n"] for r in listing.search_any(df, "a\\b", ["n"]).collect()] == ["A\\B"]
    assert listing.search_any(df, "", ["n"]).count() == 5


def test_search_names_the_reason_for_nothing(spark, software):
    categories = spark.createDataFrame(
        [(1, "One", "one", "published"), (2, "Two", "two", "draft")],
        "category_id int, category_name string, slug string, publication_status string",
    )
    relations = software.select("software_id", F.lit(1).alias("category_id"))

    def outcome(query, slug):
        rows = listing.search_in_category(
            software, relations, categories, query, slug, ["software_name"]
        ).collect()
        return sorted({r["outcome"] for r in rows}), len(rows)

    assert outcome("item 1", "one") == (["items"], 8)
    assert outcome("nothing", "one") == (["no_matches"], 1)
    assert outcome("item", "two") == (["category_unavailable"], 1)


def test_guards(software):
    checks.count_guard(40, software)
    with pytest.raises(checks.GuardFailed, match="expected 41, found 40"):
        checks.count_guard(40, software, grown_by=1)
    report = checks.check_report(
        software, {"draft": F.col("publication_status") == "draft", "none": F.lit(False)}
    )
    with pytest.raises(checks.GuardFailed, match="draft: 10 issues"):
        checks.constraint_gate(report)
    checks.constraint_gate(report.filter("check_name = 'none'"))


def test_orphans_leave_out_nulls(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert checks.orphan_count(child, "k", parent, "id", "x").collect()[0]["issue_count"] == 2


def test_insert_ignore_keeps_rows_without_a_key(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5), (None, 6)], "k string, v int")
    rows = versions.insert_ignore(old, new, ["k"], ["v"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("a", 1), ("b", 3), (None, 5), (None, 6)]
    again = versions.insert_ignore(
        versions.insert_ignore(old, new.filter("k is not null"), ["k"], ["v"]),
        new.filter("k is not null"), ["k"], ["v"],
    )
    assert again.count() == 2


def test_update_touches_only_changed_rows(spark):
    before, now = dt.datetime(2025, 1, 1), dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [(1, "a", before), (2, "b", before), (3, "c", before)], "k int, v string, t timestamp_ntz"
    )
    source = spark.createDataFrame([(1, "x"), (2, "b")], "k int, v string")
    rows = versions.update_from(
        df, source, ["k"], F.lit(True), {"v": F.col("new_v")}, ("t", F.lit(now).cast("timestamp_ntz"))
    ).collect()
    assert sorted((r["k"], r["v"], r["t"]) for r in rows) == [
        (1, "x", now), (2, "b", before), (3, "c", before),
    ]


def test_snapshot_differences(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    kept = versions.snapshot_table(df, path=str(tmp_path / "before"))
    assert versions.snapshot_diff_all(kept, df.repartition(3)).count() == 0
    changed = df.filter("k = 1").limit(1).union(spark.createDataFrame([(3, "c")], "k int, v string"))
    assert sorted(map(tuple, versions.snapshot_diff(kept, changed).collect())) == [
        (2, "b", "removed"), (3, "c", "added"),
    ]
    assert sorted(map(tuple, versions.snapshot_diff_all(kept, changed).collect())) == [
        (1, "a", "removed", 1), (2, "b", "removed", 1), (3, "c", "added", 1),
    ]


def test_lineage_is_cut_in_the_configured_folder(spark, software):
    kept = cut_lineage(software)
    assert "ExistingRDD" in kept._jdf.queryExecution().toString()
    assert spark.conf.get("spark.checkpoint.dir")
    assert sorted(ids(kept)) == list(range(40))


def test_filters_and_columns_reach_the_scan(spark):
    from shelfmark.registry import QUERIES, load_all

    load_all()
    plan = QUERIES["published_only"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan") :]
    assert "EqualTo(o_orderstatus,F)" in scan
    assert "o_orderpriority" not in scan


def test_pairs_of_products_and_categories_are_not_put_together_by_their_bytes(spark):
    products = spark.range(400).select(F.col("id").alias("software_id"), F.lit("a").alias("software_name"), F.lit("v").alias("vendor_name"))
    pairs = spark.range(4000).select((F.col("id") % 400).alias("software_id"), F.col("id").alias("category_id"), F.lit("c").alias("category_name"))
    detail = products.hint("merge").join(pairs, "software_id")
    folded = listing.review_fold(detail)
    # an exchange whose number is given is not merged by bytes
    assert "REPARTITION_BY_NUM" in folded._jdf.queryExecution().executedPlan().toString()
    assert folded.filter(F.size("categories") == 10).count() == 400
    assert listing.review_entries(detail).filter("position = 10").count() == 400
