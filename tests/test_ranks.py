"""Previous values, positions and pages from ranges, with most rows in one key and one instant."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ranks

SCHEMA = "k string, at int, i int, v string"


def rows(n, seed):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot"] * 7 + ["b", None, "c"]), rng.choice([5] * 8 + [None, 1, 2, 9]), i, rng.choice(["x", "y", None])) for i in rng.sample(range(n), n)
    ]


def ordered(given):
    """Rows of each key in order, nulls first."""
    out = {}
    for r in sorted(given, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables keep all their ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def given(spark):
    listed = rows(3000, 4)
    return listed, spark.createDataFrame(listed, SCHEMA).repartition(6)


def test_previous_and_positions(given):
    listed, df = given
    wanted_previous, wanted_place = {}, {}
    for held in ordered(listed).values():
        before = None
        for n, r in enumerate(held, 1):
            wanted_previous[r[2]], wanted_place[r[2]] = before, n
            before = r[3]
    assert {r.i: r.seen for r in ranks.previous(df, ["k"], ["at", "i"], "v", "seen").collect()} == wanted_previous
    assert {r.i: r.place for r in ranks.positions(df, ["k"], ["at", "i"], "place").collect()} == wanted_place
    empty = df.limit(0)
    assert ranks.previous(empty, ["k"], ["at", "i"], "v", "seen").count() == ranks.positions(empty, ["k"], ["i"]).count() == 0


def test_a_key_at_one_instant_is_spread(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.lit(1).alias("at"), F.col("id").cast("int").alias("i"))
    held = ranks.in_ranges(df.repartition(8), ["k", "at", "i"])
    sizes = [r["count"] for r in held.groupBy("_range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 100_000
    far = ranks.positions(df, ["k"], ["at", "i"])
    assert far.filter("position <> i + 1").count() == 0


def read(page):
    """The ranges that the plan reads."""
    plan = page._jdf.queryExecution().executedPlan().toString()
    found = re.search(r"PartitionFilters: \[[^\]]*?_range#\d+ (?:= |IN \()([\d,]+)", plan)
    return found[1].split(",")


def test_pages_of_any_depth_read_few_ranges(given):
    listed, df = given
    index = ranks.SortedIndex(df, ["at", "i"], ["k"])
    for key, held in ordered(listed).items():
        for number in (1, 2, 7, 40, 10_000):
            last = max(1, -(-len(held) // 12))
            first = (min(number, last) - 1) * 12
            page = index.page(number, 12, key)
            assert [tuple(r) for r in page.collect()] == held[first : first + 12]
            assert len(read(page)) <= 2
    assert index.page(1, 12, "nobody").count() == 0
    whole = ranks.SortedIndex(df, ["i"])
    assert [r.i for r in whole.page(30, 100).collect()] == list(range(2900, 3000))
    with pytest.raises(ValueError):
        index.page(0, 12, "hot")
    with pytest.raises(ValueError):
        index.page(1, 12)
