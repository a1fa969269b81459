import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import components, history, keyed
from shelfmark.streaming import events, streams

START = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("fold_rows", [200_000, 12, 0])
def test_ingest_agrees_with_taking_rows_one_by_one(spark, fold_rows):
    rng = random.Random(11)
    schema = "network string, external_event_id string, payload_digest string, n int"

    def some(prefix, size):
        return rng.choice([None, *[f"{prefix}{i}" for i in range(size)]])

    old = [("a", "e0", None, -1), ("b", None, "d1", -2)]
    new = [(rng.choice("ab"), some("e", 40), some("d", 40), i) for i in range(150)]
    events_seen = {(n, e) for n, e, _, _ in old if e}
    digests_seen = {(n, d) for n, _, d, _ in old if d}
    expected = []
    for n, e, d, i in new:
        if (e is None and d is None) or (n, e) in events_seen or (n, d) in digests_seen:
            continue
        expected.append(i)
        if e:
            events_seen.add((n, e))
        if d:
            digests_seen.add((n, d))
    got = events.ingest_conversions(
        spark.createDataFrame(new, schema).repartition(6), spark.createDataFrame(old, schema), "n", fold_rows
    )
    assert sorted(r["n"] for r in got.collect()) == expected


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    """Rows share an event id with the next and a digest with the one before, so every second one is accepted."""
    rounds, pointers = [], []
    forced, stored = events._forced, events.stored
    monkeypatch.setattr(events, "_forced", lambda *a: rounds.append(1) or forced(*a))
    monkeypatch.setattr(events, "stored", lambda df, label: pointers.append(label) or stored(df, label))
    n = 100_000
    rows = spark.range(n).select(
        F.lit("a").alias("network"), F.concat(F.lit("e"), F.expr("id div 2")).alias("external_event_id"),
        F.concat(F.lit("d"), F.expr("(id + 1) div 2")).alias("payload_digest"), F.col("id").alias("n"),
    )
    got = events.ingest_conversions(rows.repartition(7), rows.limit(0), "n", fold_rows=1000)
    assert got.agg(F.count("n"), F.sum(F.col("n") % 2), F.max("n")).first() == (n // 2, 0, n - 2)
    assert len(rounds) <= 2 and pointers.count("pointers") <= 20
    at_once = events.ingest_conversions(rows.repartition(7), rows.limit(0), "n")
    assert at_once.count() == n // 2 and len(rounds) <= 2


def test_small_groups_are_settled_in_one_stream(spark, monkeypatch):
    """A call per group cost milliseconds, and groups grow in number with the input. Groups span batches here."""
    settled, plans = events._taken_in_order, []

    def watched(rows, order):
        out = settled(rows, order)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(events, "_taken_in_order", watched)
    rng = random.Random(5)
    new = [("a", f"{u}e{rng.randrange(4)}", f"{u}d{rng.randrange(4)}", i) for i in range(900) for u in [rng.randrange(60)]]
    expected, seen = [], set()
    for _, e, d, i in new:
        if e not in seen and d not in seen:
            expected.append(i)
            seen |= {e, d}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        rows = spark.createDataFrame(new, "network string, external_event_id string, payload_digest string, n int")
        got = events.ingest_conversions(rows.repartition(5), rows.limit(0), "n", fold_rows=40)
        assert sorted(r["n"] for r in got.collect()) == expected
    finally:
        spark.conf.set(name, before)
    assert plans and all("FlatMapGroups" not in p and "MapInArrow" in p for p in plans)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    pairs += [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(180)] + [(7, 7), (9, 8), (8, 9)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    rng.shuffle(pairs)
    got = components.connected(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == {x: find(x) for x in root}


@pytest.mark.parametrize("hot_rows", [10**6, 40, 6])
def test_best_interval_agrees_with_comparing_all(spark, hot_rows):
    rng = random.Random(3)

    def moment():
        return START + dt.timedelta(microseconds=rng.randrange(10**12))

    links = []
    for i in range(120):
        a, b = sorted([moment(), moment()])
        links.append(
            (rng.choice("xy"), f"l{i:03}", rng.randrange(5),
             None if rng.random() < 0.1 else a, None if rng.random() < 0.2 else b)
        )
    points = [(i, rng.choice("xyz"), moment()) for i in range(300)]
    points += [(1000 + i, k, f) for i, (k, _, _, f, _) in enumerate(links) if f]
    points += [(2000 + i, k, u) for i, (k, _, _, _, u) in enumerate(links) if u]
    expected = {}
    for p, key, at in points:
        fits = [
            (-rank, link) for k, link, rank, f, u in links
            if k == key and (f is None or f <= at) and (u is None or u > at)
        ]
        if fits:
            expected[p] = min(fits)[1]
    got = keyed.best_at(
        spark.createDataFrame(points, "p int, k string, at timestamp_ntz"), ["k"], "at", ["p"],
        spark.createDataFrame(
            links, "k string, link string, rank int, f timestamp_ntz, u timestamp_ntz"
        ),
        ["k"], "f", "u", [-F.col("rank"), F.col("link")], ["link"], hot_rows=hot_rows,
    ).collect()
    assert {r["p"]: r["link"] for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_best_interval_in_one_instant_and_without_keys(spark, hot_rows):
    """Most points and intervals meet in one instant of one key; nulls, empty and touching intervals."""
    day = lambda n: START + dt.timedelta(days=n)
    links = [("x", f"a{i:03}", i % 7, day(5), day(5 + i % 40)) for i in range(300)]
    links += [("x", "open", 0, None, None), ("y", "early", 1, day(0), day(5)), ("y", "late", 1, day(5), None), (None, "none", 9, None, None)]
    points = [(i, "x", day(5)) for i in range(400)] * 2 + [(500 + i, "x", day(i)) for i in range(60)]
    points += [(600, "y", day(5)), (601, "y", day(4)), (602, None, day(5)), (603, "x", None), (604, "z", day(1))]
    expected = []
    for p, key, at in points:
        fits = [(-r, n) for k, n, r, f, u in links if key and at and k == key and (f is None or f <= at) and (u is None or u > at)]
        expected.append((p, min(fits)[1] if fits else None))
    given = spark.createDataFrame(points, "p int, k string, at timestamp_ntz"), spark.createDataFrame(links, "k string, link string, rank int, f timestamp_ntz, u timestamp_ntz")
    for outer in (False, True):
        got = keyed.best_at(
            given[0], ["k"], "at", ["p"], given[1], ["k"], "f", "u", [-F.col("rank"), F.col("link")], ["link"], "day", outer, hot_rows
        )
        wanted = [e for e in expected if outer or e[1]]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    with pytest.raises(Exception, match="whole day"):
        shifted = given[1].withColumn("f", F.col("f") + F.expr("interval 1 second"))
        keyed.best_at(given[0], ["k"], "at", ["p"], shifted, ["k"], "f", "u", [F.col("link")], ["link"], "day").collect()


def test_previous_in_order_looks_across_buckets(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice(["s", "t", None]), i, START + dt.timedelta(hours=rng.randrange(400)),
         rng.choice(["a", "b", None]))
        for i in range(400)
    ]
    expected = {}
    for key in ("s", "t", None):
        before = None
        for k, i, at, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            expected[i] = before
            before = v
    df = spark.createDataFrame(rows, "k string, i int, at timestamp_ntz, v string")
    got = keyed.previous_in_order(
        df.repartition(5), ["k"], F.date_trunc("day", "at"), ["at", "i"], "v", "before"
    )
    assert {r["i"]: r["before"] for r in got.collect()} == expected


def test_top_per_key_with_one_hot_key(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k")
    )
    got = keyed.top_per_key(df.repartition(13), ["k"], [F.desc("id")], 3)
    hot = [r["id"] for r in got.filter("k = 'hot'").orderBy("position").collect()]
    assert hot == [4997, 4996, 4995]
    assert got.count() == 24


@pytest.mark.parametrize("n", [100, 30_000])
def test_fold_has_one_shape_at_every_size(spark, n):
    df = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"))
    rows = keyed.fold_sorted(df, ["k"], F.when(F.col("id") % 2 == 0, F.col("id")), "ids").collect()
    assert {r["k"]: list(r["ids"]) for r in rows} == {
        "hot": [i for i in range(n) if i % 10 < 9 and i % 2 == 0], "cold": []
    }


@pytest.mark.parametrize("files", [1, 3])
def test_a_refused_conversion_reserves_nothing_in_the_stream(spark, tmp_path, files):
    rows = [(i, "shop", e, d, START) for i, (e, d) in enumerate([("e1", "d1"), ("e2", "d1"), ("e2", "d9"), ("e1", "d1"), (None, "d9"), ("e3", None)])]
    schema = "id int, network string, external_event_id string, payload_digest string, occurred_at timestamp"
    df = spark.createDataFrame(rows, schema)
    for part in range(files):
        df.filter(F.col("id") % files == part if files == 1 else (F.col("id") / 2).cast("int") == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    folder = streams.store_conversions(streams.unique_conversions(source), "id", f"{tmp_path}/out")
    streamed = {r["id"] for r in spark.read.parquet(folder).collect()}
    batch = {r["id"] for r in events.ingest_conversions(df, df.limit(0), "id").collect()}
    assert streamed == batch == {0, 2, 5}


def test_each_identity_is_stored_where_a_batch_lets_other_rows_through_when_read_again(spark, tmp_path):
    rows = spark.range(2000).select(
        F.lit("shop").alias("network"), F.concat(F.lit("e"), F.col("id") % 50).alias("external_event_id"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(START).cast("timestamp").alias("occurred_at"),
    )
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    drawn = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()
    numbered = source.withColumn("id", drawn())  # stands for the row that happens to be first of equal ones
    folder = streams.store_conversions(streams.unique_conversions(numbered), "id", f"{tmp_path}/out")
    assert spark.read.parquet(folder).select("external_event_id").distinct().count() == 50


VIEWS = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("view_id", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("path", T.StringType()),
    ]
)


def test_streamed_views_agree_with_the_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(2)
    paths = ["/a", "/a?q=1", "/b", "/admin/x", "/c#top"]
    rows = [
        (f"s{rng.randrange(4)}", i, START + dt.timedelta(minutes=i), rng.choice(paths))
        for i in range(300)
    ]
    for n in range(3):
        part = spark.createDataFrame(rows[n * 100 : n * 100 + 100], VIEWS).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    every = spark.createDataFrame(rows, VIEWS)
    skip = F.col("path").startswith("/admin")
    batch = history.page_views(every, "session", "at", "view_id", "path", skip)
    stream = (
        spark.readStream.schema(VIEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    got = streams.run_available(streams.page_views(stream, skip, hours=24 * 30))
    key = ["session", "view_id", "path", "referrer"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted(
        map(tuple, batch.select(key).collect()), key=str
    )


def test_ordered_views_in_any_order_of_arrival(spark, tmp_path):
    """Views come shuffled over three micro-batches; a hot session; one view is late. Open minutes wait."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(3)}", i, START + dt.timedelta(seconds=7 * i), rng.choice(["/a", "/a?q", "/b", "/admin"])) for i in range(600)]
    late = ("hot", 9999, START, "/late")
    parts = [rows[:200], rows[200:400], [*rows[400:], late]]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, VIEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    skip = F.col("path").startswith("/admin")
    stream = spark.readStream.schema(VIEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.ordered_page_views(stream, skip, delay="5 minutes", hours=24))
    newest = rows and max(r[2] for r in rows if r[3] != "/admin")
    closed = newest - dt.timedelta(minutes=5)
    batch = history.page_views(spark.createDataFrame(rows, VIEWS), "session", "at", "view_id", "path", skip)
    wanted = [r for r in batch.collect() if r["at"].replace(tzinfo=None, second=0) + dt.timedelta(minutes=1) <= closed]
    key = ["session", "view_id", "path", "referrer"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted((tuple(r[k] for k in key) for r in wanted), key=str)
    assert wanted and len(wanted) < batch.count()


@pytest.mark.parametrize("held_rows", [10_000, 40, 0])
def test_a_session_of_many_days_is_settled_at_one_timer(spark, tmp_path, held_rows):
    """Days of views in two micro-batches, held as one value, in part or by days only."""
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(2)}", i, START + dt.timedelta(hours=i), rng.choice(["/a", "/b"])) for i in range(400)]
    rng.shuffle(rows)
    for part in (rows[:399], [rows[399], ("s0", 999, START + dt.timedelta(days=30), "/a")]):
        spark.createDataFrame(part, VIEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(VIEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    views = streams.ordered_page_views(stream, F.lit(False), delay="20 days", width_ms=86_400_000, hours=24 * 100, held_rows=held_rows)
    got = streams.run_available(views)
    closed = START + dt.timedelta(days=10)
    batch = history.page_views(spark.createDataFrame(rows, VIEWS), "session", "at", "view_id", "path", F.lit(False))
    wanted = [r for r in batch.collect() if r["at"].replace(tzinfo=None) < closed]
    key = ["session", "view_id", "path", "referrer"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted((tuple(r[k] for k in key) for r in wanted), key=str)


def test_expired_hashes(spark):
    rows = [("h", START), ("h", START + dt.timedelta(1)), ("h", None), (None, None)]
    df = spark.createDataFrame(rows, "ip_hash string, ip_hash_expires_at timestamp_ntz")
    got = events.expire_ip_hash(df, F.lit(START).cast("timestamp_ntz")).collect()
    assert [(r["ip_hash"], r["valid"]) for r in got] == [
        (None, True), ("h", True), ("h", False), (None, True),
    ]


def test_containment_agrees_with_comparing_all(spark):
    from shelfmark.operators.containment import containment_join

    rng = random.Random(4)
    words = ["ab", "b", "cab", "d e", "Éa", "x-y"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for i in range(150)]
    texts += [(500 + i, texts[3][1].upper()) for i in range(20)]
    quotes = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(60)]
    quotes += [(100, "b"), (101, "b  c"), (102, quotes[0][1]), (103, "nowhere at all to be found")]

    def plain(t):
        return " ".join(t.split()).lower()

    expected = {}
    for q, quote in quotes:
        hits = [t for t, body in texts if plain(quote) in plain(body)]
        if len(plain(quote)) >= 3 and hits:
            expected[q] = (len(hits), min(hits))
    got = containment_join(
        spark.createDataFrame(quotes, "q int, quote string"),
        spark.createDataFrame(texts, "t int, body string"),
        "q", "quote", "t", "body",
    )
    assert {r["q"]: (r["texts"], r["first_text"]) for r in got.collect()} == expected
