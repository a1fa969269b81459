"""Whole results of the training-data operators where a shortcut would lose some."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import decontamination
from shelfmark.llm import shingles as near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(spark, listed):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in listed], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def first_of_groups(listed):
    """By brute force: (id, text) of the rows that stay, of distinct (id, text)."""
    listed = sorted(set(listed), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(t) for _, t in listed]
    root = list(range(len(listed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, t) for n, (i, t) in enumerate(listed) if find(n) == n), key=str)


def test_near_copies_read_texts_once_for_their_postings(spark, monkeypatch):
    """Both sides of the join of posting lists made them from the texts, at the same time."""
    kept, plans = near_copies.written, {}

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().toString()
        return kept(df, label)

    monkeypatch.setattr(near_copies, "written", watched)
    given = [(n, " ".join(f"w{n // 2}x{i}" for i in range(40)) + " end" * (n % 2)) for n in range(12)]
    edges = near_copies.links(rows(spark, given))
    assert edges.distinct().count() == 6
    assert "MapInArrow" in plans["shingle-postings"] and "MapInArrow" not in plans["shingle-lists"]


def test_pipeline_drops_edited_copies_and_rows_without_an_id(spark):
    random.seed(6)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    passage = random.sample(words, 60)
    given = []
    for n in range(25):
        base = [random.choice(words) for _ in range(random.choice([3, 6, 30, 120, 300]))]
        given.append(base)
        for _ in range(4):  # each an edit away from the one before, so that a group is a chain
            base = list(base)
            for _ in range(max(1, len(base) // random.choice([40, 60, 200]))):
                base[random.randrange(len(base))] = random.choice(words)
            given.append(base)
        given.append(passage + [random.choice(words) for _ in range(30)])  # 2 of 3 words shared, still no near copies
    random.shuffle(given)
    listed = [(None if n % 9 == 0 else n, " ".join(w)) for n, w in enumerate(given)]
    listed += [(1, listed[1][1]), (500, listed[1][1].upper()), (None, "alone without an id"), (None, "alone without an id"), (501, None), (502, "")]
    expected = first_of_groups(listed)
    found = corpus_pipeline.drop_near_duplicates(spark, rows(spark, listed), "")
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == expected
    assert len(expected) < len(listed) - 25


def test_pipeline_drops_a_large_group_of_near_copies(spark):
    random.seed(7)
    base = [f"w{i}" for i in range(200)]
    listed = []
    for n in range(300):
        w = list(base)
        w[random.randrange(200)] = f"x{n}"
        listed.append((n, " ".join(w)))
    found = corpus_pipeline.drop_near_duplicates(spark, rows(spark, [*listed, (900, "something else altogether in here")]), "")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == [0, 900]


def test_pipeline_pairs_near_copies_by_fingerprint(spark):
    random.seed(8)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = [random.choices(words, k=2500) for _ in range(6)]
    edited = [[*b[:40], "edited", *b[41:]] for b in base]  # a few of 2,500 shingles; up to two bits for most
    docs = rows(spark, list(enumerate([" ".join(w) for w in base + edited] + ["", None, "  "])))
    kinds = {r.doc_id: r["_class"] for r in near_copies.classified(docs.select("doc_id", "text")).collect()}
    pairs = {(r.a, r.b) for r in near_copies.fingerprint_pairs(docs).collect()}
    copies = {tuple(sorted((kinds[i], kinds[i + 6]), reverse=True)) for i in range(6)}
    assert pairs and pairs <= copies and len(pairs) >= 4


def hits(spark, texts, items):
    """The items found in each text."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.with_matches(rows(spark, list(enumerate(texts))), benchmark).collect()
    return {r.doc_id: [m.item_id for m in r.matches] for r in found}


def test_decontamination_where_a_contaminated_text_is_common(spark):
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(800)]
    item = " ".join(random.sample(words, 23))
    dirty = " ".join([*random.sample(words, 40), item, *random.sample(words, 40)])
    clean = [" ".join(random.sample(words, 90)) for _ in range(40)]
    assert hits(spark, [dirty], [item]) == {0: [0]}
    assert hits(spark, [dirty] * 20 + clean, [item]) == {n: [0] if n < 20 else [] for n in range(60)}


def test_decontamination_finds_short_items_in_long_texts(spark):
    random.seed(10)
    plain = "what is the of a in to and it for on as with was by at from or an be".split()
    rare = ["".join(random.choice("abcdefgh") for _ in range(7)) for _ in range(4000)]
    items = [" ".join(random.sample(plain, n)) + "?" for n in range(3, 11)] + ["one two", "solitary"]
    clean = [" ".join(w for r in random.sample(rare, 120) for w in (r, random.choice(plain))) for _ in range(40)]
    dirty = [" ".join([*random.sample(rare, 77), item, *random.sample(rare, 90)]) for item in items]
    expected = {n: [] for n in range(40)} | {40 + n: [n] for n in range(len(items))}
    edited = items[7].rstrip("?").split()
    edited[4:5] = ["other"]
    dirty.append(" ".join([*random.sample(rare, 50), *edited, *random.sample(rare, 50)]))
    expected[40 + len(items)] = [7]
    assert hits(spark, clean + dirty, items) == expected


def test_word_pairs_find_every_edited_item():
    random.seed(11)
    words = [np.uint64(random.getrandbits(64)) for _ in range(60)]  # few, so that pairs repeat
    for _ in range(400):
        m = random.randint(1, 60)
        item = [random.choice(words) for _ in range(m)]
        text = list(item)
        for _ in range(m // decontamination.ONE_IN):
            at = random.randrange(len(text))
            text[at : at + random.randint(0, 1)] = [random.choice(words)] * random.randint(0, 1)
        lead = [random.choice(words) for _ in range(random.randint(0, 30))]
        whole = np.array(lead + text + [random.choice(words) for _ in range(random.randint(0, 30))], np.uint64)
        row = np.zeros(len(whole), np.int64)
        index = decontamination.Index([(1, np.array(item, np.uint64), np.array([], np.uint64))])
        found = [index.align(i, whole[max(0, a) : b].tolist())[0] for _, _, i, a, b in decontamination.Seeds([index]).near(row, whole)]
        assert max(found, default=0) >= decontamination.ALIGNED


def test_pipeline_removes_passages_of_little_over_fifty_words(spark):
    draw = random.Random(5)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))
    passage = prose(53)
    assert 240 <= len(passage) < 400
    listed = [(i, f"{prose(120)} {passage} {prose(80)}") for i in range(2)] + [(9, prose(200))]
    frame = rows(spark, listed).withColumn("n_chars", F.length("text").cast("bigint"))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeats(spark, frame, "").collect()}
    assert left[9] == listed[2][1]
    assert all(passage[20:-20] not in left[i] and len(left[i]) < len(listed[i][1]) - 239 for i in range(2))
