"""Pairs of the near-copy stage whose whole sets are sent: few, and no similar one is left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import shingles as near_copies

SCHEMA = "doc_id bigint, text string"


def prose(draw, n):
    return [f"w{draw.randrange(10**9)}" for _ in range(n)]


def watched_links(spark, monkeypatch, listed):
    """Edges between ids, and the rows of each table that was written."""
    kept, counts = near_copies.written, {}

    def watched(df, label):
        out = kept(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", watched)
    docs = spark.createDataFrame(listed, SCHEMA)
    names = {r["_class"]: r["doc_id"] for r in near_copies.classified(docs).collect()}
    edges = {tuple(sorted((names[r.a], names[r.b]))) for r in near_copies.links(docs).collect()}
    return edges, counts


def test_texts_that_share_a_passage_only_send_no_sets(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE_ROWS", 0)  # else so few texts show that the passage is common
    draw = random.Random(3)
    passage = prose(draw, 12)
    apart = [[*prose(draw, 60), *passage, *prose(draw, 60)] for _ in range(40)]
    base = prose(draw, 120)
    alike = [[*base[:60], "other", *base[61:]], base]
    edges, counts = watched_links(spark, monkeypatch, [(n, " ".join(w)) for n, w in enumerate(apart + alike)])
    assert edges == {(40, 41)}
    assert all(n <= 2 for n in counts["shingle-sets"])


def test_members_of_a_group_without_a_middle_are_paired_once_connected(spark, monkeypatch):
    """Each differs from most others by too much; pairs of one group are not all sent with their sets."""
    draw = random.Random(4)
    chain = [prose(draw, 200)]
    for _ in range(30):
        w = list(chain[-1])
        w[draw.randrange(200)] = f"x{draw.randrange(10**9)}"
        chain.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in chain]
    edges, _ = watched_links(spark, monkeypatch, [(n, " ".join(w)) for n, w in enumerate(chain)])
    assert all(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a, b in edges)
    group = {0}
    for _ in range(31):
        group |= {x for e in edges if set(e) & group for x in e}
    assert group == set(range(31))


def test_parities_leave_out_no_similar_pair(spark):
    state = np.random.default_rng(5)
    rows, expected = [], []
    for n in range(600):
        size = int(state.integers(1, 300))
        x = state.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
        y = np.unique(np.concatenate([x[state.random(size) < state.choice([0.5, 0.85, 0.9, 0.95, 1.0])], state.integers(0, 1 << 63, int(state.integers(0, 2 + size // 8)), np.uint64)]))
        x = np.unique(x)
        shared = len(np.intersect1d(x, y))
        row = []
        for s in (x, y):
            size_of = np.array([len(s)])
            row += [len(s), near_copies._parities(np.zeros(len(s), np.int64), s, near_copies._words_for(size_of)).to_pylist()[0]]
        rows.append((n, *row))
        expected.append(len(y) > 0 and 5 * shared >= 4 * (len(x) + len(y) - shared))
    pairs = spark.createDataFrame(rows, "id int, m int, p array<bigint>, n int, q array<bigint>")
    kept = {r.id for r in pairs.filter(near_copies.able((F.col("m"), F.col("n")), (F.col("p"), F.col("q")))).collect()}
    similar = {i for i, is_similar in enumerate(expected) if is_similar}
    assert similar and similar <= kept and len(kept) < 500


def test_rows_of_other_classes_are_left_out_early(spark):
    docs = spark.createDataFrame([(n, f"text number {n} of some") for n in range(50)], SCHEMA)
    classes = near_copies.classified(docs)
    some = classes.filter("doc_id < 5").select("_class")
    found = near_copies.classified(docs, sets=True, among=near_copies._bits_of(some)).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3, 4] and all(len(r["_set"]) == 1 for r in found)
