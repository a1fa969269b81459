"""Ranked search against brute force, on odd rows, in blocks, and the graph of shared sums."""

import collections
import math
import random
import re

import numpy as np
import pytest

from shelfmark.llm import search

SCHEMA = "doc_id bigint, text string, item_id string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")


def made(seed, docs, items):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Der", "die", "élan", "ÉLAN", "日本", "a1b2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    line = lambda n: random.choice([" ", ", ", "-"]).join(random.choices(vocabulary, weights, k=n))
    return [(i, line(random.randint(0, 60))) for i in range(docs)], [(i, line(random.randint(0, 25))) for i in range(items)]


@pytest.mark.parametrize("block", [7, 2048])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 3000)
    monkeypatch.setattr(search, "HELD", 500)
    docs, items = made(block, 400, 30)
    assert found(search.search(*tables(spark, docs, items), block=block)) == brute(docs, items)


def test_odd_rows(spark):
    long = "alpha beta gamma " * 20000
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Alpha beta"), (5, "alpha BETA"), (4, "Alpha beta"), (None, "alpha"), (6, long), (7, "zeta")]
    docs += [(100 + i, "omega word") for i in range(120)]  # more ties than places
    items = [(0, "alpha, ALPHA beta"), (0, "alpha, ALPHA beta"), (0, "zeta"), (1, None), (2, ""), (3, "nowhere"), (None, "omega"), (4, "word omega")]
    got = found(search.search(*tables(spark, docs, items)))
    assert got == brute(docs, items)
    assert [r[2] for r in sorted((r for r in got if r[0] == 4), key=lambda r: r[1])] == list(range(100, 150))


def test_empty_tables(spark):
    docs, items = made(1, 20, 5)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert found(search.search(*tables(spark, d, i))) == []


def test_shared_sums_are_the_sums(monkeypatch):
    random.seed(8)
    state = np.random.default_rng(8)
    for paired in (2, 256):
        monkeypatch.setattr(search, "PAIRED", paired)
        base = [random.sample(range(60), 12) for _ in range(5)]
        held = [np.unique(np.array(random.choice(base)[: random.randint(0, 12)] + random.sample(range(60), random.randint(0, 9)), np.uint64)) for _ in range(40)]
        graph = search.shared_sums([(i, i) for i in range(40)], held)
        part = dict(zip(graph.terms.tolist(), state.integers(1, 10**6, len(graph.terms))))
        c = np.array([part[t] for t in graph.terms.tolist()], np.int64)
        scores = search._sums(graph, c, np.arange(len(c)), np.zeros(len(c), np.int64), 1)
        assert scores[:, 0].tolist() == [sum(int(part[t]) for t in some.tolist()) for some in held]
        assert graph.pairs and sum(map(len, graph.sums)) + len(graph.pairs) < sum(map(len, held))
