"""Rounds of array work that hold a bounded part of the texts."""

import random
import tracemalloc

import pyarrow as pa

from shelfmark.llm.substrings import CHUNK, Cutter, without_repeats


def noise(seed, n):
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def test_cutting_holds_little_of_a_batch():
    bodies = pa.array([noise(i, 4000).encode() for i in range(400)], pa.binary())
    cut = Cutter(240, 96)
    tracemalloc.start()
    found = sum(int(starts.sum()) for _, _, starts, *_ in cut.pieces(bodies))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400 * (4000 - 240 + 1)
    assert most < 60_000_000


def test_strings_across_rounds_of_a_long_text(spark):
    passage = noise("p", 500)
    long = noise("a", CHUNK - 250) + passage + noise("b", CHUNK + 70_000) + passage + noise("c", 1000)
    docs = spark.createDataFrame([(1, long), (2, "x" + passage + "y"), (3, noise("d", 3000))], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in without_repeats(docs).collect()}
    assert found == {1: (len(long), 1000, 2), 2: (502, 500, 1), 3: (3000, 0, 0)}
