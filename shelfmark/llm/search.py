"""Ranked lexical search of many items at once, sharing what they have in common.

The items of a block are mined for shared sets of terms: terms that the same items hold are one set, and the two sets
that most items hold together become a set of their own, as long as two items share them. Sets form a graph of
sums. A document's part of a score is computed once per set and document, whole sets are sums of two others, and an item is the
sum of the few sets left to it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import LOWER, Rolling, Texts, broadcast_up_to, small_batches, texts, word_table, words, written
from shelfmark.operators.keyed import top_per_key

#: Items searched for in one pass over the documents.
ITEMS = 2048
#: Sets of an item that are looked at in pairs. More would be summed one by one: the sharing is less, the sums are the same.
PAIRED = 256
#: Numbers in the table of partial sums, and found rows, that a task holds.
CELLS, HELD = 4_000_000, 400_000
#: Terms stand between these bytes: everything in ASCII that is no letter and no digit.
TERM_BYTES = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Saturation, in thousandths, and the share of length in the normaliser, in percent: fixed by the score.
UNIT, PERCENT, LENGTH_PERCENT, SPAN = 1000, 100, 50, 20
_HASHER = Rolling(13)


def terms(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every term."""
    row, start, stop = words(part, TERM_BYTES)
    return row, _HASHER.spans(_HASHER.prefix(LOWER[part.data]), start, stop)


@dataclass
class Graph:
    """Sums shared by the items of a block.

    ``terms`` are sorted; ``atom`` is the set each belongs to. Set ``atoms + k`` is the sum of the two sets ``pairs[k]``. Item ``i``, in
    the order of ``items``, is the sum of the sets ``sums[i]``.
    """

    items: list[tuple[int | None, int]]
    terms: np.ndarray
    atom: np.ndarray
    atoms: int
    pairs: list[tuple[int, int]]
    sums: list[np.ndarray]

    def parts(self) -> tuple:
        return self.items, self.terms, self.atom, self.atoms, self.pairs, self.sums

    @property
    def nodes(self) -> int:
        return self.atoms + len(self.pairs)


def shared_sums(items: list[tuple[int | None, int]], held: list[np.ndarray]) -> Graph:
    """The graph of items that hold the distinct terms ``held``."""
    owners: dict[int, list[int]] = defaultdict(list)
    for i, found in enumerate(held):
        for term in found.tolist():
            owners[term].append(i)
    every = sorted(owners)
    sets: dict[tuple[int, ...], int] = {}
    atom = np.array([sets.setdefault(tuple(owners[t]), len(sets)) for t in every], np.int32)
    left: list[set[int]] = [set() for _ in items]
    for who, number in sets.items():
        for i in who:
            left[i].add(number)
    shared = {number for who, number in sets.items() if len(who) > 1}
    pairs = _merged(left, shared, len(sets))
    return Graph(items, np.array(every, np.uint64), atom, len(sets), pairs, [np.array(sorted(s), np.int32) for s in left])


def _merged(left: list[set[int]], shared: set[int], first: int) -> list[tuple[int, int]]:
    """Replaces pairs of sets by new ones in ``left``, those of most items first, while two items hold a pair."""
    counts: Counter[tuple[int, int]] = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    common = [set(sorted(s & shared)[:PAIRED]) for s in left]
    for i, some in enumerate(common):
        inside = sorted(some)
        for k, a in enumerate(inside):
            for b in inside[k + 1 :]:
                counts[a, b] += 1
                where[a, b].add(i)
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    pairs = []
    while heap:
        n, pair = heapq.heappop(heap)
        if counts[pair] != -n:
            if counts[pair] > 1:
                heapq.heappush(heap, (-counts[pair], pair))
            continue
        made, users = first + len(pairs), sorted(where.pop(pair))
        pairs.append(pair)
        touched = set()
        for i in users:
            for gone in pair:
                common[i].discard(gone)
                left[i].discard(gone)
            for other in common[i]:
                for gone in pair:
                    key = (min(gone, other), max(gone, other))
                    counts[key] -= 1
                    where[key].discard(i)
                key = (other, made)
                counts[key] += 1
                where[key].add(i)
                touched.add(key)
            common[i].add(made)
            left[i].add(made)
        counts[pair] = 0
        for key in touched:
            if counts[key] > 1:
                heapq.heappush(heap, (-counts[key], key))
    return pairs


def _graphs(items: DataFrame, identifier: str, text: str, size: int) -> DataFrame:
    """(block, graph): one row per block of about ``size`` items. Rows with the same identifier and text are one item."""
    plain = items.select(F.col(identifier).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    plain = written(plain.withColumn("item", F.xxhash64(F.col("id").isNull(), "id", "text")), "items")
    parts = -(-plain.count() // size)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["item", "text"])
        held: list[np.ndarray] = []
        for part in texts(pa.array(frame["text"], pa.string())):
            row, term = terms(part)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(part.rows + 1))
            held += [np.unique(term[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
        keys = [(None if i is None or i != i else int(i), int(k)) for i, k in zip(frame["key"], frame["item"])]
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "graph": [pickle.dumps(shared_sums(keys, held).parts())]})

    dealt = plain.select(F.pmod("item", F.lit(max(parts, 1))).alias("block"), F.col("id").cast("string").alias("key"), "item", "text")
    return dealt.groupBy("block").applyInPandas(build, "block bigint, graph binary")


def _postings(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs) of documents with a term: how many they hold in all, and which of ``wanted`` how often."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for part in texts(batch.column("text")):
                row, term = terms(part)
                n = np.bincount(row, minlength=part.rows)
                at = np.minimum(np.searchsorted(asked, term), max(len(asked) - 1, 0))
                known = asked[at] == term if len(asked) else np.zeros(len(term), bool)
                both, tf = np.unique(row[known] * max(len(asked), 1) + at[known], return_counts=True)
                owner, which = np.divmod(both, max(len(asked), 1))
                offsets = pa.array(np.searchsorted(owner, np.arange(part.rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (which, tf)]
                columns = [batch.column("id").slice(part.first, part.rows), pa.array(n.astype(np.int64)), *lists]
                made = pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])
                yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(UNIT * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


class Best:
    """The first ``top`` documents of each item among those seen: higher scores first, then smaller ids, none last."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]
        self.held = 0
        self.waiting: list[list[np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        self.waiting.append([item, scores[item, doc], ids[doc], null[doc].astype(np.int64)])
        self.held += len(item)
        if self.held > HELD:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, ids, null = (np.concatenate(c) for c in zip(self.rows, *self.waiting))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.top]
        self.rows = [np.concatenate(c)[keep] for c in zip(self.rows, *self.waiting)]
        last = np.flatnonzero(rank[rank < self.top] == self.top - 1)
        self.floor[self.rows[0][last]] = self.rows[1][last]
        self.waiting, self.held = [], 0
        return self.rows


def _sums(graph: Graph, c: np.ndarray, which: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Scores (item, document) from the parts ``c`` that terms ``which`` give documents ``owner``."""
    table = np.zeros((graph.nodes, docs), np.int64)
    np.add.at(table, (graph.atom[which], owner), c)
    for k, (a, b) in enumerate(graph.pairs):
        np.add(table[a], table[b], out=table[graph.atoms + k])
    return np.stack([table[some].sum(axis=0) for some in graph.sums])


def _ranked(postings: DataFrame, graph: Graph, w: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item, id, score): of each task the first ``top`` documents of each item."""
    shared = postings.sparkSession.sparkContext.broadcast((graph, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, w = shared.value
        best = Best(len(graph.items), top)
        step = max(16, CELLS // max(graph.nodes, 1))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                # whole numbers of any size: n * documents may pass 64 bits in very large collections only
                n = np.array(part.column("n").to_pylist(), object if LENGTH_PERCENT * documents * length >= 1 << 63 else np.int64)
                m = (PERCENT - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // length).astype(np.int64)
                which, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                owner = np.repeat(np.arange(part.num_rows), sizes)
                c = w[which] * (UNIT**3 * tf // (UNIT * tf + SPAN * m[owner]))
                ids = part.column("id")
                null = np.asarray(ids.is_null())
                best.add(_sums(graph, c, which, owner, part.num_rows), ids.fill_null(0).to_numpy(), null)
        item, score, ids, null = best.settle()
        yield pa.RecordBatch.from_pydict({"item": pa.array(item.astype(np.int32)), "id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "score": score})

    return postings.select("id", "n", "terms", "tfs").mapInArrow(run, "item int, id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, identifier: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 50,
    block: int = ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item, scores above 0 only; identifiers are bigint.

    A term is a maximal run of ASCII letters and digits and of characters outside ASCII, with A-Z lower-cased, in the whole text. Null
    texts, and those without a term, count nowhere and are never found. Each row of ``docs`` is a document of its own,
    repeated ids and texts too; equal scores go by ascending id, a missing id last. Rows of ``items`` with the same identifier and
    text are one item; with another text under the same identifier a row is an item with ranks of its own. An item
    without terms, or without a document, gives no rows. Other columns are left out. Terms are told apart by 64-bit hashes.

    Items are taken in blocks, each one pass over the documents; what a task gets is bounded by a block.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(identifier).cast("bigint").alias("id"), F.col(text).alias("text"))
    graphs = written(_graphs(items, item, item_text, block), "graphs")
    found = [_block(narrow, Graph(*pickle.loads(row.graph)), top) for row in _one_by_one(graphs)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _one_by_one(graphs: DataFrame) -> Iterable:
    """The rows of ``graphs``, each read when it is its turn: a block is small, all of them need not be."""
    for row in graphs.select("block").orderBy("block").toLocalIterator():
        yield graphs.filter(F.col("block") == row.block).first()


def _block(docs: DataFrame, graph: Graph, top: int) -> DataFrame:
    spark = docs.sparkSession
    postings = written(_postings(docs, graph.terms), "postings")
    documents, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(graph.terms), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[row.term] = row.n
    found = _ranked(postings, graph, weights(df, documents), documents, length, top)
    first = top_per_key(found, ["item"], [F.col("score").desc(), F.col("id").asc_nulls_last()], top, "rank")
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(graph.items)], "item int, item_id bigint")
    return first.join(broadcast_up_to(names, len(graph.items)), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
