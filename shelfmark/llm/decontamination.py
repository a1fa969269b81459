"""Benchmark decontamination by latent semantic retrieval, then alignment.

The TF-IDF matrix of a block of benchmark passages (windows of words) gets its leading right singular vectors by a
randomised SVD: tasks multiply their own passages with the current basis, Spark adds up the products, the driver
orthonormalises a matrix of fixed size. Every window of every document is placed in that space and
compared with the block's passages by cosine, if its document has enough of an item's words at all. What is near enough is aligned word by word: the longest common
subsequence must cover most of the item, or a good part of it together with its answer.

An item that fills little of a window is far from it by cosine, so items are also looked up by pairs of words: text
that holds one with at most a fifth of its words changed, left out or put in shares a known number of its word pairs,
about as far from the text's start as in the item. What shares as many is aligned as well, whatever its words weigh.

Cosines use the whole length of a window's vector, not only its part in the space, so a window that merely shares
common words stays far; they are divided by the share of the passage that the space holds, which makes them estimates
of the cosine before reduction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.llm.common import Rolling, Texts, mixed, small_batches, texts, word_table, words, written

FEATURES = 1 << 18
RANK, EXTRA, ROUNDS = 192, 16, 3
WINDOW, STRIDE = 32, 16
#: Passages of a block, which has a space of its own: twice the rank, so that a space holds most of each of them.
BLOCK_PASSAGES = 384
#: A passage of which the space holds less gets a direction of its own.
LEAST_HELD = 0.3
#: Blocks that one pass over the documents compares with; a larger benchmark takes more passes.
BLOCKS_PER_PASS = 8
#: Least cosine of a window to be aligned.
NEAR = 0.27
#: Least part of an item that must be found in order; the lower one needs the answer too.
ALIGNED, WITH_ANSWER = 0.8, 0.6
#: An item is found by its word pairs if at most one in so many of its words differs; this is within ALIGNED.
ONE_IN = 5
SLICES = 16
#: Numbers of a table of rows and words that a task holds.
CELLS = 2_000_000
#: Bytes of text that are searched at once: each of their words takes a row of the space, 768 bytes.
SEARCHED_BYTES = 250_000
#: Words are letters and digits; all else in ASCII stands between them.
_INSIDE = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words:
    """Hashes the words of lower-cased texts."""

    def __init__(self) -> None:
        self.hasher = Rolling(6)

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        row, start, stop = words(part, _INSIDE)
        return row, self.hasher.spans(self.hasher.prefix(part.data), start, stop)

    def of(self, text: str | None) -> np.ndarray:
        parts = list(texts(pa.array([text or ""]).cast(pa.large_binary())))
        return self(parts[0])[1]


def _feature(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Word ranges of an item's passages: the last one ends with the item."""
    if n <= size:
        return [(0, n)]
    return [(a, a + size) for a in [*range(0, n - size, stride), n - size]]


def common_subsequence(item: Sequence[int], text: Sequence[int]) -> int:
    """Length of the longest common subsequence, a word of the text at a time on one bit per word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _lowered(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.coalesce(F.lower(F.col(text)), F.lit("")).alias("text"))


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total, rows = Words(), np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in texts(batch.column("text")):
                row, word = find(part)
                seen = np.unique(row * FEATURES + _feature(word))
                total += np.bincount(seen & (FEATURES - 1), minlength=FEATURES)
                rows += part.rows
        held = np.append(total, rows)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"feature": some.astype(np.int32), "n": held[some]})

    out = np.zeros(FEATURES + 1, np.int64)
    found = _lowered(docs, text).mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out[found["feature"]] = found["n"]
    return out[:-1], int(out[-1])


def weights(held: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of each feature, above 0 for one that all documents hold."""
    return (np.log((1 + n) / (1 + held)) + 0.1).astype(np.float32)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("features")
    size = np.diff(np.asarray(lists.offsets))
    filled = size > 0
    flat = np.asarray(lists.flatten()).astype(np.int64)
    return flat, (np.cumsum(size) - size)[filled], size[filled]


def _added(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of partial matrices that come as slices (slice, cells)."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.float32) for c in group["cells"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "cells": [total.tobytes()]})

    rows = parts.groupBy("slice").applyInPandas(add, "slice int, cells binary").collect()
    return np.vstack([np.frombuffer(r.cells, np.float32).reshape(-1, width) for r in sorted(rows)])[:height]


def basis(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors (vocabulary x rank) of the passages' TF-IDF matrix, whose rows have length one."""
    width = min(rank + EXTRA, len(vocabulary))
    spark = passages.sparkSession
    scale = idf[vocabulary]
    known = spark.sparkContext.broadcast((vocabulary, scale))

    def pushed(matrix: np.ndarray) -> np.ndarray:
        """A'A times ``matrix``."""
        shared = spark.sparkContext.broadcast(matrix.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, scale_ = known.value
            total = np.zeros((len(columns), width), np.float32)
            for batch in batches:
                flat, first, size = _rows(batch)
                if len(first):
                    at = np.searchsorted(columns, flat)
                    weight = scale_[at]
                    image = np.add.reduceat(shared.value[at] * weight[:, None], first, axis=0)
                    image /= np.maximum(np.add.reduceat(weight**2, first), 1e-9)[:, None]
                    np.add.at(total, at, np.repeat(image, size, axis=0) * weight[:, None])
            cells = [part.tobytes() for part in np.array_split(total, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(cells, pa.binary())], names=["slice", "cells"])

        return _added(passages.mapInArrow(run, "slice int, cells binary"), len(vocabulary), width)

    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((len(vocabulary), width)).astype(np.float32))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(pushed(q))
    small = q.T @ pushed(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    return (q @ vectors[:, best]).astype(np.float32)


class Index:
    """A block of benchmark items: their passages in a space of their own, their words and answers."""

    def __init__(self, items: list[tuple[object, np.ndarray, np.ndarray]]):
        self.ids = [i for i, _, _ in items]
        self.words = [w.tolist() for _, w, _ in items]
        self.answers = [a.tolist() for _, _, a in items]
        cut = [(n, _feature(w)[a:b]) for n, (_, w, _) in enumerate(items) for a, b in windows(len(w))]
        self.owner = np.array([n for n, _ in cut], np.int64)
        self.passages = [f for _, f in cut]
        self.vocabulary = np.unique(np.concatenate(self.passages)) if cut else np.zeros(0, np.int64)
        every = [w for _, w, _ in items]
        self.known = np.unique(np.concatenate(every)) if items else np.zeros(0, np.uint64)
        self.first_bits = np.zeros(1 << 16, bool)
        self.first_bits[self.known >> np.uint64(48)] = True
        self.member = np.zeros((len(self.known), len(items)), np.float32)
        for n, w in enumerate(every):
            np.add.at(self.member[:, n], np.searchsorted(self.known, w), 1)
        self.enough = np.array([WITH_ANSWER * len(w) - 1e-3 for w in every], np.float32)

    def possible(self, row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
        """Which items (columns) a row of words could hold: it has enough of their words, in whatever order.

        A common subsequence is no longer than that, so nothing that would align is left out.
        """
        some = np.flatnonzero(self.first_bits[word >> np.uint64(48)])
        at = np.searchsorted(self.known, word[some])
        hit = self.known[np.minimum(at, len(self.known) - 1)] == word[some]
        row, at = row[some[hit]], at[hit]
        out = np.zeros((rows, len(self.ids)), bool)
        step = max(1, CELLS // max(1, len(self.known)))
        for first in range(0, rows, step):
            a, b = np.searchsorted(row, [first, first + step])
            bag = np.zeros((min(step, rows - first), len(self.known)), np.float32)
            bag[row[a:b] - first, at[a:b]] = 1
            out[first : first + step] = bag @ self.member >= self.enough
        return out

    def place(self, space: np.ndarray, idf: np.ndarray) -> None:
        """Takes the space (vocabulary x rank), extends it where it holds too little, and places the passages."""
        scale = idf[self.vocabulary]
        matrix = np.zeros((len(self.passages), len(self.vocabulary)), np.float32)
        length = np.zeros(len(self.passages))
        for i, feature in enumerate(self.passages):
            at = np.searchsorted(self.vocabulary, feature)
            np.add.at(matrix[i], at, scale[at])
            # the sum that windows are divided by too: repeats of a word count one by one
            length[i] = np.sqrt((scale[at] ** 2).sum())
        matrix /= np.maximum(length, 1e-9)[:, None]
        whole = np.maximum((matrix**2).sum(axis=1), 1e-9)
        poor = np.flatnonzero(((matrix @ space) ** 2).sum(axis=1) < LEAST_HELD * whole)
        if len(poor):
            rest = matrix[poor] - (matrix[poor] @ space) @ space.T
            space = np.linalg.qr(np.hstack([space, rest.T]))[0].astype(np.float32)
        image = matrix @ space
        held = np.maximum((image**2).sum(axis=1), 1e-9)
        self.matrix = np.ascontiguousarray((image / held[:, None]).T.astype(np.float32))
        self.least = NEAR / float(np.sqrt((1 / held).max(initial=1e-9)))  # shortest window image that can be near
        self.table = (space * scale[:, None]).astype(np.float32)
        self.row = np.full(FEATURES, -1, np.int32)
        self.row[self.vocabulary[scale > 0]] = np.flatnonzero(scale > 0)

    def near(self, feature: np.ndarray, weight: np.ndarray, begin: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(step, item, cosine) of every window near an item; a window is a step and the next one of its row."""
        row = self.row[feature]
        used = np.flatnonzero(row >= 0)
        step = np.searchsorted(begin, used, "right") - 1
        image = np.zeros((len(begin), self.table.shape[1]), np.float32)
        first = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(step) else []
        if len(first):
            image[step[first]] = np.add.reduceat(self.table[row[used]], first, axis=0)
        length = np.add.reduceat(weight, begin)
        more = np.flatnonzero(~last)
        here, size = image.copy(), length.copy()
        here[more] += image[more + 1]
        size[more] += length[more + 1]
        here /= np.sqrt(np.maximum(size, 1e-9))[:, None]
        # a shorter image cannot reach any passage, by the inequality of Cauchy and Schwarz
        able = np.flatnonzero((here**2).sum(axis=1) >= self.least**2 * 0.999)
        for at in range(0, len(able), 4096):
            some = able[at : at + 4096]
            cosine = here[some] @ self.matrix
            window, passage = np.nonzero(cosine >= NEAR)
            for w, p in zip(window.tolist(), passage.tolist()):
                yield int(some[w]), int(self.owner[p]), float(cosine[w, p])

    def align(self, item: int, text: list[int]) -> tuple[float, bool]:
        """The part of the item that stands in ``text`` in order, and whether its answer does, word for word."""
        found = common_subsequence(self.words[item], text) / len(self.words[item])
        answer = self.answers[item]
        if found < WITH_ANSWER or not answer:
            return found, False
        return found, any(text[i : i + len(answer)] == answer for i in range(len(text) - len(answer) + 1))


class Seeds:
    """Word pairs of the items of some blocks (the word itself for an item of one), and where they stand in them."""

    def __init__(self, indexes: list[Index]):
        listed = [(b, i, np.array(w, np.uint64)) for b, index in enumerate(indexes) for i, w in enumerate(index.words)]
        self.items = [(b, i) for b, i, _ in listed]
        self.size = np.array([len(w) for _, _, w in listed], np.int64)
        self.edits = self.size // ONE_IN
        # every edit breaks two pairs at most
        self.need = np.maximum(1, self.size - 1 - 2 * self.edits)
        self.tables = []
        for k in (1, 2):
            made = [(n, self.grams(w, k)) for n, (_, _, w) in enumerate(listed) if min(2, len(w)) == k]
            if made:
                gram = np.concatenate([g for _, g in made])
                owner = np.concatenate([np.full(len(g), n) for n, g in made])
                offset = np.concatenate([np.arange(len(g)) for _, g in made])
                order = np.argsort(gram, kind="stable")
                held = np.zeros(1 << 20, bool)
                held[gram >> np.uint64(44)] = True
                self.tables.append((k, held, gram[order], owner[order], offset[order]))

    @staticmethod
    def grams(word: np.ndarray, k: int) -> np.ndarray:
        return word if k == 1 else mixed(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])

    def near(self, row: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, block, item, begin, end) of the places to align: word ranges that may reach beyond the row."""
        for k, held, gram, owner, offset in self.tables:
            found = self.grams(word, k)
            at = np.flatnonzero(held[found >> np.uint64(44)] & (row[: len(found)] == row[k - 1 :]))
            first, stop = np.searchsorted(gram, found[at], "left"), np.searchsorted(gram, found[at], "right")
            count = stop - first
            seed = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            place = np.repeat(at, count)
            item, begin = owner[seed], place - offset[seed]
            # hits of a row and an item stand together, by where the item would begin
            order = np.lexsort((begin, item, row[place]))
            place, item, begin = place[order], item[order], begin[order]
            last = np.arange(len(item)) + self.need[item] - 1
            within = np.flatnonzero(last < len(item))
            far = last[within]
            enough = (item[far] == item[within]) & (row[place[far]] == row[place[within]]) & (begin[far] - begin[within] <= self.edits[item[within]])
            within = within[enough]
            owner_row, item, begin = row[place[within]], item[within], begin[within]
            # an item without room for edits stands there word for word, so its first place will do
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (owner_row[1:] != owner_row[:-1]) | (self.edits[item[1:]] > 0)
            before = (-1, -1, 0)
            for r, n, b in zip(owner_row[new].tolist(), item[new].tolist(), begin[new].tolist()):
                edits = int(self.edits[n])
                if before[:2] == (r, n) and b <= before[2] + edits:  # inside what was yielded last
                    continue
                before = (r, n, b)
                yield r, *self.items[n], b - edits, b + int(self.size[n]) + 2 * edits


def _steps(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each step of STRIDE words, and whether it is the last step of its row."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    count = np.diff(np.append(first, len(row)))
    steps = -(-count // STRIDE)
    ends = np.cumsum(steps)
    begin = np.repeat(first, steps) + STRIDE * (np.arange(ends[-1]) - np.repeat(ends - steps, steps))
    last = np.zeros(len(begin), bool)
    last[ends - 1] = True
    return begin, last


MATCH = "array<struct<item_id:{item},cosine:double,aligned:double,answered:boolean,first_word:bigint>>"


def _search(docs: DataFrame, indexes: list[Index], idf: np.ndarray, item: str) -> DataFrame:
    """``docs`` (``row``, ``_text`` and perhaps ``_found``) with the matches of the indexes' items added to ``_found``."""
    shared = docs.sparkSession.sparkContext.broadcast((indexes, idf, Seeds(indexes)))  # a block has a bounded size
    kept = [n for n in docs.columns if n != "_found"]
    schema = StructType([*[docs.schema[n] for n in kept], *StructType.fromDDL("_found " + MATCH.format(item=item))])

    def near(index: Index, possible: np.ndarray, row: np.ndarray, word: np.ndarray, idf_: np.ndarray, best: dict) -> None:
        """Adds to ``best`` what windows near a passage of an item hold of it."""
        bounds = np.searchsorted(row, np.arange(len(possible) + 1))
        feature = _feature(word)
        begin, last = _steps(row)
        seen: dict[tuple[int, int], int] = {}
        for step, i, cosine in index.near(feature, idf_[feature] ** 2, begin, last):
            at = int(begin[step])
            r = int(row[at])
            if not possible[r, i] or seen.get((r, i), -1) >= at + WINDOW:  # the words here were aligned with the item already
                continue
            # a hit can be any passage of the item, so as much as an item more on either side
            size = len(index.words[i])
            a, b = max(bounds[r], at - size), min(bounds[r + 1], at + WINDOW + size)
            aligned, answered = index.align(i, word[a:b].tolist())
            seen[r, i] = at + WINDOW
            if aligned >= ALIGNED or aligned >= WITH_ANSWER and answered:
                if (r, i) not in best or aligned > best[r, i][1] or aligned == best[r, i][1] and best[r, i][0] is None:
                    best[r, i] = (cosine, aligned, answered, int(at - bounds[r]))

    def matches(part: Texts, find: Words) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(part.rows)]
        row, word = find(part)
        if not len(row):
            return out
        bounds = np.searchsorted(row, np.arange(part.rows + 1))
        indexes, idf_, seeds = shared.value
        seeded: list[dict[tuple[int, int], tuple]] = [{} for _ in indexes]
        for r, block, i, a, b in seeds.near(row, word):
            a, b = max(int(bounds[r]), a), min(int(bounds[r + 1]), b)
            aligned, answered = indexes[block].align(i, word[a:b].tolist())
            best = seeded[block]
            if aligned >= ALIGNED and ((r, i) not in best or aligned > best[r, i][1]):
                best[r, i] = (None, aligned, answered, int(a - bounds[r]))
        for index, best in zip(indexes, seeded):
            possible = index.possible(row, word, part.rows)
            able = possible.any(axis=1)[row]
            if able.any():
                near(index, possible, row[able], word[able], idf_, best)
            for (r, i), (cosine, aligned, answered, first) in sorted(best.items()):
                out[r].append({"item_id": index.ids[i], "cosine": cosine, "aligned": aligned, "answered": answered, "first_word": first})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Words()
        for batch in batches:
            found: list[list[dict]] = []
            for part in texts(batch.column("_text"), SEARCHED_BYTES):
                found += matches(part, find)
            if batch.schema.get_field_index("_found") >= 0:
                found = [a + b for a, b in zip(batch.column("_found").to_pylist(), found)]
            kind = pa.list_(pa.struct([("item_id", pa.int64() if item == "bigint" else pa.string()), ("cosine", pa.float64()), ("aligned", pa.float64()), ("answered", pa.bool_()), ("first_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(found, kind)], names=[*kept, "_found"])

    return docs.mapInArrow(run, schema)


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    into: str = "matches",
) -> DataFrame:
    """``docs`` with the benchmark items that each text holds, as an array ``into`` of (item_id, cosine, aligned, answered, first_word).

    ``cosine`` is null where no window is near and only word pairs led to the item. Items of any length count, so one
    of a single word is found wherever that word is.
    ``answer`` names a column of the benchmark; without one, the last sentence of an item counts as its answer.
    All documents are searched in whole, and document frequencies count all of them. Null and empty texts match
    nothing, nor do items without words. Repeated items are matched each. Rows of ``docs`` are neither dropped nor
    joined; a column of the name ``into`` is replaced. The benchmark comes to the driver in blocks of a fixed number
    of passages; tasks hold at most ``BLOCKS_PER_PASS`` blocks.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(into)
    kind = benchmark.schema[item_id].dataType.simpleString()
    idf = weights(*frequencies(docs, text))
    given = F.col(answer) if answer else F.regexp_extract(F.rtrim(F.col(item_text)), r"(?s)(?:^|.*[.!?]\s+)(.+?)$", 1)
    listed = benchmark.select(F.col(item_id).alias("id"), F.lower(F.col(item_text)).alias("text"), F.lower(given).alias("answer"))
    numbered = written(listed.orderBy("id", "text"), "items")
    out = base.select(F.struct(*base.columns).alias("row"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("_text"))
    spark = docs.sparkSession
    find, ready, block, held = Words(), [], [], 0

    def finish(items: list) -> Index:
        index = Index(items)
        lists = [(p.astype(np.int32).tolist(),) for p in index.passages]
        if lists:
            passages = spark.createDataFrame(lists, "features array<int>").repartition(min(8, len(lists)))
            index.place(basis(passages, index.vocabulary, idf, min(RANK, len(lists))), idf)
        return index

    for r in numbered.toLocalIterator():
        word = find.of(r.text)
        if not len(word):
            continue
        more = len(windows(len(word)))
        if block and held + more > BLOCK_PASSAGES:
            ready.append(finish(block))
            block, held = [], 0
            if len(ready) == BLOCKS_PER_PASS:
                out, ready = _search(out, ready, idf, kind), []
        block.append((r.id, word, find.of(r.answer)))
        held += more
    if block:
        ready.append(finish(block))
    return _search(out, ready, idf, kind).select(*[F.col("row")[c].alias(c) for c in base.columns], F.col("_found").alias(into))
