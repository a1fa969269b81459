"""Byte-level BPE encoding and decoding by a published table of ranks.

A text of one chunk is split by the tokenizer's pattern and each piece is merged by rank. A longer text is cut into
overlapping chunks that are split in parallel. The pattern looks forward only and leaves no gap, so two scans that
both end a piece at one place go on alike from there: neighbouring chunks are stitched at the first such place in
their overlap, and the pieces between two stitches are encoded, again in parallel. Texts with two chunks that never
meet (a piece longer than an overlap) are split whole.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from shelfmark.llm.common import small_batches, written

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A piece that ends this close to the end of a chunk could end elsewhere in the whole text.
LOOKAHEAD = 3
#: Pieces a task remembers. From ``LONG`` bytes on a piece is merged by itself.
REMEMBERED, LONG = 300_000, 64
#: Stands for a pair that makes no token.
NONE = 1 << 31


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Pairs:
    """Which token two neighbouring tokens make: an open hash table in arrays, so that many pairs are looked up at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found, np.int64, len(found))
        made = np.fromiter(found.values(), np.int64, len(found))
        self.bits = max(8, int(np.ceil(np.log2(len(found) + 1))) + 2)
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]], self.made[at[free]] = keys[free], made[free]  # of several, the last stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, ``NONE`` where there is none. A lower token is merged first."""
        keys = left << 32 | right
        at = self._home(keys)
        out, held = self.made[at], self.keys[at]
        more = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = NONE
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            held = self.keys[at[more]]
            hit = held == keys[more]
            out[more[hit]] = self.made[at[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out


def merge_many(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, ids): the ids of ``pieces``, as matrices of one length each. Each step merges one pair in every piece of a length.

    It is the lowest pair, leftmost of equals. A piece without one is done; the others go on among those one shorter.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out, places = [], np.zeros(0, np.int64)
    ids, made = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
    order = np.argsort(-lengths, kind="stable")
    first = 0
    for n in range(int(lengths.max(initial=0)), 0, -1):
        last = first + int(np.searchsorted(-lengths[order[first:]], -n, "right"))
        if last > first:
            new = order[first:last]
            fresh = single[np.frombuffer(b"".join(map(pieces.__getitem__, new.tolist())), np.uint8).reshape(-1, n)]
            near = pairs(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(-1, n - 1)
            if len(places):
                places, ids, made = np.concatenate([places, new]), np.concatenate([ids, fresh]), np.concatenate([made, near])
            else:
                places, ids, made = new, fresh, near
            first = last
        if not len(places):
            continue
        if n == 1:
            out.append((places, ids))
            break
        at = made.argmin(axis=1)
        token = made[np.arange(len(at)), at]
        done = token == NONE
        if done.any():
            out.append((places[done], ids[done]))
            places, ids, made, at, token = places[~done], ids[~done], made[~done], at[~done], token[~done]
        row = np.arange(len(at))
        ids[row, at] = token
        keep = np.ones(ids.shape, bool)
        keep[row, at + 1] = False
        ids = ids[keep].reshape(len(row), n - 1)
        keep = np.ones(made.shape, bool)
        keep[row, at] = False
        made = made[keep].reshape(len(row), n - 2)
        if n > 2:
            some = np.flatnonzero(at > 0)
            made[some, at[some] - 1] = pairs(ids[some, at[some] - 1], token[some])
            some = np.flatnonzero(at < n - 2)
            made[some, at[some]] = pairs(token[some], ids[some, at[some] + 1])
    return out


def merge_one(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece, by a heap of its pairs."""
    size = len(data)
    stop = list(range(1, size + 1))  # where the part that starts here ends; 0 once it is merged into another
    before = list(range(-1, size - 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(left: int) -> None:
        middle = stop[left]
        if middle < size:
            low = ranks.get(data[left : stop[middle]])
            if low is not None:
                heapq.heappush(heap, (low, left, middle, stop[middle]))

    for i in range(size - 1):
        push(i)
    while heap:
        _, left, middle, right = heapq.heappop(heap)
        if stop[left] != middle or stop[middle] != right:
            continue
        stop[left], stop[middle] = right, 0
        if right < size:
            before[right] = left
        push(left)
        if left:
            push(before[left])
    out, at = [], 0
    while at < size:
        out.append(ranks[data[at : stop[at]]])
        at = stop[at]
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder(dict):
    """Numbers pieces as they come up; the new ones are merged together when ids are asked for."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs):
        super().__init__()
        self.ranks, self.pairs = ranks, pairs
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.waiting.append(piece)
        return number

    def _learn(self) -> None:
        given, self.waiting = [p.encode() for p in self.waiting], []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        whole = [self.ranks.get(g, -1) for g in given]
        for i, (g, rank) in enumerate(zip(given, whole)):
            if rank < 0 and len(g) >= LONG:
                found.append((np.array([i]), np.array([merge_one(g, self.ranks)])))
        known = np.array(whole, np.int64)
        found.append((np.flatnonzero(known >= 0), known[known >= 0][:, None]))
        rest = [i for i, (g, rank) in enumerate(zip(given, whole)) if rank < 0 and len(g) < LONG]
        names = np.array(rest, np.int64)
        found += [(names[places], ids) for places, ids in merge_many([given[i] for i in rest], self.single, self.pairs)]
        sizes = np.zeros(len(given), np.int64)
        for places, ids in found:
            sizes[places] = ids.shape[1]
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), "<u4")
        for places, ids in found:
            flat[starts[places, None] + np.arange(ids.shape[1])] = ids
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def __call__(self, texts: list[list[str]]) -> pa.Array:
        """The packed ids of each text, given as its pieces."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.waiting:
            self._learn()
        sizes = self.sizes[numbers]
        ids = self.flat[_ragged(self.starts[numbers], sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        if len(self) > REMEMBERED:
            self._forget()
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)]).cast(pa.binary())


def unsettled(pattern: str) -> str:
    """Letters and digits of this machine's ``regex`` that the tokenizer's library, of an older Unicode, does not know as such.

    The library is asked: after a letter (or digit) a character of the same class is one piece with it.
    """
    import tiktoken

    out, everything = [], "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    for head, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        asked = regex.findall(kind, everything)
        ranks = {bytes([i]): i for i in range(256)}
        for c in asked:
            ranks.setdefault((head + c).encode(), len(ranks))
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        out += [c for c in asked if len(probe.encode_ordinary(head + c)) > 1]
    return "".join(sorted(out))


class Splitter:
    """Ends of the pieces of a text by ``pattern``; ``newer`` characters count as neither letters nor digits."""

    def __init__(self, pattern: str, newer: str):
        self.pattern, self.newer = regex.compile(pattern), frozenset(newer)
        self.beyond = regex.compile(f"[{min(newer)}-\U0010ffff]") if newer else None
        self.plain = dict.fromkeys(map(ord, newer), "¤")

    def pieces(self, text: str) -> list[str]:
        if self.beyond is None or text.isascii() or not self.beyond.search(text) or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.plain))]

    def ends(self, text: str) -> np.ndarray:
        return np.cumsum(np.fromiter(map(len, self.pieces(text)), np.int32), dtype=np.int32)


def _batches(column: pa.Array, size: int = 2_000_000) -> Iterator[list[str]]:
    """Texts of a column, nulls empty, a few megabytes of Python strings at a time."""
    lengths = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
    start = 0
    while start < len(column):
        base = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, base + size)))
        yield [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


#: What a worker process keeps from task to task, by the number of the broadcast.
_READY: dict[int, tuple[Encoder, Splitter]] = {}


class Model:
    """What tasks need to encode: tables of fixed size, shipped once per executor."""

    def __init__(self, docs: DataFrame, ranks: dict[bytes, int], pattern: str):
        self.number = uuid.uuid4().int
        self.shared = docs.sparkSession.sparkContext.broadcast((ranks, Pairs(ranks), pattern, unsettled(pattern)))

    def ready(self) -> tuple[Encoder, Splitter]:
        if self.number not in _READY:
            ranks, pairs, pattern, newer = self.shared.value
            _READY.clear()
            _READY[self.number] = Encoder(ranks, pairs), Splitter(pattern, newer)
        return _READY[self.number]


def _encoded(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """(row, ids) of rows whose texts are split in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = model.ready()
        for batch in batches:
            row = batch.column("row")
            ids = [encoder([split.pieces(t) for t in some]) for some in _batches(pc.struct_field(row, text))]
            yield pa.RecordBatch.from_arrays([row, pa.concat_arrays([pa.array([], pa.binary()), *ids])], names=["row", "ids"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("ids", BinaryType())]))


def _cut(size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                count = -(-len(text) // size)
                for first in range(0, count, 16):
                    some = range(first, min(first + 16, count))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "_row": pa.array([batch.column("_row")[i].as_py()] * len(some), pa.int64()),
                            "no": pa.array(some, pa.int32()),
                            "last": pa.array([k == count - 1 for k in some]),
                            "chunk": pa.array([text[k * size : (k + 1) * size + overlap] for k in some], pa.string()),
                        }
                    )

    return run


def _split(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split = model.ready()
        for batch in batches:
            ends = []
            for text, last in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist()):
                found = split.ends(text)
                ends.append(found if last else found[found <= len(text) - LOOKAHEAD])
            made = pa.array(ends, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "ends"])

    return run


def _merge(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = model.ready()
        for batch in batches:
            ids = []
            for i in range(batch.num_rows):
                text = batch.column("chunk")[i].as_py()
                ends = np.asarray(batch.column("ends")[i].values)
                start, stop = batch.column("start")[i].as_py(), batch.column("stop")[i].as_py()
                inside = ends[(ends > start) & (ends <= (len(text) if stop is None else stop))].tolist()
                ids.append(encoder([[text[a:b] for a, b in zip([start, *inside], inside)]]))
            made = pa.concat_arrays([pa.array([], pa.binary()), *ids])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("no"), made], names=["_row", "no", "ids"])

    return run


def _stitched(rows: DataFrame, model: Model, text: str, size: int, overlap: int) -> DataFrame:
    """(row, ids) of rows whose texts are longer than a chunk.

    They are numbered and written, so that a lost executor does not number them anew. Per text only the ends of pieces in
    overlaps are put in order; chunks travel alone.
    """
    long = written(rows.select(F.monotonically_increasing_id().alias("_row"), "row"), "long-texts")
    if long.isEmpty():
        return _encoded(rows.limit(0), model, text)
    cut = long.select("_row", F.col("row")[text].alias("text")).mapInArrow(_cut(size, overlap), "_row bigint, no int, last boolean, chunk string")
    split = cut.repartition("_row", "no").mapInArrow(_split(model), "_row bigint, no int, last boolean, chunk string, ends array<int>")
    chunks = written(split, "chunks")
    head = F.array_union(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap))
    tail = F.transform(F.filter("ends", lambda e: e >= size), lambda e: e - size)
    order = W.partitionBy("_row").orderBy("no")
    met = chunks.select("_row", "no", "last", head.alias("head"), tail.alias("tail")).select(
        "_row", "no", "last", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("meet")
    )
    met = written(met.select("*", F.coalesce(F.lag("meet").over(order), F.lit(0)).alias("start"), (F.col("meet") + size).alias("stop")), "stitches")
    apart = met.filter(~F.col("last") & F.col("meet").isNull()).select("_row").distinct()
    sound = met.join(apart, "_row", "left_anti").select("_row", "no", "start", "stop")
    merged = chunks.select("_row", "no", "chunk", "ends").join(sound, ["_row", "no"]).mapInArrow(_merge(model), "_row bigint, no int, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("no", "ids")))  # as many as a row's text has chunks
    whole = merged.groupBy("_row").agg(parts.alias("parts")).select(
        "_row", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids")
    )
    return long.join(whole, "_row").select("row", "ids").unionAll(_encoded(long.join(apart, "_row", "left_semi").select("row"), model, text))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each whole text as little-endian unsigned 32-bit numbers, one after the other.

    ``ranks`` must hold every single byte. No special tokens: their strings are text like any other. A null or empty
    text has no ids (an empty value, not null). Each row is encoded by itself, repeated ones too. All columns are
    kept, whatever their names; one called like ``ids`` is replaced.
    """
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"no rank for the bytes {lacking}")
    small_batches(docs.sparkSession)
    model = Model(docs, ranks, pattern)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    many = F.coalesce(F.length(F.col("row")[text]), F.lit(0)) > chunk
    both = _encoded(rows.filter(~many), model, text).unionAll(_stitched(rows.filter(many), model, text, chunk, overlap))
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != ids], F.col("ids").alias(ids))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``decoded``: the bytes of the tokens of ``ids``, concatenated.

    Null ids give null, no ids an empty value; an id without token raises an error. Ids that do not come from a text
    may decode to bytes that are not UTF-8, so the column is binary. A column called like ``decoded`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            row = batch.column("row")
            found = (v.as_buffer() if v.is_valid else None for v in pc.struct_field(row, ids))
            out = [None if v is None else b"".join(map(token, np.frombuffer(v, "<u4").tolist())) for v in found]
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.binary())], names=["row", "decoded"])

    made = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("decoded", BinaryType())]))
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != decoded], F.col("decoded").alias(decoded))


def numbers(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` as an array of numbers; null stays null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            out = [np.frombuffer(v.as_buffer(), "<i4") if v.is_valid else None for v in pc.struct_field(row, ids)]
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.list_(pa.int32()))], names=["row", "ids"])

    made = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType()))]))
    return made.select(*[(F.col("ids") if c == ids else F.col("row")[c]).alias(c) for c in docs.columns])
