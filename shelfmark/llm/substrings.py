"""Removal of repeated byte strings, found by suffix arrays over groups of text pieces.

Every string of ``length`` bytes contains an anchor: the smallest, by hash, of its substrings of a fixed shorter
length. Equal strings have equal anchors, so the corpus falls apart into groups by anchor, and each string of each
text belongs to exactly one piece: those starts of a text that share an anchor, and the bytes they reach over. Pieces whose
anchor comes up once hold nothing repeated. Equal pieces are one piece that is repeated as a whole. What is left of a
group, pieces that differ, is sorted into a suffix array (``suffixes``), where equal strings stand side by side.

A group of very many different pieces (a common line, the edge of a passage many texts share) is not gathered: its
pieces are cut again by longer anchors, at last by the strings themselves, which leaves nothing to sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Rolling, Texts, small_batches, texts, written
from shelfmark.llm.suffixes import repeated_windows

LENGTH = 400
#: Anchor lengths, as parts of the length, from the first cut to the last.
PARTS = (0.4, 0.96, 1.0)
#: Most pieces of a group that one suffix array takes; larger groups are cut again.
GROUP = 32
#: Bytes of the groups that are sorted in step.
BATCH_BYTES = 600_000
#: Bytes of texts, and starts of a long one, that one round of numpy work takes: some 15 arrays of eight bytes a position.
CHUNK = 250_000
ROW = "id {id}, tag bigint"
PIECE = ROW + ", base bigint, start bigint, starts int, anchor bigint, sum1 bigint, sum2 bigint"


class Cutter:
    """Cuts texts into pieces by anchors of ``k`` bytes."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.width = length, k, length - k + 1
        self.one, self.two = Rolling(31), Rolling(32)

    def _smallest(self, key: np.ndarray) -> np.ndarray:
        """The smallest key of each ``width`` neighbours: of a tail and a head of two aligned runs."""
        w, n = self.width, len(key)
        if w == 1:
            return key
        padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
        padded[:n] = key
        runs = padded.reshape(-1, w)
        heads = np.minimum.accumulate(runs, axis=1).ravel()
        tails = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(tails[: n - w + 1], heads[w - 1 : n])

    def __call__(self, part: Texts) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, first start, number of starts, anchor and two sums of each piece."""
        data, offsets = part.data, part.offsets
        for at in range(0, len(data), CHUNK):
            chunk = data[at : at + CHUNK + self.length - 1]
            if len(chunk) < self.length:
                return
            bounds = offsets - at
            starts = np.arange(len(chunk) - self.length + 1)
            row = np.searchsorted(bounds, starts, "right") - 1
            whole = starts + self.length <= bounds[row + 1]
            if not whole.any():
                continue
            one, two = self.one.prefix(chunk), self.two.prefix(chunk)
            place = np.arange(len(chunk) - self.k + 1)
            anchor = self.one.spans(one, place, place + self.k)
            # equal anchors: the first one, as the place breaks the tie
            low = np.uint64((1 << 24) - 1)
            chosen = (self._smallest((anchor & ~low) | place.astype(np.uint64)) & low).astype(np.int64)
            starts, row, chosen = starts[whole], row[whole], chosen[: len(whole)][whole]
            first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
            count = np.diff(np.append(first, len(starts)))
            a, r = starts[first], row[first]
            b = a + count - 1 + self.length
            sums = (s.spans(p, a, b).view(np.int64) for s, p in ((self.one, one), (self.two, two)))
            yield r, at + a - offsets[r], count.astype(np.int32), anchor[chosen[first]].view(np.int64), *sums

    def pieces(self, bodies: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for a whole column; rows count from its first."""
        for part in texts(bodies, CHUNK):
            for row, *rest in self(part):
                yield row + part.first, *rest


def _pieces(frame: DataFrame, length: int, k: int, kind: str) -> DataFrame:
    """Pieces of the rows of ``frame``: (id, tag, base, body); starts count from base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(length, k)
        for batch in batches:
            base = np.asarray(batch.column("base"))
            for row, start, starts, anchor, sum1, sum2 in cut.pieces(batch.column("body")):
                at = pa.array(row)
                columns = [*[batch.column(c).take(at) for c in ("id", "tag", "base")], pa.array(start + base[row]), *map(pa.array, (starts, anchor, sum1, sum2))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "base", "start", "starts", "anchor", "sum1", "sum2"])

    return frame.mapInArrow(run, PIECE.format(id=kind))


def _sorted_groups(frame: DataFrame, length: int, kind: str) -> DataFrame:
    """Repeated runs (id, tag, start, stop) among the pieces (id, tag, start, anchor, body) of each anchor."""

    def solve(groups: list[list[tuple]]) -> pa.RecordBatch:
        groups.sort(key=lambda g: sum(len(p[3]) for p in g))
        found = repeated_windows([[p[3] for p in g] for g in groups], length)
        out: list[tuple] = []
        for group, hits in zip(groups, found):
            for (identifier, tag, start, _), at in zip(group, hits):
                if len(at):
                    head = np.flatnonzero(np.append(True, at[1:] - at[:-1] > length))
                    last = np.append(head[1:], len(at)) - 1
                    out += [(identifier, tag, start + int(at[h]), start + int(at[e]) + length) for h, e in zip(head, last)]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["id", "tag", "start", "stop"])

    id_type = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        held, anchor = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "id", "tag", "start", "body")]):
                if row[0] != anchor or not groups:
                    if held > BATCH_BYTES:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append([])
                    anchor = row[0]
                groups[-1].append(row[1:])
                held += len(row[4])
        if groups:
            yield solve(groups)

    dealt = frame.repartition("anchor").sortWithinPartitions("anchor", "id", "tag", "start")
    return dealt.mapInArrow(run, ROW.format(id=kind) + ", start bigint, stop bigint")


def _bodies(wanted: DataFrame, bodies: DataFrame, length: int, kind: str, packed: bool) -> DataFrame:
    """``wanted`` pieces with their bytes, cut out of the rows they come from; one join on the row."""
    per_row = wanted.groupBy("id", "tag", "base").agg(F.collect_list(F.struct("start", "starts", "anchor", "hot")).alias("pieces"))
    same = [per_row["id"].eqNullSafe(bodies["id"]), per_row["tag"] == bodies["tag"], per_row["base"] == bodies["base"]]
    joined = bodies.join(per_row, same).select(bodies["id"], bodies["tag"], bodies["base"], bodies["body"], "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress if packed else bytes
        for batch in batches:
            for i in range(batch.num_rows):
                body, base = unpack(batch.column("body")[i].as_py()), batch.column("base")[i].as_py()
                identifier, tag = batch.column("id")[i].as_py(), batch.column("tag")[i].as_py()
                pieces = batch.column("pieces")[i].as_py()
                for at in range(0, len(pieces), 1000):
                    some = pieces[at : at + 1000]
                    cuts = [body[p["start"] - base : p["start"] - base + p["starts"] - 1 + length] for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([identifier] * len(some), batch.schema.field("id").type), pa.array([tag] * len(some), pa.int64()), pa.array([p["start"] for p in some], pa.int64()),
                            pa.array([p["anchor"] for p in some], pa.int64()), pa.array([p["hot"] for p in some], pa.bool_()), pa.array(cuts, pa.binary()),
                        ],
                        names=["id", "tag", "start", "anchor", "hot", "body"],
                    )

    return joined.mapInArrow(run, ROW.format(id=kind) + ", start bigint, anchor bigint, hot boolean, body binary")


def _packed(frame: DataFrame, kind: str) -> DataFrame:
    """Bodies compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            body = pa.array([pack(b.as_buffer()) for b in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "tag", "base")], body], names=["id", "tag", "base", "body"])

    return frame.mapInArrow(run, ROW.format(id=kind) + ", base bigint, body binary")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, tag, start, stop): byte runs covered by repeated strings; runs of a row may touch or overlap.

    ``docs`` has id, tag (both name a row) and body (binary, not null). Three joins meet the rows of an anchor or of a
    text; where copies make an anchor frequent, counting combines on the map side and the join may split it.
    """
    kind = docs.schema["id"].dataType.simpleString()
    bodies = docs.select("id", "tag", F.lit(0).cast("bigint").alias("base"), "body")
    packed = True
    runs: list[DataFrame] = []
    key = ["anchor", "sum1", "sum2"]
    for level, part in enumerate(PARTS):
        k = min(length, max(1, round(part * length)))
        cut = written(_pieces(bodies, length, k, kind), f"pieces-{level}")
        # written, so that the joins with it can split a frequent anchor
        often = written(cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor"), f"often-{level}")
        some = written(cut.join(often, "anchor").select(*cut.columns), f"shared-{level}")
        classes = some.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "base", "start", "starts")).alias("first"))
        classes = written(classes, f"classes-{level}")
        full = some.join(classes.filter("n > 1").select(*key), key)
        runs.append(full.select("id", "tag", "start", (F.col("start") + F.col("starts") - 1 + length).alias("stop")))
        if k == length:
            break
        groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("_classes"), F.min("n").alias("_least"))
        open_groups = written(groups.filter("_classes > 1 and _least = 1").select("anchor", (F.col("_classes") > GROUP).alias("hot")), f"open-{level}")
        wanted = classes.join(open_groups, "anchor").select("first.*", "anchor", "hot")
        source = _packed(bodies, kind) if packed else bodies
        found = written(_bodies(wanted, source, length, kind, packed), f"bodies-{level}")
        packed = False
        runs.append(_sorted_groups(found.filter("not hot"), length, kind))
        bodies = found.filter("hot").select("id", "tag", F.col("start").alias("base"), "body")
    out = runs[0]
    for more in runs[1:]:
        out = out.unionAll(more)
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs: those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without_repeats(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    length: int = LENGTH,
    with_text: bool = False,
) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for each row of ``docs``.

    Each byte of a text (UTF-8; null: empty) is removed if a string of ``length`` bytes that covers it also starts at
    another place of any text, its own included. With ``with_text`` a column ``kept_text`` holds what is left, without
    bytes of characters that were cut apart. All places of a repeated string go, so copies of a long text become empty.
    A repeated or null identifier does not matter: rows are told apart by identifier and text, and equal rows are copies of
    each other. Columns not in ``keep`` are left out, so that no name can clash.
    """
    small_batches(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in made]
    names = [f"k{i}" for i in range(len(kept))]
    kind = docs.schema[identifier].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(identifier).alias("id"), F.xxhash64(F.col(identifier), body).alias("tag"), body.cast("binary").alias("body")]
    runs = written(repeated_runs(docs.select(*columns), length), "runs")
    spans = runs.distinct().groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    carried = [F.col(f.name).alias(n) for n, f in zip(names, kept)]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([compress(b.as_buffer()) for b in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*names, "id", "tag")], packed], names=[*names, "id", "tag", "body"])

    lead = f"{schema}, " if schema else ""
    dense = docs.select(*carried, *columns).mapInArrow(pack, f"{lead}id {kind}, tag bigint, body binary")
    same = [dense["id"].eqNullSafe(spans["id"]), dense["tag"] == spans["tag"]]
    joined = dense.join(spans, same, "left").select(*names, "body", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found: list[list] = [[] for _ in made]
            for packed, spans_ in zip(batch.column("body"), batch.column("spans").to_pylist()):
                whole = unpack(packed.as_py())
                runs_ = _merged(spans_ or [])
                edges = [0, *[e for r in runs_ for e in r], len(whole)]
                left = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                values = [len(whole), len(whole) - len(left), len(runs_), hashlib.sha256(left).hexdigest()]
                for column, value in zip(found, [*values, left.decode("utf-8", "ignore")]):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(c, t) for c, t in zip(found, kinds)]], names=[*names, *made])

    result = joined.mapInArrow(cut, lead + "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text)
    return result.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept)], *made)
