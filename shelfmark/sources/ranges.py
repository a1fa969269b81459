"""Large files as byte ranges: one file is read by many tasks, cut where its records begin.

``text_records`` cuts a text at lines of a given shape. ``json_outline`` cuts a JSON document at the values
of chosen arrays, however large the document is. The latter reads twice. First each range says whether it begins within a
string, by how much its brackets change the depth, and which bracket it opened last at each depth; sums over the ranges of a file
then give the depth and the open brackets at every range. With those a range knows what its commas separate.

Nothing is gathered: a task holds one range and what is left of the record that begins last in it.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.session import stored

#: Bytes of a range, and by how much a task reads on at first for the end of its last record.
RANGE_BYTES, READ_ON = 16 << 20, 1 << 16
#: Depths of brackets below which containers can be asked for: the root, its members, and theirs.
DEPTH = 3
# Bytes that can stand outside strings in JSON: white space, brackets, separators, numbers, true, false, null.
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b' \t\r\n{}[],:"+-.0123456789eEtrufalsn')] = True


# Listing ---------------------------------------------------------------------------------------


class Ranges(InputPartition):
    """Some byte ranges (file, start, stop, size), small files together."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


def list_files(path: str) -> list[tuple[str, int]]:
    """(address, size) of a file, of the files of a folder and the folders below it, or of those that fit a pattern such as ``/a/*.json``.

    Names that begin with ``_`` or ``.`` are left out, as Spark does.
    """
    folder, _, last = path.rstrip("/").rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    system, inner = fs.FileSystem.from_uri((folder or "/") if pattern else path)
    given = folder if pattern else path
    prefix = given[: -len(inner)] if "://" in given and given.endswith(inner) else "file://"
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else system.get_file_info(fs.FileSelector(inner, recursive=pattern is None))
    out = []
    for info in infos:
        below = info.path[len(inner) :].strip("/").split("/")
        hidden = not found.is_file and any(part.startswith(("_", ".")) for part in below)
        if info.is_file and not hidden and (pattern is None or fnmatch.fnmatch(info.base_name, pattern)):
            out.append((prefix + info.path, info.size))
    return sorted(out)


def cut(files: list[tuple[str, int]], size: int) -> list[Ranges]:
    """Partitions of about ``size`` bytes each. An empty file is one empty range."""
    out: list[list[tuple[str, int, int, int]]] = []
    room = 0
    for file, length in files:
        for start in range(0, max(length, 1), size):
            stop = min(start + size, length)
            if not out or room < stop - start:
                out.append([])
                room = size
            out[-1].append((file, start, stop, length))
            room -= stop - start
    return [Ranges(r) for r in out]


class _File:
    """Reads any bytes of one file."""

    def __init__(self, address: str):
        system, path = fs.FileSystem.from_uri(address)
        self.handle = system.open_input_file(path)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_: object) -> None:
        self.handle.close()

    def read(self, start: int, stop: int) -> bytes:
        return self.handle.read_at(max(0, stop - start), start)


# Text ------------------------------------------------------------------------------------------


def _records(file: _File, start: int, stop: int, size: int, boundary: re.Pattern) -> Iterator[tuple[int, str]]:
    """(position, text) of the records that begin in a range. What precedes the first boundary of a file is a record too."""
    on = READ_ON
    base = max(0, start - 1)  # a line begins behind a line feed
    while True:
        end = min(size, stop + on)
        data = file.read(base, end)
        whole = end == size
        found = [m.start() + base for m in boundary.finditer(data) if (whole or m.end() < len(data)) and m.start() + base >= start]
        here = [p for p in found if p < stop]
        if start == 0 and (not here or here[0] != 0):
            here.insert(0, 0)
        after = next((p for p in found if p >= stop), size if whole else None)
        if not here or after is not None:
            break
        on *= 4
    for a, b in zip(here, [*here[1:], after]):
        yield a, data[a - base : b - base].decode()


class TextRecords(DataSource):
    """Rows (file, start, at, text): records that begin with a line that ``boundary`` matches, in files that many tasks share.

    Options: ``path``, ``boundary`` (a regular expression for a line, of bytes), ``rangeBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "text_records"

    def schema(self) -> str:
        return "file string, start bigint, at bigint, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _TextReader(dict(self.options))


class _TextReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.boundary = given["path"], given["boundary"]
        self.size = int(given.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return cut(list_files(self.path), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        boundary = re.compile(self.boundary.encode(), re.MULTILINE)
        for name, start, stop, size in partition.ranges:
            with _File(name) as file:
                for at, text in _records(file, start, stop, size, boundary):
                    yield name, start, at, text


def text_records(spark: SparkSession, path: str, boundary: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, at, text): the records of text files; ``at`` is where one begins, ``start`` the range that holds this place.

    A record goes from a line that ``boundary`` matches up to the next such line; what comes before the first one is a record, too.
    """
    spark.dataSource.register(TextRecords)
    return spark.read.format("text_records").option("boundary", boundary).option("rangeBytes", range_bytes).load(path)


# JSON ------------------------------------------------------------------------------------------


class _Structure:
    """Brackets, commas and colons outside strings in ``data``, which begins ``inside`` a string or not.

    ``data`` must not begin with an escaped character.
    """

    def __init__(self, data: np.ndarray, inside: bool):
        mark = np.zeros(len(data), np.uint8)
        mark[data == 34] = 1
        slashes = np.flatnonzero(data == 92)
        if len(slashes):
            first = np.append(True, np.diff(slashes) > 1)
            starts = slashes[first]
            lengths = np.diff(np.append(np.flatnonzero(first), len(slashes)))
            escaped = (starts + lengths)[lengths % 2 == 1]
            mark[escaped[escaped < len(data)]] = 0
        self.within = np.bitwise_xor.accumulate(mark) ^ np.uint8(inside) if len(data) else mark
        self.quotes = mark
        kinds = np.zeros(256, bool)
        kinds[list(b"{}[],:")] = True
        self.at = np.flatnonzero(kinds[data] & (self.within == 0))
        self.kind = data[self.at]
        self.step = np.isin(self.kind, list(b"{[")).astype(np.int64) - np.isin(self.kind, list(b"}]"))

    def possible(self, data: np.ndarray) -> bool:
        """Whether all that is outside strings could be JSON."""
        return bool(_PLAIN[data[(self.within == 0) & (self.quotes == 0)]].all())


def begins_inside(file: _File, start: int, size: int) -> bool:
    """Whether a string is open at ``start``.

    Both readings of the bytes around it are tried; one soon holds something that cannot stand outside a string. If
    neither does, more is read, at last from the start of the file, which is outside.
    """
    back = 4096
    while True:
        low = max(0, start - back)
        data = file.read(low, min(size, start + back))
        skip = 0
        if low:  # begin behind a character that is no backslash, so that nothing is escaped
            while skip < start - low and data[skip] == 92:
                skip += 1
            skip += 1
        bytes_ = np.frombuffer(data, np.uint8)[skip:]
        readings = [False] if not low else [False, True]
        alive = []
        for inside in readings if start - low > skip or not low else []:
            found = _Structure(bytes_, inside)
            if found.possible(bytes_) or not low:
                before = start - low - skip
                alive.append(bool(found.within[before - 1]) if before else inside)
        if len(set(alive)) == 1:
            return alive[0]
        if not low or (not alive and start - low > skip):
            raise ValueError("not JSON")
        back *= 8


def _scan(file: _File, start: int, stop: int, size: int) -> tuple[bool, int, dict[int, tuple[str, int]]]:
    """Of a range: whether it begins inside a string, the change of depth, and the last bracket opened at each depth, counted from its start."""
    inside = start > 0 and begins_inside(file, start, size)
    low, data = _unescaped(file, start, stop)
    found = _Structure(np.frombuffer(data, np.uint8), inside)
    own = found.at >= start - low
    at, kind, step = found.at[own] + low, found.kind[own], found.step[own]
    depth = np.cumsum(step)
    opened = {}
    for level in np.unique(depth[(step > 0) & (depth <= DEPTH)]).tolist():
        last = np.flatnonzero((step > 0) & (depth == level))[-1]
        opened[int(level)] = (chr(kind[last]), int(at[last]))
    return inside, int(step.sum()), opened


def _unescaped(file: _File, start: int, stop: int) -> tuple[int, bytes]:
    """Bytes from ``start`` or, behind backslashes, from the first of them: there the state is that at ``start`` and nothing is escaped."""
    low, back = start, 0
    while low > 0:
        back = back * 2 or 64
        before = file.read(max(0, start - back), start)
        kept = len(before.rstrip(b"\\"))
        low = max(0, start - back) + kept
        if kept or start - back <= 0:
            break
    return low, file.read(low, stop)


class JsonRanges(DataSource):
    """Rows (file, start, stop, size, inside, net, opened): what a range of a JSON file says about those behind it."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "file string, start bigint, stop bigint, size bigint, inside boolean, net bigint, opened map<int, struct<kind: string, at: bigint>>"

    def reader(self, schema: object) -> DataSourceReader:
        return _JsonReader(dict(self.options))


class _JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.size = given["path"], int(given.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        return cut(list_files(self.path), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for name, start, stop, size in partition.ranges:
            with _File(name) as file:
                yield name, start, stop, size, *_scan(file, start, stop, size)


class _Unfinished(Exception):
    """A value goes on behind the bytes that were read."""


def _key_before(file: _File, at: int) -> str | None:
    """The member name before the bracket or colon at ``at``; none in an array or at the root."""
    back = 256
    while True:
        low = max(0, at - back)
        text = file.read(low, at).rstrip(b" \t\r\n")
        if text.endswith(b":"):
            text = text[:-1].rstrip(b" \t\r\n")
        elif text or not low:
            if not text.endswith(b'"') or text[-1:] in (b"[", b",", b"{"):
                return None
        if text.endswith(b'"'):
            for m in range(len(text) - 2, -1, -1):
                if text[m] == 34:
                    slashes = len(text[:m]) - len(text[:m].rstrip(b"\\"))
                    if slashes < m or not low:
                        if slashes % 2 == 0:
                            return json.loads(text[m:].decode())
        if not low:
            return None
        back *= 8


class _Walk:
    """Emits what begins in one range: (at, path, kind, value)."""

    def __init__(self, file: _File, start: int, stop: int, size: int, inside: bool, depth: int, open_: list[tuple[str, int]], paths: list[str]):
        self.file, self.start, self.stop, self.size = file, start, stop, size
        self.inside, self.depth, self.open, self.paths = inside, depth, open_, paths

    def entered(self, path: str) -> bool:
        """Whether a container is looked into."""
        return any(p == path or p.startswith(path + ".") for p in self.paths)

    def rows(self) -> list[tuple[int, str, str, str | None]]:
        on = READ_ON
        while True:
            end = min(self.size, self.stop + on)
            low, self.data = _unescaped(self.file, self.start, end)
            self.low, self.whole = low, end == self.size
            found = _Structure(np.frombuffer(self.data, np.uint8), self.inside)
            own = found.at >= self.start - low
            self.at, self.kind, self.step = found.at[own] + low, found.kind[own], found.step[own]
            after = self.depth + np.cumsum(self.step)
            self.level = after + (self.step < 0)  # the depth of the container an event belongs to; of a bracket, its own
            try:
                return list(self._all())
            except _Unfinished:
                on *= 4

    def _all(self) -> Iterator[tuple[int, str, str, str | None]]:
        path = ""
        if self.depth == 0:
            first = np.flatnonzero((self.step > 0) & (self.level == 1))
            if len(first) and self.at[first[0]] < self.stop:
                yield from self._opened(first[0], 1, path)
            return
        kinds = [k for k, _ in self.open]
        for level in range(1, min(self.depth, DEPTH) + 1):
            if level > 1:
                if kinds[level - 2] != "{":
                    return
                name = _key_before(self.file, self.open[level - 1][1])
                path = f"{path}.{name}" if path else str(name)
                if not self.entered(path):
                    return
            closing = np.flatnonzero((self.step < 0) & (self.level == level))
            yield from self._inside(level, kinds[level - 1], path, -1, int(closing[0]) if len(closing) else len(self.at))

    def _opened(self, i: int, level: int, path: str) -> Iterator[tuple[int, str, str, str | None]]:
        """A container that begins in the range, at event ``i``."""
        kind = chr(self.kind[i])
        yield int(self.at[i]), path, "object" if kind == "{" else "array", None
        closing = i + 1 + np.flatnonzero((self.step[i + 1 :] < 0) & (self.level[i + 1 :] == level))
        yield from self._inside(level, kind, path, i, int(closing[0]) if len(closing) else len(self.at))

    def _inside(self, level: int, kind: str, path: str, opener: int, closer: int) -> Iterator[tuple[int, str, str, str | None]]:
        """The values between the events ``opener`` (-1: before the range) and ``closer`` (the last: behind what was read)."""
        between = slice(opener + 1, closer)
        marks = opener + 1 + np.flatnonzero((self.level[between] == level) & (self.step[between] == 0))
        if closer < len(self.at):
            marks = np.append(marks, closer)
        elif self.whole:
            raise ValueError("not JSON: a bracket is left open")
        if kind == "[":
            begin = np.append(opener, marks) if opener >= 0 else marks
            for a, b in zip(begin, [*begin[1:], None]):
                if a == closer or self.at[a] >= self.stop:
                    break
                value = self._text(a, b)
                if value:
                    yield int(self.at[a]), path, "item", value
                elif b != closer or self.kind[a] == 44:
                    raise ValueError("not JSON: a value is missing")
            return
        if level < DEPTH:
            children = opener + 1 + np.flatnonzero((self.level[between] == level + 1) & (self.step[between] > 0))
            for i in children:
                if self.at[i] >= self.stop:
                    break
                name = _key_before(self.file, int(self.at[i]))
                inner = f"{path}.{name}" if path else str(name)
                if self.entered(inner):
                    yield from self._opened(i, level + 1, inner)
        for a, b in zip(marks, [*marks[1:], None]):
            if a == closer or self.at[a] >= self.stop:
                break
            if self.kind[a] != 58:
                continue
            name = _key_before(self.file, int(self.at[a]))
            inner = f"{path}.{name}" if path else str(name)
            head = self.data[self.at[a] + 1 - self.low :][:64].lstrip()[:1]
            if level < DEPTH and self.entered(inner) and head in (b"{", b"["):
                continue
            yield int(self.at[a]), inner, "member", self._text(a, b)

    def _text(self, a: int, b: int | None) -> str:
        """What stands between two events, trimmed."""
        if b is None:
            raise _Unfinished
        return self.data[self.at[a] + 1 - self.low : self.at[b] - self.low].strip(b" \t\r\n").decode()


def _outline_of(paths: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = [(r[f"open{n}"]["kind"], r[f"open{n}"]["at"]) for n in range(1, min(r["depth"], DEPTH) + 1)]
                with _File(r["file"]) as file:
                    rows = _Walk(file, r["start"], r["stop"], r["size"], r["inside"], r["depth"], held, paths).rows()
                at, path, kind, value = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([r["file"]] * len(rows), pa.string()), "start": pa.array([r["start"]] * len(rows), pa.int64()),
                        "at": pa.array(at, pa.int64()), "path": pa.array(path, pa.string()), "kind": pa.array(kind, pa.string()),
                        "value": pa.array(value, pa.string()),
                    }
                )

    return run


def json_outline(spark: SparkSession, path: str, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, at, path, kind, value) of JSON files, as a stored table.

    ``paths`` names the containers that are looked into, from the root: ``""`` is the root, ``"a.b"`` a member of its member
    ``a``. Each of them gives a row of kind ``object`` or ``array``, each value of such an array a row ``item``, each value of
    such an object that is not looked into itself a row ``member``; the value is its JSON text. ``start`` is the range where a
    row begins, ``at`` its place. Files that are no JSON fail the load or that of their values; an empty one gives no rows.
    """
    spark.dataSource.register(JsonRanges)
    ranges = stored(spark.read.format("json_ranges").option("rangeBytes", range_bytes).load(path), "json-ranges")
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    deep = ranges.withColumn("depth", F.coalesce(F.sum("net").over(earlier), F.lit(0)))

    def opened(level: int) -> Column:
        return F.try_element_at("opened", F.lit(level) - F.col("depth").cast("int"))

    levelled = deep.withColumns({f"open{n}": F.last(opened(n), ignorenulls=True).over(earlier) for n in range(1, DEPTH + 1)})
    tasks = max(1, -(-(ranges.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0) // range_bytes))
    spread = levelled.drop("net", "opened").repartition(int(tasks))
    return stored(spread.mapInArrow(_outline_of(["", *paths]), "file string, start bigint, at bigint, path string, kind string, value string"), "json-outline")


def numbered(rows: DataFrame, into: str = "input_index") -> DataFrame:
    """``rows`` (file, start, at, ...) with the number of each in its file, from 0.

    Rows are numbered within their range; one count per range carries the numbers on.
    """
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("file", "start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("file", "start").orderBy("at")) - 1
    return rows.withColumn("_within", within).join(before, ["file", "start"]).withColumn(into, (F.col("_before") + F.col("_within")).cast("int")).drop("_before", "_within")
