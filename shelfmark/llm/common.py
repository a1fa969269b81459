"""Shared helpers: written intermediate tables, bounded broadcasts, vectorised byte work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import scratch_path
from shelfmark.session import small_batches as small_batches

MASK = (1 << 64) - 1
#: Whether Spark deletes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes and rows that one round of numpy work takes; arrays of eight bytes a position stay below 8 MB.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 5_000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs no recompute.

    Parquet keeps it small and lets later reads prune columns. Shuffle files of the job go as soon as it is done, since
    later reads go to the table. The file system drops the folder when the application ends, ``drop`` does so before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    cleaned = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleaned)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` that nothing will read any more."""
    for df in tables:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(hadoop).delete(at, True)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Asks the file system that holds ``path`` to delete it when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else left to the planner.

    ``df`` should be cheap to read, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(identifier: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as ''."""
    text = F.coalesce(identifier.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


class Texts:
    """Some consecutive rows of a text column: their bytes one after the other, and where each starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.rows = len(offsets) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def ids(self, sizes: np.ndarray | None = None) -> np.ndarray:
        """The row of each byte."""
        return np.repeat(np.arange(self.rows), np.diff(self.offsets) if sizes is None else sizes)


def texts(column: pa.Array, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """A string column as slices of about ``size`` bytes and ``rows`` rows; nulls are empty. A longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    lengths = np.zeros(len(column) + 1, np.int64)
    if len(column):
        _, offsets, data = column.buffers()
        raw = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if column.null_count:
            valid = np.asarray(column.is_valid())
            sizes = np.where(valid, np.diff(raw), 0)
            if sizes.sum() != raw[-1] - raw[0]:
                data = np.concatenate([data[a:b] for a, b, v in zip(raw, raw[1:], valid) if v] or [data[:0]])
                raw = np.concatenate([[0], np.cumsum(sizes)])
        lengths = raw
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(lengths, lengths[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(column))
        yield Texts(data[lengths[start] : lengths[stop]], lengths[start : stop + 1] - lengths[start], start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (a multiply and xor-shift finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring from prefix sums: sum of value(byte) * base**position, modulo 2**64.

    ``base`` is odd, so it has an inverse, and a shift by a start position is a product.
    """

    def __init__(self, seed: int):
        state = np.random.default_rng(seed)
        self.values = state.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(state.integers(1 << 40, 1 << 60)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            back = pow(self.base, -1, 1 << 64)
            self.up, self.down = (self._powers(b, size) for b in (self.base, back))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base & MASK))
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        raw = (prefix[stops] - prefix[starts]) * self.down[starts]
        return mixed(raw + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_table(separators: bytes) -> np.ndarray:
    """Which bytes belong to words: all but the ``separators``."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Tokens of the size, language-model and shingle contracts stand between these bytes.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(part: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of each maximal run of bytes that are ``inside``; runs end with their row."""
    member = inside[part.data]
    if not len(member):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = np.flatnonzero(np.diff(part.offsets))
    heads, tails = part.offsets[full], part.offsets[full + 1] - 1
    first[heads] = member[heads]
    last[tails] = member[tails]
    starts = np.flatnonzero(first)
    return part.row_of(starts), starts, np.flatnonzero(last) + 1
