"""The interval that wins at an instant, by one sorted pass over points and intervals together.

Points and intervals of a key meet in one task in the order of time. The pass keeps the open intervals in a heap and gives each
point the best of them, so a task holds open intervals only, never a key's points. A key with very many rows is cut into ranges
of time at quantiles of its own instants: an interval is a piece in the range where it begins and one in the range where
it ends, and of all that cover a range whole only the winner is carried into it. Ranges full of one instant are dealt
to several tasks. So a key of any size is spread, and each point is one row that travels once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from shelfmark.session import stored

#: Rows of a key from which it is cut into ranges, and the most ranges of a key.
HOT_ROWS, RANGES = 1_000_000, 1024
#: Cuts are looked up in two steps of this many.
CHUNK = 32
#: Hot keys whose ranges every task may hold.
BROADCAST_KEYS = 5_000
# Microseconds per unit of interval bounds.
UNITS = {"day": 86_400_000_000, "second": 1_000_000, "microsecond": 1}
FIRST, LAST = 0, (1 << 63) - 1


def _micros(c: Column) -> Column:
    """Microseconds since 0001-01-01 of a timestamp without zone; never negative."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'0001-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def _bound(c: Column, unit: str) -> Column:
    """An interval bound in microseconds; one inside a unit fails the job."""
    failed = F.raise_error(F.lit(f"interval bound is not a whole {unit}")).cast("bigint")
    return F.when(F.pmod(_micros(c), F.lit(UNITS[unit]).cast("bigint")) != 0, failed).otherwise(_micros(c))


def _hot_ranges(asked: DataFrame, spans: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Per hot key, if there is one: its cuts in chunks ``_chunks``, the first of each ``_firsts``, and into how many tasks each range is dealt.

    Cuts are quantiles of all instants of the key. An instant that is several of them holds that many shares of its rows.
    """
    times = asked.select(*keys, "_t").unionAll(spans.select(*keys, F.col("_start").alias("_t")))
    times = times.unionAll(spans.filter(F.col("_stop") < LAST).select(*keys, F.col("_stop").alias("_t")))
    big = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    if big.isEmpty():
        return None
    shares = F.expr(f"array({', '.join(f'{i / RANGES!r}D' for i in range(1, RANGES))})")
    found = times.join(big, keys).groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx("_t", shares, 10_000).alias("_all"))
    parts = F.least(F.lit(RANGES), F.ceil(F.col("_n") * 2 / hot_rows)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_all", F.call_function("div", i * RANGES, parts).cast("int") - 1))
    cuts = found.withColumn("_some", chosen).withColumn("_cuts", F.array_distinct("_some"))
    dealt = F.transform("_cuts", lambda c: F.size(F.filter("_some", lambda s: s == c)))
    starts = F.sequence(F.lit(0), F.size("_cuts") - 1, F.lit(CHUNK))
    return cuts.select(
        *keys,
        F.concat(F.array(F.lit(1)), dealt).alias("_dealt"),
        F.transform(starts, lambda i: F.slice("_cuts", i + 1, F.lit(CHUNK))).alias("_chunks"),
        F.transform(starts, lambda i: F.get("_cuts", i)).alias("_firsts"),
    )


def _range_of(t: Column) -> Column:
    """The number of cuts up to ``t``; 0 where a key has none."""
    chunk = F.size(F.filter("_firsts", lambda c: c <= t))
    inside = F.size(F.filter(F.get("_chunks", chunk - 1), lambda c: c <= t))
    return F.when(F.col("_firsts").isNull() | (chunk == 0), F.lit(0)).otherwise((chunk - 1) * CHUNK + inside)


def _covered(first: Column, stop: Column) -> Column:
    """The ranges from ``first`` up to ``stop`` as aligned blocks of 2**level, at most two a level."""
    empty = F.array().cast("array<int>")

    def run(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(empty)

    def at(level: int) -> Column:
        up = lambda c, n: F.shiftright(c + F.lit((1 << n) - 1), n)
        left, right = up(first, level), F.shiftright(stop, level)
        inner_left, inner_right = up(first, level + 1), F.shiftright(stop, level + 1)
        edges = F.concat(run(left, inner_left * 2), run(inner_right * 2, right))
        numbers = F.when(inner_left < inner_right, edges).otherwise(run(left, right))
        return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))

    return F.flatten(F.array(*[at(k) for k in range(RANGES.bit_length())]))


def _pieces(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of hot keys as pieces in ranges; those that cover a range whole are one, the best."""
    held = ["_order", "_payload"]
    best = F.min(F.struct(*held)).alias("_best")
    placed = spans.withColumns({"_from": _range_of(F.col("_start")), "_to": _range_of(F.col("_stop") - 1)})
    begin = placed.select(*keys, F.col("_from").alias("_range"), "_start", F.when(F.col("_from") == F.col("_to"), F.col("_stop")).otherwise(LAST).alias("_stop"), *held)
    end = placed.filter("_from < _to").select(*keys, F.col("_to").alias("_range"), F.lit(FIRST).cast("bigint").alias("_start"), "_stop", *held)
    edges = begin.unionAll(end).groupBy(*keys, "_range", "_start", "_stop").agg(best)
    nodes = placed.filter("_from + 1 < _to").select(*keys, F.inline(_covered(F.col("_from") + 1, F.col("_to"))), *held).groupBy(*keys, "level", "block").agg(best)
    width = F.call_function("shiftleft", F.lit(1), F.col("level"))
    ranges = F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1)
    whole = nodes.select(*keys, F.explode(ranges).alias("_range"), "_best").groupBy(*keys, "_range").agg(F.min("_best").alias("_best"))
    carried = whole.select(*keys, "_range", F.lit(FIRST).cast("bigint").alias("_start"), F.lit(LAST).cast("bigint").alias("_stop"), "_best")
    return edges.unionAll(carried).select(*keys, "_range", "_start", "_stop", "_best._order", "_best._payload")


def _ordered(value: object) -> object:
    """A value that compares as Spark compares it: nulls first, text by code point, structs by their fields."""
    if isinstance(value, dict):
        return tuple(map(_ordered, value.values()))
    return (value is not None, value)


class _Sweep:
    """Open intervals of the key and range that rows are read of."""

    def __init__(self) -> None:
        self.place: dict | None = None
        self.heap: list[tuple] = []
        self.seen = 0

    def changes(self, places: pa.StructArray) -> np.ndarray:
        """Where a key or range begins."""
        out = np.zeros(len(places), bool)
        out[0] = places[0].as_py() != self.place
        for part in places.flatten():
            out[1:] |= np.asarray(pc.not_equal(part.slice(1), part.slice(0, len(part) - 1)).cast(pa.uint8())).astype(bool)
        self.place = places[-1].as_py()
        return out

    def open(self, stop: int, order: object, payload: object) -> None:
        self.seen += 1  # equal orders never compare payloads
        heapq.heappush(self.heap, (order, self.seen, stop, payload))

    def winners(self, times: np.ndarray, out: list[object]) -> None:
        """Appends the winner at each of ``times``, in order, none of which another interval opens before."""
        at = 0
        while at < len(times):
            while self.heap and self.heap[0][2] <= times[at]:
                heapq.heappop(self.heap)
            if not self.heap:
                out.extend([None] * (len(times) - at))
                return
            upto = int(np.searchsorted(times, self.heap[0][2], "left"))
            out.extend([self.heap[0][3]] * (upto - at))
            at = upto


def _pass(outer: bool, payload: DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()
        for batch in batches:
            if not batch.num_rows:
                continue
            times = np.asarray(batch.column("_t"))
            span = np.asarray(batch.column("_stop").is_valid())
            changed = sweep.changes(batch.column("_place"))
            breaks = np.flatnonzero(span | changed).tolist()
            out: list[object] = []
            rows = np.flatnonzero(~span)
            for first, stop in zip([0, *breaks], [*breaks, batch.num_rows]):
                if first < stop:
                    here = first
                    if changed[first]:
                        sweep.heap = []
                    if span[first]:
                        interval = batch.slice(first, 1)
                        sweep.open(interval.column("_stop")[0].as_py(), _ordered(interval.column("_order")[0].as_py()), interval.column("_payload")[0].as_py())
                        here += 1
                    sweep.winners(times[here:stop], out)
            keep = np.array([o is not None for o in out], bool) if not outer else np.ones(len(out), bool)
            ids = batch.column("_id").take(pa.array(rows[keep]))
            found = pa.array([o for o, k in zip(out, keep) if k], batch.schema.field("_payload").type)
            yield pa.RecordBatch.from_arrays([ids, found], names=["_id", "_payload"])

    return run


def best_at(
    points: DataFrame,
    point_key: Sequence[str],
    at: str,
    point_id: Sequence[str],
    intervals: DataFrame,
    interval_key: Sequence[str],
    valid_from: str,
    valid_until: str,
    order: Sequence[Column],
    payload: Sequence[str],
    unit: str = "microsecond",
    outer: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``point_id`` of each point with the ``payload`` of the winning interval of its key at its instant.

    An interval ``[valid_from, valid_until)`` (a null end is open) wins if it is the least by ``order`` of those of
    the key that hold the instant. Interval bounds must be whole multiples of ``unit``; points may fall anywhere. Points
    without a winner are left out, or have a null payload if ``outer``; null keys and instants have none. Each row of
    ``points`` counts, repeated ones too. Both sides are stored in the columns needed, so that they are made once; keys of
    more than ``hot_rows`` points and bounds, which are cut into ranges, are counted on them.
    """
    keys = [f"_k{i}" for i in range(len(interval_key))]
    known = " and ".join(f"{k} is not null" for k in keys)
    identity = F.struct(*[F.col(c) for c in point_id]).alias("_id")
    every = points.select(*[F.col(c).alias(k) for c, k in zip(point_key, keys)], _micros(F.col(at)).alias("_t"), identity)
    asked = every.filter(f"{known} and _t is not null")
    spans = intervals.select(
        *[F.col(c).try_cast(every.schema[k].dataType).alias(k) for c, k in zip(interval_key, keys)],
        F.coalesce(_bound(F.col(valid_from), unit), F.lit(FIRST)).alias("_start"),
        F.coalesce(_bound(F.col(valid_until), unit), F.lit(LAST)).alias("_stop"),
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"),
        F.struct(*payload).alias("_payload"),
    ).filter(f"{known} and _start < _stop")
    held_types = {f.name: f.dataType for f in spans.schema.fields if f.name in ("_order", "_payload")}
    asked, spans = stored(asked, "points"), stored(spans, "intervals")
    hot = _hot_ranges(asked, spans, keys, hot_rows)
    if hot is not None:
        hot = stored(hot, "hot-keys")
        hot_keys = hot.count()
        beside = F.broadcast(hot) if hot_keys <= BROADCAST_KEYS else hot
        salts = F.get("_dealt", F.col("_range"))
        asked = asked.join(beside, keys, "left").withColumn("_range", _range_of(F.col("_t")))
        asked = asked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id", F.spark_partition_id()), salts), F.lit(0)).cast("int"))
        cold = spans.join(beside, keys, "left_anti").withColumns({"_range": F.lit(0), "_salt": F.lit(0)})
        cut = _pieces(spans.join(beside, keys), keys).join(beside, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        columns = [*keys, "_range", "_salt", "_start", "_stop", "_order", "_payload"]
        spans = cold.select(*columns).unionAll(cut.select(*columns))
    else:
        asked, spans = (df.withColumns({"_range": F.lit(0), "_salt": F.lit(0)}) for df in (asked, spans))
    place = F.struct(*keys, "_range", "_salt").alias("_place")
    none = {n: F.lit(None).cast(t).alias(n) for n, t in held_types.items()}
    left = asked.select(place, "_t", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_stop"), none["_order"], none["_payload"], "_id")
    no_id = F.lit(None).cast(asked.schema["_id"].dataType).alias("_id")
    right = spans.select(place, F.col("_start").alias("_t"), F.lit(0).alias("_kind"), "_stop", "_order", "_payload", no_id)
    sorted_rows = left.unionAll(right).repartition("_place").sortWithinPartitions("_place", "_t", "_kind")
    schema = StructType([StructField("_id", asked.schema["_id"].dataType), StructField("_payload", held_types["_payload"])])
    found = sorted_rows.mapInArrow(_pass(outer, held_types["_payload"]), schema)
    if outer:
        found = found.unionAll(every.filter(f"not ({known} and _t is not null)").select("_id", none["_payload"]))
    return found.select("_id.*", "_payload.*")
