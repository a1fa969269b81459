"""The event rules as Structured Streaming jobs.

Sinks are parquet folders with a checkpoint next to them; nothing is gathered on the
driver. ``run_available`` processes what there is and stops, which is also how the tests
run these jobs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from shelfmark.session import scratch_path
from shelfmark.streaming.events import ingest_conversions


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*") -> DataFrame:
    """New parquet files of a folder, as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    )


def run_available(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Write everything available to parquet and return what was written."""
    target = path or scratch_path(stream.sparkSession, "stream")
    started = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{target}-checkpoint")
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def _each_batch(stream: DataFrame, step: Callable[[DataFrame, int], DataFrame], target: str) -> str:
    def write(batch: DataFrame, number: int) -> None:
        # A micro-batch may be computed again when it is read again, and a stateful step could then let another of equal rows
        # through, so that ids found by one reading would be missing in the next. It is read once.
        spark = batch.sparkSession
        kept = scratch_path(spark, "micro-batch")
        batch.write.parquet(kept)
        step(spark.read.schema(batch.schema).parquet(kept), number).write.mode("overwrite").parquet(f"{target}/batch={number}")
        at = spark._jvm.org.apache.hadoop.fs.Path(kept)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    started = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{target}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return target


def run_batches(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str | None = None
) -> str:
    """Apply a batch operator to each micro-batch; each batch owns one folder of the result.

    A batch that is run again after a failure overwrites its folder, so rows are neither
    lost nor doubled.
    """
    target = path or scratch_path(stream.sparkSession, "batches")
    return _each_batch(stream, lambda batch, _: step(batch), target)


def unique_conversions(conversions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Conversions without exact repeats, the usual retry: same event id and payload digest within the delay.

    Rows that share only one of the two are left to ``store_conversions``: whether one is refused
    depends on what was accepted before it, and a refused row must reserve nothing.
    """
    missing = F.lit("\x00")
    return (
        conversions.filter("external_event_id is not null or payload_digest is not null")
        .withColumns({"_event": F.coalesce("external_event_id", missing), "_digest": F.coalesce("payload_digest", missing)})
        .withWatermark("occurred_at", delay)
        .dropDuplicatesWithinWatermark(["network", "_event", "_digest"])
        .drop("_event", "_digest")
    )


def store_conversions(conversions: DataFrame, order: str, path: str | None = None) -> str:
    """Settle each micro-batch, in ``order``, against the conversions of all earlier ones, and store what is accepted."""
    target = path or scratch_path(conversions.sparkSession, "conversions")

    def settle(batch: DataFrame, number: int) -> DataFrame:
        if number == 0:
            return ingest_conversions(batch, batch.limit(0), order)
        stored = batch.sparkSession.read.parquet(target).filter(F.col("batch") < number)
        return ingest_conversions(batch, stored, order)

    return _each_batch(conversions, settle, target)


def counts_by_link(
    events: DataFrame, link: str, at: str, width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Events per link and window, each window once, after the delay has passed."""
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"), link)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(link, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def conversions_with_clicks(
    conversions: DataFrame, clicks: DataFrame, within: str = "30 days", delay: str = "1 hour"
) -> DataFrame:
    """Conversions joined to their earlier click; unmatched ones come out once it is too late."""
    left = conversions.withWatermark("occurred_at", delay)
    right = clicks.select(
        F.col("affiliate_click_id").alias("_click"),
        F.col("affiliate_link_id").alias("click_link_id"),
        F.col("occurred_at").alias("clicked_at"),
    ).withWatermark("clicked_at", delay)
    on = (
        (F.col("affiliate_click_id") == F.col("_click"))
        & (F.col("clicked_at") <= F.col("occurred_at"))
        & (F.col("clicked_at") >= F.col("occurred_at") - F.expr(f"interval {within}"))
    )
    return left.join(right, on, "left").drop("_click")


def _views_of_session(timeout_ms: int):
    """State function: keeps the last path of a session, drops views that repeat it."""

    def step(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(chunks)).sort_values(["at", "view_id"], kind="stable")
        before = [last, *rows["path"].tolist()[:-1]]
        rows["referrer"] = pd.Series(before, index=rows.index, dtype="object")
        state.update((rows["path"].iloc[-1],))
        newest = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + timeout_ms)
        kept = rows[rows["path"] != rows["referrer"]]
        yield kept[["session", "view_id", "at", "path", "referrer"]]

    return step


def page_views(visits: DataFrame, skipped: Column, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Views (session, view_id, at, path) that count, with their referrer.

    Streaming form of ``history.page_views``. The last path of a session is forgotten after
    ``hours`` without a view, so state does not grow without end. A group is one session's
    rows of one micro-batch.
    """
    schema = T.StructType(
        [
            T.StructField("session", visits.schema["session"].dataType),
            T.StructField("view_id", visits.schema["view_id"].dataType),
            T.StructField("at", T.TimestampType()),
            T.StructField("path", T.StringType()),
            T.StructField("referrer", T.StringType()),
        ]
    )
    step = _views_of_session(hours * 3_600_000)
    public = visits.filter(~skipped).select(
        "session",
        "view_id",
        F.col("at").cast("timestamp").alias("at"),
        F.regexp_replace("path", r"[?#].*$", "").alias("path"),
    )
    return (
        public.withWatermark("at", delay)
        .groupBy("session")
        .applyInPandasWithState(
            step, schema, T.StructType([T.StructField("path", T.StringType())]), "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


#: Rows of a session that are held as one value of its state; more are held by their minutes.
HELD_ROWS = 10_000


def _missing(value) -> bool:
    return value is None or value != value


class _OrderedViews(StatefulProcessor):
    """Holds a session's views, and settles a minute of event time once the watermark has passed it.

    ``open`` keeps up to HELD_ROWS views as one value, the number of minutes in ``parts`` and the next timer; when more come,
    they go to ``held``, by minutes as parts, which ``parts`` counts. ``last`` is the path and time of the last view settled.
    A session has one timer at the end of its earliest minute, where all minutes that the watermark has passed are
    settled; another one, a millisecond past a whole minute, forgets the session or is set again.
    """

    def __init__(self, view_id: T.DataType, width_ms: int, forget_ms: int, held_rows: int):
        self.view_id, self.width, self.forget, self.most = view_id, width_ms, forget_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        minute = T.StructType([T.StructField("minute", T.LongType())])
        part = T.StructType([*minute, T.StructField("part", T.IntegerType())])
        rows = T.StructField("rows", T.BinaryType())
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([rows, T.StructField("minutes", T.LongType()), T.StructField("timer", T.LongType())]))
        self.held = handle.getMapState("held", part, T.StructType([rows]))
        self.parts = handle.getMapState("parts", minute, T.StructType([T.StructField("n", T.IntegerType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("path", T.StringType()), T.StructField("at_ms", T.LongType())]))

    def _minute(self, view: tuple) -> int:
        return view[0] // (self.width * 1000)

    def _by_minute(self, views: list[tuple]) -> dict[int, list[tuple]]:
        found: dict[int, list[tuple]] = {}
        for view in views:
            found.setdefault(self._minute(view), []).append(view)
        return found

    def _put_away(self, views: list[tuple]) -> int:
        """Adds views to ``held``; returns how many minutes are new there."""
        new = 0
        for minute, some in self._by_minute(views).items():
            known = self.parts.getValue((minute,))
            n = known[0] if known else 0
            self.held.updateValue((minute, n), (pickle.dumps(some),))
            self.parts.updateValue((minute,), (n + 1,))
            new += not known
        return new

    def _keep(self, views: list[tuple], minutes: int, timer: int, least: int | None) -> None:
        """Stores what is open; ``least`` is the earliest minute, for which a timer stands from then on."""
        if least is None:
            self.open.clear()
            return
        end = (least + 1) * self.width
        if not timer or end < timer:
            self.handle.registerTimer(end)
            timer = end
        self.open.update((pickle.dumps(views), minutes, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = self.open.get()
        views, minutes, timer = (pickle.loads(known[0]), known[1], known[2]) if known else ([], 0, 0)
        least = None
        for chunk in rows:
            chunk = chunk[chunk["at_us"] >= watermark * 1000]
            if not len(chunk):
                continue
            first = int(chunk["at_us"].min()) // (self.width * 1000)
            least = first if least is None else min(least, first)
            views.extend(zip(chunk["at_us"].tolist(), chunk["view_id"].tolist(), chunk["path"].tolist()))
            if len(views) > self.most:
                minutes += self._put_away(views)
                views = []
        if least is not None:
            self._keep(views, minutes, timer, least)
        return iter(())

    def _forgotten(self, newest: int) -> int:
        return (newest + self.forget) // self.width * self.width + self.width + 1

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        if expiry % self.width:
            newest = self.last.get()[1]
            if newest + self.forget < expiry:
                self.last.clear()
            else:
                self.handle.registerTimer(self._forgotten(newest))
            return
        known = self.open.get()
        if not known or known[2] != expiry:  # an earlier minute came after this timer was set, and took it along
            return
        passed = max(expiry, timerValues.getCurrentWatermarkInMs()) // self.width
        views, minutes = pickle.loads(known[0]), known[1]
        done = [v for v in views if self._minute(v) < passed]
        left = [v for v in views if self._minute(v) >= passed]
        least = min(map(self._minute, left), default=None)
        if not minutes:
            yield from self._settled(key, done)
        else:
            rest = self._by_minute(done)
            counts = {int(k[0]): self.parts.getValue(k)[0] for k in list(self.parts.keys())}
            for minute in sorted({*rest, *(m for m in counts if m < passed)}):
                some = rest.get(minute, [])
                for i in range(counts.get(minute, 0)):
                    some = some + pickle.loads(self.held.getValue((minute, i))[0])
                    self.held.removeKey((minute, i))
                if minute in counts:
                    self.parts.removeKey((minute,))
                    minutes -= 1
                yield from self._settled(key, some)
            least = min([*([] if least is None else [least]), *(m for m in counts if m >= passed)], default=None)
        self._keep(left, minutes, 0, least)

    def _settled(self, key: tuple, views: list[tuple]) -> Iterator[pd.DataFrame]:
        """The views that count of some that follow those settled before."""
        if not views:
            return
        views.sort(key=lambda v: (v[0], _missing(v[1]), 0 if _missing(v[1]) else v[1]))
        last = self.last.get()
        before = [last[0] if last else None, *[v[2] for v in views[:-1]]]
        newest = int(views[-1][0]) // 1000
        self.last.update((views[-1][2], newest))
        if not last:
            self.handle.registerTimer(self._forgotten(newest))
        kept = [(key[0], v[1], v[0], v[2], b) for v, b in zip(views, before) if v[2] is None or v[2] != b]
        if kept:
            yield pd.DataFrame(kept, columns=["session", "view_id", "at_us", "path", "referrer"], dtype="object")


def ordered_page_views(visits: DataFrame, skipped: Column, hours: int = 24, delay: str = "1 hour", width_ms: int = 60_000, held_rows: int = HELD_ROWS) -> DataFrame:
    """Views (session, view_id, at, path) that count, with their referrer, in the order of event time across micro-batches.

    A view waits until the watermark, ``delay`` behind the newest view, has passed its minute (``width_ms``); views of a
    session may therefore come in any order within the delay. One older than the watermark is late and left out. A task
    holds one chunk of input and up to ``held_rows`` views, or one minute of one session, whatever the session's length; the
    rest is in the state store, which must be that of RocksDB and is set to it here. A session's last path is forgotten after ``hours``
    without a view.
    """
    visits.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    kinds = {n: visits.schema[n].dataType for n in ("session", "view_id")}
    schema = T.StructType(
        [*[T.StructField(n, t) for n, t in kinds.items()], T.StructField("at_us", T.LongType()), T.StructField("path", T.StringType()), T.StructField("referrer", T.StringType())]
    )
    public = visits.filter(~skipped).select(
        "session", "view_id", F.col("at").cast("timestamp").alias("at"), F.regexp_replace("path", r"[?#].*$", "").alias("path")
    )
    timed = public.filter("at is not null").withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    processor = _OrderedViews(kinds["view_id"], width_ms, hours * 3_600_000, held_rows)
    found = timed.groupBy("session").transformWithStateInPandas(processor, schema, "append", "EventTime")
    return found.select("session", "view_id", F.timestamp_micros("at_us").alias("at"), "path", "referrer")


def seen_bounds(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last sighting per key; for update mode through ``run_batches``."""
    return events.groupBy(*keys).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at")
    )
