"""Streaming jobs with keyed state: what a micro-batch reads and writes grows with its rows, not with a stream's history.

State lives in RocksDB (set `STORE` in the session first); a map's entries are single keys there, so a micro-batch touches the
entries of its own events. Each job has a batch twin with the same rows: health.with_faults, contiguous_fills,
health.heartbeat and health.starts_within.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

#: The setting that these jobs need, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator:
    """The arrivals of a key in a micro-batch, in order."""
    return pd.concat(list(frames)).sort_values(by, kind="stable").itertuples()


def _ms(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class _Faults(StatefulProcessor):
    """The last sequence of a stream, and a map entry for each event id that expires after the bound."""

    def __init__(self, bound_ms: int, silence_ms: int) -> None:
        self.bound_ms, self.silence_ms = bound_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, timer long")
        self.seen = handle.getMapState("seen", "event_id long", "at long", self.bound_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        last, timer = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in _rows(rows, ["received_at", "sequence", "event_id"]):
            event = (int(r.event_id),)
            again = self.seen.containsKey(event)
            fault = "duplicate" if again else "out_of_order" if last is not None and r.sequence < last else "gap" if last is not None and r.sequence > last + 1 else None
            if not again:
                self.seen.updateValue(event, (_ms(r.received_at),))
            last = int(r.sequence)
            out.append((key[0], event[0], last, fault))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(timer)
        self.last.update((last, timer))
        yield pd.DataFrame(out, columns=["stream_id", "event_id", "sequence", "fault"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        last, _ = self.last.get()
        self.last.update((last, None))
        yield pd.DataFrame({"stream_id": [key[0]], "event_id": [None], "sequence": [last], "fault": ["stale"]}).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def event_faults(observations: DataFrame, bound_seconds: int = 86_400, silence_seconds: int = 600) -> DataFrame:
    """(stream_id, event_id, sequence, fault) of each arrival, faults as in health.with_faults; `stale` with no event after a silence.

    observations: stream_id, event_id (long), sequence, received_at; a stream. An event id is remembered for `bound_seconds` of
    processing time after it came: a copy within the bound is a duplicate, one after it is judged by its sequence. Rows of one
    micro-batch are taken in order of received_at. The timers run on processing time, so batches without data go on; a job that is to end
    by itself (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off."""
    schema = "stream_id string, event_id long, sequence long, fault string"
    return observations.groupBy("stream_id").transformWithStateInPandas(_Faults(bound_seconds * 1000, silence_seconds * 1000), schema, "append", "ProcessingTime")


#: Columns of contiguous_fills, as a job and as its twin.
FILLS = "order_id string, sequence long, event_id long, status string, filled long"


class _Reorder(StatefulProcessor):
    """The next sequence of an order, and the events that came before their turn."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "next long, filled long, frozen boolean")
        self.waiting = handle.getMapState("waiting", "sequence long", "event_id long, quantity long, ordered long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        following, filled, frozen = self.done.get() if self.done.exists() else (1, 0, False)
        out = []
        for r in _rows(rows, ["event_time", "sequence", "event_id"]):
            sequence, event = int(r.sequence), int(r.event_id)
            if sequence < following or self.waiting.containsKey((sequence,)):
                out.append((key[0], sequence, event, "duplicate", None))
            elif frozen:
                out.append((key[0], sequence, event, "frozen", None))
            else:
                self.waiting.updateValue((sequence,), (event, int(r.quantity), int(r.ordered)))
                if sequence > following:
                    self.handle.registerTimer(_ms(r.event_time) + self.wait_ms)
            while not frozen and self.waiting.containsKey((following,)):
                event, quantity, ordered = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
                if filled + quantity > ordered:
                    frozen = True
                    out.append((key[0], following, event, "over_fill", filled))
                else:
                    filled += quantity
                    out.append((key[0], following, event, "accepted", filled))
                following += 1
            if frozen:
                out += self._given_up(key[0])
        self.done.update((following, filled, frozen))
        yield self._frame(out)

    def _given_up(self, order: str) -> list[tuple]:
        left = sorted((s[0], v[0]) for s, v in self.waiting.iterator())
        self.waiting.clear()
        return [(order, s, e, "frozen", None) for s, e in left]

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["order_id", "sequence", "event_id", "status", "filled"]).astype({"filled": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        following, filled, frozen = self.done.get()
        if frozen or not any(True for _ in self.waiting.keys()):
            return
        self.done.update((following, filled, True))
        yield self._frame(self._given_up(key[0]))

    def close(self) -> None:
        pass


def ordered_fills(events: DataFrame, wait: str = "1 hour", wait_seconds: int = 3_600) -> DataFrame:
    """I3 as a stream: (order_id, sequence, event_id, status, filled). Events are released in order of sequence, from 1, without a gap.

    events: order_id, sequence, event_id, event_time, quantity, ordered (the order's quantity). status: accepted (filled is the sum so far);
    over_fill for the event that would exceed the order, which freezes it; duplicate for a sequence that was
    taken or waits; frozen for all after an over-fill, and for those that waited until the watermark passed their
    time by `wait_seconds` while a sequence before them was missing. Within that wait any order of arrival gives the accepted and
    over_fill rows of contiguous_fills. Which of several events with one sequence is taken: the first to come."""
    return events.withWatermark("event_time", wait).groupBy("order_id").transformWithStateInPandas(_Reorder(wait_seconds * 1000), FILLS, "append", "EventTime")


def contiguous_fills(events: DataFrame) -> DataFrame:
    """The batch twin of ordered_fills: a table of events; of those with one sequence the least (event_time, event_id) is taken, what follows a gap or an over-fill is frozen."""
    copy = F.row_number().over(Window.partitionBy("order_id", "sequence").orderBy("event_time", "event_id"))
    order = Window.partitionBy("order_id", "_again").orderBy("sequence")
    marked = events.withColumn("_again", copy > 1)
    gap = F.col("sequence") != F.row_number().over(order)  # without copies the sequences are 1, 2, 3, ...
    summed = F.sum("quantity").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("_gap", gap).withColumn("_sum", summed)
    over = (~F.col("_gap")) & (F.col("_sum") > F.col("ordered"))
    rows = rows.withColumn("_over", over).withColumn("_before", F.coalesce(F.max("_over").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    status = F.when(F.col("_again"), "duplicate").when(F.col("_gap") | F.col("_before"), "frozen").when(F.col("_over"), "over_fill").otherwise("accepted")
    filled = F.when(status == "accepted", F.col("_sum")).when(status == "over_fill", F.col("_sum") - F.col("quantity"))
    return rows.select("order_id", "sequence", "event_id", status.alias("status"), filled.cast("long").alias("filled"))


#: Columns of component_watch.
WATCH = "component string, at timestamp, kind string, recent long, allowed boolean"


class _Watch(StatefulProcessor):
    """The last beat of a component with the timer that would tell of its silence, and a ring of its last starts."""

    def __init__(self, stale_ms: int, window_ms: int, maximum: int) -> None:
        self.stale_ms, self.window_ms, self.maximum = stale_ms, window_ms, maximum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "last long, timer long")
        self.starts = handle.getValueState("starts", "at array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        last, timer = self.beat.get() if self.beat.exists() else (None, None)
        set_before = timer
        ring = list(self.starts.get()[0]) if self.starts.exists() else []
        out = []
        for r in _rows(rows, ["event_time"]):
            at = _ms(r.event_time)
            if timer is not None and at - last > self.stale_ms:  # the silence ended before its timer told of it
                out.append((key[0], pd.Timestamp(last + self.stale_ms, unit="ms"), "stale", None, None))
            last = at if last is None else max(last, at)
            timer = -1 if timer is None else timer
            if r.kind == "start":
                ring = sorted([*ring, at])[-(self.maximum + 1) :]  # one more than allowed is enough to refuse
                recent = sum(at - self.window_ms <= s <= at for s in ring)
                out.append((key[0], r.event_time, "start", recent, recent <= self.maximum))
        if set_before is not None:
            self.handle.deleteTimer(set_before)
        timer = last + self.stale_ms
        self.handle.registerTimer(timer)
        self.beat.update((last, timer))
        self.starts.update((ring,))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        last, timer = self.beat.get()
        if timer is None or expiredTimerInfo.getExpiryTimeInMs() < timer:
            return
        self.beat.update((last, None))
        yield self._frame([(key[0], pd.Timestamp(timer, unit="ms"), "stale", None, None)])

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["component", "at", "kind", "recent", "allowed"]).astype({"recent": "Int64", "allowed": "boolean"})

    def close(self) -> None:
        pass


def component_watch(beats: DataFrame, stale_seconds: int, window_seconds: int, maximum: int, delay: str = "1 minute") -> DataFrame:
    """I6, I7 as a stream: (component, at, kind, recent, allowed).

    beats: component, event_time, kind ('beat' or 'start', which is a beat too). A `start` row tells how many starts came
    within the window up to it (counted to maximum + 1) and whether that is allowed. A `stale` row tells of a silence of over `stale_seconds`; `at`
    is when that was reached. It comes from a timer as the watermark passes it, without any new row of the component, or with
    the beat that ends the silence if that comes first; so the rows do not depend on how micro-batches are cut."""
    return beats.withWatermark("event_time", delay).groupBy("component").transformWithStateInPandas(_Watch(stale_seconds * 1000, window_seconds * 1000, maximum), WATCH, "append", "EventTime")


def route_late(events: DataFrame, folder: str, checkpoint: str, delay_seconds: int, time: str = "event_time"):
    """A stream writer that keeps late rows apart instead of dropping them. Start it with .start().

    Each micro-batch n writes `on_time/batch=n` and `late/batch=n` and, last, `progress/batch=n`: the greatest event time seen up to it.
    Late is a row whose time is `delay_seconds` or more before the greatest time of the batches before, as
    read from their progress. A batch that is run again finds the same progress and writes the same
    folders over, so nothing is there twice and late + on-time are all rows; rows without a time are late."""

    def progress(spark: SparkSession, number: int):
        found = spark.read.schema("seen timestamp, batch long").parquet(f"{folder}/progress").where(F.col("batch") < number)
        return found.agg(F.max("seen")).first()[0]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = progress(spark, number) if number else None
        late = F.col(time).isNull() | (F.lit(False) if before is None else F.col(time) <= F.lit(before) - F.expr(f"INTERVAL {delay_seconds} SECONDS"))
        kept = df.withColumn("_late", late).persist()
        try:
            for name, wanted in (("on_time", ~F.col("_late")), ("late", F.col("_late"))):
                kept.where(wanted).drop("_late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            kept.agg(F.max(time).cast("timestamp").alias("seen")).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
