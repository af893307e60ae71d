"""Stream semantics: each operator as a batch job over a table and, where state is needed, as a streaming job.

Observations: stream_id, event_id, sequence, event_time, received_at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.scan import fold_in_blocks

cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])


def with_faults(observations: DataFrame) -> DataFrame:
    """With `fault` in order of arrival: duplicate (event id seen before), out_of_order (sequence below the one before), gap
    (more than one above it), else null. An equal sequence with a new id passes."""
    arrival = Window.partitionBy("stream_id").orderBy("received_at", "sequence", "event_id")
    again = F.row_number().over(Window.partitionBy("stream_id", "event_id").orderBy("received_at", "sequence"))
    before = F.lag("sequence").over(arrival)
    fault = F.when(F.col("_again") > 1, "duplicate").when(F.col("sequence") < F.col("_before"), "out_of_order").when(F.col("sequence") > F.col("_before") + 1, "gap")
    return observations.withColumn("_again", again).withColumn("_before", before).withColumn("fault", fault).drop("_again", "_before")


def stream_health(observations: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """(stream_id, status, events): the first fault in order of arrival; else stale if the last event is too old; else healthy."""
    order = F.struct("received_at", "sequence", "event_id")
    faulty = with_faults(observations)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max("event_time"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct(order.alias("o"), "fault")))
    return faulty.groupBy("stream_id").agg(F.count("*").alias("events"), F.coalesce(first["fault"], F.when(age > max_age_seconds, "stale").otherwise("healthy")).alias("status")).select("stream_id", "status", "events")


def fault_counts(observations: DataFrame, window: str | None = None, max_age_seconds: int = 300) -> DataFrame:
    """Faults of each kind by stream (and window of received_at); stale are events older than the age when they arrived."""
    keys = ["stream_id"] + ([F.window("received_at", window).alias("window")] if window else [])
    of = lambda name: F.count_if(F.col("fault") == name).alias(name)
    late = F.unix_timestamp("received_at") - F.unix_timestamp("event_time") > max_age_seconds
    return with_faults(observations).groupBy(*keys).agg(of("gap"), of("duplicate"), of("out_of_order"), F.count_if(late).alias("stale"))


def _walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One stream's arrivals of a micro-batch: its faults, and what is remembered for the next."""
    last, ids, status = (state.get[0], list(state.get[1]), state.get[2]) if state.exists else (None, [], "healthy")
    if state.hasTimedOut:
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({"stream_id": [key[0]], "event_id": [None], "sequence": [last], "fault": ["stale"]})
        return
    seen, out = set(ids), []
    for r in pd.concat(list(frames)).sort_values(["received_at", "sequence", "event_id"]).itertuples():
        fault = None
        if r.event_id in seen:
            fault = "duplicate"
        elif last is not None and r.sequence < last:
            fault = "out_of_order"
        elif last is not None and r.sequence > last + 1:
            fault = "gap"
        if r.event_id not in seen:
            seen.add(r.event_id)
            ids.append(r.event_id)
        last = int(r.sequence)
        status = fault if fault and status == "healthy" else status
        out.append((key[0], r.event_id, r.sequence, fault))
    state.update((last, ids, status))
    state.setTimeoutDuration(STALE_MS)
    yield pd.DataFrame(out, columns=["stream_id", "event_id", "sequence", "fault"])


#: The silence after which a stream is stale.
STALE_MS = 600_000


def stream_faults(observations: DataFrame) -> DataFrame:
    """with_faults as a streaming job: state by stream is the last sequence and the ids of all its events, so it
    grows with them and is written anew by each micro-batch; a timer tells of silence (fault stale, no event). Rows of one stream must share a type of event_id (long)."""
    return observations.groupBy("stream_id").applyInPandasWithState(_walk, "stream_id string, event_id long, sequence long, fault string", "last long, ids array<long>, status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idempotent_ingest(events: DataFrame, identity: list[str], time: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Events once each. On a stream: dropped within the watermark; on a table: the first by time stays."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(identity)
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(time))).where("_n = 1").drop("_n")


def frozen_after_gap(events: DataFrame, key: str, seq: str = "sequence") -> DataFrame:
    """Events with `accepted`: those of a key up to its first gap, each sequence once; what follows a gap waits."""
    order = Window.partitionBy(key).orderBy(seq)
    one = events.withColumn("_n", F.row_number().over(Window.partitionBy(key, seq).orderBy("event_id")))
    gap = one.withColumn("_g", F.when(F.col(seq) > F.coalesce(F.lag(seq).over(order), F.lit(0)) + 1, 1).otherwise(0))
    return gap.withColumn("accepted", (F.sum("_g").over(order.rangeBetween(Window.unboundedPreceding, 0)) == 0) & (F.col("_n") == 1)).drop("_n", "_g")


def threshold_alerts(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, instrument, observed, threshold) of quotes that meet an enabled rule. Rules may be few or one for
    every instrument; Spark broadcasts them if they are small, also against a stream of quotes. Conditions: above, below, change_pct_above, change_pct_below."""
    pct = (F.col("price") - F.col("previous_close")) / F.nullif("previous_close", F.lit(0.0)) * 100
    on = rules.where("enabled").select("rule_id", F.col("instrument").alias("_i"), "condition", "threshold")
    met = quotes.join(on, quotes["instrument"] == F.col("_i"))
    observed = F.when(F.col("condition").isin("above", "below"), F.col("price")).otherwise(pct)
    up = F.col("condition").isin("above", "change_pct_above")
    keep = [c for c in ("event_time",) if c in quotes.columns]
    return met.withColumn("observed", observed).where((up & (F.col("observed") >= F.col("threshold"))) | (~up & (F.col("observed") <= F.col("threshold")))).select("rule_id", "instrument", *keep, "observed", "threshold")


_ALERT = "fingerprint string, at timestamp, decision string, escalation long"


def _dedup(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened, last, level = state.get if state.exists else (False, None, 0)
    out = []
    for r in pd.concat(list(frames)).sort_values(["at", "acknowledge"]).itertuples():
        at = r.at.timestamp()
        if r.acknowledge:
            opened, decision = False, "acknowledged"
        elif opened and at - last < COOLDOWN_S:
            decision = "suppressed"
        else:
            level, opened, last, decision = (level + 1 if opened else 1), True, at, "raised"
        out.append((key[0], r.at, decision, level))
    state.update((opened, last if last is not None else 0.0, level))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _ALERT.split(", ")])


#: Seconds in which an open alert is not raised again.
COOLDOWN_S = 3600


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """(fingerprint, at, decision, escalation): raised, suppressed (open and within the cooldown) or acknowledged.

    alerts: fingerprint, at, acknowledge. Alerts of one time are taken with acknowledgements last, and a null
    acknowledgement is none. State by fingerprint is three numbers; runs on streams and tables alike."""
    if alerts.isStreaming:
        return alerts.groupBy("fingerprint").applyInPandasWithState(_dedup, _ALERT, "opened boolean, last double, level long", "append", GroupStateTimeout.NoTimeout)

    return _dedup_table(alerts)


def _dedup_table(alerts: DataFrame) -> DataFrame:
    """The same over a table: the alerts of a fingerprint as one sorted array, folded in the JVM."""
    at = lambda c: F.unix_micros(c)

    def step(s: Column, r: Column) -> Column:
        held = s["opened"] & (at(r["at"]) - s["last"] < COOLDOWN_S * 1_000_000)
        decision = F.when(r["acknowledge"], "acknowledged").when(held, "suppressed").otherwise("raised")
        raised = ~r["acknowledge"] & ~held
        level = F.when(raised, F.when(s["opened"], s["level"] + 1).otherwise(1)).otherwise(s["level"]).cast("long")
        return F.struct((~r["acknowledge"]).alias("opened"), F.when(raised, at(r["at"])).otherwise(s["last"]).alias("last"), level.alias("level"), decision.alias("decision"))

    start = F.struct(F.lit(False).alias("opened"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("level"), F.lit("").alias("decision"))
    rows = alerts.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("timestamp").alias("at"), F.coalesce("acknowledge", F.lit(False)).alias("acknowledge")))).alias("r"))
    return rows.select("fingerprint", F.explode(fold_in_blocks("r", start, step)).alias("o")).select("fingerprint", "o.r.at", "o.s.decision", F.col("o.s.level").alias("escalation"))


def freshness(events: DataFrame, as_of: Column, limit_seconds: int, by: str = "session") -> DataFrame:
    """By session: the last event not after `as_of`, its age, and whether that is within the limit."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.max("event_time"))
    return events.where(F.col("event_time") <= as_of).groupBy(by).agg(F.max("event_time").alias("last_event"), age.alias("age_seconds"), (age <= limit_seconds).alias("fresh"))


def heartbeat(beats: DataFrame, now: Column, stale_after_seconds: int, by: str = "component") -> DataFrame:
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max("event_time"))
    return beats.groupBy(by).agg(age.alias("age_seconds"), (age > stale_after_seconds).alias("stale"))


def starts_within(starts: DataFrame, window_seconds: int, maximum: int, by: str = "component") -> DataFrame:
    """Starts with how many came within the window before and with each, and whether that is allowed."""
    own = Window.partitionBy(by).orderBy("_s").rangeBetween(-window_seconds, 0)
    return starts.withColumn("_s", F.unix_timestamp("event_time")).withColumn("recent", F.count("*").over(own)).withColumn("allowed", F.col("recent") <= maximum).drop("_s")


def risk_breaches(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(scope, metric, value, bound, severity) of metrics over their limit. limits: metric, bound, severity, a row a metric."""
    return metrics.join(limits, "metric").where("value > bound or value is null").select("scope", "metric", "value", "bound", "severity")


def latest_metric(metrics: DataFrame) -> DataFrame:
    """The last value of each metric; in update mode on a stream."""
    return metrics.groupBy("metric").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and their sum by type and tumbling window; later than the watermark does not count on a stream."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", size).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
