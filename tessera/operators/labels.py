"""Forward-return labels with their interval and the reason when there is none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import AvailabilityPolicy, at_clock


@dataclass(frozen=True)
class LabelSpec:
    """kind: "o2c" (next open to the close of that session) or "o2o" (next open to the open `horizon` sessions later)."""

    kind: str = "o2c"
    horizon: int = 1
    benchmark: bool = False
    version: str = "v1"


def build_labels(spec: LabelSpec, bars: DataFrame, universe: DataFrame, sessions: DataFrame, instruments: DataFrame | None = None, benchmark: DataFrame | None = None, policy: AvailabilityPolicy = AvailabilityPolicy()) -> DataFrame:
    """A label for each eligible member and decision date.

    bars: instrument_id, trade_date, open, close, volume; universe: instrument_id, trade_date, eligible; sessions: trade_date,
    session_idx of one market; instruments: instrument_id, listing_date, delisting_date; benchmark: trade_date, open, close.
    The decision falls on the last session not after its date; entry is the next session's open. Reasons, in
    order: insufficient_future_sessions, listing_or_delisting_boundary, missing_or_suspended_observation,
    unexecutable_entry_observation, unexecutable_exit_observation, missing_benchmark_observation.
    """
    ahead = 0 if spec.kind == "o2c" else spec.horizon
    exit_price, exit_clock = ("close", "13:30:00") if spec.kind == "o2c" else ("open", "09:00:00")
    days = sessions.select("trade_date", "session_idx")
    on = lambda name, shift: days.select(F.col("trade_date").alias(name), (F.col("session_idx") - shift).alias("session_idx"))
    decided = universe.where("eligible").select("instrument_id", F.col("trade_date").alias("decision_date"))
    dated = decided.join(days.withColumnRenamed("trade_date", "decision_date"), "decision_date")
    dated = dated.join(on("entry_date", 1), "session_idx", "left").join(on("exit_date", 1 + ahead), "session_idx", "left")
    side = lambda prefix, price: bars.select("instrument_id", F.col("trade_date").alias(f"{prefix}_date"), F.col(price).alias(f"{prefix}_price"), F.col("volume").alias(f"{prefix}_volume"), F.lit(True).alias(f"{prefix}_seen"))
    full = dated.join(side("entry", "open"), ["instrument_id", "entry_date"], "left").join(side("exit", exit_price), ["instrument_id", "exit_date"], "left")
    if instruments is not None:
        full = full.join(instruments.select("instrument_id", "listing_date", "delisting_date"), "instrument_id", "left")
    else:
        full = full.withColumn("listing_date", F.lit(None).cast("date")).withColumn("delisting_date", F.lit(None).cast("date"))
    if spec.benchmark:
        level = lambda prefix, price: benchmark.select(F.col("trade_date").alias(f"{prefix}_date"), F.col(price).alias(f"{prefix}_level"))
        full = full.join(level("entry", "open"), "entry_date", "left").join(level("exit", exit_price), "exit_date", "left")
    outside = F.coalesce(F.col("entry_date") < F.col("listing_date"), F.lit(False)) | F.coalesce(F.col("exit_date") >= F.col("delisting_date"), F.lit(False))
    dead = lambda prefix: F.coalesce((F.col(f"{prefix}_price") <= 0) | (F.col(f"{prefix}_volume") <= 0) | F.col(f"{prefix}_price").isNull(), F.lit(True))
    reason = F.when(F.col("exit_date").isNull(), "insufficient_future_sessions").when(outside, "listing_or_delisting_boundary")
    reason = reason.when(F.col("entry_seen").isNull() | F.col("exit_seen").isNull(), "missing_or_suspended_observation")
    reason = reason.when(dead("entry"), "unexecutable_entry_observation").when(dead("exit"), "unexecutable_exit_observation")
    raw = F.col("exit_price") / F.nullif("entry_price", F.lit(0.0)) - 1
    market = F.col("exit_level") / F.nullif("entry_level", F.lit(0.0)) - 1 if spec.benchmark else F.lit(None).cast("double")
    if spec.benchmark:
        reason = reason.when(market.isNull(), "missing_benchmark_observation")
    judged = full.withColumn("invalid_reason", reason)
    good = F.col("invalid_reason").isNull()
    return judged.select(
        "instrument_id", "decision_date", policy.available(F.col("decision_date")).alias("decision_time"), F.lit(spec.kind).alias("label_kind"), F.lit(spec.version).alias("label_version"), F.lit(max(1, ahead)).alias("horizon_sessions"),
        "entry_date", "exit_date", F.when(good, raw - (market if spec.benchmark else 0)).alias("label_value"), F.when(good, raw).alias("raw_return"), F.when(good, market).alias("benchmark_return"),
        at_clock(F.col("entry_date"), "09:00:00").alias("label_interval_start"), at_clock(F.col("exit_date"), exit_clock).alias("label_interval_end"), good.alias("valid"), "invalid_reason",
    )
