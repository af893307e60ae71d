"""Portfolio targets from predictions, rebalance dates, coverage rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class TargetPolicy:
    """method: top_k (k), quantile (q of the rows, rounded up) or threshold (prediction above t); the cash buffer, the most
    of one weight, and whether a list shorter than k is used or held in cash."""

    method: str = "top_k"
    k: int = 10
    q: float = 0.2
    t: float = 0.0
    buffer: float = 0.05
    cap: float = 0.2
    short_list: str = "use_available"


def build_targets(predictions: DataFrame, policy: TargetPolicy = TargetPolicy()) -> DataFrame:
    """Every row with `rank`, `selected`, `weight` and `reason`. predictions: decision_time, instrument_id, prediction (null: not ranked)."""
    w = Window.partitionBy("decision_time")
    good = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    ranked = predictions.withColumn("_ok", good).withColumn("rank", F.when(good, F.row_number().over(w.orderBy(F.desc("_ok"), F.desc("prediction"), "instrument_id")))).withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w))
    inside = {"top_k": F.col("rank") <= policy.k, "quantile": F.col("rank") <= F.ceil(F.round(F.col("_n") * policy.q, 9)), "threshold": F.col("prediction") > policy.t}[policy.method]
    picked = ranked.withColumn("_in", F.coalesce(inside, F.lit(False)))
    counted = picked.withColumn("_c", F.sum(F.col("_in").cast("int")).over(w))
    held = (F.col("_c") < policy.k) & F.lit(policy.method == "top_k" and policy.short_list == "hold_cash")
    chosen = F.col("_in") & ~held
    weight = F.when(chosen, F.least(F.lit(1 - policy.buffer) / F.nullif("_c", F.lit(0)), F.lit(policy.cap))).otherwise(0.0)
    reason = F.when(~F.col("_ok"), "missing_prediction").when(F.col("_in") & held, "insufficient_candidates").when(chosen, "selected").otherwise("not_selected")
    return counted.select(*predictions.columns, "rank", chosen.alias("selected"), weight.alias("weight"), reason.alias("reason"))


def rebalance_dates(sessions: DataFrame, freq: str = "daily", n: int = 1) -> DataFrame:
    """Sessions on which to trade: daily, every n-th (from the first), or weekly (the first of each ISO week)."""
    if freq == "daily":
        return sessions.select("trade_date")
    if freq == "every_n":
        return sessions.where((F.col("session_idx") - 1) % n == 0).select("trade_date")
    return sessions.groupBy(F.expr("extract(YEAROFWEEK FROM trade_date)").alias("_y"), F.weekofyear("trade_date").alias("_w")).agg(F.min("trade_date").alias("trade_date")).select("trade_date")


def apply_coverage_policy(targets: DataFrame, universe: DataFrame, minimum: float = 0.8, on_missing: str = "liquidate", on_fail: str = "skip") -> DataFrame:
    """Targets of decisions that predict enough of their universe, with rows for the members that lack one.

    on_missing: liquidate (weight 0), hold (weight null) or skip (no row); on_fail: skip such decisions or raise."""
    member = universe.select("decision_time", "instrument_id")
    own = targets.select("decision_time", "instrument_id", "weight", F.lit(True).alias("_has"))
    met = member.join(own, ["decision_time", "instrument_id"], "left").withColumn("coverage", F.count("_has").over(Window.partitionBy("decision_time")) / F.count("*").over(Window.partitionBy("decision_time")))
    if on_fail == "fail" and met.where(F.col("coverage") < minimum).limit(1).count():
        raise ValueError("a decision covers too little of its universe")
    enough = met.where(F.col("coverage") >= minimum)
    if on_missing == "skip":
        enough = enough.where("_has")
    filled = F.when(F.col("_has"), F.col("weight")).otherwise(F.lit(0.0 if on_missing == "liquidate" else None).cast("double"))
    return enough.select("decision_time", "instrument_id", filled.alias("weight"), F.coalesce("_has", F.lit(False)).alias("predicted"), "coverage")


def equal_weight(df: DataFrame, places: int = 6) -> DataFrame:
    """With `weight`: one over the rows of the session rounded down, the remainder on the last instrument."""
    w = Window.partitionBy("session")
    scale = 10**places
    base = F.floor(F.lit(scale) / F.count("*").over(w))
    last = F.row_number().over(w.orderBy(F.desc("instrument_id"))) == 1
    return df.withColumn("weight", (base + F.when(last, F.lit(scale) - base * F.count("*").over(w)).otherwise(0)) / scale)


def buy_and_hold(df: DataFrame) -> DataFrame:
    """Equal weights on the first session only."""
    first = df.agg(F.min("session").alias("session"))
    return equal_weight(df.join(first, "session"))
