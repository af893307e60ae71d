"""Factor lab: many factors in one long table (factor_key, trade_date, symbol, value, close), evaluated side by side."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.crosssec import average_rank, centered_rank
from tessera.operators.evaluation import correlation

_DAY = ("factor_key", "trade_date")


def with_forward_return(long: DataFrame, horizon: int) -> DataFrame:
    """With `label_value`: the close `horizon` own rows on over this close, less one."""
    w = Window.partitionBy("factor_key", "symbol").orderBy("trade_date")
    return long.withColumn("label_value", F.lead("close", horizon).over(w) / F.nullif("close", F.lit(0.0)) - 1)


def factor_daily_stats(long: DataFrame, horizon: int = 5) -> DataFrame:
    """(factor_key, trade_date, n, ic, spread): rank IC and top-less-bottom third; dates with under 3 pairs or no IC are left out."""
    pairs = with_forward_return(long, horizon).where("value is not null and label_value is not null")
    n = F.count("*").over(Window.partitionBy(*_DAY))
    place = lambda c: F.row_number().over(Window.partitionBy(*_DAY).orderBy(c, "symbol"))
    ranked = pairs.withColumn("n", n).withColumn("_rx", average_rank("value", _DAY)).withColumn("_ry", average_rank("label_value", _DAY)).withColumn("_i", place("value")).where("n >= 3")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    spread = F.avg(F.when(F.col("_i") > F.col("n") - third, F.col("label_value"))) - F.avg(F.when(F.col("_i") <= third, F.col("label_value")))
    return ranked.groupBy(*_DAY).agg(F.max("n").alias("n"), correlation("_rx", "_ry").alias("ic"), spread.alias("spread")).where("ic is not null")


def factor_summary(stats: DataFrame, horizon: int = 5) -> DataFrame:
    """By factor: dates, observations, mean, deviation, information ratio, share of positive dates, mean spread in percent."""
    sd = F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    ratio = F.when(sd > 0, F.avg("ic") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(252.0 / horizon))).otherwise(F.lit(0.0))
    return stats.groupBy("factor_key").agg(F.count("*").alias("n_dates"), F.sum("n").alias("n_rows"), F.avg("ic").alias("mean_ic"), sd.alias("ic_sd"), ratio.alias("ir"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_ratio"), (F.avg("spread") * 100).alias("spread_pct"))


def hac_tstat(stats: DataFrame, horizon: int = 5) -> DataFrame:
    """(factor_key, t_stat, p_value): Newey-West with Bartlett weights over lags 1..min(horizon - 1, n - 2).

    The series has a row a date and factor; the lags are a self-join on the date's number."""
    w = Window.partitionBy("factor_key")
    own = stats.select("factor_key", (F.col("ic") - F.avg("ic").over(w)).alias("d"), F.row_number().over(w.orderBy("trade_date")).alias("i"), F.count("*").over(w).alias("n"), F.avg("ic").over(w).alias("m"))
    most = F.least(F.lit(horizon - 1), F.col("n") - 2)
    lagged = own.select("factor_key", "d", "i", "n", F.explode(F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<bigint>"))).alias("lag"))
    back = own.select("factor_key", F.col("d").alias("_e"), F.col("i").alias("_j"))
    pairs = lagged.withColumn("_j", F.col("i") - F.col("lag")).join(back, ["factor_key", "_j"])
    weight = 1 - F.col("lag") / (F.least(F.lit(horizon - 1), F.col("n") - 2) + 1)
    extra = pairs.groupBy("factor_key").agg(F.sum(2 * weight * F.col("d") * F.col("_e") / F.col("n")).alias("extra"))
    base = own.groupBy("factor_key").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.avg(F.pow("d", 2)).alias("v0"))
    variance = F.greatest((F.col("v0") + F.coalesce("extra", F.lit(0.0))) / F.col("n"), F.lit(0.0))
    t = F.when((F.col("n") >= 3) & (variance > 0), F.col("m") / F.sqrt(variance))
    return base.join(extra, "factor_key", "left").select("factor_key", "n", t.alias("t_stat")).withColumn("p_value", erfc_p("t_stat"))


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


def erfc_p(t: str) -> Column:
    """Two-sided normal p of a t value; runs on one row a factor."""
    return _two_sided(F.col(t))


def bh_qvalues(df: DataFrame, p: str = "p_value", key: str = "factor_key") -> DataFrame:
    """With `q_value` after Benjamini and Hochberg; a null p counts as 1. One row a factor: a single window is enough."""
    full = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    rank = F.row_number().over(Window.orderBy("_p", key))
    m = F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scaled = full.withColumn("_k", rank).withColumn("_s", F.col("_p") * m / F.col("_k"))
    least = F.min("_s").over(Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("q_value", F.least(F.lit(1.0), least)).drop("_p", "_k", "_s")


def train_test_eval(stats: DataFrame, train_ratio: float = 0.7, horizon: int = 5) -> DataFrame:
    """By factor: mean IC before and after the split by date order, score, orientation and status.

    split = min(n - 5, max(10, floor(n * ratio))), with at least 20 dates; status: insufficient, weak (|train IC| under
    0.01), sign_flip or stable; score = |train IC| * sqrt(train dates)."""
    w = Window.partitionBy("factor_key")
    n = F.count("*").over(w)
    split = F.least(n - 5, F.greatest(F.lit(10), F.floor(n * F.lit(train_ratio))))
    placed = stats.withColumn("_i", F.row_number().over(w.orderBy("trade_date"))).withColumn("_n", n).withColumn("_split", split)
    train = F.avg(F.when(F.col("_i") <= F.col("_split"), F.col("ic")))
    test = F.avg(F.when(F.col("_i") > F.col("_split"), F.col("ic")))
    out = placed.groupBy("factor_key").agg(F.max("_n").alias("n_dates"), F.max("_split").alias("n_train"), train.alias("train_ic"), test.alias("test_ic"))
    enough = F.col("n_dates") >= 20
    status = F.when(~enough, "insufficient").when(F.abs("train_ic") < 0.01, "weak").when(F.col("train_ic") * F.col("test_ic") < 0, "sign_flip").otherwise("stable")
    return out.select("factor_key", "n_dates", F.when(enough, F.col("n_train")).alias("n_train"), F.when(enough, F.col("train_ic")).alias("train_ic"), F.when(enough, F.col("test_ic")).alias("test_ic"), F.when(enough, F.abs("train_ic") * F.sqrt("n_train")).otherwise(F.lit(0.0)).alias("score"), F.when(F.col("train_ic") < 0, -1).otherwise(1).alias("orientation"), status.alias("status"))


def factor_correlations(ranks: DataFrame, cutoff: str | None = None) -> DataFrame:
    """(k1, k2, rho, n) of each pair of factors over the dates before the cutoff. ranks: factor_key, trade_date, symbol, centered."""
    rows = ranks.where(F.col("trade_date") < F.lit(cutoff)) if cutoff else ranks
    cell = rows.groupBy("trade_date", "symbol").agg(F.array_sort(F.collect_list(F.struct(F.col("factor_key").alias("k"), F.col("centered").alias("x")))).alias("f"))
    # A cell's factors meet inside its own row, so ranks are shuffled once and the sums are combined map-side.
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda b: F.struct(a["k"].alias("k1"), b["k"].alias("k2"), a["x"].alias("x"), b["x"].alias("y")))))
    return cell.select(F.explode(pairs).alias("p")).select("p.*").where("k1 < k2").groupBy("k1", "k2").agg(correlation("x", "y").alias("rho"), F.count("*").alias("n"))


def pick_uncorrelated(scored: DataFrame, correlations: DataFrame, top_k: int = 6, threshold: float = 0.85) -> list[str]:
    """Factors by falling score, each kept if it is not too close to one kept before. Works on one row a factor and pair."""
    near = {frozenset((r["k1"], r["k2"])) for r in correlations.where(F.abs("rho") >= threshold).collect()}
    kept: list[str] = []
    for r in scored.orderBy(F.desc("score"), "factor_key").select("factor_key").collect():
        if len(kept) < top_k and all(frozenset((r[0], k)) not in near for k in kept):
            kept.append(r[0])
    return kept


def discover(long: DataFrame, horizon: int = 5, train_ratio: float = 0.7) -> DataFrame:
    """Summary, significance, q-value and split of every factor, one row each, with its place by score."""
    stats = factor_daily_stats(long, horizon)
    tested = bh_qvalues(hac_tstat(stats, horizon).drop("n"))
    out = factor_summary(stats, horizon).join(tested, "factor_key").join(train_test_eval(stats, train_ratio, horizon).drop("n_dates"), "factor_key")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "factor_key")))


def factor_weights(summary: DataFrame, method: str = "ic_weighted") -> DataFrame:
    """(factor_key, weight), absolute values summing to 1: equal (sign alone), ic_weighted, or ir_weighted (IC over max(sd, 0.001))."""
    sign = F.when(F.col("mean_ic") < 0, -1.0).otherwise(1.0)
    raw = {"equal": sign, "ic_weighted": F.col("mean_ic"), "ir_weighted": F.col("mean_ic") / F.greatest("ic_sd", F.lit(0.001))}[method]
    return summary.select("factor_key", raw.alias("_w")).withColumn("weight", F.col("_w") / F.nullif(F.sum(F.abs("_w")).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))).drop("_w")


def synthesize(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """(trade_date, symbol, composite): weighted ranks over the weights of the factors that the symbol has that day.

    weights has a row a factor (dozens), so it is broadcast."""
    met = ranks.join(F.broadcast(weights), "factor_key")
    return met.groupBy("trade_date", "symbol").agg((F.sum(F.col("weight") * F.col("centered")) / F.nullif(F.sum(F.abs("weight")), F.lit(0.0))).alias("composite"))


def latest_ranking(scores: DataFrame, score: str = "composite") -> DataFrame:
    """The rows of the last date by falling score, numbered."""
    last = scores.agg(F.max("trade_date").alias("trade_date"))
    return scores.join(last, "trade_date").withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(score), "symbol")))


def rank_turnover(scores: DataFrame, score: str = "composite") -> DataFrame:
    """(trade_date, turnover_pct): mean change of ranks scaled 0..1 against the date before, over symbols of both."""
    n = F.count("*").over(Window.partitionBy("trade_date"))
    scaled = scores.withColumn("_r", (average_rank(score, ["trade_date"]) - 1) / F.greatest(n - 1, F.lit(1)))
    dates = scores.select("trade_date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("trade_date")))
    own = scaled.join(dates, "trade_date").select("trade_date", "symbol", "_r", "_i")
    back = own.select("symbol", F.col("_r").alias("_b"), (F.col("_i") + 1).alias("_i"))
    return own.join(back, ["symbol", "_i"]).groupBy("trade_date").agg((F.avg(F.abs(F.col("_r") - F.col("_b"))) * 100).alias("turnover_pct"))


__all__ = ["bh_qvalues", "centered_rank", "discover", "factor_correlations", "factor_daily_stats", "factor_summary", "factor_weights", "hac_tstat", "latest_ranking", "pick_uncorrelated", "rank_turnover", "synthesize", "train_test_eval", "with_forward_return"]
