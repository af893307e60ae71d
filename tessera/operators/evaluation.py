"""Factor evaluation: information coefficients, quantile portfolios, turnover, decay, bootstrap.

The joined table has a row for each date and instrument: decision_date, instrument_id, value, label_value, and any
keys to group by besides (feature_name, market, horizon, fold). Dates are shuffled once; what follows has a row a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.crosssec import average_rank


def join_feature_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Valid features with the valid label of their instrument and date."""
    f = features.where("valid and value is not null").select("instrument_id", "decision_date", "feature_name", "value")
    y = labels.where("valid and label_value is not null").select("instrument_id", "decision_date", "label_value", "horizon_sessions")
    return f.join(y, ["instrument_id", "decision_date"])


def correlation(x: str, y: str) -> Column:
    """Pearson's, or null where either side is constant or alone."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def with_ranks(joined: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "decision_date"]
    return joined.withColumn("_rx", average_rank("value", keys)).withColumn("_ry", average_rank("label_value", keys))


def daily_ic(joined: DataFrame, by: list[str] | None = None, min_n: int = 3) -> DataFrame:
    """Pearson and rank IC of each date, with n, valid and reason (insufficient_cross_section, constant_cross_section)."""
    by = by or []
    days = with_ranks(joined, by).groupBy(*by, "decision_date").agg(F.count("*").alias("n"), correlation("value", "label_value").alias("_ic"), correlation("_rx", "_ry").alias("_rank"))
    enough = F.col("n") >= min_n
    reason = F.when(~enough, "insufficient_cross_section").when(F.col("_ic").isNull() | F.col("_rank").isNull(), "constant_cross_section")
    return days.select(*by, "decision_date", "n", F.when(enough, F.col("_ic")).alias("ic"), F.when(enough, F.col("_rank")).alias("rank_ic"), reason.isNull().alias("valid"), reason.alias("invalid_reason"))


def ic_summary(daily: DataFrame, by: list[str] | None = None, annualization: int = 252, min_icir: int = 20) -> DataFrame:
    """Mean ICs, deviation, ICIR (with enough dates and spread), share of positive dates."""
    n, sd = F.count("ic"), F.stddev_samp("ic")
    icir = F.when((n >= min_icir) & (sd != 0), F.avg("ic") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(annualization))))
    return daily.groupBy(*(by or [])).agg(n.alias("n_dates"), F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"), sd.alias("ic_sd"), icir.alias("icir"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive_ratio"))


def value_summary(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coverage, missing rate, and least, middle and greatest value of a factor."""
    seen = F.count("value") / F.nullif(F.count("*"), F.lit(0))
    return features.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), seen.alias("coverage"), (1 - seen).alias("missing_rate"), F.min("value").alias("min_value"), F.percentile("value", F.lit(0.5)).alias("median_value"), F.max("value").alias("max_value"))


def with_quantile(joined: DataFrame, q: int = 5, by: list[str] | None = None) -> DataFrame:
    """With `quantile` 1..q: floor(i * q / n) + 1 for the i-th row (from 0) of its date by value, then instrument."""
    keys = [*(by or []), "decision_date"]
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("value", "instrument_id")) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    return joined.withColumn("quantile", F.least(F.lit(q), (F.floor(i * q / n) + 1).cast("int")))


def quantile_returns(joined: DataFrame, q: int = 5, by: list[str] | None = None) -> DataFrame:
    """Mean label and size of each quantile on each date."""
    by = by or []
    return with_quantile(joined, q, by).groupBy(*by, "decision_date", "quantile").agg(F.avg("label_value").alias("mean_label"), F.count("*").alias("n"))


def top_minus_bottom(returns: DataFrame, q: int = 5, by: list[str] | None = None, direction: str = "long_high") -> DataFrame:
    """Mean spread over dates that have both ends."""
    by = by or []
    side = lambda k: F.max(F.when(F.col("quantile") == k, F.col("mean_label")))
    days = returns.groupBy(*by, "decision_date").agg((side(q) - side(1)).alias("_s"))
    sign = 1 if direction == "long_high" else -1
    return days.groupBy(*by).agg((F.avg("_s") * sign).alias("spread"), F.count("_s").alias("n_dates"))


def membership_turnover(joined: DataFrame, q: int = 5, by: list[str] | None = None) -> DataFrame:
    """Of each quantile and date, the share of members that were not in it on the last date it had any; first: null."""
    by = by or []
    own = with_quantile(joined, q, by).select(*by, "quantile", "decision_date", "instrument_id")
    dates = own.select(*by, "quantile", "decision_date").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by, "quantile").orderBy("decision_date")))
    placed = own.join(dates, [*by, "quantile", "decision_date"])
    before = placed.select(*by, "quantile", "instrument_id", (F.col("_i") + 1).alias("_i"), F.lit(1).alias("_kept"))
    met = placed.join(before, [*by, "quantile", "instrument_id", "_i"], "left")
    share = 1 - F.sum(F.coalesce("_kept", F.lit(0))) / F.count("*")
    return met.groupBy(*by, "quantile", "decision_date").agg(F.when(F.max("_i") > 1, share).alias("turnover"))


def ic_breakdown(joined: DataFrame, key: str) -> DataFrame:
    """By a key of the rows: rows, and the mean of its daily ICs (dates with one row or a constant count no IC)."""
    days = daily_ic(joined, [key], 1)
    return days.groupBy(key).agg(F.sum("n").alias("n_rows"), F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"))


def ic_decay(joined: DataFrame, min_n: int = 3) -> DataFrame:
    """By horizon: mean daily IC and the dates that have one."""
    return daily_ic(joined, ["horizon_sessions"], min_n).groupBy("horizon_sessions").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_dates"))


def date_counts(df: DataFrame, date: str = "decision_date") -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("n"))


def prediction_metrics(ledger: DataFrame, q: int = 5, by: tuple[str, ...] = ("split_role", "fold_id")) -> DataFrame:
    """Errors, ICs, spread and top-quantile turnover of a prediction ledger, by role and fold.

    ledger: instrument_id, decision_date, prediction, target. Dates with fewer rows than quantiles count for ICs and
    errors, not for quantiles; turnover compares with the last date that was evaluated."""
    keys = list(by)
    rows = ledger.withColumn("value", F.col("prediction")).withColumn("label_value", F.col("target"))
    errors = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("target"), 2))).alias("rmse"), F.avg("prediction").alias("prediction_mean"), F.stddev_samp("prediction").alias("prediction_sd"))
    ics = daily_ic(rows, keys, 2).groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"))
    wide = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "decision_date"))).where(F.col("_n") >= q)
    spread = top_minus_bottom(quantile_returns(wide, q, keys), q, keys).select(*keys, "spread")
    turn = membership_turnover(wide, q, keys).where(F.col("quantile") == q).groupBy(*keys).agg(F.avg("turnover").alias("top_turnover"))
    return errors.join(ics, keys, "left").join(spread, keys, "left").join(turn, keys, "left")


def block_bootstrap(daily: DataFrame, seed: int = 1, block: int = 5, resamples: int = 100) -> DataFrame:
    """2.5 % and 97.5 % of the mean daily rank IC over resamples of contiguous blocks; one row.

    daily: decision_date, rank_ic, a row a date. With fewer than max(3, 2 * block) dates: available is false."""
    days = daily.where("rank_ic is not null").select("rank_ic", (F.row_number().over(Window.orderBy("decision_date")) - 1).alias("i"))
    n = days.count()
    spark = daily.sparkSession
    if n < max(3, 2 * block):
        return spark.range(1).select(F.lit(False).alias("available"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    blocks = -(-n // block)
    draws = spark.range(resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).withColumn("s", F.pmod(F.xxhash64(F.lit(seed), "r", "b"), F.lit(n - block + 1)))
    places = draws.select("r", F.posexplode(F.sequence("s", F.col("s") + block - 1)).alias("k", "i"), "b").where(F.col("b") * block + F.col("k") < n)
    means = places.join(days, "i").groupBy("r").agg(F.avg("rank_ic").alias("m"))
    return means.agg(F.lit(True).alias("available"), F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))
