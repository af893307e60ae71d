"""Cross-sections: ranks, z-scores, winsorising, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BY = ("decision_time", "feature_name", "feature_version")


def average_rank(value: str, by: list[str] | tuple[str, ...], where: Column | None = None) -> Column:
    """Rank from 1, ties averaged, among the rows of `by` (with `where`, among those alone)."""
    keys = [*map(F.col, by), *([where] if where is not None else [])]
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def cross_sectional_rank(df: DataFrame, value: str = "value", by: tuple[str, ...] = BY) -> DataFrame:
    """With `rank_value` in 0..1 (ties averaged, a single row 0.5) and `coverage`; invalid rows stay, with null and 0."""
    good = F.col(value).isNotNull()
    n = F.count(value).over(Window.partitionBy(*by))
    rank = F.when(n == 1, F.lit(0.5)).otherwise((average_rank(value, by, good) - 1) / F.nullif(n - 1, F.lit(0)))
    return df.withColumn("rank_value", F.when(good, rank)).withColumn("coverage", F.when(good, 1.0).otherwise(0.0))


def cross_sectional_zscore(df: DataFrame, value: str = "value", by: tuple[str, ...] = BY) -> DataFrame:
    """Valid rows with `zscore` (sample deviation; null if that is zero)."""
    w = Window.partitionBy(*by)
    return df.where(F.col(value).isNotNull()).withColumn("zscore", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def winsorize_cross_section(df: DataFrame, lower: float = 0.01, upper: float = 0.99, value: str = "value", by: tuple[str, ...] = BY) -> DataFrame:
    """Valid rows with `winsorized`: clipped to the nearest-rank quantiles of their cross-section."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", place).withColumn("_n", n)
    at = lambda q: F.round(F.lit(q) * (F.col("_n") - 1))
    bound = lambda q: F.max(F.when(F.col("_i") == at(q), F.col(value))).over(w)
    return ranked.withColumn("_lo", bound(lower)).withColumn("_hi", bound(upper)).withColumn("winsorized", F.least(F.greatest(value, "_lo"), "_hi")).drop("_i", "_n", "_lo", "_hi")


def add_missing_indicator(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("is_missing", F.col(value).isNull())


def neutralize(kind: str) -> None:
    """Sector and size neutralising need data that panels do not carry."""
    raise NotImplementedError(f"{kind} neutralization is not supported: no point-in-time {kind} table")


def label_rank(labels: DataFrame) -> DataFrame:
    """Labels with `label_rank` in 0..1 among the valid ones of a decision time."""
    ranked = cross_sectional_rank(labels.withColumn("_v", F.when(F.col("valid"), F.col("label_value"))), "_v", ("decision_time", "label_version"))
    return ranked.withColumnRenamed("rank_value", "label_rank").drop("_v", "coverage")


def centered_rank(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("trade_date", "factor_key")) -> DataFrame:
    """Valid rows with `centered` in -0.5..0.5: (rank - 1) / max(1, n - 1) - 0.5; a single row -0.5."""
    good = df.where(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*by))
    return good.withColumn("centered", (average_rank(value, by) - 1) / F.greatest(n - 1, F.lit(1)) - 0.5)
