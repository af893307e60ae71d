"""Panels derived from the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.grid import calendar_of, with_session_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each user and day of events; available at 10:00 UTC (18:00 in Taipei)."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instrument_id"), F.to_date("ts").alias("trade_date"), "ts", "event_id", "value")
    order = F.struct("ts", "event_id")
    bars = events.groupBy("instrument_id", "trade_date").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("traded_value"))
    return bars.withColumn("available_at", F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 10 HOURS"))


def event_sessions(bars: DataFrame) -> DataFrame:
    return with_session_index(calendar_of(bars))


def everyone(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """All instruments as eligible members on all sessions."""
    return bars.select("instrument_id").distinct().join(sessions.select("trade_date", "market")).withColumn("eligible", F.lit(True))


#: The same in SQL: bars, days (with session_idx) and grid.
EVENT_BARS = """
bars AS (
  SELECT CAST(user_id AS VARCHAR) AS instrument_id, CAST(ts AS DATE) AS trade_date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
         count(*) AS volume, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS traded_value
  FROM events GROUP BY 1, 2),
days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session_idx FROM (SELECT DISTINCT trade_date FROM bars)),
grid AS (
  SELECT i.instrument_id, d.trade_date, d.session_idx, b.open, b.high, b.low, b.close, b.volume, b.traded_value
  FROM (SELECT DISTINCT instrument_id FROM bars) i CROSS JOIN days d LEFT JOIN bars b ON b.instrument_id = i.instrument_id AND b.trade_date = d.trade_date)
"""


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each brand and week of ship dates: unit prices of its lines, in order of day, order and line."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines.select(F.col("p_brand").alias("instrument_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("trade_date"), price.alias("price"), order.alias("o"), "l_quantity", "l_extendedprice")
    return rows.groupBy("instrument_id", "trade_date").agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum(F.col("l_quantity").cast("long")).alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("traded_value"))


BRAND_BARS = """
bars AS (
  SELECT p_brand AS instrument_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS traded_value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
"""


def rounded(df: DataFrame, places: int = 6, **kinds: int) -> DataFrame:
    """Double columns rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, kinds.get(c, places)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
