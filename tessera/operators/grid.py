"""Calendars, dense grids, and joins by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_session_index(calendar: DataFrame, by: str = "market", day: str = "trade_date") -> DataFrame:
    """Open sessions with `session_idx` from 1, per market. A calendar is a dimension of days, not of rows."""
    order = Window.partitionBy(by).orderBy(day)
    return calendar.where("status = 'trading_day'").withColumn("session_idx", F.row_number().over(order))


def calendar_of(bars: DataFrame, market: str = "tw") -> DataFrame:
    """A calendar of the days on which any instrument has a bar."""
    return bars.select("trade_date").distinct().select("trade_date", F.lit(market).alias("market"), F.lit("trading_day").alias("status"))


def dense_grid(instruments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every instrument on every session of its market within its listing.

    instruments: instrument_id, market, and optionally listing_date and delisting_date; sessions: trade_date, market,
    session_idx. An instrument whose market has no sessions uses those of `tw`."""
    have = [r["market"] for r in sessions.select("market").distinct().collect()]  # a handful of exchanges
    placed = instruments.withColumn("_on", F.when(F.col("market").isin(have), F.col("market")).otherwise(F.lit("tw")))
    met = placed.join(sessions.withColumnRenamed("market", "_on"), "_on").drop("_on")
    if "listing_date" in instruments.columns:
        met = met.where("listing_date is null or trade_date >= listing_date")
    if "delisting_date" in instruments.columns:
        met = met.where("delisting_date is null or trade_date < delisting_date")
    return met


def on_grid(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Grid rows with their bar, if any; of bars with one key the last by available_at counts."""
    order = Window.partitionBy("instrument_id", "trade_date").orderBy(F.desc_nulls_last("available_at"))
    one = bars.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "market")
    return grid.join(one, ["instrument_id", "trade_date"], "left")


def missing_sessions(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """Grid rows without a bar."""
    return grid.join(bars.select("instrument_id", "trade_date"), ["instrument_id", "trade_date"], "left_anti")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the latest right row of its key before (strict) or not after its time.

    One sort of both sides by key and time, no inequality join. Right rows with one key and time: the greatest values count."""
    out = left.columns
    both = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None)).select(*by, "_t", "_side", F.struct(*out).alias("_l"))
    seen = right.select(*by, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(F.lit(True).alias("_hit"), *values).alias("_r"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.unionByName(seen, allowMissingColumns=True)
    found = rows.withColumn("_found", F.last("_r", ignorenulls=True).over(order)).where("_l is not null")
    return found.select("_l.*", *(F.col(f"_found.{v}").alias(f"asof_{v}") for v in values))


def interval_anti_join(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Left rows whose interval meets no interval of the right side with the same keys.

    Only whether intervals meet counts, so the right side is first merged into disjoint ones: then the one that
    starts last before a left interval's end decides, found as of. No side is broadcast, whatever its size."""
    order = Window.partitionBy(*by).orderBy(start, end)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    merged = right.select(*by, start, end).distinct().withColumn("_new", F.when(F.col(start) <= F.max(end).over(upto), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_island").agg(F.min(start).alias("_start"), F.max(end).alias("_end"))
    joined = asof_backward(left, merged, by, end, "_start", ["_end"], strict=False)
    return joined.where(F.col("asof__end").isNull() | (F.col("asof__end") < F.col(start))).drop("asof__end")


def classify_observations(bars: DataFrame, instruments: DataFrame, calendar: DataFrame, suspensions: DataFrame) -> DataFrame:
    """(instrument_id, trade_date, status) on every calendar day: market_closed, not_yet_listed, delisted (after the
    last day), suspended, provider_missing, zero_volume or observed, whichever comes first."""
    days = calendar.select("trade_date", "market", "status")
    grid = instruments.select("instrument_id", "market", "listing_date", "delisting_date").join(days.withColumnRenamed("status", "_open"), "market")
    full = grid.join(bars.select("instrument_id", "trade_date", "volume", F.lit(True).alias("_bar")), ["instrument_id", "trade_date"], "left").join(suspensions.select("instrument_id", "trade_date", F.lit(True).alias("_halt")), ["instrument_id", "trade_date"], "left")
    day = F.col("trade_date")
    status: Column = F.when(F.col("_open") != "trading_day", "market_closed").when(day < F.col("listing_date"), "not_yet_listed").when(day > F.col("delisting_date"), "delisted").when(F.col("_halt"), "suspended").when(F.col("_bar").isNull(), "provider_missing").when(F.col("volume") == 0, "zero_volume").otherwise("observed")
    return full.select("instrument_id", "trade_date", status.alias("status"))


def common_sessions(bars: DataFrame) -> DataFrame:
    """Days on which every instrument has a bar."""
    whole = bars.agg(F.count_distinct("instrument_id").alias("_all"))
    return bars.groupBy("trade_date").agg(F.count_distinct("instrument_id").alias("_n")).join(whole, F.col("_n") == F.col("_all")).select("trade_date")


def settlement_dates(trades: DataFrame, sessions: DataFrame, lag: int = 2) -> DataFrame:
    """Trades with `settlement_date`, the session `lag` sessions on (null past the calendar's end)."""
    here = sessions.select(F.col("trade_date").alias("session"), F.col("session_idx").alias("_i"))
    there = sessions.select(F.col("trade_date").alias("settlement_date"), (F.col("session_idx") - lag).alias("_i"))
    return trades.join(here.join(there, "_i", "left").drop("_i"), "session", "left")
