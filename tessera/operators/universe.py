"""Normalising provider rows, quality findings, universe rules and their metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import AvailabilityPolicy, classify_security, row_checksum


def normalize_prices(raw: DataFrame, provider: str, ingested_at: Column | None = None) -> DataFrame:
    """Provider rows to bars: either spelling of a field, missing turnover 0, available when published, and a checksum."""
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in raw.columns), F.lit(0))
    day = F.col("date").cast("date")
    policy = AvailabilityPolicy(buffer_minutes=0)
    rows = raw.select(F.col("stock_id").alias("instrument_id"), day.alias("trade_date"), F.col("open").cast("double").alias("open"), first("max", "high").cast("double").alias("high"), first("min", "low").cast("double").alias("low"), F.col("close").cast("double").alias("close"), first("Trading_Volume", "volume").cast("long").alias("volume"), first("Trading_money", "traded_value").cast("double").alias("traded_value"), first("Trading_turnover", "turnover").cast("long").alias("turnover"))
    out = rows.withColumns({"event_time": policy.event_time(F.col("trade_date")), "available_at": policy.available(F.col("trade_date")), "ingested_at": ingested_at if ingested_at is not None else F.lit(None).cast("timestamp"), "provider": F.lit(provider), "volume_unit": F.lit("shares")})
    return out.withColumn("checksum", row_checksum("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "traded_value", "turnover"))


def normalize_calendar(raw: DataFrame, market: str = "tw") -> DataFrame:
    return raw.select(F.col("date").cast("date").alias("trade_date"), F.lit(market).alias("market"), F.lit("trading_day").alias("status"), F.lit("Asia/Taipei").alias("timezone")).distinct()


def normalize_instruments(info: DataFrame, delisting: DataFrame, prices: DataFrame) -> DataFrame:
    """Instruments from listing notices, delistings and prices.

    market: the only one of twse and tpex an instrument was on, else unknown; name: the greatest, else the delisting's;
    listing_date: the first price, or the first after the last emerging-market notice; delisted-only ones stay."""
    notices = info.groupBy("stock_id").agg(F.collect_set(F.when(F.col("type").isin("twse", "tpex"), F.col("type"))).alias("_m"), F.max("stock_name").alias("_name"), F.array_sort(F.collect_set("industry_category")).alias("categories"), F.max(F.when(F.col("type") == "emerging", F.col("date").cast("date"))).alias("_emerging"))
    gone = delisting.groupBy("stock_id").agg(F.max("date").cast("date").alias("delisting_date"), F.max_by("stock_name", "date").alias("_gone"))
    both = notices.join(gone, "stock_id", "full_outer")
    dates = prices.select(F.col("instrument_id").alias("stock_id"), "trade_date")
    listed = both.join(dates, "stock_id", "left").groupBy("stock_id").agg(F.min(F.when(F.col("_emerging").isNull() | (F.col("trade_date") > F.col("_emerging")), F.col("trade_date"))).alias("listing_date"))
    name = F.coalesce("_name", "_gone")
    market = F.when(F.size("_m") == 1, F.col("_m")[0]).otherwise("unknown")
    return both.join(listed, "stock_id").select(F.col("stock_id").alias("instrument_id"), name.alias("name"), F.coalesce(market, F.lit("unknown")).alias("market"), classify_security(F.col("stock_id"), name, F.col("categories")).alias("security_type"), "categories", "listing_date", "delisting_date", F.lit("provisional").alias("quality"))


def filter_available(df: DataFrame, decision_time: Column) -> DataFrame:
    return df.where(F.col("available_at").isNotNull() & (F.col("available_at") <= decision_time))


def decision_snapshot(df: DataFrame, findings: DataFrame, decision_time: Column) -> DataFrame:
    """What was available; refused if the findings hold an error."""
    if findings.where("severity = 'error'").limit(1).count():
        raise ValueError("quality findings hold errors; no snapshot")
    return filter_available(df, decision_time)


def filter_panel(df: DataFrame, start: str | None = None, end: str | None = None, symbols: list[str] | DataFrame | None = None) -> DataFrame:
    """Rows of a range of dates and some instruments: plain predicates, which reach the scan, or a frame with `instrument_id`, which is semi-joined."""
    out = df
    if start:
        out = out.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("trade_date") <= F.lit(end).cast("date"))
    if isinstance(symbols, DataFrame):
        return out.join(symbols, "instrument_id", "left_semi")
    return out.where(F.col("instrument_id").isin(symbols)) if symbols else out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def validate_daily_prices(bars: DataFrame, instruments: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Findings (severity, code, instrument_id, trade_date).

    A negative price hides the row's other price checks. No two findings need a shuffle but the duplicates' own."""
    prices = ("open", "high", "low", "close")
    negative = F.least(*prices) < 0
    zero = F.greatest(*prices) == 0
    partial = (F.least(*prices) == 0) & ~zero
    wrong = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    price_code = F.when(negative, "NEGATIVE_PRICE").when(zero, "NO_PUBLISHED_PRICE").when(partial, "PARTIAL_ZERO_PRICE").when(wrong, "INVALID_OHLC")
    activity = F.when(~negative & ((F.col("volume") < 0) | (F.col("traded_value") < 0)), "NEGATIVE_ACTIVITY")
    codes = F.filter(F.array(price_code, activity), lambda x: x.isNotNull())
    rows = bars.select("instrument_id", "trade_date", F.explode(codes).alias("code"))
    found = rows.select(F.when(F.col("code") == "NO_PUBLISHED_PRICE", "warning").otherwise("error").alias("severity"), "code", "instrument_id", "trade_date")
    own = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "instrument_id", "trade_date")
    found = found.unionByName(own(duplicate_keys(bars, ["instrument_id", "trade_date"]), "error", "DUPLICATE_PRIMARY_KEY"))
    if instruments is not None:
        dated = instruments.withColumn("trade_date", F.lit(None).cast("date"))
        found = found.unionByName(own(dated.where("market = 'unknown'"), "warning", "UNKNOWN_HISTORICAL_MARKET"))
        found = found.unionByName(own(dated.where("listing_date is null"), "warning", "MISSING_LISTING_DATE"))
    if missing is not None:
        found = found.unionByName(own(missing, "warning", "MISSING_TRADING_DAY"))
    return found


def issue_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n"))


def search_issues(findings: DataFrame, severity: str | None = None, contains: str | None = None, start: str | None = None, end: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """One page of findings: errors first, then by date, instrument and code."""
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if contains:
        out = out.where(F.upper("instrument_id").contains(contains.upper()))
    if start:
        out = out.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return out.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "trade_date", "instrument_id", "code").offset((page - 1) * size).limit(size)


@dataclass(frozen=True)
class UniversePolicy:
    minimum_listing_days: int = 5
    lookback: int = 5
    liquidity_window: int = 5
    minimum_median_value: float = 0.0


def build_universe(policy: UniversePolicy, grid: DataFrame) -> DataFrame:
    """(instrument_id, trade_date, market, eligible, reasons) for each grid row, by earlier bars alone.

    grid: a row for each instrument and session, with market, security_type, listing_date, delisting_date, session_idx, close,
    traded_value (null without a bar). Only bars before the day count, and only those with a price for history and
    liquidity; the median is that of the last `liquidity_window` of them."""
    w = Window.partitionBy("instrument_id").orderBy("session_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("close") > 0
    rows = grid.withColumn("_bars", F.count("close").over(before)).withColumn("_usable", F.sum(F.when(usable, 1).otherwise(0)).over(before))
    # The median needs a window of usable bars alone; it is carried on to the days that follow.
    good = rows.where(usable)
    own = Window.partitionBy("instrument_id").orderBy("session_idx").rowsBetween(1 - policy.liquidity_window, 0)
    medians = good.select("instrument_id", "session_idx", F.percentile("traded_value", F.lit(0.5)).over(own).alias("_m"), F.count("traded_value").over(own).alias("_c"))
    met = rows.join(medians, ["instrument_id", "session_idx"], "left").withColumn("_median", F.last("_m", ignorenulls=True).over(before)).withColumn("_have", F.last("_c", ignorenulls=True).over(before))
    day = F.col("trade_date")
    have = F.coalesce("_have", F.lit(0))
    reasons = F.filter(
        F.array(
            F.when(F.col("security_type") != "ordinary_share", "not_ordinary_share"),
            F.when(F.col("market") == "unknown", "unknown_market"),
            F.when(F.coalesce(day < F.col("listing_date"), F.lit(True)), "not_yet_listed"),
            F.when(day >= F.col("delisting_date"), "delisted"),
            F.when(F.coalesce("_bars", F.lit(0)) < policy.minimum_listing_days, "minimum_listing_days"),
            F.when(F.col("close").isNull(), "missing_daily_bar"),
            F.when(F.col("close") <= 0, "suspended_or_no_price"),
            F.when(F.coalesce("_usable", F.lit(0)) < policy.lookback, "insufficient_lookback"),
            F.when(have < policy.liquidity_window, "insufficient_liquidity_history"),
            F.when((have >= policy.liquidity_window) & (F.col("_median") < policy.minimum_median_value), "minimum_trailing_median_traded_value"),
        ),
        lambda x: x.isNotNull(),
    )
    return met.select("instrument_id", "trade_date", "market", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def universe_metadata(membership: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row: span, instruments known in it, those of unknown market or provisional quality, and whether it is complete."""
    span = membership.agg(F.min("trade_date").alias("coverage_start"), F.max("trade_date").alias("as_of"))
    alive = instruments.join(span, F.coalesce(F.col("listing_date") <= F.col("as_of"), F.lit(True)) & F.coalesce(F.col("delisting_date") >= F.col("coverage_start"), F.lit(True)))
    counts = alive.agg(F.count("*").alias("known"), F.count_if(F.col("market") == "unknown").alias("unknown_market"), F.count_if(F.col("quality") == "provisional").alias("provisional"))
    return span.join(counts).withColumn("is_research_complete", (F.col("unknown_market") == 0) & (F.col("provisional") == 0))


def exclusion_counts(membership: DataFrame) -> DataFrame:
    return membership.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def completeness(meta: DataFrame, gaps: tuple[str, ...]) -> DataFrame:
    """With `classification`: validated if the universe is complete and no gap counter is above zero, else exploratory."""
    clean = F.col("is_research_complete")
    for g in gaps:
        clean = clean & (F.coalesce(g, F.lit(1)) == 0)
    return meta.withColumn("classification", F.when(clean, "validated").otherwise("exploratory"))


def coverage_ok(report: DataFrame, minimum: float, latency_sla_seconds: int) -> DataFrame:
    """With `accepted`: no missing fields, on time, entitled, point-in-time complete, and covered enough."""
    return report.withColumn("accepted", (F.size("missing_fields") == 0) & (F.col("latency_seconds") <= latency_sla_seconds) & F.col("entitled") & F.col("pit_complete") & (F.col("coverage_ratio") >= minimum))


def compare_volumes(left: DataFrame, right: DataFrame, unit_col: str) -> DataFrame:
    """Volumes of two providers in shares: absolute difference, and relative to the greater (1 at least)."""
    shares = lambda c, unit: F.when(unit == "thousand_shares", F.round(c * 1000)).otherwise(F.round(c)).cast("long")
    both = left.select("instrument_id", "trade_date", F.col("volume").alias("_a")).join(right.select("instrument_id", "trade_date", shares(F.col("volume"), F.col(unit_col)).alias("_b")), ["instrument_id", "trade_date"])
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.select("instrument_id", "trade_date", gap.alias("absolute_difference"), (gap / F.greatest("_a", "_b", F.lit(1))).alias("relative_difference"))


def merge_incremental(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: str = "first") -> DataFrame:
    """The union, whatever columns either lacks, with one row a key: the first or last by ingested_at (of equals, the existing)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.asc("ingested_at"), F.asc("_new")] if keep == "first" else [F.desc("ingested_at"), F.asc("_new")]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n", "_new")


def discover_symbols(info: DataFrame, delisting: DataFrame) -> DataFrame:
    return info.select("stock_id").union(delisting.select("stock_id")).distinct().where("stock_id rlike '^[0-9]{4}$'")


def latest_revision(df: DataFrame, keys: list[str], revision: str, as_of: Column | None = None) -> DataFrame:
    """The highest revision of each key among those available by `as_of`."""
    seen = df if as_of is None else filter_available(df, as_of)
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(revision)))).where("_n = 1").drop("_n")


def panel_coverage(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: sessions, instruments seen and asked for, and what stands in the way (no_bars, missing_instruments)."""
    seen = bars.agg(F.count_distinct("trade_date").alias("sessions"), F.count_distinct("instrument_id").alias("instruments"))
    asked = requested.agg(F.count_distinct("instrument_id").alias("requested"))
    lacking = requested.join(bars.select("instrument_id").distinct(), "instrument_id", "left_anti").agg(F.count("*").alias("missing"))
    blockers = F.filter(F.array(F.when(F.col("sessions") == 0, "no_bars"), F.when(F.col("missing") > 0, "missing_instruments")), lambda x: x.isNotNull())
    return seen.join(asked).join(lacking).withColumn("blockers", F.concat_ws(";", blockers))


def provider_agreement(values: DataFrame) -> DataFrame:
    """By record key: providers, and whether all have one checksum."""
    return values.groupBy("record_key").agg(F.count_distinct("provider").alias("providers"), (F.count_distinct("checksum") == 1).alias("agrees"))
