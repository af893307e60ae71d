"""Queries of sources, sinks and record audits: tables are written, read back and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import audit, universe
from tessera.plans.inputs import BRAND_BARS, EVENT_BARS, brand_bars, event_bars, rounded, table
from tessera.sources import files
from tessera.sources.scratch import scratch_folder

#: Rows of a provider file.
_FILE_ROWS = 5_000


def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, B1: brand bars as provider files ({status, msg, data}), read and normalised."""
    bars = brand_bars(spark, sf_dir)
    row = F.struct(F.col("trade_date").cast("string").alias("date"), F.col("instrument_id").alias("stock_id"), F.col("volume").alias("Trading_Volume"), F.col("traded_value").cast("long").alias("Trading_money"), "open", F.col("high").alias("max"), F.col("low").alias("min"), "close", F.lit(1).cast("long").alias("Trading_turnover"))
    many = max(1, -(-bars.count() // _FILE_ROWS))
    whole = bars.select(F.pmod(F.xxhash64("instrument_id", "trade_date"), F.lit(many)).alias("file"), row.alias("row")).groupBy("file").agg(F.collect_list("row").alias("data"))
    path = scratch_folder(spark)
    whole.select("file", F.to_json(F.struct(F.lit(200).alias("status"), F.lit("success").alias("msg"), "data")).alias("value")).write.partitionBy("file").text(path)
    prices = universe.normalize_prices(files.read_provider_json(spark, f"{path}/*"), "provider")
    # Prices are quotients of the same two doubles in both engines and travel as text without loss, so they are compared as they are.
    return prices.select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "traded_value", "turnover", F.col("available_at").isNotNull().alias("known"))


def cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand bars as a cache with a file a year and symbol, of which the symbols' own are read, in a range of dates."""
    bars = brand_bars(spark, sf_dir).withColumn("symbol", F.regexp_replace("instrument_id", "#", ""))
    row = F.struct(F.col("trade_date").cast("string").alias("date"), F.col("symbol").alias("stock_id"), F.col("volume").alias("Trading_Volume"), F.col("traded_value").cast("long").alias("Trading_money"), "open", F.col("high").alias("max"), F.col("low").alias("min"), "close", F.lit(1).cast("long").alias("Trading_turnover"))
    # A symbol's bars of a year are one document.
    whole = bars.select("symbol", F.year("trade_date").alias("year"), row.alias("row")).groupBy("symbol", "year").agg(F.collect_list("row").alias("data"))
    path = scratch_folder(spark)
    whole.select(F.concat(F.lit("bars_"), "year", F.lit("__"), "symbol", F.lit(".json")).alias("file"), F.to_json(F.struct(F.lit(200).alias("status"), F.lit("success").alias("msg"), "data")).alias("value")).write.partitionBy("file").text(path)
    # The reader takes a list of symbols; here all brands, a few dozen.
    symbols = [r[0] for r in table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "")).distinct().collect()]
    found = files.read_cached_bars(spark, path, sorted(symbols), "1993-01-01", "1997-12-31")
    return found.select("instrument_id", "trade_date", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), "volume")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listing notices of users, some of the emerging market; some purchases as delistings, also of ids that have no notice."""
    events = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    stock = F.col("user_id").cast("string").alias("stock_id")
    name = F.concat(F.lit("N"), F.col("event_id") % 7).alias("stock_name")
    early = (F.col("user_id") % 5 == 0) & (F.dayofmonth("date") <= 10) & (F.col("event_id") % 2 == 0)
    kind = F.when(early, "emerging").when(F.col("user_id") % 3 == 0, "twse").when(F.col("user_id") % 3 == 2, "tpex").when(F.col("event_id") % 2 == 0, "twse").otherwise("tpex")
    info = events.select(stock, name, kind.alias("type"), F.col("event_type").alias("industry_category"), "date")
    gone = events.where("event_type = 'purchase' and event_id % 10 = 0").select(F.when(F.col("event_id") % 20 == 0, -F.col("user_id")).otherwise(F.col("user_id")).cast("string").alias("stock_id"), name, "date")
    gone = gone.groupBy("stock_id").agg(F.max("stock_name").alias("stock_name"), F.max("date").alias("date"))
    made = universe.normalize_instruments(info, gone, event_bars(spark, sf_dir))
    return made.select("instrument_id", "name", "market", F.concat_ws(",", "categories").alias("categories"), "listing_date", "delisting_date", "quality")


def csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: orders of a day as a bar, in a file with headers in the other language and thousands commas; bars that were read."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("*").alias("n"))
    shown = lambda c: F.format_number(c, 2)
    rows = days.select(F.col("day").cast("string").alias("日期"), shown("low").alias("開盤價"), shown("high").alias("最高價"), shown("low").alias("最低價"), F.when(F.dayofmonth("day") == 13, "--").otherwise(shown("high")).alias("收盤價"), F.format_number(F.col("n") * 1000, 0).alias("成交股數"))
    path = scratch_folder(spark)
    rows.write.option("header", True).csv(path)
    return rounded(files.read_bars_csv(spark, path)[0].drop("file"), 2)


def panel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a Parquet panel by day, read back and asked by name."""
    path = scratch_folder(spark)
    files.write_panel(event_bars(spark, sf_dir).drop("available_at"), path, ["trade_date"])
    files.register_panel(files.read_panel(spark, path), "tessera_panel_files")
    return rounded(spark.sql("SELECT instrument_id, trade_date, open, close, volume FROM tessera_panel_files"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, read back under a schema with their number."""
    path = scratch_folder(spark)
    n = files.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return rounded(files.read_jsonl(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", n), 2)


def typed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as typed records, some with prices below zero; what breaks a rule."""
    bars = event_bars(spark, sf_dir).withColumn("low", F.when(F.dayofmonth("trade_date") == 11, -F.col("low")).otherwise(F.col("low"))).withColumn("volume", F.when(F.dayofmonth("trade_date") == 12, -F.col("volume")).otherwise(F.col("volume")))
    path = scratch_folder(spark)
    bars.drop("traded_value").write.json(path)
    return files.read_typed(spark, "market", path)[1].select("instrument_id", "trade_date", "code")


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, then all other events, appended to one log; alerts of each kind and user."""
    e = table(spark, sf_dir, "events")
    path = scratch_folder(spark)
    for which in ("event_type = 'purchase'", "event_type <> 'purchase'"):
        files.alert_sink(e.where(which).select(F.col("event_type").alias("kind"), "user_id", "event_id"), path)
    return spark.read.schema("kind string, user_id long, event_id long").json(path).groupBy("kind", "user_id").agg(F.count("*").alias("n"))


def exact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders are pinned to an exact version; every third names a moving one, every fifth is cut."""
    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string"), 256)
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, "latest").when(k % 5 == 0, F.substring(digest, 1, 63)).otherwise(digest).alias("version"))
    return rows.select("o_orderkey", audit.version_ok(F.col("version")).alias("pinned"))


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: days of events as a calendar."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("date"))
    return universe.normalize_calendar(days)


def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as predictions, with rows of each fault by day and user."""
    b = event_bars(spark, sf_dir)
    k, day = F.col("instrument_id").cast("int"), F.dayofmonth("trade_date")
    at = F.col("trade_date").cast("timestamp")
    ledger = b.select(
        "instrument_id", at.alias("decision_time"), F.when(k % 11 == 0, "train").when(k % 13 == 0, "final_holdout").otherwise("test").alias("split_role"), F.when(day % 2 == 0, 1).otherwise(F.when(k % 7 == 0, 2).otherwise(1)).alias("fold_id"),
        F.when(k % 17 == 0, at).otherwise(at - F.expr("INTERVAL 1 DAY")).alias("fit_cutoff"), F.when(k % 19 == 0, at + F.expr("INTERVAL 1 HOUR")).otherwise(at).alias("available_at"), F.when(F.col("volume") > 8, F.lit(float("nan"))).otherwise(F.col("close")).alias("prediction"),
        F.when(k % 29 == 0, "m2").otherwise("m1").alias("model_artifact_version"),
    )
    ledger = ledger.unionByName(ledger.where((F.col("instrument_id").cast("int") % 23 == 0)))
    members = b.select("instrument_id", "trade_date", (k % 5 != 0).alias("eligible"))
    listings = b.groupBy("instrument_id").agg(F.date_sub(F.max("trade_date"), 2).alias("delisting_date"))
    return audit.prediction_violations(ledger, members, listings).groupBy("code").agg(F.count("*").alias("n"))


def batch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last bar as a target of one batch; what breaks a rule."""
    b = event_bars(spark, sf_dir)
    last = b.groupBy("instrument_id").agg(F.max_by("close", "trade_date").alias("price"), F.max("trade_date").alias("day"))
    k = F.col("instrument_id").cast("int")
    rows = last.select("instrument_id", F.when(k % 7 == 0, 1.5).otherwise(0.001).alias("weight"), F.when(k % 5 == 0, 0.0).otherwise(F.col("price") + 1).alias("price"), F.when(k % 3 == 0, F.col("day")).otherwise(F.lit("2024-02-01").cast("date")).alias("session"), F.lit("2024-01-31 10:00:00").cast("timestamp").alias("decision_time"), F.lit("2024-01-31 09:00:00").cast("timestamp").alias("available_at"), (k % 11 != 0).alias("eligible"))
    rows = rows.unionByName(rows.where(F.col("instrument_id").cast("int") % 13 == 0))
    return audit.target_violations(rows, "2024-02-01", "2024-02-01 00:00:00").groupBy("code").agg(F.count("*").alias("n"))


def conformance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as contract rows; codes of those that break one."""
    b = event_bars(spark, sf_dir)
    k, day = F.col("instrument_id").cast("int"), F.col("trade_date")
    start = F.lit("2024-01-03").cast("date")
    rows = b.select(
        "instrument_id", day.alias("session"), start.alias("valid_from"), F.lit("2024-12-31").cast("date").alias("valid_to"), F.when(k % 7 == 0, F.date_add(day, 1)).otherwise(day).cast("timestamp").alias("announced_at"), day.cast("timestamp").alias("decision_time"), (F.col("volume") > 1).alias("tradable"),
        F.when(k % 5 == 0, F.col("high")).alias("limit_price"), F.when(k % 10 == 0, "up").alias("limit_code"), F.lit(True).alias("market_open"), F.when(F.dayofmonth(day) != 9, 1.0).alias("benchmark_level"), F.when(k % 11 == 0, "gap").otherwise("healthy").alias("stream_status"),
        start.alias("entitled_from"), F.lit(None).cast("date").alias("entitled_to"), day.cast("timestamp").alias("received_at"), (k % 13 != 0).alias("providers_agree"), (k % 17 == 0).alias("used_fallback"), (F.col("volume") / 10).alias("coverage"), F.lit(0.2).alias("minimum_coverage"),
    )
    return audit.conformance(rows).select("instrument_id", "session", F.concat_ws(";", "codes").alias("codes"))


def accepted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days of events as a coverage report."""
    b = event_bars(spark, sf_dir)
    k = F.col("instrument_id").cast("int")
    own = b.groupBy("instrument_id").agg(F.count("*").alias("days"), F.sum("volume").cast("long").alias("latency_seconds"))
    report = own.select("instrument_id", F.when(k % 7 == 0, F.array(F.lit("close"))).otherwise(F.array().cast("array<string>")).alias("missing_fields"), "latency_seconds", (k % 5 != 0).alias("entitled"), F.lit(True).alias("pit_complete"), (F.col("days") / 30).alias("coverage_ratio"))
    return universe.coverage_ok(report, 0.2, 60).select("instrument_id", "accepted")


QUERIES = [provider_prices, cached_bars, instruments, csv_bars, panel_files, json_lines, typed_violations, alert_log, exact_versions, calendars, ledger_violations, batch_violations, conformance_codes, accepted_coverage]

_R = lambda c, n=6: f"round({c}, {n}) + 0.0"
_K = "CAST(instrument_id AS INTEGER)"

ORACLES = {
    "cached_bars": f"WITH {BRAND_BARS} SELECT 'TWSE:' || replace(instrument_id, '#', '') AS instrument_id, trade_date, {', '.join(f'CAST(CAST({c} AS DECIMAL(20,8)) AS DOUBLE) AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM bars WHERE trade_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'",
    "instruments": f"""WITH {EVENT_BARS},
e AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS d, 'N' || event_id % 7 AS name FROM events),
i AS (SELECT CAST(user_id AS VARCHAR) AS s, name, event_type, d, CASE WHEN user_id % 5 = 0 AND day(d) <= 10 AND event_id % 2 = 0 THEN 'emerging' WHEN user_id % 3 = 0 THEN 'twse' WHEN user_id % 3 = 2 THEN 'tpex' WHEN event_id % 2 = 0 THEN 'twse' ELSE 'tpex' END AS type FROM e),
n AS (SELECT s, max(name) AS name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories, max(CASE WHEN type = 'emerging' THEN d END) AS em, CASE WHEN count(DISTINCT CASE WHEN type <> 'emerging' THEN type END) = 1 THEN max(CASE WHEN type <> 'emerging' THEN type END) ELSE 'unknown' END AS market FROM i GROUP BY 1),
g AS (SELECT CAST(CASE WHEN event_id % 20 = 0 THEN -user_id ELSE user_id END AS VARCHAR) AS s, max(name) AS name, max(d) AS gone FROM e WHERE event_type = 'purchase' AND event_id % 10 = 0 GROUP BY 1),
b AS (SELECT s, n.name, n.categories, n.em, n.market, g.name AS gname, g.gone FROM n FULL OUTER JOIN g USING (s))
SELECT b.s AS instrument_id, coalesce(b.name, b.gname) AS name, coalesce(b.market, 'unknown') AS market, coalesce(b.categories, '') AS categories,
       min(CASE WHEN b.em IS NULL OR p.trade_date > b.em THEN p.trade_date END) AS listing_date, b.gone AS delisting_date, 'provisional' AS quality
FROM b LEFT JOIN bars p ON p.instrument_id = b.s GROUP BY b.s, b.name, b.gname, b.market, b.categories, b.gone""",
    "provider_prices": f"WITH {BRAND_BARS} SELECT instrument_id, trade_date, open, high, low, close, volume, CAST(trunc(traded_value) AS DOUBLE) AS traded_value, CAST(1 AS BIGINT) AS turnover, true AS known FROM bars",
    "csv_bars": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS trade_date, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1) SELECT trade_date, round(low, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(high, 2) AS close, n * 1000 AS volume FROM d WHERE day(trade_date) <> 13",
    "panel_files": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date, {_R('open')} AS open, {_R('close')} AS close, volume FROM bars",
    "json_lines": "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders",
    "typed_violations": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date, 'price_not_positive' AS code FROM bars WHERE least(open, high, CASE WHEN day(trade_date) = 11 THEN -low ELSE low END, close) <= 0 UNION ALL SELECT instrument_id, trade_date, 'volume_negative' FROM bars WHERE day(trade_date) = 12",
    "alert_log": "SELECT event_type AS kind, user_id, count(*) AS n FROM events GROUP BY ALL",
    "exact_versions": "SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS pinned FROM orders",
    "calendars": "SELECT DISTINCT CAST(ts AS DATE) AS trade_date, 'tw' AS market, 'trading_day' AS status, 'Asia/Taipei' AS timezone FROM events",
    "ledger_violations": f"""WITH {EVENT_BARS}, one AS (SELECT *, {_K} AS k, day(trade_date) AS d FROM bars), l AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 23 = 0),
coded AS (
  SELECT 'role_not_out_of_sample' AS code FROM l WHERE k % 11 = 0 UNION ALL SELECT 'holdout_without_audit' FROM l WHERE k % 13 = 0 AND k % 11 <> 0
  UNION ALL SELECT 'fit_cutoff_not_before_decision' FROM l WHERE k % 17 = 0 UNION ALL SELECT 'available_after_decision' FROM l WHERE k % 19 = 0 UNION ALL SELECT 'not_finite' FROM l WHERE volume > 8
  UNION ALL SELECT 'several_folds' FROM l GROUP BY trade_date HAVING count(DISTINCT CASE WHEN d % 2 = 1 AND k % 7 = 0 THEN 2 ELSE 1 END) > 1
  UNION ALL SELECT 'several_owners' FROM one WHERE k % 23 = 0 UNION ALL SELECT 'outside_universe' FROM l WHERE k % 5 = 0
  UNION ALL SELECT 'delisted' FROM l JOIN (SELECT instrument_id, max(trade_date) - 2 AS gone FROM bars GROUP BY 1) g USING (instrument_id) WHERE trade_date > gone
  UNION ALL SELECT 'several_contracts' FROM one HAVING count(DISTINCT k % 29 = 0) > 1)
SELECT code, count(*) AS n FROM coded GROUP BY 1""",
    "batch_violations": f"""WITH {EVENT_BARS}, one AS (SELECT instrument_id, {_K} AS k, max(trade_date) AS d FROM bars GROUP BY 1), t AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 13 = 0),
coded AS (
  SELECT 'weight_out_of_range' AS code FROM t WHERE k % 7 = 0 UNION ALL SELECT 'price_not_positive' FROM t WHERE k % 5 = 0 UNION ALL SELECT 'wrong_session' FROM t WHERE k % 3 = 0 AND d <> DATE '2024-02-01'
  UNION ALL SELECT 'decision_not_before_session' FROM t WHERE k % 3 = 0 AND DATE '2024-01-31' >= d UNION ALL SELECT 'not_eligible' FROM t WHERE k % 11 = 0
  UNION ALL SELECT 'duplicate' FROM one WHERE k % 13 = 0 UNION ALL SELECT 'weights_above_one' FROM (SELECT sum(CASE WHEN k % 7 = 0 THEN 1.5 ELSE 0.001 END) AS w FROM t) WHERE w > 1 + 1e-9)
SELECT code, count(*) AS n FROM coded GROUP BY 1""",
    "conformance_codes": f"""WITH {EVENT_BARS}, c AS (SELECT instrument_id, trade_date AS session, concat_ws(';', CASE WHEN trade_date < DATE '2024-01-03' THEN 'outside_validity' END, CASE WHEN k % 7 = 0 THEN 'late_announcement' END, CASE WHEN volume <= 1 THEN 'not_tradable' END,
  CASE WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'price_limit_without_code' END, CASE WHEN day(trade_date) = 9 THEN 'benchmark_missing' END, CASE WHEN k % 11 = 0 THEN 'stream_fault' END, CASE WHEN trade_date < DATE '2024-01-03' THEN 'outside_entitlement' END,
  CASE WHEN k % 13 = 0 THEN 'provider_disagreement' END, CASE WHEN k % 17 = 0 THEN 'fallback_used' END, CASE WHEN volume / 10 < 0.2 THEN 'coverage_below_minimum' END) AS codes FROM (SELECT *, {_K} AS k FROM bars))
SELECT * FROM c WHERE codes <> ''""",
    "accepted_coverage": f"WITH {EVENT_BARS}, o AS (SELECT instrument_id, {_K} AS k, count(*) AS days, sum(volume) AS late FROM bars GROUP BY 1) SELECT instrument_id, k % 7 <> 0 AND late <= 60 AND k % 5 <> 0 AND days / 30 >= 0.2 AS accepted FROM o",
}
