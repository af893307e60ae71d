"""Queries of joins on two clocks and of running sums, over brand bars, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import observations
from tessera.operators import bitemporal, scan
from tessera.plans.inputs import BRAND_BARS, EVENT_BARS, brand_bars, event_bars, rounded, table


def _revised_actions(bars: DataFrame) -> DataFrame:
    """A split in week 20 and a dividend in week 40 of each brand, announced three weeks before, revised a week before (the split also
    put off by two weeks), and the split withdrawn to a ratio of one half a year later."""
    week = F.weekofyear("trade_date")
    made = bars.where(week.isin(20, 40)).select("instrument_id", F.when(week == 20, "stock_split").otherwise("cash_dividend").alias("action_type"), F.col("trade_date").alias("planned"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("revision")).where("revision < 3 or action_type = 'stock_split'")
    split, r = F.col("action_type") == "stock_split", F.col("revision")
    known = F.date_add("planned", F.when(r == 1, -21).when(r == 2, -7).otherwise(180))
    return made.select(
        "instrument_id", "action_type", "revision", F.lit("s").alias("source"), F.concat_ws("|", "instrument_id", "planned").alias("source_event_id"), known.cast("timestamp").alias("available_at"),
        F.when(split & (r >= 2), F.date_add("planned", 14)).otherwise(F.col("planned")).alias("ex_date"), F.when(split, F.when(r == 1, 2.0).when(r == 2, 2.5).otherwise(0.5)).alias("ratio"), F.when(~split, F.when(r == 1, 25.0).otherwise(30.0)).alias("cash_amount"))


def price_views_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as decisions saw it on its own day, ten weeks later and two years later."""
    bars = brand_bars(spark, sf_dir)
    later = F.explode(F.array(*(F.lit(n) for n in (0, 70, 730))))
    decisions = bars.select("instrument_id", "trade_date", later.alias("days")).select("instrument_id", "trade_date", "days", F.date_add("trade_date", F.col("days")).cast("timestamp").alias("decision_time"))
    made = bitemporal.price_views_as_of(decisions, bars, _revised_actions(bars))
    return rounded(made.select("instrument_id", "trade_date", "days", "split_factor", "cash_factor", "split_close", "total_return_close"), 9)


def revisions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's highest order key known on the day of each order and thirty days before it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("available_at"))
    ago = F.explode(F.array(F.lit(0), F.lit(30)))
    decisions = orders.select("o_custkey", F.col("o_orderkey").alias("asked_by"), "available_at", ago.alias("days")).select("o_custkey", "asked_by", "days", (F.col("available_at") - F.make_dt_interval(F.col("days"))).alias("decision_time"))
    return bitemporal.revisions_as_of(decisions, orders, ["o_custkey"], ["o_orderkey"], revision="o_orderkey").drop("decision_time")


def running_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every line adds to the notional of its side, as all lines follow one another; two keys hold all rows, dealt by month."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").cast("decimal(18,2)").alias("notional"))
    made = scan.running_sums(lines, ["side"], ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "notional"], F.trunc("day", "month"), {"running": "notional"})
    return made.select("l_orderkey", "l_linenumber", "side", F.col("running").cast("double").alias("running"))


def observations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's close as JSON text, cut short on some days, and read back; corrupt texts stand apart."""
    bars = event_bars(spark, sf_dir).select("instrument_id", F.col("trade_date").alias("day"), observations.encode_observation(F.col("trade_date"), "close", F.col("close"), F.col("available_at")).alias("text"))
    broken = bars.withColumn("text", F.when(F.dayofmonth("day") == 13, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    rows, rejects = observations.decode_observations(broken, "text")
    return rows.select("instrument_id", "day", "field", F.unix_timestamp("available_at").alias("known"), "value").unionByName(rejects.select("instrument_id", "day", F.lit("corrupt").alias("field")), allowMissingColumns=True)


QUERIES = [price_views_as_of, revisions_as_of, running_notional, observations_json]

_R = lambda c, n=9: f"round({c}, {n}) + 0.0"

ORACLES = {
    "price_views_as_of": f"""WITH {BRAND_BARS},
planned AS (SELECT instrument_id, trade_date AS planned, CASE WHEN weekofyear(trade_date) = 20 THEN 'split' ELSE 'cash' END AS kind, unnest([1, 2, 3]) AS revision FROM bars WHERE weekofyear(trade_date) IN (20, 40)),
actions AS (
  SELECT instrument_id, planned, kind, revision, planned + CASE revision WHEN 1 THEN -21 WHEN 2 THEN -7 ELSE 180 END AS known,
         CASE WHEN kind = 'split' AND revision >= 2 THEN planned + 14 ELSE planned END AS ex_date, CASE revision WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 2.5 ELSE 0.5 END AS ratio, CASE revision WHEN 1 THEN 25.0::DOUBLE ELSE 30.0 END AS amount
  FROM planned WHERE revision < 3 OR kind = 'split'),
priced AS (SELECT a.*, b.close AS before FROM actions a ASOF LEFT JOIN bars b ON a.instrument_id = b.instrument_id AND a.ex_date > b.trade_date),
decisions AS (SELECT instrument_id, trade_date, close, unnest([0, 70, 730]) AS days FROM bars),
seen AS (
  SELECT d.instrument_id, d.trade_date, d.days, p.kind, p.ex_date, p.ratio, p.amount, p.before
  FROM decisions d JOIN priced p ON p.instrument_id = d.instrument_id AND p.known <= d.trade_date + d.days
  QUALIFY row_number() OVER (PARTITION BY d.instrument_id, d.trade_date, d.days, p.planned, p.kind ORDER BY p.revision DESC) = 1),
factors AS (
  SELECT instrument_id, trade_date, days, product(CASE WHEN kind = 'split' THEN 1 / ratio ELSE 1 END) AS sf, product(CASE WHEN kind = 'cash' AND before > 0 THEN (before - amount) / before ELSE 1 END) AS cf
  FROM seen WHERE ex_date > trade_date GROUP BY ALL)
SELECT instrument_id, trade_date, days, {_R('coalesce(sf, 1)')} AS split_factor, {_R('coalesce(cf, 1)')} AS cash_factor, {_R('close * coalesce(sf, 1)')} AS split_close, {_R('close * coalesce(sf, 1) * coalesce(cf, 1)')} AS total_return_close
FROM decisions LEFT JOIN factors USING (instrument_id, trade_date, days)""",
    "observations_json": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date AS day, CASE WHEN day(trade_date) = 13 THEN 'corrupt' ELSE 'close' END AS field, CASE WHEN day(trade_date) <> 13 THEN CAST(epoch(trade_date) AS BIGINT) + 36000 END AS known, CASE WHEN day(trade_date) <> 13 THEN close END AS value FROM bars",
    "running_notional": "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM lineitem",
    "revisions_as_of": """WITH d AS (SELECT o_custkey, o_orderkey AS asked_by, o_orderdate, unnest([0, 30]) AS days FROM orders)
SELECT d.o_custkey, asked_by, days, max(o.o_orderkey) AS known_o_orderkey FROM d LEFT JOIN orders o ON o.o_custkey = d.o_custkey AND o.o_orderdate <= d.o_orderdate - to_days(CAST(days AS INTEGER)) GROUP BY ALL""",
}
