"""Queries of actions, audits, targets and portfolios, over lines, orders and event bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import columns as H
from tessera.operators import actions, audit, grid, hashtree, portfolio, targets
from tessera.plans.inputs import BRAND_BARS, EVENT_BARS, brand_bars, event_bars, event_sessions, rounded, table
from tessera.sources.scratch import scratch_folder

_POLICY = H.CostPolicy()


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fills: returned ones are sales; twenty portfolios by supplier; fee and tax in whole units."""
    lines = table(spark, sf_dir, "lineitem")
    # Cut, not rounded, to four places: engines differ in how they round a tie of doubles.
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10_000).cast("decimal(14,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(20,4)")
    rows = lines.select((F.col("l_suppkey") % 20).cast("string").alias("portfolio"), F.col("l_partkey").cast("string").alias("instrument_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fill_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("seq"), F.to_date("l_shipdate").alias("session"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("long").alias("quantity"), price.alias("price"))
    gross = (F.col("price") * F.col("quantity")).cast("decimal(20,8)")
    return rows.withColumn("fee", H.commission(gross, _POLICY)).withColumn("tax", H.transaction_tax(gross, F.col("side"), _POLICY))


_FILLS = """fills AS (
  SELECT *, CASE WHEN price * quantity = 0 THEN 0 ELSE ceil(greatest(CAST(price * quantity * 0.001425 AS DECIMAL(30,8)), 20)) END AS fee, CASE WHEN side = 'sell' THEN floor(CAST(price * quantity * 0.003 AS DECIMAL(30,8))) ELSE 0 END AS tax
  FROM (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS portfolio, CAST(l_partkey AS VARCHAR) AS instrument_id, l_orderkey || '-' || l_linenumber AS fill_id, l_orderkey AS order_id, l_linenumber AS seq, CAST(l_shipdate AS DATE) AS session,
          CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_quantity AS BIGINT) AS quantity, CAST(CAST(CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT) AS DECIMAL(14,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,4)) AS price FROM lineitem))"""


def _d(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


def fill_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4."""
    return _fills(spark, sf_dir).select("fill_id", _d("fee"), _d("tax"))


def order_commissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: the minimum is charged once an order."""
    gross = (F.col("price") * F.col("quantity")).cast("decimal(20,8)")
    return _fills(spark, sf_dir).withColumn("fee", H.incremental_commission(gross, ["order_id"], ["seq", "instrument_id", "quantity", "price"], _POLICY)).select("fill_id", "instrument_id", _d("fee"))


def tick_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: a part's price, a hundredth of it, rounded for either side."""
    p = table(spark, sf_dir, "part").withColumn("p", F.round(F.col("p_retailprice") / 10, 3).cast("decimal(20,6)"))
    return p.select("p_partkey", H.tick_round(F.col("p"), F.lit("buy")).cast("double").alias("buy"), H.tick_round(F.col("p"), F.lit("sell")).cast("double").alias("sell"))


def settlement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: two event sessions after each event's day."""
    sessions = event_sessions(event_bars(spark, sf_dir))
    trades = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("session"))
    return grid.settlement_dates(trades, sessions).select("event_id", "settlement_date")


def slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: against the part's list price."""
    fills = _fills(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("instrument_id"), "p_retailprice"), "instrument_id")
    return rounded(fills.select("fill_id", H.slippage_cost(F.col("quantity"), F.col("price").cast("double"), F.col("p_retailprice"), F.col("side")).alias("slippage")), 4)


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change on the day before of each user's close, and the 90th percentile of its size."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    moved = event_bars(spark, sf_dir).withColumn("previous", F.lag("close").over(w))
    rows = moved.select("instrument_id", H.change_pct(F.col("close"), F.col("previous")).alias("pct"))
    return rounded(rows.groupBy("instrument_id").agg(F.avg("pct").alias("mean_pct"), H.linear_quantile(F.abs("pct"), 0.9).alias("p90")), 5)


def parsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3: numbers with commas from prices, and markets with symbols from part keys."""
    p = table(spark, sf_dir, "part")
    key = H.instrument_key(F.concat_ws(":", F.when(F.col("p_partkey") % 3 == 0, "otc").when(F.col("p_partkey") % 3 == 1, "bad"), F.lpad(F.col("p_partkey").cast("string"), 4, "0")))
    text = F.when(F.col("p_partkey") % 4 == 0, "--").otherwise(F.concat(F.lit("X"), F.format_number("p_retailprice", 2)))
    return rounded(p.select("p_partkey", H.parse_number(text).alias("price"), key["market"].alias("market"), key["symbol"].alias("symbol")), 2)


def roc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: order dates written with years from 1911."""
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws("/", F.year("o_orderdate") - 1911, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return o.select("o_orderkey", H.roc_date(text).alias("day"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by key, name and type."""
    p = table(spark, sf_dir, "part")
    cats = F.array(F.when(F.col("p_size") < 10, "ETF").otherwise("Steel"))
    return p.select("p_partkey", H.classify_security(F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit("-DR"))).otherwise(F.col("p_name")), cats).alias("kind"))


def fill_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against ten times their part's mean quantity as the day's volume."""
    v = Window.partitionBy("instrument_id")
    rows = _fills(spark, sf_dir).withColumn("volume", F.floor(F.avg("quantity").over(v) * 10).cast("long"))
    reason = H.unfilled_reason(F.col("quantity"), F.col("volume"), F.col("seq") == 7, F.col("seq") == 6)
    return rows.select("fill_id", H.fill_capacity(F.col("volume")).alias("room"), reason.alias("reason"))


def target_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of 10 for a twentieth of a million in each part; the bounds are checked by SQL."""
    p = table(spark, sf_dir, "part").withColumn("price", F.round("p_retailprice", 2).cast("decimal(12,2)"))
    q = H.target_quantity(F.lit("0.05").cast("decimal(10,4)"), F.lit(1_000_000).cast("decimal(18,2)"), F.col("price"), 10, _POLICY)
    return p.select("p_partkey", q.alias("quantity"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of each portfolio's accounts (cost of sales apart, which needs J2)."""
    return rounded(portfolio.trial_balance(portfolio.postings(_fills(spark, sf_dir))).select("portfolio", "account", _d("balance")), 3)


def unbalanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that do not sum to zero, with costs of sales; none."""
    fills = _fills(spark, sf_dir)
    return portfolio.unbalanced(portfolio.postings(fills, portfolio.cost_basis(fills))).select("portfolio", "fill_id", _d("residual"))


def cost_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold in the JVM; the SQL walks the fills by recursion, in whole units of 0.00000001."""
    out = portfolio.cost_basis(_fills(spark, sf_dir))
    return out.select("portfolio", "instrument_id", "fill_id", "held", _d("book_cost"), _d("cost_of_sales"), _d("realised"), "code")


def settled_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the calendar of ship days."""
    fills = _fills(spark, sf_dir)
    sessions = grid.with_session_index(grid.calendar_of(fills.select(F.col("session").alias("trade_date"))))
    return portfolio.settlements(fills, sessions).select("portfolio", "trade_date", _d("flow"), _d("settled_cash"), _d("payable"), _d("receivable"))


def dividend_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brands' shipped quantity so far as the holding; a payment on the first Monday of each year."""
    bars = brand_bars(spark, sf_dir)
    held = F.sum("volume").over(Window.partitionBy("instrument_id").orderBy("trade_date"))
    positions = bars.select(F.lit("p").alias("portfolio"), "instrument_id", F.col("trade_date").alias("session"), held.alias("held"))
    acts = bars.groupBy("instrument_id", F.year("trade_date").alias("y")).agg(F.min("trade_date").alias("ex_date")).select("instrument_id", "ex_date", F.date_add("ex_date", 30).alias("payment_date"), F.lit(0.5).alias("cash_amount"))
    return rounded(portfolio.dividends(acts, positions))


def stale_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user on every session, marked by the last close."""
    bars = event_bars(spark, sf_dir)
    sessions = event_sessions(bars)
    marks = bars.join(sessions, "trade_date").select("instrument_id", "session_idx", F.col("close").alias("mark"))
    cells = grid.dense_grid(bars.select("instrument_id").distinct().withColumn("market", F.lit("tw")), sessions).select("instrument_id", "session_idx")
    return rounded(portfolio.stale_marks(cells, marks, 1))


def nav_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brands' weekly quantity at the close, with a tenth of the value as cash."""
    b = brand_bars(spark, sf_dir)
    positions = b.select(F.lit("p").alias("portfolio"), "trade_date", F.col("volume").alias("held"), F.when(F.weekofyear("trade_date") != 9, F.col("close")).alias("mark"))
    cash = b.groupBy("trade_date").agg((F.sum(F.col("volume").cast("double")) * 10).alias("settled_cash")).select(F.lit("p").alias("portfolio"), "trade_date", "settled_cash", F.lit(5.0).alias("receivable"), F.lit(3.0).alias("payable"), F.lit(1.0).alias("dividends_receivable"))
    return rounded(portfolio.nav(positions, cash), 3)


def _nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_bars(spark, sf_dir).select(F.col("instrument_id").alias("run_id"), "trade_date", F.col("close").alias("nav"), (F.col("open") / F.col("close")).alias("exposure"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as runs."""
    fills = brand_bars(spark, sf_dir).select(F.col("instrument_id").alias("run_id"), F.col("high").alias("notional"), (F.col("low") / 1000).alias("cost"))
    return rounded(portfolio.performance(_nav(spark, sf_dir), fills), 5)


def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that trade in every week, against the mean close."""
    b = brand_bars(spark, sf_dir)
    whole = b.agg(F.count_distinct("trade_date").alias("_n"))
    full = b.groupBy("instrument_id").agg(F.count("*").alias("_c")).join(whole, F.col("_n") == F.col("_c")).select("instrument_id")
    levels = b.groupBy("trade_date").agg(F.avg("close").alias("level"))
    w = Window.partitionBy("run_id").orderBy("trade_date")
    returns = b.join(full, "instrument_id").select(F.col("instrument_id").alias("run_id"), "trade_date", "close").withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).where("ret is not null").drop("close")
    return rounded(portfolio.benchmark_stats(portfolio.align_benchmark(returns, levels)), 4)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's weekly value and flows."""
    b = brand_bars(spark, sf_dir)
    nav_ = b.select(F.col("instrument_id").alias("portfolio"), "trade_date", (F.col("close") * 10 + 100).alias("nav"), (F.col("close") * 10).alias("market_value"))
    flows = b.select(F.col("instrument_id").alias("portfolio"), "trade_date", (F.col("open") / 2).alias("bought"), (F.col("low") / 2).alias("sold"), F.lit(0.5).alias("slippage"), F.lit(1.0).alias("fees"), F.lit(0.25).alias("taxes"), F.lit(2.0).alias("dividends"))
    return rounded(portfolio.attribution(nav_, flows), 8)


def notional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 spread over the brands of each portfolio."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("instrument_id"), "p_brand")
    rows = _fills(spark, sf_dir).join(brands, "instrument_id").select("portfolio", F.col("p_brand").alias("instrument_id"), "price", "quantity", F.lit(1000.0).alias("total"))
    return rounded(portfolio.notional_allocation(rows), 4, allocated=2)


def pretrade_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines against holdings of 40 shares in every other part."""
    orders = _fills(spark, sf_dir).select("portfolio", F.col("fill_id").alias("order_id"), "instrument_id", "side", "quantity", F.col("price").cast("double").alias("price"))
    held = orders.where("cast(instrument_id as int) % 2 = 0").select("portfolio", "instrument_id").distinct().withColumn("held", F.lit(40)).withColumn("value", F.lit(4_000.0))
    accounts = orders.select("portfolio").distinct().where("portfolio != '3'").withColumn("nav", F.lit(200_000.0)).withColumn("cash", F.lit(150_000.0))
    return portfolio.pretrade_flags(orders, held, accounts, 0.2, 60_000).withColumn("flags", F.concat_ws(";", "flags"))


def reservation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines, a third of them partly filled."""
    lines = _fills(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fill_id"), (F.col("l_linestatus") == "O").alias("active")), "fill_id")
    rows = lines.withColumn("filled", F.when(F.col("order_id") % 3 == 0, F.floor(F.col("quantity") / 2)).otherwise(0))
    return rounded(portfolio.reservation_totals(rows), 4)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select(F.col("trade_date").alias("decision_time"), "instrument_id", F.when(F.col("volume") % 5 != 0, F.round(F.try_divide("close", "open") - 1, 9)).alias("prediction"))


def top_k_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return rounded(targets.build_targets(_predictions(spark, sf_dir), targets.TargetPolicy(k=8)).drop("prediction"))


def quantile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the best fifth."""
    return rounded(targets.build_targets(_predictions(spark, sf_dir), targets.TargetPolicy("quantile", q=0.2, cap=0.1)).drop("prediction"))


def target_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight against an equal holding of the best fifth by volume."""
    bars = event_bars(spark, sf_dir).withColumnRenamed("trade_date", "decision_time")
    t = targets.build_targets(_predictions(spark, sf_dir), targets.TargetPolicy(k=8)).where("selected").join(bars.select("decision_time", "instrument_id", F.col("close").alias("price"), "volume"), ["decision_time", "instrument_id"]).withColumn("nav", F.lit(10_000.0))
    p = bars.where("volume >= 4").select("decision_time", "instrument_id", F.lit(0.02).alias("weight"), F.lit(2).alias("quantity"))
    return rounded(portfolio.target_limits(t, p, max_turnover=0.9, min_cash=0.06, max_participation=1.0, max_orders=7))


def coverage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """days on which four fifths of the day's users have a prediction; the others go to zero."""
    rows = _predictions(spark, sf_dir)
    t = targets.build_targets(rows.where("prediction is not null"), targets.TargetPolicy(k=8))
    return rounded(targets.apply_coverage_policy(t, rows, 0.8))


def weekly_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first sessions of ISO weeks."""
    return targets.rebalance_dates(event_sessions(event_bars(spark, sf_dir)), "weekly")


def equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    rows = event_bars(spark, sf_dir).select(F.col("trade_date").alias("session"), "instrument_id")
    return rounded(targets.equal_weight(rows))


def target_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand's parts: a fiftieth each, against shipped quantity at the list price."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("instrument_id"), "p_retailprice", "p_size", "p_brand")
    t = parts.select(F.col("p_brand").alias("portfolio"), "instrument_id", F.lit(0.02).alias("weight"), F.lit(1_000_000.0).alias("nav"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("instrument_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("held")).join(parts.select("instrument_id", F.col("p_brand").alias("portfolio")), "instrument_id")
    return rounded(portfolio.target_drift(t, held, parts.where("p_size > 3").select("instrument_id", F.col("p_retailprice").alias("mark"))), 9)


def fills_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus")
    return portfolio.fills_with_orders(_fills(spark, sf_dir).select("order_id", "fill_id", "side"), orders)


def pnl_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    rows = brand_bars(spark, sf_dir).select(F.col("instrument_id").alias("portfolio"), "trade_date", F.col("close").alias("nav"))
    return rounded(portfolio.pnl_drawdown(rows), 9)


def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("done").alias("state"))
    fills = _fills(spark, sf_dir).select("session", (F.col("price") * F.col("quantity")).cast("decimal(22,4)").alias("notional"), F.col("fee").cast("decimal(22,4)").alias("cost"))
    report = portfolio.daily_report(orders, fills)  # summed in decimals
    return report.withColumns({c: F.col(c).cast("double") for c in ("notional", "costs")})


def _plan_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch of the best one, two or three is bought at the open and sold at the close, by three calendars."""
    b = event_bars(spark, sf_dir)
    best = targets.build_targets(_predictions(spark, sf_dir), targets.TargetPolicy(k=3)).where("selected").select(F.col("decision_time").alias("trade_date"), "instrument_id", "rank")
    sessions = event_sessions(b)
    calendars = [targets.rebalance_dates(sessions, freq, 3).select("trade_date", F.lit(name).alias("rebalance")) for name, freq in (("daily", "daily"), ("weekly", "weekly"), ("every_third", "every_n"))]
    dates = calendars[0].unionByName(calendars[1]).unionByName(calendars[2])
    plan = best.join(b, ["trade_date", "instrument_id"]).where("open > 0 AND close > 0").join(dates, "trade_date").withColumn("top_k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("rank <= top_k")
    sides = F.array(F.struct(F.lit("buy").alias("side"), F.col("open").alias("price")), F.struct(F.lit("sell").alias("side"), F.col("close").alias("price")))
    return plan.withColumn("s", F.explode(sides)).select("rebalance", "top_k", "s.side", F.floor(F.round(F.lit(100_000.0) / F.col("top_k") / F.col("open"), 9)).alias("quantity"), F.round("s.price", 2).alias("price"), (F.col("volume") * 1000).alias("volume"))


def scenario_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the plans under every scenario."""
    return rounded(portfolio.scenario_costs(_plan_fills(spark, sf_dir), portfolio.scenario_grid(spark)).drop("scenario_id"))


def scenario_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, return, turnover, slippage and capacity of the plans under every scenario; weekly plans of two and three are not made, so they fail."""
    fills = _plan_fills(spark, sf_dir).where("rebalance != 'weekly' OR top_k = 1")
    return rounded(portfolio.scenario_outcomes(fills, portfolio.scenario_grid(spark), 1_000_000.0).drop("scenario_id", "checksum"), 12)


def price_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with a split in week 20 of each year and a dividend in week 40."""
    b = brand_bars(spark, sf_dir)
    week = F.weekofyear("trade_date")
    acts = b.where(week.isin(20, 40)).select("instrument_id", F.when(week == 20, "stock_split").otherwise("cash_dividend").alias("action_type"), F.col("trade_date").alias("ex_date"), F.when(week == 20, 2.0).alias("ratio"), F.when(week == 40, 25.0).alias("cash_amount"), F.lit("s").alias("source"), F.concat_ws("|", "instrument_id", "trade_date").alias("source_event_id"), F.lit(1).alias("revision"))
    out = actions.price_views(b, acts)
    return rounded(out.select("instrument_id", "trade_date", "split_factor", "cash_factor", "split_close", "total_return_close", "split_volume", "ohlc_ok"), 9)


def unsupported_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions by priority."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "rights_issue").when(F.col("o_orderpriority").startswith("2"), "capital_reduction").otherwise("cash_dividend")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("instrument_id"), F.to_date("o_orderdate").alias("ex_date"), kind.alias("action_type"), F.when(F.col("o_orderstatus") == "F", "loss_offset").alias("capital_reduction_subtype"))
    return actions.unsupported_actions(rows)


def action_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as actions with missing and negative fields."""
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select(F.lit("s").alias("source"), F.col("o_orderkey").alias("source_event_id"), F.when(k < 2, "cash_dividend").when(k < 4, "stock_split").otherwise("symbol_change").alias("action_type"), F.when(k == 2, -1.0).alias("ratio"), F.when(k == 1, -5.0).alias("cash_amount"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("ex_date"), F.col("o_orderdate").alias("announcement_time"), (F.col("o_orderdate") - F.when(F.col("o_orderkey") % 7 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("available_at"), F.lit(None).cast("string").alias("old_symbol"), F.lit("x").alias("new_symbol"))
    return actions.action_violations(rows)


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a remote copy that lacks some, has others, and differs in a few."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    remote = o.where("o_orderkey % 10 != 3").select(F.when(F.col("o_orderkey") % 10 == 4, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 10 == 5, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 10 == 6, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return audit.reconcile(o, remote, ["o_orderkey"], ["o_orderstatus", "o_custkey"], "orders")


def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a changed copy."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    changed = c.where("c_custkey % 6 != 1").select(F.when(F.col("c_custkey") % 6 == 2, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(F.col("c_custkey") % 6 == 3, -1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_custkey") % 6 == 4, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return audit.table_diff(c, changed, ["c_custkey"], ("c_nationkey",))


def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as events of their order, in which P never goes back to O."""
    return audit.order_audit(_order_events(spark, sf_dir))


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each order."""
    return audit.order_states(_order_events(spark, sf_dir))


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).select(k.alias("order_id"), (F.col("n") + F.when((k % 5 == 0) & (F.col("n") > 2), 1).otherwise(0)).alias("sequence"), F.col("l_linestatus").alias("state"), F.concat_ws("-", k - F.when(k % 97 == 0, 1).otherwise(0), "n").alias("event_id"), F.col("l_quantity").alias("filled"), F.lit(45.0).alias("quantity"))


def journal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run; views are intents, clicks risk, carts reserve and purchases fill."""
    e = table(spark, sf_dir, "events")
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    kinds = ["fill", "intent", "reserve", "risk", "run_completed"]
    kind = F.coalesce(*(F.when(F.col("event_type") == n, F.lit(k)) for n, k in zip(names, kinds, strict=False)), F.lit("other"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("event_id").over(w)).where("event_id % 211 != 0")
    return audit.journal_audit(rows.select(F.col("user_id").alias("run_id"), F.col("n").alias("sequence"), kind.alias("kind"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("before")).alias("causation_id"), (F.col("event_id") % 5).alias("correlation_id")))


def order_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("occurred_at"), F.col("o_orderstatus").alias("detail"))
    f = _fills(spark, sf_dir).select(F.col("fill_id").alias("id"), F.col("session").alias("occurred_at"), F.col("side").alias("detail"))
    r = o.where("id % 2 = 0").withColumn("detail", F.lit("accepted"))
    return audit.order_activity(o, f, r)


def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B20 as rules: brands' bars with the high halved in week 5."""
    b = brand_bars(spark, sf_dir).withColumn("high", F.when(F.weekofyear("trade_date") == 5, F.col("high") / 2).otherwise(F.col("high")))
    return audit.violations(b, audit.bar_rules(), ["instrument_id", "trade_date"])


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents; the hash is over the rows as JSON, which DuckDB writes alike for these columns."""
    return audit.fingerprint(table(spark, sf_dir, "documents"))


def hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the documents' hash tree."""
    docs = table(spark, sf_dir, "documents")
    return hashtree.tree(hashtree.leaves(docs, ["doc_id"], 2), 2)


def changed_by_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which some came, went and changed, found by their trees in tables with a folder a range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.col("o_orderkey")
    copy = orders.where(key % 997 != 1).withColumn("o_orderstatus", F.when(key % 1009 == 2, "?").otherwise(F.col("o_orderstatus"))).unionByName(orders.where(key % 991 == 3).withColumn("o_orderkey", -key))
    sides = []
    for df in (orders, copy):
        path = scratch_folder(spark)
        hashtree.write_ranges(df, ["o_orderkey"], path, 2)
        sides.append(spark.read.schema(orders.schema.add("range", "string")).parquet(path))
    trees = [hashtree.tree(hashtree.leaves(d.drop("range"), ["o_orderkey"], 2), 2) for d in sides]
    return hashtree.changed_rows(*sides, hashtree.unequal_ranges(*trees, 2), ["o_orderkey"])


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a column named like a token, and with absolute paths replaced in the url."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.concat(F.lit("see /var/data/"), F.col("page_id").cast("string"), F.lit(" now")).alias("note"), F.lit("x").alias("api_token"))
    return audit.redact(p)


QUERIES = [fill_costs, order_commissions, tick_prices, settlement_dates, slippage, price_changes, parsed_keys, roc_dates, securities, fill_capacities, target_quantities, postings, unbalanced_postings, cost_basis, settled_cash, dividend_entitlements, stale_marks, nav_snapshots, performance, benchmark_stats, attribution, notional_allocation, pretrade_flags, reservation_totals, top_k_targets, quantile_targets, target_limits, coverage_targets, weekly_rebalance, equal_weights, target_drift, fills_with_orders, pnl_drawdown, daily_report, scenario_costs, scenario_outcomes, price_views, unsupported_actions, action_violations, reconciliation, table_diff, order_audit, order_states, journal_audit, order_activity, bar_violations, table_fingerprint, hash_tree, changed_by_tree, redacted]

_R = lambda c, n=6: f"round({c}, {n}) + 0.0"
_BB = f"WITH {BRAND_BARS}"
_EB = f"WITH {EVENT_BARS}"
_FF = f"WITH {_FILLS}"
_CUM = "CASE WHEN {c} = 0 THEN 0 ELSE ceil(greatest(CAST({c} * 0.001425 AS DECIMAL(30,8)), 20)) END"
_PRED = f"{_EB}, pred AS (SELECT trade_date AS decision_time, instrument_id, CASE WHEN volume % 5 <> 0 THEN round(close / nullif(open, 0) - 1, 9) END AS p FROM bars), rk AS (SELECT *, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY decision_time ORDER BY p IS NULL, p DESC, instrument_id) END AS rank, count(p) OVER (PARTITION BY decision_time) AS n FROM pred)"
_TOP8 = _PRED + ", t AS (SELECT *, coalesce(rank <= 8, false) AS selected, CASE WHEN rank <= 8 THEN least(0.95 / least(8, n), 0.2) ELSE 0 END AS weight FROM rk)"


def _tick_sql(side: str) -> str:
    tick = lambda c: f"(CASE WHEN {c} >= 1000 THEN 5 WHEN {c} >= 500 THEN 1 WHEN {c} >= 100 THEN 0.5 WHEN {c} >= 50 THEN 0.1 WHEN {c} >= 10 THEN 0.05 ELSE 0.01 END)"
    f = "ceil" if side == "buy" else "floor"
    step = lambda c: f"{f}(round({c} / {tick(c)}, 6)) * {tick(c)}"
    return f"(SELECT {step('c')} FROM (SELECT {step('b')} AS c FROM (SELECT {step('p')} AS b)))"


_BASIS = f"""WITH RECURSIVE {_FILLS},
q AS (SELECT portfolio, instrument_id, fill_id, side, CAST(quantity AS HUGEINT) AS n, CAST(CAST(price * 10000 AS BIGINT) AS HUGEINT) * 10000 AS p, CAST(fee AS HUGEINT) * 100000000 AS f, CAST(tax AS HUGEINT) * 100000000 AS t, row_number() OVER (PARTITION BY portfolio, instrument_id ORDER BY session, fill_id) AS k FROM fills),
w AS (
  SELECT DISTINCT portfolio, instrument_id, '' AS fill_id, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS held, CAST(0 AS HUGEINT) AS book, CAST(0 AS HUGEINT) AS cost, CAST(0 AS HUGEINT) AS realised, CAST(NULL AS VARCHAR) AS code FROM q
  UNION ALL
  SELECT portfolio, instrument_id, fill_id, k, CASE WHEN side = 'buy' THEN held + n WHEN short THEN held ELSE held - n END,
         CASE WHEN side = 'buy' THEN book + p * n + f ELSE book - cost END, cost, CASE WHEN side = 'buy' OR short THEN 0 ELSE p * n - f - t - cost END, CASE WHEN short THEN 'short_sale' END
  FROM (SELECT *, CASE WHEN side = 'buy' OR short THEN 0 WHEN n = held THEN book ELSE (book * n) // held + CASE WHEN 2 * ((book * n) % held) > held OR (2 * ((book * n) % held) = held AND ((book * n) // held) % 2 = 1) THEN 1 ELSE 0 END END AS cost
        FROM (SELECT q.*, w.held, w.book, q.side <> 'buy' AND q.n > w.held AS short FROM w JOIN q ON q.portfolio = w.portfolio AND q.instrument_id = w.instrument_id AND q.k = w.k + 1)))"""

_FIELDS = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(["doc_id", "lang", "n_chars", "source", "text"]))
_HASHES = f"SELECT substr(sha256(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR)), 1, 2) AS range, sha256({_FIELDS}) AS h FROM documents"
_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS w{i}" for i in range(4))
_UP = "SELECT substr(range, 1, {d}) AS range, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(range || ':' || digest, ',' ORDER BY range)) AS digest FROM {t} GROUP BY 1"

#: Fills of the plans, executed up to each participation, and the grid of scenarios.
_PLANS = f"""{_PRED}, dates AS (SELECT trade_date, 'daily' AS rebalance FROM days UNION ALL SELECT min(trade_date), 'weekly' FROM days GROUP BY isoyear(trade_date), weekofyear(trade_date) UNION ALL SELECT trade_date, 'every_third' FROM days WHERE (session_idx - 1) % 3 = 0),
fills AS (SELECT rebalance, k AS top_k, side, CAST(floor(round(100000.0::DOUBLE / k / open, 9)) AS BIGINT) AS quantity, CAST(round(CASE side WHEN 'buy' THEN open ELSE close END, 2) AS DECIMAL(20,4)) AS price, volume * 1000 AS volume
  FROM rk JOIN bars b ON b.trade_date = rk.decision_time AND b.instrument_id = rk.instrument_id JOIN dates d ON d.trade_date = b.trade_date, unnest([1, 2, 3]) t(k), unnest(['buy', 'sell']) u(side) WHERE rank <= k AND open > 0 AND close > 0),
e AS (SELECT *, least(quantity, CAST(floor(volume * p::DOUBLE) AS BIGINT)) AS done, CAST(price * least(quantity, CAST(floor(volume * p::DOUBLE) AS BIGINT)) AS DECIMAL(20,8)) AS g FROM fills, unnest([0.01, 0.05, 0.1, 0.25]) q(p))"""
_GRID = """s AS (SELECT b::DOUBLE AS slippage_bps, p::DOUBLE AS participation, c::DOUBLE AS commission_factor, r AS rebalance, k AS top_k FROM unnest([0, 5, 10, 25, 50]) z(b), unnest([0.01, 0.05, 0.1, 0.25]) q(p), unnest([0.5, 1, 2]) x(c), unnest(['daily', 'weekly', 'every_third']) y(r), unnest([1, 2, 3]) t(k))"""

ORACLES = {
    "table_fingerprint": """WITH h AS (SELECT sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR)) AS h FROM documents),
c AS (SELECT h, count(*) AS n FROM h GROUP BY 1), f AS (SELECT substr(h, 1, 4) AS p, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS h FROM c GROUP BY 1),
m AS (SELECT substr(p, 1, 2) AS p, sum(n) AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM f GROUP BY 1)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, sha256(coalesce(string_agg(h, '' ORDER BY p), '')) AS fingerprint FROM m""",
    "hash_tree": f"""WITH h AS ({_HASHES}), s AS (SELECT range, count(*) AS rows, {_SUMS} FROM h GROUP BY 1),
n2 AS (SELECT range, rows, sha256(concat_ws('|', rows, w0, w1, w2, w3)) AS digest FROM s), n1 AS ({_UP.format(d=1, t="n2")}), n0 AS ({_UP.format(d=0, t="n1")})
SELECT 2 AS depth, * FROM n2 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 0, * FROM n0""",
    "changed_by_tree": "SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 997 = 1 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 997 <> 1 AND o_orderkey % 1009 = 2 AND o_orderstatus <> '?' UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 991 = 3",
    "cost_basis": f"{_BASIS} SELECT portfolio, instrument_id, fill_id, CAST(held AS BIGINT) AS held, CAST(book AS DOUBLE) / 1e8 AS book_cost, CAST(cost AS DOUBLE) / 1e8 AS cost_of_sales, CAST(realised AS DOUBLE) / 1e8 AS realised, code FROM w WHERE k > 0",
    "fill_costs": f"{_FF} SELECT fill_id, CAST(fee AS DOUBLE) AS fee, CAST(tax AS DOUBLE) AS tax FROM fills",
    "order_commissions": f"{_FF}, c AS (SELECT fill_id, instrument_id, price * quantity AS g, sum(price * quantity) OVER (PARTITION BY order_id ORDER BY seq, instrument_id, quantity, price ROWS UNBOUNDED PRECEDING) AS c FROM fills) SELECT fill_id, instrument_id, CAST({_CUM.format(c='c')} - {_CUM.format(c='(c - g)')} AS DOUBLE) AS fee FROM c",
    "tick_prices": f"SELECT p_partkey, CAST({_tick_sql('buy')} AS DOUBLE) AS buy, CAST({_tick_sql('sell')} AS DOUBLE) AS sell FROM (SELECT p_partkey, round(p_retailprice / 10, 3) AS p FROM part)",
    "settlement_dates": f"{_EB} SELECT e.event_id, b.trade_date AS settlement_date FROM events e JOIN days a ON a.trade_date = CAST(e.ts AS DATE) LEFT JOIN days b ON b.session_idx = a.session_idx + 2",
    "slippage": f"{_FF} SELECT fill_id, {_R('quantity * (CAST(price AS DOUBLE) - p_retailprice) * CASE WHEN side = chr(98) || chr(117) || chr(121) THEN 1 ELSE -1 END', 4)} AS slippage FROM fills JOIN part ON p_partkey = CAST(instrument_id AS BIGINT)",
    "price_changes": f"{_EB}, m AS (SELECT instrument_id, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS pct FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)) SELECT instrument_id, {_R('avg(pct)', 5)} AS mean_pct, {_R('quantile_cont(abs(pct), 0.9)', 5)} AS p90 FROM m GROUP BY 1",
    "parsed_keys": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN round(p_retailprice, 2) END AS price, CASE p_partkey % 3 WHEN 0 THEN 'otc' WHEN 2 THEN 'tse' END AS market, CASE WHEN p_partkey % 3 <> 1 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') END AS symbol FROM part",
    "roc_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "securities": "SELECT p_partkey, CASE WHEN p_size < 10 OR p_partkey % 9 = 0 THEN 'excluded_product' ELSE 'ordinary_share' END AS kind FROM part",
    "fill_capacities": f"{_FF}, v AS (SELECT *, CAST(floor(avg(quantity) OVER (PARTITION BY instrument_id) * 10) AS BIGINT) AS volume FROM fills), r AS (SELECT *, CAST(floor(volume * 0.1::DOUBLE) AS BIGINT) AS room FROM v) SELECT fill_id, room, CASE WHEN seq = 7 THEN 'suspended' WHEN seq = 6 THEN 'price_limit_locked' WHEN volume = 0 THEN 'zero_volume' WHEN room = 0 THEN 'participation_capacity_zero' WHEN room < quantity THEN 'insufficient_volume_for_full_fill' END AS reason FROM r",
    "target_quantities": "SELECT p_partkey, max(k * 10) AS quantity FROM (SELECT p_partkey, CAST(round(p_retailprice, 2) AS DECIMAL(12,2)) AS price FROM part) p, range(0, 60) t(k) WHERE k = 0 OR k * 10 * price + ceil(greatest(CAST(k * 10 * price * 0.001425 AS DECIMAL(30,8)), 20)) <= 50000 GROUP BY 1",
    "postings": f"{_FF}, g AS (SELECT portfolio, side, CAST(sum(price * quantity) AS DOUBLE) AS v, CAST(sum(fee) AS DOUBLE) AS fee, CAST(sum(tax) AS DOUBLE) AS tax FROM fills GROUP BY 1, 2) SELECT portfolio, account, round(CAST(sum(a) AS DOUBLE), 3) + 0.0 AS balance FROM (SELECT portfolio, unnest(CASE WHEN side = 'buy' THEN ['inventory', 'payable'] ELSE ['cost_of_sales', 'inventory', 'receivable', 'commission', 'tax', 'proceeds'] END) AS account, unnest(CASE WHEN side = 'buy' THEN [v + fee, -(v + fee)] ELSE [0, 0, v - fee - tax, fee, tax, -v] END) AS a FROM g) GROUP BY 1, 2",
    "unbalanced_postings": "SELECT '' AS portfolio, '' AS fill_id, 0.0::DOUBLE AS residual WHERE false",
    "settled_cash": f"{_FF}, d AS (SELECT session, row_number() OVER (ORDER BY session) AS i FROM (SELECT DISTINCT session FROM fills)), c AS (SELECT f.portfolio, f.session, b.session AS due, CASE WHEN side = 'buy' THEN -(price * quantity + fee) ELSE price * quantity - fee - tax END AS cash FROM fills f JOIN d a USING (session) LEFT JOIN d b ON b.i = a.i + 2), e AS (SELECT portfolio, session AS trade_date, 0 AS flow, -least(cash, 0) AS pay, greatest(cash, 0) AS rec FROM c UNION ALL SELECT portfolio, due, cash, least(cash, 0), -greatest(cash, 0) FROM c WHERE due IS NOT NULL), g AS (SELECT portfolio, trade_date, sum(flow) AS flow, sum(pay) AS pay, sum(rec) AS rec FROM e GROUP BY 1, 2) SELECT portfolio, trade_date, CAST(flow AS DOUBLE) AS flow, CAST(sum(flow) OVER w AS DOUBLE) AS settled_cash, CAST(sum(pay) OVER w AS DOUBLE) AS payable, CAST(sum(rec) OVER w AS DOUBLE) AS receivable FROM g WINDOW w AS (PARTITION BY portfolio ORDER BY trade_date)",
    "dividend_entitlements": f"{_BB}, h AS (SELECT instrument_id, trade_date, sum(volume) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS held FROM bars), a AS (SELECT instrument_id, min(trade_date) AS ex_date FROM bars GROUP BY instrument_id, year(trade_date)) SELECT 'p' AS portfolio, a.instrument_id, a.ex_date, CAST(a.ex_date + 30 AS DATE) AS payment_date, CAST(max(held) AS BIGINT) AS quantity, {_R('max(held) * 0.5')} AS amount FROM a JOIN h ON h.instrument_id = a.instrument_id AND h.trade_date < a.ex_date GROUP BY 1, 2, 3, 4",
    "stale_marks": f"{_EB}, m AS (SELECT instrument_id, session_idx, last_value(close IGNORE NULLS) OVER w AS mark, session_idx - last_value(CASE WHEN close IS NOT NULL THEN session_idx END IGNORE NULLS) OVER w AS age FROM grid WINDOW w AS (PARTITION BY instrument_id ORDER BY session_idx ROWS UNBOUNDED PRECEDING)) SELECT instrument_id, CAST(session_idx AS INTEGER) AS session_idx, {_R('mark')} AS mark, CAST(age AS INTEGER) AS age, coalesce(age > 1, true) AS stale FROM m",
    "nav_snapshots": f"{_BB} SELECT 'p' AS portfolio, trade_date, {_R('sum(CASE WHEN weekofyear(trade_date) <> 9 THEN volume * close ELSE 0 END)', 3)} AS market_value, {_R('sum(volume) * 10 + 5 - 3 + 1 + sum(CASE WHEN weekofyear(trade_date) <> 9 THEN volume * close ELSE 0 END)', 3)} AS nav, weekofyear(trade_date) <> 9 AS complete FROM bars GROUP BY trade_date",
    "performance": f"{_BB}, m AS (SELECT instrument_id AS run_id, trade_date, close AS nav, open / close AS exposure, high, low, close / lag(close) OVER w - 1 AS r, close / max(close) OVER w - 1 AS d FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)), g AS (SELECT run_id, count(r) AS n_returns, arg_max(nav, trade_date) / arg_min(nav, trade_date) AS x, date_diff('day', min(trade_date), max(trade_date)) AS days, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END)) AS dn, min(d) AS md, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS pr, avg(exposure) AS e, avg(nav) AS an, sum(high) AS nt, sum(low / 1000) AS tc, count(*) AS nf FROM m GROUP BY 1) SELECT run_id, n_returns, {_R('x - 1', 5)} AS total_return, {_R('pow(x, 365.25 / days) - 1', 5)} AS cagr, {_R('m * 252', 5)} AS annual_mean, {_R('sd * sqrt(252)', 5)} AS volatility, {_R('m / sd * sqrt(252)', 5)} AS sharpe, {_R('m / dn * sqrt(252)', 5)} AS sortino, {_R('md', 5)} AS max_drawdown, {_R('(pow(x, 365.25 / days) - 1) / abs(md)', 5)} AS calmar, {_R('pr', 5)} AS positive_ratio, {_R('e', 5)} AS mean_exposure, {_R('tc', 5)} AS total_cost, nf AS n_fills, {_R('nt / an', 5)} AS turnover FROM g",
    "benchmark_stats": f"{_BB}, f AS (SELECT instrument_id FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT trade_date) FROM bars)), lv AS (SELECT trade_date, avg(close) AS l FROM bars GROUP BY 1), bm AS (SELECT trade_date, l / lag(l) OVER (ORDER BY trade_date) - 1 AS b FROM lv), r AS (SELECT instrument_id AS run_id, trade_date, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY trade_date) - 1 AS r FROM bars JOIN f USING (instrument_id)), j AS (SELECT run_id, r, b FROM r JOIN bm USING (trade_date) WHERE r IS NOT NULL) SELECT run_id, {_R('avg(r - b) * 252', 4)} AS active_return, {_R('stddev_samp(r - b) * sqrt(252)', 4)} AS tracking_error, {_R('avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252))', 4)} AS information_ratio, {_R('covar_samp(r, b) / var_samp(b)', 4)} AS beta, {_R('(avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252', 4)} AS alpha, {_R('product(1 + r) - 1', 4)} AS compounded, {_R('product(1 + b) - 1', 4)} AS benchmark_compounded FROM j GROUP BY 1",
    "attribution": f"{_BB}, m AS (SELECT instrument_id AS portfolio, trade_date, (close - lag(close) OVER w) * 10 AS delta, (close - lag(close) OVER w) * 10 - open / 2 + low / 2 AS pe FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)) SELECT portfolio, trade_date, {_R('delta', 8)} AS delta, {_R('pe', 8)} AS price_effect, 2.0 AS dividends, 1.0 AS fees, 0.25 AS taxes, 0.5 AS slippage, {_R('delta - pe - 2 + 1 + 0.25 + 0.5', 8)} AS residual FROM m WHERE delta IS NOT NULL",
    "notional_allocation": f"{_FF}, n AS (SELECT portfolio, p_brand AS instrument_id, CAST(sum(price * quantity) AS DOUBLE) AS v FROM fills JOIN part ON p_partkey = CAST(instrument_id AS BIGINT) GROUP BY 1, 2), s AS (SELECT *, floor(100000 * (v / sum(v) OVER (PARTITION BY portfolio))) AS s, row_number() OVER (PARTITION BY portfolio ORDER BY instrument_id DESC) = 1 AS fin FROM n) SELECT portfolio, instrument_id, {_R('v', 4)} AS notional, {_R('CASE WHEN fin THEN 100000 - (sum(s) OVER (PARTITION BY portfolio) - s) ELSE s END / 100', 2)} AS allocated FROM s",
    "pretrade_flags": f"{_FF}, o AS (SELECT portfolio, fill_id AS order_id, instrument_id, side, quantity, CAST(price AS DOUBLE) AS price, CASE WHEN CAST(instrument_id AS INT) % 2 = 0 THEN 40 ELSE 0 END AS held, CAST(quantity * price AS DECIMAL(20,4)) AS v, fee + tax AS cost, CASE WHEN portfolio <> '3' THEN 200000.0 END AS nav, CASE WHEN portfolio <> '3' THEN 150000.0 END AS cash, CASE WHEN side = 'sell' THEN 0 ELSE 1 END AS k FROM fills), r AS (SELECT *, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER i AS sold, sum(CASE WHEN side = 'buy' THEN v + cost ELSE 0 END) OVER q AS bought, coalesce(worth, 0) - CASE WHEN held > 0 THEN 4000 ELSE 0 END + sum(CASE WHEN side = 'buy' THEN v ELSE -v END) OVER q - sum(CASE WHEN side = 'buy' THEN v ELSE -v END) OVER i AS others, held + sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER i AS aft FROM o LEFT JOIN (SELECT portfolio, 4000 * count(DISTINCT instrument_id) AS worth FROM fills WHERE CAST(instrument_id AS INT) % 2 = 0 GROUP BY 1) USING (portfolio) WINDOW i AS (PARTITION BY portfolio, instrument_id ORDER BY k, order_id ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY portfolio ORDER BY k, order_id ROWS UNBOUNDED PRECEDING)) SELECT portfolio, order_id, concat_ws(';', CASE WHEN nav IS NULL OR price <= 0 THEN 'valuation_missing' END, CASE WHEN side = 'sell' AND sold > held THEN 'short_sale' END, CASE WHEN v > 60000 THEN 'notional_limit' END, CASE WHEN price > 0 AND greatest(aft, 0) * price > 0.2 * nav THEN 'weight_limit' END, CASE WHEN price > 0 AND CAST(others AS DOUBLE) + greatest(aft, 0) * price > nav THEN 'gross_limit' END, CASE WHEN side = 'buy' AND bought > cash THEN 'insufficient_buying_power' END) AS flags FROM r",
    "reservation_totals": f"{_FF}, a AS (SELECT f.*, quantity - CASE WHEN order_id % 3 = 0 THEN quantity // 2 ELSE 0 END AS rest FROM fills f JOIN lineitem l ON l.l_orderkey = f.order_id AND l.l_linenumber = f.seq WHERE l_linestatus = 'O') SELECT portfolio, instrument_id, round(CAST(sum(CASE WHEN side = 'buy' THEN rest * price ELSE 0 END) AS DOUBLE), 4) + 0.0 AS reserved_cash, CAST(sum(CASE WHEN side = 'sell' THEN rest ELSE 0 END) AS BIGINT) AS reserved_shares, CAST(sum(CASE WHEN side = 'buy' THEN rest ELSE -rest END) AS BIGINT) AS projected_delta FROM a GROUP BY 1, 2",
    "top_k_targets": f"{_TOP8} SELECT decision_time, instrument_id, CAST(rank AS INTEGER) AS rank, selected, {_R('CAST(weight AS DOUBLE)')} AS weight, CASE WHEN p IS NULL THEN 'missing_prediction' WHEN selected THEN 'selected' ELSE 'not_selected' END AS reason FROM t",
    "quantile_targets": f"{_PRED}, t AS (SELECT *, coalesce(rank <= ceil(round(n * 0.2, 9)), false) AS selected FROM rk), u AS (SELECT *, count(*) FILTER (selected) OVER (PARTITION BY decision_time) AS c FROM t) SELECT decision_time, instrument_id, CAST(rank AS INTEGER) AS rank, selected, {_R('CAST(CASE WHEN selected THEN least(0.95 / c, 0.1) ELSE 0 END AS DOUBLE)')} AS weight, CASE WHEN p IS NULL THEN 'missing_prediction' WHEN selected THEN 'selected' ELSE 'not_selected' END AS reason FROM u",
    "target_limits": f"{_TOP8}, j AS (SELECT coalesce(a.decision_time, b.trade_date) AS decision_time, coalesce(a.weight, 0) AS t, CASE WHEN b.trade_date IS NOT NULL THEN 0.02 ELSE 0 END AS p, a.decision_time IS NULL AS o, a.volume, a.decision_time IS NOT NULL AND coalesce(abs(floor(round(10000 * CAST(a.weight AS DOUBLE) / nullif(a.close, 0), 9)) - CASE WHEN b.trade_date IS NOT NULL THEN 2 ELSE 0 END), -1) <> 0 AS moves, abs(floor(round(10000 * CAST(a.weight AS DOUBLE) / nullif(a.close, 0), 9)) - CASE WHEN b.trade_date IS NOT NULL THEN 2 ELSE 0 END) AS change FROM (SELECT t.*, c.close, c.volume FROM t JOIN bars c ON c.trade_date = t.decision_time AND c.instrument_id = t.instrument_id WHERE selected) a FULL JOIN (SELECT * FROM bars WHERE volume >= 4) b ON a.decision_time = b.trade_date AND a.instrument_id = b.instrument_id), g AS (SELECT decision_time, sum(t) AS gross, max(t) AS largest, count(*) FILTER (t > 0) AS positions, sum(abs(t - p)) AS turnover, count(*) FILTER (o) AS omitted, count(*) FILTER (moves) AS orders, count(*) FILTER (moves AND coalesce(volume <= 0 OR change > volume, true)) AS over_volume FROM j GROUP BY 1) SELECT decision_time, {_R('CAST(gross AS DOUBLE)')} AS gross, {_R('CAST(largest AS DOUBLE)')} AS largest, positions, {_R('CAST(turnover AS DOUBLE)')} AS turnover, omitted, orders, over_volume, concat_ws(';', CASE WHEN gross > 0.94 + 1e-9 THEN 'cash_buffer' END, CASE WHEN turnover > 0.9 + 1e-9 THEN 'turnover_limit' END, CASE WHEN omitted > 0 THEN 'omitted_positions' END, CASE WHEN over_volume > 0 THEN 'volume_participation' END, CASE WHEN orders > 7 THEN 'order_count' END) AS reasons FROM g",
    "coverage_targets": f"{_TOP8}, c AS (SELECT *, count(p) OVER (PARTITION BY decision_time) / count(*) OVER (PARTITION BY decision_time) AS cov FROM t) SELECT decision_time, instrument_id, {_R('CAST(CASE WHEN p IS NOT NULL THEN weight ELSE 0 END AS DOUBLE)')} AS weight, p IS NOT NULL AS predicted, {_R('cov')} AS coverage FROM c WHERE cov >= 0.8",
    "weekly_rebalance": f"{_EB} SELECT min(trade_date) AS trade_date FROM days GROUP BY isoyear(trade_date), weekofyear(trade_date)",
    "equal_weights": f"{_EB}, c AS (SELECT trade_date AS session, instrument_id, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY instrument_id DESC) AS k FROM bars) SELECT session, instrument_id, {_R('(1000000 // n + CASE WHEN k = 1 THEN 1000000 - (1000000 // n) * n ELSE 0 END) / 1000000')} AS weight FROM c",
    "target_drift": f"WITH h AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS held FROM lineitem GROUP BY 1), a AS (SELECT p_brand AS portfolio, CAST(p_partkey AS VARCHAR) AS instrument_id, CASE WHEN coalesce(held, 0) = 0 THEN 0.0 WHEN p_size > 3 THEN held * p_retailprice / 1000000 END AS actual FROM part LEFT JOIN h ON l_partkey = p_partkey) SELECT portfolio, instrument_id, 0.02 AS weight, {_R('actual', 9)} AS actual, {_R('actual - 0.02', 9)} AS drift, {_R('sum(abs(actual - 0.02)) OVER (PARTITION BY portfolio)', 9)} AS total_drift FROM a",
    "fills_with_orders": f"{_FF} SELECT order_id, fill_id, side, o_orderstatus FROM fills JOIN orders ON o_orderkey = order_id",
    "pnl_drawdown": f"{_BB} SELECT instrument_id AS portfolio, trade_date, {_R('close - lag(close) OVER w', 9)} AS daily_pnl, {_R('max(close) OVER w', 9)} AS peak_nav, {_R('close / max(close) OVER w - 1', 9)} AS drawdown FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)",
    "daily_report": f"{_FF}, a AS (SELECT CAST(o_orderdate AS DATE) AS session, count(*) AS orders, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders GROUP BY 1), b AS (SELECT session, count(*) AS fills, CAST(sum(CAST(price * quantity AS DECIMAL(22,4))) AS DOUBLE) AS notional, CAST(sum(CAST(fee AS DECIMAL(22,4))) AS DOUBLE) AS costs FROM fills GROUP BY 1) SELECT session, orders, rejected, fills, notional, costs FROM a FULL JOIN b USING (session)",
    "scenario_costs": f"""{_PLANS},
o AS (SELECT rebalance, top_k, p::DOUBLE AS participation, count(*) AS n_fills, count(*) FILTER (done < quantity) AS unfilled, CAST(sum(g) AS DECIMAL(22,4)) AS gross, CAST(sum(CASE WHEN g = 0 THEN 0 ELSE ceil(greatest(CAST(g * 0.001425 AS DECIMAL(30,8)), 20)) END) AS DECIMAL(22,4)) AS fee, CAST(sum(CASE WHEN side = 'sell' THEN floor(CAST(g * 0.003 AS DECIMAL(30,8))) ELSE 0 END) AS DECIMAL(22,4)) AS tax FROM e GROUP BY ALL),
{_GRID}
SELECT slippage_bps, participation, commission_factor, rebalance, top_k, n_fills, unfilled, {_R('CAST(gross AS DOUBLE)')} AS traded, {_R('CAST(fee * CAST(commission_factor AS DECIMAL(8,4)) + tax + gross * CAST(slippage_bps / 10000 AS DECIMAL(12,8)) AS DOUBLE)')} AS costs FROM s LEFT JOIN o USING (participation, rebalance, top_k)""",
    "scenario_outcomes": f"""{_PLANS},
o AS (SELECT rebalance, top_k, p::DOUBLE AS participation, count(*) AS n_fills, count(*) FILTER (done < quantity) AS unfilled, CAST(sum(g) AS DECIMAL(22,4)) AS gross, CAST(sum(CASE side WHEN 'buy' THEN g ELSE -g END) AS DECIMAL(22,4)) AS net, min(CAST(price * CAST(floor(volume * p::DOUBLE) AS BIGINT) AS DECIMAL(28,4))) AS room, CAST(sum(CASE WHEN g = 0 THEN 0 ELSE ceil(greatest(CAST(g * 0.001425 AS DECIMAL(30,8)), 20)) END) AS DECIMAL(22,4)) AS fee, CAST(sum(CASE WHEN side = 'sell' THEN floor(CAST(g * 0.003 AS DECIMAL(30,8))) ELSE 0 END) AS DECIMAL(22,4)) AS tax FROM e WHERE rebalance <> 'weekly' OR top_k = 1 GROUP BY ALL),
{_GRID},
v AS (SELECT *, CASE WHEN n_fills IS NULL THEN 'no_fills' WHEN gross = 0 THEN 'nothing_executed' END AS reason, gross * CAST(slippage_bps / 10000 AS DECIMAL(12,8)) AS slip FROM s LEFT JOIN o USING (participation, rebalance, top_k))
SELECT slippage_bps, participation, commission_factor, rebalance, top_k, CASE WHEN reason IS NULL THEN 'completed' ELSE 'failed' END AS status, reason, {_R('CASE WHEN reason IS NULL THEN CAST(-net - (fee * CAST(commission_factor AS DECIMAL(8,4)) + tax + slip) AS DOUBLE) / 1000000 END', 12)} AS total_return,
  {_R('CASE WHEN reason IS NULL THEN CAST(gross AS DOUBLE) / 1000000 END', 12)} AS turnover, {_R('CASE WHEN reason IS NULL THEN CAST(slip AS DOUBLE) END', 12)} AS slippage_cost, {_R('CASE WHEN reason IS NULL THEN CAST(room AS DOUBLE) END', 12)} AS capacity FROM v""",
    "price_views": f"{_BB}, x AS (SELECT *, weekofyear(trade_date) AS w, lag(close) OVER o AS pc FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date)), f AS (SELECT *, coalesce(product(CASE WHEN w = 20 THEN 0.5 ELSE 1 END) OVER l, 1) AS sf, coalesce(product(CASE WHEN w = 40 AND pc > 0 THEN (pc - 25) / pc ELSE 1 END) OVER l, 1) AS cf FROM x WINDOW l AS (PARTITION BY instrument_id ORDER BY trade_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT instrument_id, trade_date, {_R('sf', 9)} AS split_factor, {_R('cf', 9)} AS cash_factor, {_R('close * sf', 9)} AS split_close, {_R('close * sf * cf', 9)} AS total_return_close, CAST(round(volume / sf) AS BIGINT) AS split_volume, high >= greatest(open, close, low) AND low <= least(open, close, high) AS ohlc_ok FROM f",
    "unsupported_actions": "WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument_id, CAST(o_orderdate AS DATE) AS ex_date, CASE WHEN o_orderpriority LIKE '1%' THEN 'rights_issue' WHEN o_orderpriority LIKE '2%' THEN 'capital_reduction' ELSE 'cash_dividend' END AS k, CASE WHEN o_orderstatus = 'F' THEN 'loss_offset' END AS s FROM orders) SELECT instrument_id, ex_date, k AS code FROM a WHERE k = 'rights_issue' OR (k = 'capital_reduction' AND s IS NULL) UNION ALL SELECT instrument_id, ex_date, 'several_adjusting_actions' FROM a WHERE k = 'cash_dividend' GROUP BY 1, 2 HAVING count(*) > 1",
    "action_violations": "WITH a AS (SELECT o_orderkey AS e, o_orderkey % 5 AS k, o_orderkey % 7 = 0 AS early, o_orderstatus = 'P' AS noex FROM orders) SELECT 's' AS source, e AS source_event_id, unnest(list_filter([CASE WHEN k = 3 THEN 'missing_ratio' END, CASE WHEN k = 2 THEN 'ratio_not_positive' END, CASE WHEN k = 0 THEN 'missing_cash_amount' END, CASE WHEN k = 1 THEN 'cash_amount_negative' END, CASE WHEN k < 4 AND noex THEN 'missing_ex_date' END, CASE WHEN early THEN 'available_before_announcement' END, CASE WHEN k = 4 THEN 'missing_symbols' END], lambda x : x IS NOT NULL)) AS code FROM a",
    "reconciliation": "WITH r AS (SELECT CASE WHEN o_orderkey % 10 = 4 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'Z' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 10 <> 6 THEN o_custkey END AS cu FROM orders WHERE o_orderkey % 10 <> 3), j AS (SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'unknown_locally' WHEN r.o_orderkey IS NULL THEN 'missing_remotely' WHEN o_orderstatus IS DISTINCT FROM st OR o_custkey IS DISTINCT FROM cu THEN 'differs:' || concat_ws(',', CASE WHEN o_orderstatus IS DISTINCT FROM st THEN 'o_orderstatus' END, CASE WHEN o_custkey IS DISTINCT FROM cu THEN 'o_custkey' END) END AS detail FROM orders o FULL JOIN r ON o.o_orderkey = r.o_orderkey) SELECT 'orders' AS category, o_orderkey, true AS critical, detail FROM j WHERE detail IS NOT NULL",
    "table_diff": "WITH r AS (SELECT CASE WHEN c_custkey % 6 = 2 THEN c_custkey + 1000000 ELSE c_custkey END AS k, CASE WHEN c_custkey % 6 = 3 THEN -1 ELSE c_nationkey END AS n, CASE WHEN c_custkey % 6 = 4 THEN 0 ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 6 <> 1), j AS (SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'added' WHEN k IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN c_custkey IS NULL OR k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c_nationkey IS DISTINCT FROM n THEN 'c_nationkey' END, CASE WHEN c_acctbal IS DISTINCT FROM b THEN 'c_acctbal' END) END AS fields FROM customer FULL JOIN r ON c_custkey = k) SELECT c_custkey, change, fields, change = 'changed' AND fields LIKE '%c_nationkey%' AS critical_change FROM j WHERE change <> 'changed' OR fields <> ''",
    "order_audit": "WITH ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS INTEGER) AS n FROM lineitem), e AS (SELECT l_orderkey AS order_id, n + CASE WHEN l_orderkey % 5 = 0 AND n > 2 THEN 1 ELSE 0 END AS sequence, l_linestatus AS state, (l_orderkey - CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) || '-' || n AS event_id, l_quantity AS filled FROM ln), w AS (SELECT *, lag(state) OVER o AS was, lag(sequence) OVER o AS bef, row_number() OVER (PARTITION BY event_id ORDER BY order_id, sequence) AS n FROM e WINDOW o AS (PARTITION BY order_id ORDER BY sequence)) SELECT order_id, sequence, unnest(list_filter([CASE WHEN was = 'F' AND state = 'O' THEN 'transition_not_allowed' END, CASE WHEN sequence <> bef + 1 THEN 'sequence_gap' END, CASE WHEN filled > 45 THEN 'overfilled' END, CASE WHEN n > 1 THEN 'duplicate_event' END], lambda x : x IS NOT NULL)) AS code FROM w",
    "order_states": "WITH ln AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS INTEGER) AS n FROM lineitem), e AS (SELECT l_orderkey AS order_id, n + CASE WHEN l_orderkey % 5 = 0 AND n > 2 THEN 1 ELSE 0 END AS sequence, l_linestatus AS state, (l_orderkey - CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) || '-' || n AS event_id, l_quantity AS filled FROM ln) SELECT order_id, arg_max(state, sequence) AS state, max(sequence) AS sequence FROM e GROUP BY 1",
    "journal_audit": "WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), n AS (SELECT user_id AS run_id, event_id, event_id % 5 AS cor, event_type, CAST(row_number() OVER w AS INTEGER) AS sequence, lag(event_id) OVER w AS bef FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT n.*, coalesce(CASE k WHEN 1 THEN 'fill' WHEN 2 THEN 'intent' WHEN 3 THEN 'reserve' WHEN 4 THEN 'risk' WHEN 5 THEN 'run_completed' END, 'other') AS kind, CASE WHEN event_id % 3 = 0 THEN bef END AS cause FROM n JOIN t USING (event_type) WHERE event_id % 211 <> 0), g AS (SELECT run_id, sequence, lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence) AS b FROM e), s AS (SELECT *, list_position(['intent', 'risk', 'reserve', 'fill'], kind) AS p FROM e WHERE kind IN ('intent', 'risk', 'reserve', 'fill')), m AS (SELECT *, max(p) OVER (PARTITION BY run_id, cor ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mp FROM s) SELECT run_id, sequence, 'sequence_gap' AS code FROM g WHERE sequence <> coalesce(b, 0) + 1 UNION ALL SELECT a.run_id, a.sequence, 'broken_causation' FROM e a LEFT JOIN e c ON c.run_id = a.run_id AND c.event_id = a.cause WHERE a.cause IS NOT NULL AND (c.sequence IS NULL OR c.sequence >= a.sequence) UNION ALL SELECT run_id, sequence, 'step_out_of_order' FROM m WHERE p < mp UNION ALL SELECT run_id, max(sequence), 'missing_terminal_event' FROM e GROUP BY 1 HAVING arg_max(kind, sequence) <> 'run_completed' UNION ALL SELECT run_id, max(sequence), 'reservation_active' FROM e GROUP BY run_id, cor HAVING count(*) FILTER (kind = 'reserve') > count(*) FILTER (kind = 'fill')",
    "order_activity": f"{_FF} SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS occurred_at, o_orderstatus AS detail FROM orders UNION ALL SELECT 'fill', fill_id, session, side FROM fills UNION ALL SELECT 'risk', CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE), 'accepted' FROM orders WHERE o_orderkey % 2 = 0",
    "bar_violations": f"{_BB}, b AS (SELECT instrument_id, trade_date, open, low, close, CASE WHEN weekofyear(trade_date) = 5 THEN high / 2 ELSE high END AS high FROM bars) SELECT instrument_id, trade_date, unnest(list_filter([CASE WHEN high < greatest(open, close, low) THEN 'high_below' END, CASE WHEN low > least(open, close, high) THEN 'low_above' END], lambda x : x IS NOT NULL)) AS code FROM b",
    "redacted": r"SELECT page_id, regexp_replace(url, '(^|[^\w/:])/(?:[\w.\-]+/)+[\w.\-]*', '\1<path>', 'g') AS url, regexp_replace(html, '(^|[^\w/:])/(?:[\w.\-]+/)+[\w.\-]*', '\1<path>', 'g') AS html, 'see <path> now' AS note FROM pages",
}
