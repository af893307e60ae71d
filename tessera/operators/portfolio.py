"""Tables of fills, positions and values of many portfolios at once.

Money is decimal(20,8) and rates decimal(38,18) unless said otherwise. Keys are portfolio and instrument; no operator looks at one
portfolio at a time on the driver.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.functions import columns as H
from tessera.functions.columns import CostPolicy
from tessera.operators import scan
from tessera.operators.grid import asof_backward
from tessera.operators.scan import fold_in_blocks

#: Fills of a position that are folded together; a block's rows are appended to the result at once.
_BLOCK = 512
_WHOLE = "decimal(38,0)"


def _share(book: Column, quantity: Column, held: Column) -> Column:
    """book * quantity / held in whole units, ties to even; exact, as remainder and quotient are taken apart."""
    product = (book * quantity).cast(_WHOLE)
    left = product % held.cast(_WHOLE)
    down = F.try_divide(product - left, held).cast(_WHOLE)
    twice = left * 2
    return (down + F.when((twice > held) | ((twice == held) & (down % 2 == 1)), 1).otherwise(0)).cast(_WHOLE)


def _step(s: Column, r: Column) -> Column:
    """The position after one fill or split; all amounts, the ratio of a split (price) as well, in units of 0.00000001."""
    zero = F.lit(0).cast(_WHOLE)
    kind, n, held, book = r["side"], r["quantity"], s["held"], s["book"]
    one = F.lit(100_000_000).cast("decimal(9,0)")
    split_to = held.cast("decimal(19,0)") * r["price"].cast("decimal(18,0)")
    splits, buys = kind == "split", kind == "buy"
    whole = split_to % one == 0
    short = ~splits & ~buys & (n > held)
    sells = ~splits & ~buys & ~short
    cost = F.when(sells, F.when(n == held, book).otherwise(_share(book, n, held))).otherwise(zero).cast(_WHOLE)
    after = F.when(splits & whole, F.try_divide(split_to, one).cast("long")).when(buys, held + n).when(sells, held - n).otherwise(held)
    realised = F.when(sells, -r["due"] - cost).otherwise(zero).cast(_WHOLE)
    code = F.when(splits & ~whole, "split_not_integral").when(short, "short_sale")
    return F.struct(after.cast("long").alias("held"), F.when(buys, book + r["paid"]).otherwise(book - cost).cast(_WHOLE).alias("book"), cost.alias("cost"), realised.alias("realised"), code.alias("code"))


def cost_basis(fills: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Each fill with the position after it: held, book cost, cost of sales and realised gain; average cost, no short sales.

    fills: portfolio, instrument_id, fill_id, session, side, quantity, price, fee, tax; splits: portfolio, instrument_id,
    session, ratio, applied before that day's fills. The fold depends on order, so a position is one sorted array, folded in
    the JVM block by block; positions run in parallel. What a fill pays (buys) and what is due on it (fee, tax, less gross) need no
    position, so they are made before the fold, in its units."""
    money = lambda c: F.col(c).cast("decimal(20,8)").alias(c)
    rows = fills.select("portfolio", "instrument_id", F.col("fill_id").cast("string").alias("fill_id"), "session", F.lit(1).alias("seq"), "side", F.col("quantity").cast("long").alias("quantity"), money("price"), money("fee"), money("tax"))
    if splits is not None:
        zero = F.lit(0).cast("decimal(20,8)")
        rows = rows.unionByName(splits.select("portfolio", "instrument_id", F.lit("split").alias("fill_id"), "session", F.lit(0).alias("seq"), F.lit("split").alias("side"), F.lit(0).cast("long").alias("quantity"), F.col("ratio").cast("decimal(20,8)").alias("price"), zero.alias("fee"), zero.alias("tax")))
    start = F.struct(F.lit(0).cast("long").alias("held"), *(F.lit(0).cast(_WHOLE).alias(c) for c in ("book", "cost", "realised")), F.lit(None).cast("string").alias("code"))
    units = lambda c: F.floor(F.col(c) * F.lit(100_000_000).cast("decimal(9,0)")).cast(_WHOLE)
    gross = (units("price") * F.col("quantity")).cast(_WHOLE)
    # In the order of price, fee and tax: of one quantity and price, what is paid rises with the fee, and what is due with the tax.
    ready = rows.select("portfolio", "instrument_id", F.struct("session", "seq", "fill_id", "side", "quantity", units("price").alias("price"), (gross + units("fee")).cast(_WHOLE).alias("paid"), (units("fee") + units("tax") - gross).cast(_WHOLE).alias("due")).alias("r"))
    sorted_rows = ready.groupBy("portfolio", "instrument_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    folded = sorted_rows.select("portfolio", "instrument_id", fold_in_blocks("r", start, _step, _BLOCK).alias("o"))
    out = folded.select("portfolio", "instrument_id", F.explode("o").alias("o"))
    amount = lambda c: (F.col(f"o.s.{c}").cast("decimal(28,0)") * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(20,8)")
    return out.select("portfolio", "instrument_id", "o.r.fill_id", "o.r.session", "o.r.side", "o.r.quantity", "o.s.held", amount("book").alias("book_cost"), amount("cost").alias("cost_of_sales"), amount("realised").alias("realised"), "o.s.code")


def postings(fills: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """(portfolio, fill_id, session, account, amount): double entries, each fill summing to zero."""
    rows = fills if basis is None else fills.join(basis.select("portfolio", "instrument_id", F.col("fill_id"), "cost_of_sales"), ["portfolio", "instrument_id", "fill_id"])
    cost = F.col("cost_of_sales") if basis is not None else F.lit(0).cast("decimal(20,8)")
    m = lambda c: c.cast("decimal(20,8)")
    gross, fee, tax = m(F.col("price") * F.col("quantity")), m(F.col("fee")), m(F.col("tax"))
    line = lambda account, amount: F.struct(F.lit(account).alias("account"), m(amount).alias("amount"))
    buy = F.array(line("inventory", gross + fee), line("payable", -(gross + fee)))
    sell = F.array(line("cost_of_sales", cost), line("inventory", -cost), line("receivable", gross - fee - tax), line("commission", fee), line("tax", tax), line("proceeds", -gross))
    return rows.select("portfolio", "fill_id", "session", F.explode(F.when(F.col("side") == "buy", buy).otherwise(sell)).alias("p")).select("portfolio", "fill_id", "session", "p.account", "p.amount")


def trial_balance(entries: DataFrame) -> DataFrame:
    return entries.groupBy("portfolio", "account").agg(F.sum("amount").cast("decimal(28,8)").alias("balance"))


def unbalanced(entries: DataFrame) -> DataFrame:
    """Fills whose entries do not sum to zero."""
    return entries.groupBy("portfolio", "fill_id").agg(F.sum("amount").alias("residual")).where("residual != 0")


def settlements(fills: DataFrame, sessions: DataFrame, lag: int = 2) -> DataFrame:
    """(portfolio, trade_date, flow, settled_cash, payable, receivable) by session: cash moves `lag` sessions after the trade."""
    from tessera.operators.grid import settlement_dates

    m = lambda c: c.cast("decimal(24,8)")
    gross = F.col("price") * F.col("quantity")
    cash = F.when(F.col("side") == "buy", -(gross + F.col("fee"))).otherwise(gross - F.col("fee") - F.col("tax"))
    dated = settlement_dates(fills.withColumn("cash", m(cash)), sessions, lag)
    on_trade = dated.select("portfolio", F.col("session").alias("trade_date"), F.lit(0).cast("decimal(24,8)").alias("flow"), m(-F.least("cash", F.lit(0))).alias("pay"), m(F.greatest("cash", F.lit(0))).alias("rec"))
    on_due = dated.where("settlement_date is not null").select("portfolio", F.col("settlement_date").alias("trade_date"), F.col("cash").alias("flow"), m(F.least("cash", F.lit(0))).alias("pay"), m(-F.greatest("cash", F.lit(0))).alias("rec"))
    days = on_trade.unionByName(on_due).groupBy("portfolio", "trade_date").agg(*(F.sum(c).cast("decimal(24,8)").alias(c) for c in ("flow", "pay", "rec")))
    upto = Window.partitionBy("portfolio").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(upto).cast("decimal(28,8)")
    return days.select("portfolio", "trade_date", "flow", run("flow").alias("settled_cash"), run("pay").alias("payable"), run("rec").alias("receivable"))


def dividends(actions: DataFrame, positions: DataFrame) -> DataFrame:
    """Entitlements: what was held before the ex-date times the amount, due on the payment date. positions: portfolio, instrument_id, session, held."""
    owners = positions.select("portfolio", "instrument_id").distinct()
    due = actions.join(owners, "instrument_id")
    held = asof_backward(due, positions, ["portfolio", "instrument_id"], "ex_date", "session", ["held"])
    return held.where("asof_held > 0").select("portfolio", "instrument_id", "ex_date", "payment_date", F.col("asof_held").alias("quantity"), (F.col("asof_held") * F.col("cash_amount")).alias("amount"))


def stale_marks(positions: DataFrame, marks: DataFrame, limit: int = 2) -> DataFrame:
    """Positions by session with the last mark, its age in sessions, and whether that is too old (or there is none).

    positions: instrument_id, session_idx and others; marks: instrument_id, session_idx, mark."""
    dated = marks.withColumn("mark_idx", F.col("session_idx"))
    found = asof_backward(positions, dated, ["instrument_id"], "session_idx", "session_idx", ["mark", "mark_idx"], strict=False)
    age = F.col("session_idx") - F.col("asof_mark_idx")
    return found.withColumnRenamed("asof_mark", "mark").withColumn("age", age).withColumn("stale", F.coalesce(age > limit, F.lit(True))).drop("asof_mark_idx")


def nav(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """(portfolio, trade_date, market_value, nav, complete): cash and unsettled amounts plus positions at their marks.

    positions: portfolio, trade_date, held, mark; cash: portfolio, trade_date, settled_cash, receivable, payable, dividends_receivable."""
    value = positions.groupBy("portfolio", "trade_date").agg(F.sum(F.col("held") * F.coalesce("mark", F.lit(0))).alias("market_value"), (F.count_if(F.col("mark").isNull() & (F.col("held") != 0)) == 0).alias("complete"))
    both = cash.join(value, ["portfolio", "trade_date"], "left")
    worth = F.coalesce("market_value", F.lit(0))
    return both.select("portfolio", "trade_date", worth.alias("market_value"), (F.col("settled_cash") + F.col("receivable") - F.col("payable") + F.col("dividends_receivable") + worth).alias("nav"), F.coalesce("complete", F.lit(True)).alias("complete"))


def performance(nav_: DataFrame, fills: DataFrame, by: str = "run_id", annual: int = 252) -> DataFrame:
    """By run: returns, risk ratios, turnover and costs; runs with under three returns have null ratios.

    nav_: run, trade_date, nav, exposure; fills: run, notional, cost."""
    w = Window.partitionBy(by).orderBy("trade_date")
    moved = nav_.withColumn("_r", F.col("nav") / F.nullif(F.lag("nav", 1).over(w), F.lit(0.0)) - 1).withColumn("_d", F.col("nav") / F.nullif(F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - 1)
    n, mean, sd = F.count("_r"), F.avg("_r"), F.stddev_samp("_r")
    down = F.sqrt(F.avg(F.when(F.col("_r").isNotNull(), F.pow(F.least("_r", F.lit(0.0)), 2))))
    first, last = F.min_by("nav", "trade_date"), F.max_by("nav", "trade_date")
    days = F.datediff(F.max("trade_date"), F.min("trade_date"))
    cagr = F.pow(last / F.nullif(first, F.lit(0.0)), F.lit(365.25) / F.nullif(days, F.lit(0))) - 1
    enough = lambda c: F.when(n >= 3, c)
    core = moved.groupBy(by).agg(n.alias("n_returns"), (last / F.nullif(first, F.lit(0.0)) - 1).alias("total_return"), cagr.alias("cagr"), enough(mean * annual).alias("annual_mean"), enough(sd * F.sqrt(F.lit(float(annual)))).alias("volatility"), enough(mean / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(annual)))).alias("sharpe"), enough(mean / F.nullif(down, F.lit(0.0)) * F.sqrt(F.lit(float(annual)))).alias("sortino"), F.min("_d").alias("max_drawdown"), enough(cagr / F.nullif(F.abs(F.min("_d")), F.lit(0.0))).alias("calmar"), F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))).alias("positive_ratio"), F.avg("exposure").alias("mean_exposure"), F.avg("nav").alias("_nav"))
    traded = fills.groupBy(by).agg(F.sum("notional").alias("_n"), F.sum("cost").alias("total_cost"), F.count("*").alias("n_fills"))
    return core.join(traded, by, "left").withColumn("turnover", F.coalesce("_n", F.lit(0.0)) / F.nullif("_nav", F.lit(0.0))).drop("_n", "_nav")


def align_benchmark(returns: DataFrame, levels: DataFrame, by: str = "run_id") -> DataFrame:
    """Returns with the benchmark's return of the same session; raises unless every run's sessions are the benchmark's."""
    moved = levels.withColumn("benchmark_return", F.col("level") / F.nullif(F.lag("level", 1).over(Window.orderBy("trade_date")), F.lit(0.0)) - 1).where("benchmark_return is not null").select("trade_date", "benchmark_return")
    runs = returns.select(by).distinct().join(moved)
    if returns.join(runs, [by, "trade_date"], "full_outer").where("benchmark_return is null or ret is null").limit(1).count():
        raise ValueError("sessions of returns and benchmark differ")
    return returns.join(moved, "trade_date")


def benchmark_stats(aligned: DataFrame, by: str = "run_id", annual: int = 252) -> DataFrame:
    """By run: active return, tracking error, information ratio, beta, annual alpha, and both compounded returns."""
    active = F.col("ret") - F.col("benchmark_return")
    te = F.stddev_samp(active) * F.sqrt(F.lit(float(annual)))
    beta = F.try_divide(F.covar_samp("ret", "benchmark_return"), F.nullif(F.var_samp("benchmark_return"), F.lit(0.0)))
    return aligned.groupBy(by).agg((F.avg(active) * annual).alias("active_return"), te.alias("tracking_error"), (F.avg(active) * annual / F.nullif(te, F.lit(0.0))).alias("information_ratio"), beta.alias("beta"), ((F.avg("ret") - beta * F.avg("benchmark_return")) * annual).alias("alpha"), (F.product(1 + F.col("ret")) - 1).alias("compounded"), (F.product(1 + F.col("benchmark_return")) - 1).alias("benchmark_compounded"))


def attribution(nav_: DataFrame, flows: DataFrame) -> DataFrame:
    """(portfolio, trade_date, delta, price_effect, dividends, fees, taxes, slippage, residual) by session.

    nav_: portfolio, trade_date, nav, market_value; flows: portfolio, trade_date, bought, sold (at reference prices), slippage, fees,
    taxes, dividends. Price effect is the change of market value less net purchases."""
    w = Window.partitionBy("portfolio").orderBy("trade_date")
    rows = nav_.join(flows, ["portfolio", "trade_date"], "left").fillna(0, ["bought", "sold", "slippage", "fees", "taxes", "dividends"])
    delta = F.col("nav") - F.lag("nav", 1).over(w)
    price = F.col("market_value") - F.lag("market_value", 1).over(w) - F.col("bought") + F.col("sold")
    out = rows.withColumn("delta", delta).withColumn("price_effect", price).where("delta is not null")
    return out.select("portfolio", "trade_date", "delta", "price_effect", "dividends", "fees", "taxes", "slippage", (F.col("delta") - F.col("price_effect") - F.col("dividends") + F.col("fees") + F.col("taxes") + F.col("slippage")).alias("residual"))


def notional_allocation(fills: DataFrame, total: str = "total", places: int = 2) -> DataFrame:
    """A total per portfolio spread over instruments by executed notional, rounded down, the remainder on the last."""
    rows = fills.groupBy("portfolio", "instrument_id", total).agg(F.sum((F.col("price") * F.col("quantity")).cast("decimal(20,4)")).alias("notional"))
    w = Window.partitionBy("portfolio")
    scale = 10**places
    share = F.floor(F.col(total) * scale * (F.col("notional").cast("double") / F.sum("notional").over(w).cast("double")))
    placed = rows.withColumn("_s", share).withColumn("_last", F.row_number().over(w.orderBy(F.desc("instrument_id"))) == 1)
    amount = F.when(F.col("_last"), F.round(F.col(total) * scale) - (F.sum("_s").over(w) - F.col("_s"))).otherwise(F.col("_s")) / scale
    return placed.select("portfolio", "instrument_id", F.col("notional").cast("double").alias("notional"), amount.alias("allocated"))


def pretrade_flags(orders: DataFrame, positions: DataFrame, accounts: DataFrame, max_weight: float = 0.2, max_notional: float = 1e6, max_gross: float = 1.0, policy: CostPolicy = CostPolicy(), blocks: int = 64, crowd: int = 100_000) -> DataFrame:
    """(portfolio, order_id, flags): orders as they would be reserved in turn, sells first, then by order_id.

    orders: portfolio, order_id, instrument_id, side, quantity, price; positions: portfolio, instrument_id, held, value, a row
    a position; accounts: portfolio, nav, cash, a row a portfolio. Gross exposure is the value of other positions, the orders before on other
    instruments, and this instrument after the order at its price; buys need cash for their fees as well. The sums before
    each order are a scan on two levels over `blocks` ranges of order ids, so a portfolio with all orders is spread over them;
    so is a position of more than `crowd` orders. Positions and accounts open the sums as rows of their own, so orders are
    shuffled once for each of the two sums, and joined with nothing.
    Orders of one id and side go by instrument, quantity and price, so the flags depend on the rows alone, not on how they are stored."""
    # 0: sell, 1: buy, 2: neither, which takes its turn with the buys; -1: what opens the sums.
    side = F.when(F.col("side") == "sell", 0).when(F.col("side") == "buy", 1).otherwise(2)
    opens = F.lit(-1).alias("_side")
    lines = orders.select("portfolio", "order_id", "instrument_id", side.alias("_side"), "quantity", "price")
    owned, value = positions.where("portfolio is not null"), F.col("value").cast("decimal(24,4)")
    of_one = lambda c: F.when(F.col("instrument_id").isNotNull(), c)
    opening = owned.select("portfolio", "instrument_id", opens, of_one(F.col("held")).alias("held"), of_one(value).alias("value"))
    worth = owned.groupBy("portfolio").agg(F.sum(value).alias("worth")).select("portfolio", opens, "worth")
    funds = accounts.where("portfolio is not null").select("portfolio", opens, "nav", "cash").unionByName(worth, allowMissingColumns=True)

    sells, buys, ordered = F.col("_side") == 0, F.col("_side") == 1, F.col("_side") >= 0
    notional = (F.col("quantity") * F.col("price")).cast("decimal(20,4)")
    signed = F.when(buys, notional).when(ordered, -notional)
    turn = F.least("_side", F.lit(1))
    block = turn * (2 * blocks) + F.coalesce(scan.range_blocks(orders, "order_id", blocks), F.lit(-1))
    order = [turn, "order_id", "instrument_id", "quantity", "price"]

    bucket, many = scan.crowded(orders, ["portfolio", "instrument_id"], crowd)
    own = lines.unionByName(opening, allowMissingColumns=True).withColumn("_bucket", bucket).join(F.broadcast(many), "_bucket", "left")
    moved = {"_sold": F.when(sells, F.col("quantity")), "_held": "held", "_moved": F.when(buys, F.col("quantity")).when(ordered, -F.col("quantity")), "_value": "value", "_same": signed}
    each = scan.running_sums(own, ["portfolio", "instrument_id"], order, block, moved, F.col("_crowded").isNotNull()).where(ordered)
    held = F.coalesce("_held", F.lit(0))
    each = each.select(*lines.columns, (sells & (F.col("_sold") > held)).alias("_short"), (held + F.col("_moved")).alias("_after"), (F.coalesce("_value", F.lit(0)) + F.col("_same")).alias("_rest"))

    paid = {"_bought": F.when(buys, notional + H.commission(notional.cast("decimal(20,8)"), policy)).when(ordered, 0), "_all": signed, "_nav": "nav", "_cash": "cash", "_worth": "worth"}
    # Orders alike in all columns keep the turn they had in their position.
    again = [*order, F.when(buys, F.col("_after")).otherwise(-F.col("_after"))]
    full = scan.running_sums(each.unionByName(funds, allowMissingColumns=True), ["portfolio"], again, block, paid, of=lines.unionByName(funds, allowMissingColumns=True)).where(ordered)
    nav, price = F.col("_nav"), F.col("price")
    own_value = F.greatest("_after", F.lit(0)) * price
    others = F.coalesce("_worth", F.lit(0)) - F.col("_rest") + F.col("_all")
    unvalued = nav.isNull() | price.isNull() | (nav <= 0) | (price <= 0)
    found = {
        "valuation_missing": unvalued,
        "short_sale": F.col("_short"),
        "notional_limit": notional > max_notional,
        "weight_limit": ~unvalued & (own_value > max_weight * nav),
        "gross_limit": ~unvalued & (others.cast("double") + own_value > max_gross * nav),
        "insufficient_buying_power": buys & (F.col("_bought") > F.col("_cash")),
    }
    flags = F.filter(F.array(*(F.when(hit, name) for name, hit in found.items())), lambda x: x.isNotNull())
    return full.select("portfolio", "order_id", flags.alias("flags"))


def reservation_totals(orders: DataFrame) -> DataFrame:
    """By portfolio and instrument, of active orders: cash reserved by buys, shares by sells, and the change to come."""
    rest = F.col("quantity") - F.col("filled")
    buy, sell = F.when(F.col("side") == "buy", rest).otherwise(0), F.when(F.col("side") == "sell", rest).otherwise(0)
    return orders.where("active").groupBy("portfolio", "instrument_id").agg(F.sum((buy * F.col("price")).cast("decimal(24,4)")).cast("double").alias("reserved_cash"), F.sum(sell).alias("reserved_shares"), F.sum(buy - sell).alias("projected_delta"))


def target_limits(targets: DataFrame, positions: DataFrame, max_gross: float = 1.0, max_single: float = 0.2, max_positions: int = 50, max_turnover: float = 1.0, min_cash: float = 0.0, max_participation: float = 0.1, max_orders: int = 100) -> DataFrame:
    """(decision_time, gross, largest, positions, turnover, omitted, orders, over_volume, reasons) of each batch of targets against what is held.

    targets: decision_time, instrument_id, weight, price, volume, nav; positions: decision_time, instrument_id, weight, quantity.
    A target's order is the whole number of shares that its weight buys, less those held; over_volume counts orders
    beyond their share of the volume, or without a price or volume to tell."""
    want = targets.select("decision_time", "instrument_id", F.col("weight").alias("_t"), "price", "volume", "nav")
    have = positions.select("decision_time", "instrument_id", F.col("weight").alias("_p"), "quantity")
    both = want.join(have, ["decision_time", "instrument_id"], "full_outer")
    t, p = F.coalesce("_t", F.lit(0.0)), F.coalesce("_p", F.lit(0.0))
    desired = F.floor(F.round(F.try_divide(F.col("nav") * F.col("_t"), "price"), 9))
    change = F.abs(desired - F.coalesce("quantity", F.lit(0)))
    ordered = F.col("_t").isNotNull() & F.coalesce(change != 0, F.lit(True))
    over = ordered & F.coalesce((F.col("volume") <= 0) | (change > F.col("volume") * max_participation), F.lit(True))
    rows = both.groupBy("decision_time").agg(F.sum(t).alias("gross"), F.max(t).alias("largest"), F.count_if(t > 0).alias("positions"), F.sum(F.abs(t - p)).alias("turnover"), F.count_if(F.col("_t").isNull() & (p > 0)).alias("omitted"), F.count_if(ordered).alias("orders"), F.count_if(over).alias("over_volume"))
    found = {
        "gross_limit": F.col("gross") > max_gross + 1e-9,
        "single_limit": F.col("largest") > max_single + 1e-9,
        "cash_buffer": F.col("gross") > 1 - min_cash + 1e-9,
        "position_count": F.col("positions") > max_positions,
        "turnover_limit": F.col("turnover") > max_turnover + 1e-9,
        "omitted_positions": F.col("omitted") > 0,
        "volume_participation": F.col("over_volume") > 0,
        "order_count": F.col("orders") > max_orders,
    }
    return rows.withColumn("reasons", F.concat_ws(";", *(F.when(hit, name) for name, hit in found.items())))


def target_drift(targets: DataFrame, positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Targets with the weight held (null without a mark) and the drift; total of absolute drifts of the portfolio. targets: portfolio, instrument_id, weight, nav."""
    full = targets.join(positions, ["portfolio", "instrument_id"], "left").join(marks, "instrument_id", "left")
    quantity = F.coalesce("held", F.lit(0))
    actual = F.when(quantity == 0, F.lit(0.0)).otherwise(quantity * F.col("mark") / F.nullif("nav", F.lit(0.0)))
    return full.withColumn("actual", actual).withColumn("drift", F.col("actual") - F.col("weight")).withColumn("total_drift", F.sum(F.abs("drift")).over(Window.partitionBy("portfolio"))).select("portfolio", "instrument_id", "weight", "actual", "drift", "total_drift")


def fills_with_orders(fills: DataFrame, orders: DataFrame) -> DataFrame:
    return fills.join(orders, "order_id")


def pnl_drawdown(snapshots: DataFrame) -> DataFrame:
    """(portfolio, trade_date, daily_pnl, peak_nav, drawdown)."""
    w = Window.partitionBy("portfolio").orderBy("trade_date")
    peak = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return snapshots.select("portfolio", "trade_date", (F.col("nav") - F.lag("nav", 1).over(w)).alias("daily_pnl"), peak.alias("peak_nav"), (F.col("nav") / F.nullif(peak, F.lit(0.0)) - 1).alias("drawdown"))


def daily_report(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """(session, orders, rejected, fills, notional, costs) by session."""
    a = orders.groupBy("session").agg(F.count("*").alias("orders"), F.count_if(F.col("state") == "rejected").alias("rejected"))
    b = fills.groupBy("session").agg(F.count("*").alias("fills"), F.sum("notional").alias("notional"), F.sum("cost").alias("costs"))
    return a.join(b, "session", "full_outer")


def scenario_grid(spark: SparkSession) -> DataFrame:
    """540 scenarios, each with a checksum as its id: slippage, participation, commission, rebalancing and breadth."""
    rows = list(product((0.0, 5.0, 10.0, 25.0, 50.0), (0.01, 0.05, 0.1, 0.25), (0.5, 1.0, 2.0), ("daily", "weekly", "every_third"), (1, 2, 3)))
    grid = spark.createDataFrame(rows, "slippage_bps double, participation double, commission_factor double, rebalance string, top_k int")
    return grid.withColumn("scenario_id", H.row_checksum("slippage_bps", "participation", "commission_factor", "rebalance", "top_k"))


def _plan_sums(fills: DataFrame, grid: DataFrame, policy: CostPolicy) -> DataFrame:
    """Sums of each plan (rebalance, top_k) and participation of the grid, each fill executed up to its share of the volume."""
    shares = [r[0] for r in grid.select("participation").distinct().limit(1001).collect()]
    if len(shares) > 1000:
        raise ValueError("at most 1,000 participations")

    def executed(share: float) -> Column:
        room = H.fill_capacity(F.col("volume"), share)
        done, price = F.least("quantity", room), F.col("price").cast("decimal(20,4)")
        gross = (price * done).cast("decimal(20,8)")
        bought = F.when(F.col("side") == "buy", gross).otherwise(-gross)
        return F.struct(F.lit(share).alias("participation"), (done < F.col("quantity")).alias("short"), gross.alias("gross"), bought.alias("net"), (price * room).cast("decimal(28,4)").alias("room"), H.commission(gross, policy).alias("fee"), H.transaction_tax(gross, F.col("side"), policy).alias("tax"))

    each = fills.select("rebalance", "top_k", F.explode(F.array(*map(executed, shares))).alias("x")).select("rebalance", "top_k", "x.*")
    sums = [F.sum(c).cast("decimal(22,4)").alias(f"_{c}") for c in ("gross", "net", "fee", "tax")]
    return each.groupBy("rebalance", "top_k", "participation").agg(F.count("*").alias("n_fills"), F.count_if("short").alias("unfilled"), F.min("room").alias("_room"), *sums)


def _slipped() -> Column:
    return F.col("_gross") * (F.col("slippage_bps") / 10_000).cast("decimal(12,8)")


def _plan_cost() -> Column:
    """In decimals, so that no sum of doubles stands on the edge of a cent."""
    return F.col("_fee") * F.col("commission_factor").cast("decimal(8,4)") + F.col("_tax") + _slipped()


def scenario_costs(fills: DataFrame, grid: DataFrame, policy: CostPolicy = CostPolicy()) -> DataFrame:
    """(scenario_id, ..., n_fills, unfilled, traded, costs): what the fills cost under every scenario; a scenario without fills has nulls.

    fills: rebalance, top_k (the plan they belong to), side, quantity, price, volume. A fill is executed up to its share of the
    volume; commission (its minimum and rounding) and tax are charged on each fill. Costs of executed fills are linear in the other
    factors, so the fills are summed once for each participation and plan, whatever the number of scenarios."""
    joined = grid.join(_plan_sums(fills, grid, policy), ["rebalance", "top_k", "participation"], "left")
    return joined.select(*grid.columns, "n_fills", "unfilled", F.col("_gross").cast("double").alias("traded"), _plan_cost().cast("double").alias("costs"))


#: Columns that make a scenario.
SCENARIO = ["slippage_bps", "participation", "commission_factor", "rebalance", "top_k"]


def scenario_outcomes(fills: DataFrame, grid: DataFrame, capital: float, policy: CostPolicy = CostPolicy(), maximum: int = 1_000, allow_large: bool = False) -> DataFrame:
    """(scenario_id, SCENARIO, status, reason, total_return, turnover, slippage_cost, capacity, checksum): a row for every scenario, none chosen.

    Fills as in scenario_costs(), of plans that end flat. The return is what the sales bring over the purchases after all costs, to the
    capital; turnover is all that is traded, to the capital; capacity is the least notional that any fill of the plan leaves room for.
    A scenario that cannot be evaluated stays as a row with status failed, nulls and its reason: no_fills, or nothing_executed if no fill has
    room for a share. Grids that repeat a scenario, and those of more than `maximum` rows unless allow_large, are refused. The
    checksum covers the scenario and its outcome in decimals, so it does not depend on the order of fills."""
    if maximum < 1 or capital <= 0:
        raise ValueError("maximum and capital have to be positive")
    if not allow_large and len(grid.limit(maximum + 1).select("top_k").collect()) > maximum:
        raise ValueError(f"the grid has more than {maximum} scenarios")
    if not grid.groupBy(*SCENARIO).count().where("count > 1").isEmpty():
        raise ValueError("the grid repeats a scenario")
    joined = grid.select("scenario_id", *SCENARIO).join(_plan_sums(fills, grid, policy), ["rebalance", "top_k", "participation"], "left")
    reason = F.when(F.col("n_fills").isNull(), "no_fills").when(F.col("_gross") == 0, "nothing_executed")
    kept = joined.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "completed").otherwise("failed"))
    money = {"_gain": -F.col("_net") - _plan_cost(), "_traded": F.col("_gross"), "_slip": _slipped(), "_least": F.col("_room")}
    exact = kept.select("scenario_id", *SCENARIO, "status", "reason", *(F.when(F.col("reason").isNull(), c).alias(n) for n, c in money.items()))
    share = lambda c: F.col(c).cast("double") / capital
    return exact.select(
        "scenario_id", *SCENARIO, "status", "reason", share("_gain").alias("total_return"), share("_traded").alias("turnover"), F.col("_slip").cast("double").alias("slippage_cost"), F.col("_least").cast("double").alias("capacity"),
        H.row_checksum("scenario_id", "status", "reason", *money).alias("checksum"),
    )


def money_columns(*names: str) -> list[Column]:
    return [F.col(n).cast("decimal(20,8)").alias(n) for n in names]
