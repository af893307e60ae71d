"""Trading signals over own rows, round trips, equity curves and drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def _own() -> Window:
    """A symbol's rows in order of date."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def _held(event: Column) -> Column:
    """1 or 0 events carried on; 0 before the first."""
    return F.coalesce(F.last(event, ignorenulls=True).over(_own().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def sma_cross(bars: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    """With `target` 1 while the fast mean is above the slow one, and there are rows enough for both."""
    mean = lambda n: F.avg("close").over(_own().rowsBetween(1 - n, 0))
    return bars.withColumn("target", F.when((F.row_number().over(_own()) >= slow) & (mean(fast) > mean(slow)), 1).otherwise(0))


def rsi_signal(bars: DataFrame, length: int = 14, lower: float = 30, upper: float = 70) -> DataFrame:
    """With `rsi` (simple means; no losses: 100) and `target`: 1 from rsi <= lower until rsi >= upper."""
    moved = bars.withColumn("_n", F.row_number().over(_own())).withColumn("_d", F.col("close") - F.lag("close", 1).over(_own()))
    own = _own().rowsBetween(1 - length, 0)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(own), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(own)
    rsi = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    found = moved.withColumn("rsi", F.when(F.col("_n") > length, rsi))
    event = F.when(F.col("rsi") <= lower, 1).when(F.col("rsi") >= upper, 0)
    return found.withColumn("target", _held(event)).drop("_n", "_d")


def breakout(bars: DataFrame, entry: int = 20, exit_: int = 10) -> DataFrame:
    """With `target`: 1 from a close above the highest of the `entry` closes before, until one below the lowest of `exit_`."""
    before = lambda f, n: f("close").over(_own().rowsBetween(-n, -1))
    n = F.row_number().over(_own()) - 1
    event = F.when((n >= entry) & (F.col("close") > before(F.max, entry)), 1).when((n >= exit_) & (F.col("close") < before(F.min, exit_)), 0)
    return bars.withColumn("_e", event).withColumn("target", _held(F.col("_e"))).drop("_e")


def round_trips(signals: DataFrame, quantity: int = 1_000, cost_rate: float = 0.002) -> DataFrame:
    """(symbol, trade, entry_date, entry_price, exit_date, exit_price, pnl, return_pct, costs, exit_reason).

    A change of target trades at the next own row's open; a position that is open at the end closes at the last close
    (end_of_data). A change on the last row trades no more."""
    last = Window.partitionBy("symbol")
    rows = signals.withColumn("_was", F.coalesce(F.lag("target", 1).over(_own()), F.lit(0))).withColumn("_open", F.lead("open", 1).over(_own())).withColumn("_day", F.lead("trade_date", 1).over(_own()))
    rows = rows.withColumn("_end", F.max("trade_date").over(last)).withColumn("_close", F.max_by("close", "trade_date").over(last))
    changes = rows.where("target != _was and _day is not null").withColumn("trade", F.sum(F.col("target")).over(_own().rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda side, c: F.max(F.when(F.col("target") == side, F.col(c)))
    trips = changes.groupBy("symbol", "trade").agg(pick(1, "_day").alias("entry_date"), pick(1, "_open").alias("entry_price"), pick(0, "_day").alias("_x"), pick(0, "_open").alias("_p"), F.max("_end").alias("_end"), F.max("_close").alias("_close"))
    exit_price = F.coalesce("_p", "_close")
    costs = (F.col("entry_price") + exit_price) * quantity * cost_rate
    pnl = (exit_price - F.col("entry_price")) * quantity - costs
    return trips.select("symbol", "trade", "entry_date", "entry_price", F.coalesce("_x", "_end").alias("exit_date"), exit_price.alias("exit_price"), pnl.alias("pnl"), (pnl / F.nullif(F.col("entry_price") * quantity, F.lit(0.0)) * 100).alias("return_pct"), costs.alias("costs"), F.when(F.col("_x").isNull(), "end_of_data").otherwise("signal").alias("exit_reason"))


def equity_metrics(curve: DataFrame, by: str = "run_id") -> DataFrame:
    """By run: annual return and volatility over 252 days, Sharpe, greatest drawdown and buy-and-hold return. curve: run, trade_date, equity, benchmark."""
    w = Window.partitionBy(by).orderBy("trade_date")
    moved = curve.withColumn("_r", F.col("equity") / F.nullif(F.lag("equity", 1).over(w), F.lit(0.0)) - 1).withColumn("_dd", F.col("equity") / F.nullif(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - 1)
    first, last, n = F.min_by("equity", "trade_date"), F.max_by("equity", "trade_date"), F.count("_r")
    vol = F.stddev_samp("_r") * F.sqrt(F.lit(252.0))
    annual = F.when(n > 0, F.pow(last / F.nullif(first, F.lit(0.0)), F.lit(252.0) / F.nullif(n, F.lit(0))) - 1)
    hold = F.max_by("benchmark", "trade_date") / F.nullif(F.min_by("benchmark", "trade_date"), F.lit(0.0)) - 1
    return moved.groupBy(by).agg(annual.alias("annual_return"), vol.alias("volatility"), (F.avg("_r") * 252 / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.min("_dd").alias("max_drawdown"), hold.alias("buy_and_hold"))


def trade_metrics(trips: DataFrame, by: str = "symbol") -> DataFrame:
    """Trades, share of winners, and profit factor (no losses: 999.99 if there are gains, else 0)."""
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    factor = F.when(loss > 0, F.least(gain / F.nullif(loss, F.lit(0.0)), F.lit(999.99))).when(gain > 0, 999.99).otherwise(0.0)
    return trips.groupBy(by).agg(F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), factor.alias("profit_factor"))


def equity_vs_hold(curve: DataFrame, by: str = "run_id") -> DataFrame:
    """With both curves as multiples of their first value."""
    w = Window.partitionBy(by).orderBy("trade_date")
    scaled = lambda c: F.col(c) / F.nullif(F.first(c).over(w), F.lit(0.0))
    return curve.withColumn("equity_multiple", scaled("equity")).withColumn("hold_multiple", scaled("benchmark"))


def drawdown(nav: DataFrame, by: str = "run_id", value: str = "nav") -> DataFrame:
    """By run: the greatest drawdown, when it began (its peak), its trough, when the peak was reached again, and its sessions.

    Of equal drawdowns the first counts. nav: run, trade_date, value."""
    w = Window.partitionBy(by).orderBy("trade_date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = nav.withColumn("_i", F.row_number().over(w)).withColumn("_peak", F.max(value).over(upto))
    peak_day = F.max(F.when(F.col(value) == F.col("_peak"), F.col("trade_date"))).over(upto)
    rows = placed.withColumn("_peak_day", peak_day).withColumn("_dd", F.col(value) / F.nullif("_peak", F.lit(0.0)) - 1)
    order = F.struct("_dd", "trade_date")
    worst = rows.groupBy(by).agg(F.min("_dd").alias("max_drawdown"), F.min_by(F.struct("trade_date", "_peak_day", "_peak", "_i"), order).alias("t"))
    again = rows.join(worst.select(by, "t"), by).where((F.col("trade_date") > F.col("t.trade_date")) & (F.col(value) >= F.col("t._peak"))).groupBy(by).agg(F.min("trade_date").alias("recovery_date"))
    began = rows.select(by, F.col("trade_date").alias("_day"), F.col("_i").alias("_from"))
    out = worst.join(again, by, "left")
    met = out.join(began, (out[by] == began[by]) & (out["t._peak_day"] == began["_day"])).drop(began[by])
    return met.select(by, "max_drawdown", F.col("t._peak_day").alias("peak_date"), F.col("t.trade_date").alias("trough_date"), "recovery_date", (F.col("t._i") - F.col("_from")).alias("sessions_to_trough"))
