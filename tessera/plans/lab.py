"""Queries of the factor lab and of signals, over bars of brands by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import factorlab, features, signals
from tessera.plans.inputs import BRAND_BARS, brand_bars, rounded

_KEYS = ["momentum_5", "reversal_3", "volatility_5", "volume_ratio_5", "price_position_10"]


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_bars(spark, sf_dir).withColumnRenamed("instrument_id", "symbol")


def _long(spark: SparkSession, sf_dir: str, keys: list[str] | None = _KEYS) -> DataFrame:
    return features.compute_row_factors(_bars(spark, sf_dir), keys)


def row_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every factor over own rows."""
    return rounded(_long(spark, sf_dir, None).drop("close"))


def centered_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E28."""
    return rounded(factorlab.centered_rank(_long(spark, sf_dir)).select("symbol", "trade_date", "factor_key", "centered"))


def factor_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16."""
    return rounded(factorlab.factor_daily_stats(_long(spark, sf_dir)))


def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return rounded(factorlab.factor_summary(factorlab.factor_daily_stats(_long(spark, sf_dir))))


def hac_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The t statistic (its p value is checked in the tests; SQL has no erfc)."""
    return rounded(factorlab.hac_tstat(factorlab.factor_daily_stats(_long(spark, sf_dir))).drop("p_value"))


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20."""
    return rounded(factorlab.train_test_eval(factorlab.factor_daily_stats(_long(spark, sf_dir))))


def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21."""
    return rounded(factorlab.factor_correlations(factorlab.centered_rank(_long(spark, sf_dir))))


def discover_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors; needs erfc, so SQL has no twin."""
    return rounded(factorlab.discover(_long(spark, sf_dir, None)))


def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ranking of the IC-weighted composite."""
    long = _long(spark, sf_dir)
    weights = factorlab.factor_weights(factorlab.factor_summary(factorlab.factor_daily_stats(long)))
    return rounded(factorlab.latest_ranking(factorlab.synthesize(factorlab.centered_rank(long), weights)))


def rank_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plain mean of the centered ranks."""
    ranks = factorlab.centered_rank(_long(spark, sf_dir))
    equal = ranks.select("factor_key").distinct().withColumn("weight", F.lit(1.0))
    return rounded(factorlab.rank_turnover(rounded(factorlab.synthesize(ranks, equal), 9)))


def sma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E29, K3."""
    return signals.sma_cross(_bars(spark, sf_dir), 5, 20).select("symbol", "trade_date", "target")


def rsi_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E30."""
    return rounded(signals.rsi_signal(_bars(spark, sf_dir)).select("symbol", "trade_date", "rsi", "target"))


def breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E31."""
    return signals.breakout(_bars(spark, sf_dir)).select("symbol", "trade_date", "target")


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, on breakout signals."""
    return rounded(signals.round_trips(signals.breakout(_bars(spark, sf_dir))), 7)


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and profit factor."""
    return rounded(signals.trade_metrics(signals.round_trips(signals.breakout(_bars(spark, sf_dir)))), 4)


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select(F.col("symbol").alias("run_id"), "trade_date", F.col("close").alias("equity"), F.col("open").alias("benchmark"))


def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closes of a brand as an equity curve, its opens as the benchmark."""
    return rounded(signals.equity_metrics(_curve(spark, sf_dir)))


def equity_vs_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E33."""
    return rounded(signals.equity_vs_hold(_curve(spark, sf_dir)).select("run_id", "trade_date", "equity_multiple", "hold_multiple"))


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26."""
    return rounded(signals.drawdown(_bars(spark, sf_dir).select(F.col("symbol").alias("run_id"), "trade_date", F.col("close").alias("nav"))))


QUERIES = [row_factors, centered_ranks, factor_daily_stats, factor_summary, hac_tstat, train_test_split, factor_correlations, discover_factors, synthesize, rank_turnover, sma_cross, rsi_signal, breakout, round_trips, trade_metrics, equity_metrics, equity_vs_hold, drawdown]

_R = lambda c, n=6: f"round({c}, {n}) + 0.0"
_B = BRAND_BARS.replace("AS instrument_id", "AS symbol") + """,
based AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS prev, ln(close / lag(close) OVER w) AS lg,
                 coalesce(abs(close / lag(close) OVER w - 1) / nullif(close * volume, 0) * 1e9, 0) AS ill FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))"""


def _row_sql(keys: list[str] | None) -> str:
    o = lambda n: f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    past = lambda n: f"close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY trade_date) - 1"
    pos = lambda n: f"CASE WHEN max(high) {o(n)} = min(low) {o(n)} THEN 0.0 ELSE (close - min(low) {o(n)}) / (max(high) {o(n)} - min(low) {o(n)}) END"
    found: dict[str, tuple[int, str]] = {f"momentum_{n}": (n + 1, past(n)) for n in (5, 10, 20, 60)}
    found |= {f"reversal_{n}": (n + 1, f"-({past(n)})") for n in (3, 5, 10)}
    found |= {f"volatility_{n}": (n + 1, f"stddev_samp(lg) {o(n)} * sqrt(252)") for n in (5, 10, 20)}
    found |= {f"volume_ratio_{n}": (n, f"volume / avg(volume) {o(n)}") for n in (5, 20)}
    found |= {f"ma_gap_{a}_{b}": (b, f"avg(close) {o(a)} / avg(close) {o(b)} - 1") for a, b in ((5, 20), (10, 60), (20, 60))}
    found |= {f"price_position_{n}": (n, pos(n)) for n in (10, 20, 60)}
    found |= {f"intraday_strength_{n}": (n, f"avg(close / open - 1) {o(n)}") for n in (1, 5)}
    found |= {f"range_volatility_{n}": (n, f"avg((high - low) / close) {o(n)}") for n in (5, 20)}
    found |= {f"illiquidity_{n}": (n, f"avg(ill) {o(n)}") for n in (5, 20)}
    rows = [f"SELECT symbol, trade_date, close, '{k}' AS factor_key, CASE WHEN n >= {n} THEN {e} END AS value FROM based" for k, (n, e) in found.items() if not keys or k in keys]
    return f"WITH {_B}, long AS ({' UNION ALL '.join(rows)})"


_STATS = _row_sql(_KEYS) + """,
pairs AS (SELECT * FROM (SELECT *, lead(close, 5) OVER (PARTITION BY factor_key, symbol ORDER BY trade_date) / close - 1 AS y FROM long) WHERE value IS NOT NULL AND y IS NOT NULL),
placed AS (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY factor_key, trade_date ORDER BY value, symbol) AS i,
                  rank() OVER (PARTITION BY factor_key, trade_date ORDER BY value) + (count(*) OVER (PARTITION BY factor_key, trade_date, value) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY factor_key, trade_date ORDER BY y) + (count(*) OVER (PARTITION BY factor_key, trade_date, y) - 1) / 2.0 AS ry
           FROM pairs WINDOW d AS (PARTITION BY factor_key, trade_date)),
stats AS (SELECT factor_key, trade_date, max(n) AS n,
                 CASE WHEN min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic,
                 avg(y) FILTER (i > n - greatest(1, n // 3)) - avg(y) FILTER (i <= greatest(1, n // 3)) AS spread
          FROM placed WHERE n >= 3 GROUP BY 1, 2 HAVING CASE WHEN min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_samp(rx, ry) END IS NOT NULL),
summary AS (SELECT factor_key, count(*) AS n_dates, CAST(sum(n) AS BIGINT) AS n_rows, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0) AS ic_sd,
                   avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive_ratio, avg(spread) * 100 AS spread_pct FROM stats GROUP BY 1),
ranks AS (SELECT symbol, trade_date, factor_key,
                 (rank() OVER (PARTITION BY factor_key, trade_date ORDER BY value) + (count(*) OVER (PARTITION BY factor_key, trade_date, value) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY factor_key, trade_date) - 1, 1) - 0.5 AS centered
          FROM long WHERE value IS NOT NULL)"""
_BRK = f"""WITH {_B}, ev AS (SELECT *, CASE WHEN n - 1 >= 20 AND close > max(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 1
  WHEN n - 1 >= 10 AND close < min(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN 0 END AS e FROM based),
sig AS (SELECT symbol, trade_date, open, close, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS target FROM ev)"""
_TRIPS = _BRK + """, r AS (SELECT *, coalesce(lag(target) OVER w, 0) AS was, lead(open) OVER w AS nopen, lead(trade_date) OVER w AS nday, max(trade_date) OVER (PARTITION BY symbol) AS fin,
   last_value(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fc FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
c AS (SELECT *, CAST(sum(target) OVER (PARTITION BY symbol ORDER BY trade_date) AS BIGINT) AS trade FROM r WHERE target <> was AND nday IS NOT NULL),
g AS (SELECT symbol, trade, max(nday) FILTER (target = 1) AS entry_date, max(nopen) FILTER (target = 1) AS entry_price, max(nday) FILTER (target = 0) AS x, max(nopen) FILTER (target = 0) AS p, max(fin) AS fin, max(fc) AS fc FROM c GROUP BY 1, 2),
trips AS (SELECT symbol, trade, entry_date, entry_price, coalesce(x, fin) AS exit_date, coalesce(p, fc) AS exit_price,
   (coalesce(p, fc) - entry_price) * 1000 - (entry_price + coalesce(p, fc)) * 1000 * 0.002 AS pnl, (entry_price + coalesce(p, fc)) * 1000 * 0.002 AS costs, CASE WHEN x IS NULL THEN 'end_of_data' ELSE 'signal' END AS exit_reason FROM g)"""

ORACLES = {
    "row_factors": f"{_row_sql(None)} SELECT symbol, trade_date, factor_key, {_R('value')} AS value FROM long",
    "centered_ranks": f"{_STATS} SELECT symbol, trade_date, factor_key, {_R('centered')} AS centered FROM ranks",
    "factor_daily_stats": f"{_STATS} SELECT factor_key, trade_date, n, {_R('ic')} AS ic, {_R('spread')} AS spread FROM stats",
    "factor_summary": f"{_STATS} SELECT factor_key, n_dates, n_rows, {_R('mean_ic')} AS mean_ic, {_R('ic_sd')} AS ic_sd, {_R('CASE WHEN ic_sd > 0 THEN mean_ic / ic_sd * sqrt(252.0 / 5) ELSE 0 END')} AS ir, {_R('positive_ratio')} AS positive_ratio, {_R('spread_pct')} AS spread_pct FROM summary",
    "hac_tstat": f"{_STATS}, own AS (SELECT factor_key, ic - avg(ic) OVER k AS d, avg(ic) OVER k AS m, count(*) OVER k AS n, row_number() OVER (PARTITION BY factor_key ORDER BY trade_date) AS i FROM stats WINDOW k AS (PARTITION BY factor_key)), ex AS (SELECT a.factor_key, sum(2 * (1 - (a.i - b.i) / (least(4, a.n - 2) + 1.0)) * a.d * b.d / a.n) AS extra FROM own a JOIN own b ON a.factor_key = b.factor_key AND a.i - b.i BETWEEN 1 AND least(4, a.n - 2) GROUP BY 1), base AS (SELECT factor_key, max(n) AS n, max(m) AS m, avg(d * d) AS v0 FROM own GROUP BY 1) SELECT factor_key, n, {_R('CASE WHEN n >= 3 AND (v0 + coalesce(extra, 0)) / n > 0 THEN m / sqrt((v0 + coalesce(extra, 0)) / n) END')} AS t_stat FROM base LEFT JOIN ex USING (factor_key)",
    "train_test_split": f"{_STATS}, p AS (SELECT *, count(*) OVER k AS c, row_number() OVER (PARTITION BY factor_key ORDER BY trade_date) AS i FROM stats WINDOW k AS (PARTITION BY factor_key)), s AS (SELECT *, least(c - 5, greatest(10, CAST(floor(c * 0.7) AS BIGINT))) AS cut FROM p), g AS (SELECT factor_key, max(c) AS n_dates, max(cut) AS n_train, avg(ic) FILTER (i <= cut) AS a, avg(ic) FILTER (i > cut) AS b FROM s GROUP BY 1) SELECT factor_key, n_dates, CASE WHEN n_dates >= 20 THEN n_train END AS n_train, CASE WHEN n_dates >= 20 THEN {_R('a')} END AS train_ic, CASE WHEN n_dates >= 20 THEN {_R('b')} END AS test_ic, CASE WHEN n_dates >= 20 THEN {_R('abs(a) * sqrt(n_train)')} ELSE 0.0 END AS score, CASE WHEN a < 0 THEN -1 ELSE 1 END AS orientation, CASE WHEN n_dates < 20 THEN 'insufficient' WHEN abs(a) < 0.01 THEN 'weak' WHEN a * b < 0 THEN 'sign_flip' ELSE 'stable' END AS status FROM g",
    "factor_correlations": f"{_STATS} SELECT a.factor_key AS k1, b.factor_key AS k2, {_R('covar_samp(a.centered, b.centered) / (stddev_samp(a.centered) * stddev_samp(b.centered))')} AS rho, count(*) AS n FROM ranks a JOIN ranks b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND a.factor_key < b.factor_key GROUP BY 1, 2",
    "synthesize": f"{_STATS}, wt AS (SELECT factor_key, mean_ic / sum(abs(mean_ic)) OVER () AS weight FROM summary), comp AS (SELECT trade_date, symbol, sum(weight * centered) / sum(abs(weight)) AS composite FROM ranks JOIN wt USING (factor_key) GROUP BY 1, 2) SELECT trade_date, symbol, {_R('composite')} AS composite, CAST(row_number() OVER (ORDER BY composite DESC, symbol) AS INTEGER) AS place FROM comp WHERE trade_date = (SELECT max(trade_date) FROM comp)",
    "rank_turnover": f"{_STATS}, comp AS (SELECT trade_date, symbol, round(sum(centered) / count(*), 9) + 0.0 AS composite FROM ranks GROUP BY 1, 2), sc AS (SELECT trade_date, symbol, (rank() OVER (PARTITION BY trade_date ORDER BY composite) + (count(*) OVER (PARTITION BY trade_date, composite) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY trade_date) - 1, 1) AS r, dense_rank() OVER (ORDER BY trade_date) AS i FROM comp) SELECT a.trade_date, {_R('avg(abs(a.r - b.r)) * 100')} AS turnover_pct FROM sc a JOIN sc b ON a.symbol = b.symbol AND b.i = a.i - 1 GROUP BY 1",
    "sma_cross": f"WITH {_B} SELECT symbol, trade_date, CASE WHEN n >= 20 AND avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS target FROM based",
    "rsi_signal": f"WITH {_B}, m AS (SELECT *, avg(greatest(close - prev, 0)) OVER w AS g, avg(greatest(prev - close, 0)) OVER w AS l FROM based WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), r AS (SELECT *, CASE WHEN n > 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM m) SELECT symbol, trade_date, {_R('rsi')} AS rsi, coalesce(last_value(CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS target FROM r",
    "breakout": f"{_BRK} SELECT symbol, trade_date, target FROM sig",
    "round_trips": f"{_TRIPS} SELECT symbol, trade, entry_date, {_R('entry_price', 7)} AS entry_price, exit_date, {_R('exit_price', 7)} AS exit_price, {_R('pnl', 7)} AS pnl, {_R('pnl / (entry_price * 1000) * 100', 7)} AS return_pct, {_R('costs', 7)} AS costs, exit_reason FROM trips",
    "trade_metrics": f"{_TRIPS} SELECT symbol, count(*) AS trades, {_R('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS win_rate, {_R('CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN least(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 999.99) WHEN sum(greatest(pnl, 0)) > 0 THEN 999.99 ELSE 0 END', 4)} AS profit_factor FROM trips GROUP BY 1",
    "equity_metrics": f"WITH {_B}, m AS (SELECT *, close / prev - 1 AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS dd FROM based) SELECT symbol AS run_id, {_R('pow(arg_max(close, trade_date) / arg_min(close, trade_date), 252.0 / count(r)) - 1')} AS annual_return, {_R('stddev_samp(r) * sqrt(252)')} AS volatility, {_R('avg(r) * 252 / (stddev_samp(r) * sqrt(252))')} AS sharpe, {_R('min(dd)')} AS max_drawdown, {_R('arg_max(open, trade_date) / arg_min(open, trade_date) - 1')} AS buy_and_hold FROM m GROUP BY 1",
    "equity_vs_hold": f"WITH {_B} SELECT symbol AS run_id, trade_date, {_R('close / first_value(close) OVER w')} AS equity_multiple, {_R('open / first_value(open) OVER w')} AS hold_multiple FROM based WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)",
    "drawdown": f"WITH {_B}, p AS (SELECT symbol, trade_date, close, n, max(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS peak FROM based), q AS (SELECT *, max(CASE WHEN close = peak THEN trade_date END) OVER (PARTITION BY symbol ORDER BY trade_date) AS pd, close / peak - 1 AS dd FROM p), worst AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dd, trade_date) = 1) SELECT w.symbol AS run_id, {_R('w.dd')} AS max_drawdown, w.pd AS peak_date, w.trade_date AS trough_date, (SELECT min(x.trade_date) FROM q x WHERE x.symbol = w.symbol AND x.trade_date > w.trade_date AND x.close >= w.peak) AS recovery_date, CAST(w.n - (SELECT x.n FROM q x WHERE x.symbol = w.symbol AND x.trade_date = w.pd) AS INTEGER) AS sessions_to_trough FROM worst w",
}
