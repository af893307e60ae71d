"""Queries over the event panel: features, cross-sections, labels, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import bucketed, crosssec, evaluation, features, grid, labels
from tessera.plans.inputs import BRAND_BARS, EVENT_BARS, brand_bars, event_bars, event_sessions, everyone, rounded
from tessera.sources.scratch import scratch_folder


def _panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = event_bars(spark, sf_dir)
    sessions = event_sessions(bars)
    return bars, sessions, everyone(bars, sessions)


def _features(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> DataFrame:
    bars, sessions, members = _panel(spark, sf_dir)
    specs = [s for s in features.REGISTRY.all() if not names or s.name in names]
    return features.compute_features(bars, members, sessions, specs)


def baseline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered feature with its validity."""
    return rounded(_features(spark, sf_dir).drop("decision_time", "feature_version"))


#: name -> (SQL over the named windows, rows needed)
_FEATURE_SQL = {
    "reversal_1": ("-(close / lag(close, 1) OVER w - 1)", 2),
    "momentum_5": ("close / lag(close, 5) OVER w - 1", 6),
    "momentum_20": ("close / lag(close, 20) OVER w - 1", 21),
    "momentum_60": ("close / lag(close, 60) OVER w - 1", 61),
    "realized_volatility_20": ("stddev_samp(r) OVER w20", 21),
    "downside_volatility_20": ("sqrt(avg(pow(least(r, 0), 2)) OVER w20)", 21),
    "average_traded_value_20": ("avg(traded_value) OVER w20", 20),
    "volume_activity_proxy_20": ("volume / avg(volume) OVER w20", 20),
    "amihud_illiquidity_20": ("avg(abs(r) / traded_value) OVER w20", 21),
    "overnight_return": ("open / lag(close, 1) OVER w - 1", 2),
    "intraday_return": ("close / open - 1", 1),
    "price_to_moving_average_20": ("close / avg(close) OVER w20 - 1", 20),
    "distance_from_rolling_high_20": ("close / max(high) OVER w20 - 1", 20),
    "volume_surprise_20": ("volume / avg(volume) OVER (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) - 1", 21),
}


#: The inputs of each feature that must be above zero; volume and traded value have reasons of their own.
_FEATURE_PRICES = {"overnight_return": ("open", "close"), "intraday_return": ("open", "close"), "distance_from_rolling_high_20": ("close", "high"), "average_traded_value_20": (), "volume_activity_proxy_20": (), "volume_surprise_20": ()}


def _feature_sql(name: str) -> str:
    value, n = _FEATURE_SQL[name]
    own = f"(PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    prices = _FEATURE_PRICES.get(name, ("close",))
    low = f"coalesce(min(least({', '.join(prices)})) OVER {own} <= 0, false)" if prices else "false"
    poor = f"coalesce(min(traded_value) OVER {own} <= 0, false)" if "traded_value" in value else "false"
    return f"""SELECT instrument_id, trade_date AS decision_date, '{name}' AS feature_name, {value} AS raw, session_idx, count(close) OVER {own} AS have, {n} AS need, {low} AS low_price, {poor} AS low_value
    FROM moved WINDOW w AS (PARTITION BY instrument_id ORDER BY session_idx), w20 AS (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


_MOVED = EVENT_BARS + ", moved AS (SELECT *, close / lag(close, 1) OVER (PARTITION BY instrument_id ORDER BY session_idx) - 1 AS r FROM grid)"


def _features_sql(names: tuple[str, ...]) -> str:
    return f"""WITH {_MOVED}, found AS ({' UNION ALL '.join(map(_feature_sql, names))}),
features AS (SELECT instrument_id, decision_date, feature_name,
       CASE WHEN session_idx < need THEN 'insufficient_lookback' WHEN have < need THEN 'provider_missing_or_suspended_session'
            WHEN low_price THEN 'non_positive_price_input' WHEN low_value THEN 'non_positive_traded_value' END AS invalid_reason, raw
  FROM found)"""


def _labels(spark: SparkSession, sf_dir: str, spec: labels.LabelSpec) -> DataFrame:
    bars, sessions, members = _panel(spark, sf_dir)
    index = bars.groupBy("trade_date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return labels.build_labels(spec, bars, members, sessions, None, index if spec.benchmark else None)


_LABEL_COLUMNS = ("instrument_id", "decision_date", "entry_date", "exit_date", "label_value", "valid", "invalid_reason")


def labels_o2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next open to that day's close."""
    return rounded(_labels(spark, sf_dir, labels.LabelSpec()).select(*_LABEL_COLUMNS))


def labels_o2o_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open to open over five sessions, relative to the mean price of all."""
    return rounded(_labels(spark, sf_dir, labels.LabelSpec("o2o", 5, True)).select(*_LABEL_COLUMNS, "raw_return", "benchmark_return"))


def _labels_sql(ahead: int, exit_price: str, relative: bool) -> str:
    off = "x.px / e.open - 1" + (" - (mx.px / me.open - 1)" if relative else "")
    return f"""{EVENT_BARS}, market AS (SELECT trade_date, avg(open) AS open, avg(close) AS close FROM bars GROUP BY 1),
labels AS (
  SELECT g.instrument_id, g.trade_date AS decision_date, de.trade_date AS entry_date, dx.trade_date AS exit_date,
         CASE WHEN dx.trade_date IS NULL THEN 'insufficient_future_sessions' WHEN e.open IS NULL OR x.px IS NULL THEN 'missing_or_suspended_observation'
              WHEN e.open <= 0 THEN 'unexecutable_entry_observation' WHEN x.px <= 0 THEN 'unexecutable_exit_observation' END AS invalid_reason,
         {off} AS raw_label, x.px / e.open - 1 AS raw_return, mx.px / me.open - 1 AS benchmark_return
  FROM grid g
  LEFT JOIN days de ON de.session_idx = g.session_idx + 1 LEFT JOIN days dx ON dx.session_idx = g.session_idx + 1 + {ahead}
  LEFT JOIN bars e ON e.instrument_id = g.instrument_id AND e.trade_date = de.trade_date
  LEFT JOIN (SELECT instrument_id, trade_date, {exit_price} AS px FROM bars) x ON x.instrument_id = g.instrument_id AND x.trade_date = dx.trade_date
  LEFT JOIN market me ON me.trade_date = de.trade_date LEFT JOIN (SELECT trade_date, {exit_price} AS px FROM market) mx ON mx.trade_date = dx.trade_date)"""


def _joined(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("momentum_5", "reversal_1", "intraday_return")) -> DataFrame:
    return evaluation.join_feature_label(_features(spark, sf_dir, names), _labels(spark, sf_dir, labels.LabelSpec()))


_NAMES = ("momentum_5", "reversal_1", "intraday_return")
_JOINED = _features_sql(_NAMES) + ", " + _labels_sql(0, "close", False).split(EVENT_BARS)[1].lstrip(", ") + """,
joined AS (
  SELECT f.instrument_id, f.decision_date, f.feature_name, f.raw AS value, l.raw_label AS label_value
  FROM features f JOIN labels l ON l.instrument_id = f.instrument_id AND l.decision_date = f.decision_date
  WHERE f.invalid_reason IS NULL AND l.invalid_reason IS NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY feature_name, decision_date ORDER BY value) + (count(*) OVER (PARTITION BY feature_name, decision_date, value) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY feature_name, decision_date ORDER BY label_value) + (count(*) OVER (PARTITION BY feature_name, decision_date, label_value) - 1) / 2.0 AS ry
  FROM joined),
daily AS (
  SELECT feature_name, decision_date, count(*) AS n,
         CASE WHEN count(*) >= 3 AND min(value) <> max(value) AND min(label_value) <> max(label_value) THEN covar_samp(value, label_value) / (stddev_samp(value) * stddev_samp(label_value)) END AS ic,
         CASE WHEN count(*) >= 3 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS rank_ic
  FROM ranked GROUP BY 1, 2)
"""


def joined_feature_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1."""
    return rounded(_joined(spark, sf_dir).drop("horizon_sessions"))


def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    return rounded(evaluation.daily_ic(_joined(spark, sf_dir), ["feature_name"]))


def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7."""
    return rounded(evaluation.ic_summary(evaluation.daily_ic(_joined(spark, sf_dir), ["feature_name"]), ["feature_name"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 and D7 over momentum_5 alone."""
    return rounded(evaluation.ic_summary(evaluation.daily_ic(_joined(spark, sf_dir, ("momentum_5",)), ["feature_name"]), ["feature_name"]))


def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and range of each feature."""
    return rounded(evaluation.value_summary(_features(spark, sf_dir, _NAMES), ["feature_name"]))


def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8."""
    return rounded(evaluation.quantile_returns(_joined(spark, sf_dir), 5, ["feature_name"]))


def top_minus_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    return rounded(evaluation.top_minus_bottom(evaluation.quantile_returns(_joined(spark, sf_dir), 5, ["feature_name"]), 5, ["feature_name"]))


def membership_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    return rounded(evaluation.membership_turnover(_joined(spark, sf_dir), 5, ["feature_name"]))


def ic_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By feature and half of the month."""
    rows = _joined(spark, sf_dir).withColumn("part", F.concat_ws("/", "feature_name", F.when(F.dayofmonth("decision_date") <= 15, "early").otherwise("late")))
    return rounded(evaluation.ic_breakdown(rows, "part"))


def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """momentum_5 against open-to-open labels of one to five sessions."""
    f = _features(spark, sf_dir, ("momentum_5",))
    parts = [evaluation.join_feature_label(f, _labels(spark, sf_dir, labels.LabelSpec("o2o", h))) for h in (1, 3, 5)]
    return rounded(evaluation.ic_decay(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13."""
    return evaluation.date_counts(_joined(spark, sf_dir))


def ic_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its own random draws, so SQL has no twin."""
    daily = evaluation.daily_ic(_joined(spark, sf_dir, ("momentum_5",)), ["feature_name"])
    return evaluation.block_bootstrap(daily)


def cross_sectional_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15, E18."""
    ranked = crosssec.add_missing_indicator(crosssec.cross_sectional_rank(_features(spark, sf_dir, _NAMES)))
    return rounded(ranked.select("instrument_id", "decision_date", "feature_name", "rank_value", "coverage", "is_missing"))


def cross_sectional_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16."""
    return rounded(crosssec.cross_sectional_zscore(_features(spark, sf_dir, _NAMES)).select("instrument_id", "decision_date", "feature_name", "zscore"))


def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17."""
    return rounded(crosssec.winsorize_cross_section(_features(spark, sf_dir, _NAMES), 0.05, 0.95).select("instrument_id", "decision_date", "feature_name", "winsorized"))


def label_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21."""
    return rounded(crosssec.label_rank(_labels(spark, sf_dir, labels.LabelSpec())).select("instrument_id", "decision_date", "label_rank"))


def feature_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum of each instrument on its last day, which is one row each."""
    f = _features(spark, sf_dir, ("momentum_5",))
    last = F.max("decision_date").over(Window.partitionBy("instrument_id"))
    return rounded(f.withColumn("_last", last).where("decision_date = _last").select("instrument_id", "decision_date", "value"))


def classify_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing on the first bar, delisting on the last but one, suspended on Mondays after the 20th."""
    bars, sessions, _ = _panel(spark, sf_dir)
    span = bars.groupBy("instrument_id").agg(F.min("trade_date").alias("listing_date"), F.date_sub(F.max("trade_date"), 1).alias("delisting_date")).withColumn("market", F.lit("tw"))
    halted = bars.where("weekday(trade_date) = 0 and dayofmonth(trade_date) > 20").select("instrument_id", "trade_date")
    closed = sessions.select("trade_date", "market", F.when(F.dayofmonth("trade_date") == 13, "holiday").otherwise("trading_day").alias("status"))
    return grid.classify_observations(bars, span, closed, halted)


def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, G3."""
    bars, sessions, _ = _panel(spark, sf_dir)
    members = bars.select("instrument_id").distinct().withColumn("market", F.lit("tw"))
    return grid.missing_sessions(grid.dense_grid(members, sessions), bars).select("instrument_id", "trade_date")


def common_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks in which every brand has a bar."""
    return grid.common_sessions(brand_bars(spark, sf_dir))


def asof_previous_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last close strictly before each event's day."""
    bars = event_bars(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("instrument_id"), "event_id", F.to_date("ts").alias("day"))
    return rounded(grid.asof_backward(asked, bars, ["instrument_id"], "day", "trade_date", ["close"]))


def interval_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label intervals of early decisions that meet no evaluation interval of the last ten days."""
    rows = _labels(spark, sf_dir, labels.LabelSpec("o2o", 3)).where("valid")
    test = rows.where("dayofmonth(decision_date) > 20")
    train = rows.where("dayofmonth(decision_date) <= 20")
    kept = grid.interval_anti_join(train, test, ["instrument_id"], "label_interval_start", "label_interval_end")
    return kept.select("instrument_id", "decision_date")


def bucketed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored in buckets of their instrument, read again for the return of each day and the mean of its instrument so far."""
    bars = event_bars(spark, sf_dir).select("instrument_id", "trade_date", "close")
    stored = spark.table(bucketed.write_bucketed(bars, scratch_folder(spark), buckets=8))
    own = Window.partitionBy("instrument_id").orderBy("trade_date")
    back = F.lag("close").over(own)
    so_far = F.avg("close").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rounded(stored.select("instrument_id", "trade_date", (F.col("close") / F.nullif(back, F.lit(0.0)) - 1).alias("day_return"), so_far.alias("mean_close")))


QUERIES = [bucketed_returns, baseline_features, labels_o2c, labels_o2o_benchmark, joined_feature_label, daily_ic, ic_summary, value_summary, quantile_returns, top_minus_bottom, membership_turnover, ic_breakdown, ic_decay, universe_counts, ic_bootstrap, cross_sectional_rank, cross_sectional_zscore, winsorize, label_rank, feature_inspect, classify_observations, missing_sessions, common_sessions, asof_previous_close, interval_purge]

_R = lambda c: f"round({c}, 6) + 0.0"
_LABEL_SQL = "SELECT instrument_id, decision_date, entry_date, exit_date, CASE WHEN invalid_reason IS NULL THEN {v} END AS label_value, invalid_reason IS NULL AS valid, invalid_reason"
_QUANTILES = "quant AS (SELECT *, least(5, CAST(floor((row_number() OVER (PARTITION BY feature_name, decision_date ORDER BY value, instrument_id) - 1) * 5 / count(*) OVER (PARTITION BY feature_name, decision_date)) AS INTEGER) + 1) AS quantile FROM joined)"
_DECAY = ", ".join(f"l{h} AS (WITH {_labels_sql(h, 'open', False)} SELECT {h} AS horizon_sessions, instrument_id, decision_date, raw_label FROM labels WHERE invalid_reason IS NULL)" for h in (1, 3, 5))

ORACLES = {
    "bucketed_returns": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date, round(close / nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY trade_date), 0) - 1, 6) + 0.0 AS day_return, round(avg(close) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS mean_close FROM bars",
    "baseline_features": f"{_features_sql(tuple(_FEATURE_SQL))} SELECT instrument_id, decision_date, feature_name, CASE WHEN invalid_reason IS NULL THEN {_R('raw')} END AS value, invalid_reason IS NULL AS valid, invalid_reason FROM features",
    "labels_o2c": f"WITH {_labels_sql(0, 'close', False)} {_LABEL_SQL.format(v=_R('raw_label'))} FROM labels",
    "labels_o2o_benchmark": f"WITH {_labels_sql(5, 'open', True)} {_LABEL_SQL.format(v=_R('raw_label'))}, CASE WHEN invalid_reason IS NULL THEN {_R('raw_return')} END AS raw_return, CASE WHEN invalid_reason IS NULL THEN {_R('benchmark_return')} END AS benchmark_return FROM labels",
    "joined_feature_label": f"{_JOINED} SELECT instrument_id, decision_date, feature_name, {_R('value')} AS value, {_R('label_value')} AS label_value FROM joined",
    "daily_ic": f"{_JOINED} SELECT feature_name, decision_date, n, {_R('ic')} AS ic, {_R('rank_ic')} AS rank_ic, ic IS NOT NULL AND rank_ic IS NOT NULL AS valid, CASE WHEN n < 3 THEN 'insufficient_cross_section' WHEN ic IS NULL OR rank_ic IS NULL THEN 'constant_cross_section' END AS invalid_reason FROM daily",
    "ic_summary": f"{_JOINED} SELECT feature_name, count(ic) AS n_dates, {_R('avg(ic)')} AS mean_ic, {_R('avg(rank_ic)')} AS mean_rank_ic, {_R('stddev_samp(ic)')} AS ic_sd, CASE WHEN count(ic) >= 20 AND stddev_samp(ic) <> 0 THEN {_R('avg(ic) / stddev_samp(ic) * sqrt(252)')} END AS icir, {_R('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS positive_ratio FROM daily GROUP BY 1",
    "value_summary": f"{_features_sql(_NAMES)} SELECT feature_name, count(*) AS n_rows, {_R('count(v) / count(*)')} AS coverage, {_R('1 - count(v) / count(*)')} AS missing_rate, {_R('min(v)')} AS min_value, {_R('median(v)')} AS median_value, {_R('max(v)')} AS max_value FROM (SELECT feature_name, CASE WHEN invalid_reason IS NULL THEN raw END AS v FROM features) GROUP BY 1",
    "quantile_returns": f"{_JOINED}, {_QUANTILES} SELECT feature_name, decision_date, quantile, {_R('avg(label_value)')} AS mean_label, count(*) AS n FROM quant GROUP BY 1, 2, 3",
    "top_minus_bottom": f"{_JOINED}, {_QUANTILES}, ends AS (SELECT feature_name, decision_date, avg(label_value) FILTER (quantile = 5) - avg(label_value) FILTER (quantile = 1) AS s FROM quant GROUP BY 1, 2) SELECT feature_name, {_R('avg(s)')} AS spread, count(s) AS n_dates FROM ends GROUP BY 1",
    "membership_turnover": f"{_JOINED}, {_QUANTILES}, dates AS (SELECT feature_name, quantile, decision_date, row_number() OVER (PARTITION BY feature_name, quantile ORDER BY decision_date) AS i FROM (SELECT DISTINCT feature_name, quantile, decision_date FROM quant)), placed AS (SELECT q.*, d.i FROM quant q JOIN dates d USING (feature_name, quantile, decision_date)) SELECT a.feature_name, a.quantile, a.decision_date, CASE WHEN max(a.i) > 1 THEN {_R('1 - count(b.instrument_id) / count(*)')} END AS turnover FROM placed a LEFT JOIN placed b ON b.feature_name = a.feature_name AND b.quantile = a.quantile AND b.instrument_id = a.instrument_id AND b.i = a.i - 1 GROUP BY 1, 2, 3",
    "ic_breakdown": f"{_JOINED}, per AS (SELECT feature_name || '/' || CASE WHEN day(decision_date) <= 15 THEN 'early' ELSE 'late' END AS part, decision_date, count(*) AS n, CASE WHEN min(value) <> max(value) AND min(label_value) <> max(label_value) THEN covar_samp(value, label_value) / (stddev_samp(value) * stddev_samp(label_value)) END AS ic, CASE WHEN min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS rank_ic FROM ranked GROUP BY 1, 2) SELECT part, CAST(sum(n) AS BIGINT) AS n_rows, {_R('avg(ic)')} AS mean_ic, {_R('avg(rank_ic)')} AS mean_rank_ic FROM per GROUP BY 1",
    "ic_decay": f"{_features_sql(('momentum_5',))}, {_DECAY}, all_l AS (FROM l1 UNION ALL FROM l3 UNION ALL FROM l5), days_ic AS (SELECT l.horizon_sessions, f.decision_date, CASE WHEN count(*) >= 3 AND min(raw) <> max(raw) AND min(raw_label) <> max(raw_label) THEN covar_samp(raw, raw_label) / (stddev_samp(raw) * stddev_samp(raw_label)) END AS ic FROM features f JOIN all_l l USING (instrument_id, decision_date) WHERE f.invalid_reason IS NULL GROUP BY 1, 2) SELECT horizon_sessions, {_R('avg(ic)')} AS mean_ic, count(ic) AS n_dates FROM days_ic GROUP BY 1",
    "universe_counts": f"{_JOINED} SELECT decision_date, count(*) AS n FROM joined GROUP BY 1",
    "cross_sectional_rank": f"{_features_sql(_NAMES)}, v AS (SELECT *, CASE WHEN invalid_reason IS NULL THEN raw END AS value FROM features), r AS (SELECT *, count(value) OVER (PARTITION BY feature_name, decision_date) AS n, rank() OVER (PARTITION BY feature_name, decision_date, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY feature_name, decision_date, value) - 1) / 2.0 AS k FROM v) SELECT instrument_id, decision_date, feature_name, CASE WHEN value IS NOT NULL THEN {_R('CASE WHEN n = 1 THEN 0.5 ELSE (k - 1) / (n - 1) END')} END AS rank_value, CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS coverage, value IS NULL AS is_missing FROM r",
    "cross_sectional_zscore": f"{_features_sql(_NAMES)} SELECT instrument_id, decision_date, feature_name, {_R('(raw - avg(raw) OVER w) / nullif(stddev_samp(raw) OVER w, 0)')} AS zscore FROM features WHERE invalid_reason IS NULL WINDOW w AS (PARTITION BY feature_name, decision_date)",
    "winsorize": f"{_features_sql(_NAMES)}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_name, decision_date ORDER BY raw) - 1 AS i, count(*) OVER (PARTITION BY feature_name, decision_date) AS n FROM features WHERE invalid_reason IS NULL), b AS (SELECT feature_name, decision_date, max(raw) FILTER (i = round(0.05 * (n - 1))) AS lo, max(raw) FILTER (i = round(0.95 * (n - 1))) AS hi FROM r GROUP BY 1, 2) SELECT r.instrument_id, r.decision_date, r.feature_name, {_R('least(greatest(raw, lo), hi)')} AS winsorized FROM r JOIN b USING (feature_name, decision_date)",
    "label_rank": f"WITH {_labels_sql(0, 'close', False)}, v AS (SELECT instrument_id, decision_date, CASE WHEN invalid_reason IS NULL THEN raw_label END AS value FROM labels), r AS (SELECT *, count(value) OVER (PARTITION BY decision_date) AS n, rank() OVER (PARTITION BY decision_date, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY decision_date, value) - 1) / 2.0 AS k FROM v) SELECT instrument_id, decision_date, CASE WHEN value IS NOT NULL THEN {_R('CASE WHEN n = 1 THEN 0.5 ELSE (k - 1) / (n - 1) END')} END AS label_rank FROM r",
    "feature_inspect": f"{_features_sql(('momentum_5',))} SELECT instrument_id, decision_date, CASE WHEN invalid_reason IS NULL THEN {_R('raw')} END AS value FROM features QUALIFY decision_date = max(decision_date) OVER (PARTITION BY instrument_id)",
    "classify_observations": f"WITH {EVENT_BARS}, span AS (SELECT instrument_id, min(trade_date) AS a, CAST(max(trade_date) - 1 AS DATE) AS b FROM bars GROUP BY 1) SELECT g.instrument_id, g.trade_date, CASE WHEN day(g.trade_date) = 13 THEN 'market_closed' WHEN g.trade_date < a THEN 'not_yet_listed' WHEN g.trade_date > b THEN 'delisted' WHEN close IS NOT NULL AND dayofweek(g.trade_date) = 1 AND day(g.trade_date) > 20 THEN 'suspended' WHEN close IS NULL THEN 'provider_missing' WHEN volume = 0 THEN 'zero_volume' ELSE 'observed' END AS status FROM grid g JOIN span USING (instrument_id)",
    "missing_sessions": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date FROM grid WHERE close IS NULL",
    "common_sessions": f"WITH {BRAND_BARS} SELECT trade_date FROM bars GROUP BY 1 HAVING count(DISTINCT instrument_id) = (SELECT count(DISTINCT instrument_id) FROM bars)",
    "asof_previous_close": f"WITH {EVENT_BARS}, asked AS (SELECT CAST(user_id AS VARCHAR) AS instrument_id, event_id, CAST(ts AS DATE) AS day FROM events) SELECT a.instrument_id, a.event_id, a.day, {_R('arg_max(b.close, b.trade_date)')} AS asof_close FROM asked a LEFT JOIN bars b ON b.instrument_id = a.instrument_id AND b.trade_date < a.day GROUP BY 1, 2, 3",
    "interval_purge": f"WITH {_labels_sql(3, 'open', False)}, good AS (SELECT * FROM labels WHERE invalid_reason IS NULL) SELECT a.instrument_id, a.decision_date FROM good a WHERE day(a.decision_date) <= 20 AND NOT EXISTS (SELECT 1 FROM good t WHERE day(t.decision_date) > 20 AND t.instrument_id = a.instrument_id AND a.entry_date <= t.exit_date AND t.entry_date <= a.exit_date)",
}
