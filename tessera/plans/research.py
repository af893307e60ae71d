"""Queries of universes, quality findings, supervised panels and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import evaluation, features, grid, labels, mlpanel, universe
from tessera.operators.selection import stored
from tessera.plans.inputs import EVENT_BARS, event_bars, event_sessions, everyone, rounded, table
from tessera.plans.panel import _feature_sql, _labels_sql, _MOVED  # the SQL twins of features and labels

_NAMES = ["reversal_1", "momentum_5", "intraday_return"]


def _instruments(bars: DataFrame) -> DataFrame:
    """Listed on the first bar, delisted the day after the last; every seventh user of unknown market, every fifth another product."""
    number = F.col("instrument_id").cast("int")
    span = bars.groupBy("instrument_id").agg(F.min("trade_date").alias("listing_date"), F.date_add(F.max("trade_date"), 1).alias("delisting_date"))
    return span.withColumn("security_type", F.when(number % 5 == 0, "excluded_product").otherwise("ordinary_share")).withColumn("known_market", F.when(number % 7 == 0, "unknown").otherwise("tw")).withColumn("quality", F.when(number % 3 == 0, "provisional").otherwise("final"))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    sessions = event_sessions(bars)
    who = _instruments(bars)
    cells = grid.dense_grid(bars.select("instrument_id").distinct().withColumn("market", F.lit("tw")), sessions)
    full = grid.on_grid(cells, bars).join(who, "instrument_id").withColumn("market", F.col("known_market"))
    return universe.build_universe(universe.UniversePolicy(3, 4, 5, 2000.0), full)


def build_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22."""
    return _membership(spark, sf_dir).withColumn("reasons", F.concat_ws(";", "reasons"))


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    return universe.exclusion_counts(_membership(spark, sf_dir))


def universe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, B16."""
    who = _instruments(event_bars(spark, sf_dir)).withColumn("market", F.col("known_market"))
    meta = universe.universe_metadata(_membership(spark, sf_dir), who)
    return universe.completeness(meta, ("unknown_market", "provisional"))


def _dirty(bars: DataFrame) -> DataFrame:
    """Event bars with faults by the day and user, and the 7th day twice."""
    bars = bars.select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "traded_value")
    pick = (F.col("instrument_id").cast("int") + F.dayofmonth("trade_date")) % 11
    broken = bars.withColumns({
        "open": F.when(pick == 1, -F.col("open")).when(pick == 2, 0.0).when(pick == 3, 0.0).otherwise(F.col("open")),
        "high": F.when(pick == 2, 0.0).when(pick == 4, F.col("low") / 2).otherwise(F.col("high")), "low": F.when(pick == 2, 0.0).otherwise(F.col("low")), "close": F.when(pick == 2, 0.0).otherwise(F.col("close")),
        "volume": F.when(pick == 5, -F.col("volume")).otherwise(F.col("volume")),
    })
    return broken.unionByName(broken.where("dayofmonth(trade_date) = 7"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: each kind of finding reads the bars, and none sorts the events again in a few tasks of the union.
    bars = stored(event_bars(spark, sf_dir))
    who = _instruments(bars).select("instrument_id", F.col("known_market").alias("market"), F.when(F.col("instrument_id").cast("int") % 4 != 1, F.col("listing_date")).alias("listing_date"))
    cells = grid.dense_grid(bars.select("instrument_id").distinct().withColumn("market", F.lit("tw")), event_sessions(bars))
    return universe.validate_daily_prices(_dirty(bars), who, grid.missing_sessions(cells, bars).select("instrument_id", "trade_date"))


def price_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, B20."""
    return _findings(spark, sf_dir)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return universe.duplicate_keys(_dirty(event_bars(spark, sf_dir)), ["instrument_id", "trade_date"])


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3."""
    return universe.issue_counts(_findings(spark, sf_dir), ["severity", "code"])


def search_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of findings about users with a 1."""
    return universe.search_issues(_findings(spark, sf_dir), contains="1", page=2, size=20)


def available_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was available at the end of 1997."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("available_at"))
    return universe.filter_available(rows, F.lit("1997-12-31").cast("timestamp")).select("o_orderkey")


def filtered_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a span of days, of the users with two events or more in one of all days."""
    bars = event_bars(spark, sf_dir)
    busy = bars.where("volume > 1").select("instrument_id").distinct()
    return rounded(universe.filter_panel(bars, "2024-01-05", "2024-01-15", busy).select("instrument_id", "trade_date", "close"))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer by mid 1996."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("available_at"))
    return rounded(universe.latest_revision(rows, ["o_custkey"], "o_orderkey", F.lit("1996-06-30").cast("timestamp")).drop("available_at"))


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: orders merged with a later copy of every third that has another column; the first ingested stay."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("ingested_at"))
    later = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("ingested_at") - F.expr("INTERVAL 1 DAY") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("ingested_at"), F.lit("copy").alias("note"))
    return universe.merge_incremental(orders, later, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "note")


def discovered_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-digit part keys of orders' lines, or of parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stock_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("stock_id"))
    return universe.discover_symbols(parts, lines)


def volume_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second provider in thousands of shares, rounded."""
    bars = event_bars(spark, sf_dir).withColumn("volume", F.col("volume") * 1499)
    other = bars.select("instrument_id", "trade_date", F.round(F.col("volume") / 1000).alias("volume"), F.lit("thousand_shares").alias("unit"))
    return rounded(universe.compare_volumes(bars, other, "unit"))


def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users asked for, and one that never came."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instrument_id")).distinct().union(spark.sql("SELECT 'none' AS instrument_id"))
    return universe.panel_coverage(event_bars(spark, sf_dir), asked)


def provider_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as providers of its ship day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_key"), F.col("l_suppkey").alias("provider"), F.year("l_shipdate").alias("checksum"))
    return universe.provider_agreement(rows)


def _supervised(spark: SparkSession, sf_dir: str, policy: str = "invalid") -> DataFrame:
    bars = event_bars(spark, sf_dir)
    sessions = event_sessions(bars)
    members = everyone(bars, sessions)
    f = features.compute_features(bars, members, sessions, [s for s in features.REGISTRY.all() if s.name in _NAMES])
    return mlpanel.build_supervised(f, labels.build_labels(labels.LabelSpec("o2o", 2), bars, members, sessions), members, _NAMES, policy)


def supervised_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C3."""
    rows = _supervised(spark, sf_dir)
    return rounded(rows.select("instrument_id", "decision_date", *(F.get("feature_vector", F.lit(i)).alias(f"f{i}") for i in range(3)), "label_value", "sample_valid", "sample_reason"))


_FOLDS = mlpanel.FoldConfig(train=12, validation=3, test=3, embargo=1, holdout=3)


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mlpanel.walk_forward(_supervised(spark, sf_dir, "drop_sample"), event_sessions(event_bars(spark, sf_dir)), _FOLDS)


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E25, C7, G5."""
    return _folds(spark, sf_dir).select("fold_id", "role", "instrument_id", "decision_date", "purged")


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and cutoffs."""
    return mlpanel.fold_counts(_folds(spark, sf_dir)).withColumn("fit_cutoff", F.to_date("fit_cutoff"))


def robust_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D25, K4."""
    bars = event_bars(spark, sf_dir)
    long = bars.select("instrument_id", F.col("trade_date").alias("decision_date"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value")) for c in ("close", "volume")))).alias("f")).select("instrument_id", "decision_date", "f.*")
    return rounded(mlpanel.apply_robust(long, mlpanel.fit_robust(long, "2024-01-01", "2024-01-15")).select("instrument_id", "decision_date", "feature_name", "scaled"))


def fold_preprocessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the training part of each fold."""
    return rounded(mlpanel.fit_fold_preprocessor(_folds(spark, sf_dir).where("role = 'train' and not purged")))


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D27."""
    return rounded(mlpanel.with_sample_weight(_supervised(spark, sf_dir, "drop_sample"), "by_date").select("instrument_id", "decision_date", "weight"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: the preprocessor, the models and the predictions read them.
    rows = stored(_folds(spark, sf_dir).where("fold_id > 0"))
    ready = mlpanel.with_sample_weight(mlpanel.apply_preprocessor(rows, mlpanel.fit_fold_preprocessor(rows.where("role = 'train' and not purged"))))
    fitted = mlpanel.fit_candidates(ready.where("role = 'train' and not purged"), 3)
    if not fitted:
        return ready.limit(0).withColumn("candidate", F.lit("")).withColumn("rank", F.lit(0)).withColumn("alpha", F.lit(0.0)).withColumn("prediction", F.lit(0.0))
    return mlpanel.predict(ready.where("role != 'train'"), fitted)


def linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each candidate; solved from Gram sums, so SQL has no twin (numpy checks it in the tests)."""
    return rounded(_ledger(spark, sf_dir).select("fold_id", "role", "instrument_id", "decision_date", "candidate", "prediction"))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each fold in order of validation."""
    return rounded(mlpanel.select_candidates(_ledger(spark, sf_dir)))


def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum as the prediction of the label, by half of the month as the fold."""
    rows = _supervised(spark, sf_dir, "drop_sample").select("instrument_id", "decision_date", F.lit("test").alias("split_role"), F.when(F.dayofmonth("decision_date") <= 15, 1).otherwise(2).alias("fold_id"), F.get("feature_vector", F.lit(1)).alias("prediction"), F.col("label_value").alias("target"))
    return rounded(evaluation.prediction_metrics(rows))


def expanding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D33."""
    rows = _supervised(spark, sf_dir, "drop_sample").select("decision_date", F.get("feature_vector", F.lit(1)).alias("value"), "label_value")
    return rounded(mlpanel.expanding_regression(rows), 5)


def available_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks of each order date."""
    from tessera.functions.columns import AvailabilityPolicy

    p, day = AvailabilityPolicy(), F.to_date("o_orderdate")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", at(p.event_time(day)).alias("event_time"), at(p.published(day)).alias("published"), at(p.available(day)).alias("available"))


QUERIES = [build_universe, exclusion_counts, universe_metadata, price_findings, duplicate_keys, issue_counts, search_issues, available_orders, filtered_panel, latest_revision, merged_orders, discovered_symbols, volume_gaps, panel_coverage, provider_agreement, supervised_panel, walk_forward, fold_counts, robust_scaler, fold_preprocessor, sample_weights, linear_models, experiment, prediction_metrics, expanding_regression, available_times]

_R = lambda c, n=6: f"round({c}, {n}) + 0.0"
_UNI = EVENT_BARS + """,
who AS (SELECT instrument_id, min(trade_date) AS listing, CAST(max(trade_date) + 1 AS DATE) AS gone, CASE WHEN CAST(instrument_id AS INT) % 5 = 0 THEN 'excluded_product' ELSE 'ordinary_share' END AS st,
               CASE WHEN CAST(instrument_id AS INT) % 7 = 0 THEN 'unknown' ELSE 'tw' END AS market FROM bars GROUP BY 1),
med AS (SELECT instrument_id, session_idx, quantile_cont(traded_value, 0.5) OVER o AS m, count(*) OVER o AS c FROM grid WHERE close > 0 WINDOW o AS (PARTITION BY instrument_id ORDER BY session_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
h AS (SELECT g.*, w.listing, w.gone, w.st, w.market, count(g.close) OVER b AS nb, last_value(med.m IGNORE NULLS) OVER b AS m, coalesce(last_value(med.c IGNORE NULLS) OVER b, 0) AS c
      FROM grid g JOIN who w USING (instrument_id) LEFT JOIN med USING (instrument_id, session_idx)
      WINDOW b AS (PARTITION BY g.instrument_id ORDER BY g.session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT instrument_id, trade_date, market, list_filter([CASE WHEN st <> 'ordinary_share' THEN 'not_ordinary_share' END, CASE WHEN market = 'unknown' THEN 'unknown_market' END,
   CASE WHEN trade_date < listing THEN 'not_yet_listed' END, CASE WHEN trade_date >= gone THEN 'delisted' END, CASE WHEN nb < 3 THEN 'minimum_listing_days' END, CASE WHEN close IS NULL THEN 'missing_daily_bar' END,
   CASE WHEN nb < 4 THEN 'insufficient_lookback' END, CASE WHEN c < 5 THEN 'insufficient_liquidity_history' END, CASE WHEN c >= 5 AND m < 2000 THEN 'minimum_trailing_median_traded_value' END], lambda x : x IS NOT NULL) AS reasons FROM h)"""
_DIRTY = EVENT_BARS + """,
p AS (SELECT *, (CAST(instrument_id AS INT) + day(trade_date)) % 11 AS k FROM bars),
d0 AS (SELECT instrument_id, trade_date, CASE WHEN k = 1 THEN -open WHEN k IN (2, 3) THEN 0 ELSE open END AS open, CASE WHEN k = 2 THEN 0 WHEN k = 4 THEN low / 2 ELSE high END AS high, CASE WHEN k = 2 THEN 0 ELSE low END AS low,
       CASE WHEN k = 2 THEN 0 ELSE close END AS close, CASE WHEN k = 5 THEN -volume ELSE volume END AS volume, traded_value FROM p),
dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE day(trade_date) = 7),
coded AS (SELECT instrument_id, trade_date, CASE WHEN least(open, high, low, close) < 0 THEN 'NEGATIVE_PRICE' WHEN greatest(open, high, low, close) = 0 THEN 'NO_PUBLISHED_PRICE' WHEN least(open, high, low, close) = 0 THEN 'PARTIAL_ZERO_PRICE'
            WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'INVALID_OHLC' END AS code FROM dirty
          UNION ALL SELECT instrument_id, trade_date, CASE WHEN least(open, high, low, close) >= 0 AND (volume < 0 OR traded_value < 0) THEN 'NEGATIVE_ACTIVITY' END FROM dirty),
findings AS (
  SELECT CASE WHEN code = 'NO_PUBLISHED_PRICE' THEN 'warning' ELSE 'error' END AS severity, code, instrument_id, trade_date FROM coded WHERE code IS NOT NULL
  UNION ALL SELECT 'error', 'DUPLICATE_PRIMARY_KEY', instrument_id, trade_date FROM dirty GROUP BY 3, 4 HAVING count(*) > 1
  UNION ALL SELECT 'warning', 'UNKNOWN_HISTORICAL_MARKET', instrument_id, NULL FROM (SELECT DISTINCT instrument_id FROM bars) WHERE CAST(instrument_id AS INT) % 7 = 0
  UNION ALL SELECT 'warning', 'MISSING_LISTING_DATE', instrument_id, NULL FROM (SELECT DISTINCT instrument_id FROM bars) WHERE CAST(instrument_id AS INT) % 4 = 1
  UNION ALL SELECT 'warning', 'MISSING_TRADING_DAY', instrument_id, trade_date FROM grid WHERE close IS NULL)"""
_SUP = f"""WITH {_MOVED}, f AS ({' UNION ALL '.join(map(_feature_sql, _NAMES))}),
wide AS (SELECT instrument_id, decision_date, {', '.join(f"max(raw) FILTER (feature_name = '{n}' AND session_idx >= need AND have >= need AND NOT low_price) AS f{i}" for i, n in enumerate(_NAMES))} FROM f GROUP BY 1, 2),
{_labels_sql(2, 'open', False).split(EVENT_BARS)[1].lstrip(', ')},
sup AS (SELECT l.instrument_id, l.decision_date, l.entry_date, l.exit_date, f0, f1, f2, CASE WHEN l.invalid_reason IS NULL THEN raw_label END AS label_value,
  concat_ws(';', 'invalid_label:' || l.invalid_reason, {', '.join(f"CASE WHEN f{i} IS NULL THEN 'missing_or_invalid_feature:{n}' END" for i, n in enumerate(_NAMES))}) AS reason FROM labels l JOIN wide USING (instrument_id, decision_date)),
good AS (SELECT s.*, d.session_idx FROM sup s JOIN days d ON d.trade_date = s.decision_date WHERE reason = ''),
cnt AS (SELECT max(session_idx) AS n FROM days),
bounds AS (SELECT CAST(k AS INTEGER) AS fold_id, 12 + (k - 1) * 6 AS b FROM range(1, 100) t(k), cnt WHERE 12 + (k - 1) * 6 + 1 + 3 + 1 + 3 <= n - 3),
placed AS (SELECT fold_id, CASE WHEN session_idx <= b THEN 'train' WHEN session_idx BETWEEN b + 2 AND b + 4 THEN 'validation' WHEN session_idx BETWEEN b + 6 AND b + 8 THEN 'test' END AS role, g.* FROM good g, bounds),
folds AS (SELECT *, role = 'train' AND coalesce(exit_date >= min(entry_date) FILTER (role <> 'train') OVER (PARTITION BY fold_id), false) AS purged FROM placed WHERE role IS NOT NULL
          UNION ALL SELECT 0, 'final_holdout', g.*, false FROM good g, cnt WHERE session_idx > n - 3)"""
_PRE = _SUP + """, tr AS (SELECT fold_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END AS x FROM folds, range(0, 3) t(pos) WHERE role = 'train' AND NOT purged),
md AS (SELECT fold_id, pos, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM tr GROUP BY 1, 2)"""

ORACLES = {
    "build_universe": f"WITH {_UNI} SELECT instrument_id, trade_date, market, len(reasons) = 0 AS eligible, array_to_string(reasons, ';') AS reasons FROM u",
    "exclusion_counts": f"WITH {_UNI} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM u) GROUP BY 1",
    "universe_metadata": f"WITH {_UNI}, m AS (SELECT min(trade_date) AS coverage_start, max(trade_date) AS as_of FROM days), k AS (SELECT count(*) AS known, count(*) FILTER (market = 'unknown') AS unknown_market, count(*) FILTER (CAST(instrument_id AS INT) % 3 = 0) AS provisional FROM who) SELECT *, unknown_market = 0 AND provisional = 0 AS is_research_complete, CASE WHEN unknown_market = 0 AND provisional = 0 THEN 'validated' ELSE 'exploratory' END AS classification FROM m, k",
    "price_findings": f"WITH {_DIRTY} SELECT * FROM findings",
    "duplicate_keys": f"WITH {_DIRTY} SELECT instrument_id, trade_date, count(*) AS copies FROM dirty GROUP BY 1, 2 HAVING count(*) > 1",
    "issue_counts": f"WITH {_DIRTY} SELECT severity, code, count(*) AS n FROM findings GROUP BY 1, 2",
    "search_issues": f"WITH {_DIRTY} SELECT * FROM findings WHERE instrument_id LIKE '%1%' ORDER BY CASE WHEN severity = 'error' THEN 0 ELSE 1 END, trade_date NULLS FIRST, instrument_id, code LIMIT 20 OFFSET 20",
    "available_orders": "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-12-31'",
    "filtered_panel": f"WITH {EVENT_BARS} SELECT instrument_id, trade_date, {_R('close')} AS close FROM bars WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND instrument_id IN (SELECT instrument_id FROM bars WHERE volume > 1)",
    "latest_revision": f"SELECT o_custkey, o_orderkey, {_R('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "merged_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'copy' END AS note FROM orders",
    "discovered_symbols": "SELECT stock_id FROM (SELECT CAST(p_partkey AS VARCHAR) AS stock_id FROM part UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem) WHERE regexp_full_match(stock_id, '[0-9]{4}')",
    "volume_gaps": f"WITH {EVENT_BARS}, v AS (SELECT instrument_id, trade_date, volume * 1499 AS a, CAST(round(round(volume * 1499 / 1000) * 1000) AS BIGINT) AS b FROM bars) SELECT instrument_id, trade_date, abs(a - b) AS absolute_difference, {_R('abs(a - b) / greatest(a, b, 1)')} AS relative_difference FROM v",
    "panel_coverage": f"WITH {EVENT_BARS}, s AS (SELECT * FROM bars), q AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events UNION SELECT 'none') SELECT count(DISTINCT trade_date) AS sessions, count(DISTINCT instrument_id) AS instruments, (SELECT count(*) FROM q) AS requested, (SELECT count(*) FROM q WHERE id NOT IN (SELECT instrument_id FROM s)) AS missing, 'missing_instruments' AS blockers FROM s",
    "provider_agreement": "SELECT l_orderkey AS record_key, count(DISTINCT l_suppkey) AS providers, count(DISTINCT year(l_shipdate)) = 1 AS agrees FROM lineitem GROUP BY 1",
    "supervised_panel": f"{_SUP} SELECT instrument_id, decision_date, {', '.join(f'{_R(c)} AS {c}' for c in ('f0', 'f1', 'f2', 'label_value'))}, reason = '' AS sample_valid, nullif(reason, '') AS sample_reason FROM sup",
    "walk_forward": f"{_SUP} SELECT fold_id, role, instrument_id, decision_date, purged FROM folds",
    "fold_counts": f"{_SUP} SELECT fold_id, role, count(*) AS n, CAST(sum(CASE WHEN purged THEN 1 ELSE 0 END) AS BIGINT) AS purged, max(decision_date) FILTER (role = 'train' AND NOT purged) AS fit_cutoff FROM folds GROUP BY 1, 2",
    "robust_scaler": f"WITH {EVENT_BARS}, l AS (SELECT instrument_id, trade_date AS decision_date, 'close' AS feature_name, close AS value FROM bars UNION ALL SELECT instrument_id, trade_date, 'volume', volume FROM bars), m AS (SELECT feature_name, quantile_cont(value, 0.5) AS md FROM l WHERE decision_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 1), s AS (SELECT l.feature_name, quantile_cont(abs(value - md), 0.5) AS mad FROM l JOIN m USING (feature_name) WHERE decision_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 1) SELECT instrument_id, decision_date, l.feature_name, {_R('(value - md) / mad')} AS scaled FROM l JOIN m USING (feature_name) JOIN s USING (feature_name) WHERE mad > 0",
    "fold_preprocessor": f"{_PRE} SELECT fold_id, pos, {_R('max(median)')} AS median, {_R('max(lo)')} AS lo, {_R('max(hi)')} AS hi, {_R('avg(least(greatest(x, lo), hi))')} AS mean, {_R('CASE WHEN stddev_samp(least(greatest(x, lo), hi)) > 0 THEN stddev_samp(least(greatest(x, lo), hi)) ELSE 1 END')} AS sd FROM tr JOIN md USING (fold_id, pos) GROUP BY 1, 2",
    "sample_weights": f"{_SUP} SELECT instrument_id, decision_date, {_R('1.0 / count(*) OVER (PARTITION BY decision_date)')} AS weight FROM good",
    "prediction_metrics": f"""{_SUP}, rows AS (SELECT instrument_id, decision_date, CASE WHEN day(decision_date) <= 15 THEN 1 ELSE 2 END AS fold_id, f1 AS p, label_value AS y FROM good),
rk AS (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY fold_id, decision_date ORDER BY p, instrument_id) AS i, rank() OVER (PARTITION BY fold_id, decision_date ORDER BY p) + (count(*) OVER (PARTITION BY fold_id, decision_date, p) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY fold_id, decision_date ORDER BY y) + (count(*) OVER (PARTITION BY fold_id, decision_date, y) - 1) / 2.0 AS ry FROM rows WINDOW d AS (PARTITION BY fold_id, decision_date)),
ics AS (SELECT fold_id, decision_date, CASE WHEN count(*) >= 2 AND min(p) <> max(p) AND min(y) <> max(y) THEN covar_samp(p, y) / (stddev_samp(p) * stddev_samp(y)) END AS ic, CASE WHEN count(*) >= 2 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ric FROM rk GROUP BY 1, 2),
q AS (SELECT *, least(5, (i - 1) * 5 // n + 1) AS qq FROM rk WHERE n >= 5), sp AS (SELECT fold_id, decision_date, avg(y) FILTER (qq = 5) - avg(y) FILTER (qq = 1) AS s FROM q GROUP BY 1, 2),
t5 AS (SELECT *, dense_rank() OVER (PARTITION BY fold_id ORDER BY decision_date) AS di FROM q WHERE qq = 5), tu AS (SELECT a.fold_id, a.di, CASE WHEN a.di > 1 THEN 1 - count(b.instrument_id) / count(*) END AS t FROM t5 a LEFT JOIN t5 b ON b.fold_id = a.fold_id AND b.instrument_id = a.instrument_id AND b.di = a.di - 1 GROUP BY 1, 2)
SELECT 'test' AS split_role, fold_id, count(*) AS n, {_R('avg(abs(p - y))')} AS mae, {_R('sqrt(avg((p - y) * (p - y)))')} AS rmse, {_R('avg(p)')} AS prediction_mean, {_R('stddev_samp(p)')} AS prediction_sd, {_R('(SELECT avg(ic) FROM ics z WHERE z.fold_id = r.fold_id)')} AS mean_ic, {_R('(SELECT avg(ric) FROM ics z WHERE z.fold_id = r.fold_id)')} AS mean_rank_ic, {_R('(SELECT avg(s) FROM sp z WHERE z.fold_id = r.fold_id)')} AS spread, {_R('(SELECT avg(t) FROM tu z WHERE z.fold_id = r.fold_id)')} AS top_turnover FROM rows r GROUP BY fold_id""",
    "expanding_regression": f"{_SUP}, a AS (SELECT decision_date, count(*) AS n, sum(f1) AS sx, sum(label_value) AS sy, sum(f1 * label_value) AS sxy, sum(f1 * f1) AS sxx FROM good GROUP BY 1), r AS (SELECT decision_date, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy, sum(sxx) OVER w AS sxx FROM a WINDOW w AS (ORDER BY decision_date ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)), s AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM r WHERE n >= 2) SELECT decision_date, CAST(n AS BIGINT) AS n, {_R('(sy - slope * sx) / n', 5)} AS intercept, {_R('slope', 5)} AS slope FROM s",
    "available_times": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS event_time, strftime(CAST(o_orderdate AS DATE) + INTERVAL 570 MINUTE, '%Y-%m-%d %H:%M:%S') AS published, strftime(CAST(o_orderdate AS DATE) + INTERVAL 600 MINUTE, '%Y-%m-%d %H:%M:%S') AS available FROM orders",
}
