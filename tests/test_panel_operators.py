"""Hand-made cases: no look-ahead, ordered folds, parsing, models, streams, sources."""

import datetime as dt
import json
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as H
from tessera.operators import actions, audit, crosssec, evaluation, factorlab, features, grid, mlpanel, portfolio, signals, targets, universe
from tessera.sources import files
from tessera.streaming import health

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]


def bars(spark, n=25, ids=("a", "b", "c"), shift=0.0):
    rows = [(k, DAYS[i], 100.0 + i * (j + 1), 101.0 + i * (j + 1), 99.0 + i * (j + 1), 100.0 + i * (j + 1) + (shift if i >= 20 else 0), 1000 + i, 1e5 + i, dt.datetime.combine(DAYS[i], dt.time(10))) for j, k in enumerate(ids) for i in range(n)]
    return spark.createDataFrame(rows, "instrument_id string, trade_date date, open double, high double, low double, close double, volume long, traded_value double, available_at timestamp")


def panel(spark, df):
    sessions = grid.with_session_index(grid.calendar_of(df))
    members = df.select("instrument_id").distinct().join(sessions.select("trade_date", "market")).withColumn("eligible", F.lit(True))
    return df, members, sessions


def test_features_do_not_look_ahead(spark):
    get = lambda df: {(r.instrument_id, r.decision_date, r.feature_name): r.value for r in features.compute_features(*panel(spark, df)).where("decision_date < date'2024-01-20'").collect()}
    assert get(bars(spark)) == get(bars(spark, shift=50.0))


def test_missing_session_invalidates_and_late_bar_is_not_used(spark):
    df = bars(spark).where("not (instrument_id = 'a' and trade_date = date'2024-01-10')")
    df = df.withColumn("available_at", F.when((F.col("instrument_id") == "b") & (F.col("trade_date") == F.lit("2024-01-12").cast("date")), F.lit("2024-03-01").cast("timestamp")).otherwise(F.col("available_at")))
    df = df.withColumn("volume", F.when((F.col("instrument_id") == "c") & (F.col("trade_date") == F.lit("2024-01-12").cast("date")), 0).otherwise(F.col("volume")))
    out = {(r.instrument_id, str(r.decision_date)): r.invalid_reason for r in features.compute_features(*panel(spark, df), [s for s in features.REGISTRY.all() if s.name == "momentum_5"]).collect()}
    assert out["a", "2024-01-12"] == "provider_missing_or_suspended_session"
    assert out["b", "2024-01-14"] == "observation_not_available_at_decision"
    assert out["c", "2024-01-14"] == "zero_volume_or_suspended_observation"
    assert out["a", "2024-01-03"] == "insufficient_lookback"
    assert out["a", "2024-01-16"] is None


def test_specs_may_not_read_labels_or_change():
    with pytest.raises(ValueError):
        features.FeatureSpec("x", "v1", ("label_value",), 1, lambda w: F.lit(1))
    with pytest.raises(ValueError):
        features.REGISTRY.add(features.FeatureSpec("momentum_5", "v1", ("open",), 9, lambda w: F.lit(1)))
    with pytest.raises(NotImplementedError):
        crosssec.neutralize("sector")


def test_ic_by_hand(spark):
    rows = [("d", str(i), float(i), float(i * i)) for i in range(4)] + [("e", str(i), 1.0, float(i)) for i in range(3)] + [("f", "0", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "decision_date string, instrument_id string, value double, label_value double")
    out = {r.decision_date: r for r in evaluation.daily_ic(df).collect()}
    assert out["d"].rank_ic == pytest.approx(1) and out["d"].ic == pytest.approx(np.corrcoef(range(4), [0, 1, 4, 9])[0, 1])
    assert out["e"].invalid_reason == "constant_cross_section" and out["f"].invalid_reason == "insufficient_cross_section"


def test_quantile_is_not_ntile(spark):
    df = spark.createDataFrame([("d", f"{i}", float(i), 0.0) for i in range(7)], "decision_date string, instrument_id string, value double, label_value double")
    assert [r.quantile for r in evaluation.with_quantile(df, 5).orderBy("value").collect()] == [i * 5 // 7 + 1 for i in range(7)]


def test_bootstrap(spark):
    days = spark.createDataFrame([(d, 0.1 * (i % 3)) for i, d in enumerate(DAYS)], "decision_date date, rank_ic double")
    r = evaluation.block_bootstrap(days).first()
    assert r.available and r.lower <= 0.1 <= r.upper
    assert not evaluation.block_bootstrap(days.limit(3)).first().available


def test_p_and_q_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", None)], "factor_key string, t_stat double").withColumn("p_value", factorlab.erfc_p("t_stat"))
    out = {r.factor_key: r for r in factorlab.bh_qvalues(df).collect()}
    assert out["a"].p_value == pytest.approx(math.erfc(2 / math.sqrt(2))) and out["c"].p_value is None
    assert out["a"].q_value == pytest.approx(3 * out["a"].p_value) and out["b"].q_value == pytest.approx(1.5 * out["b"].p_value) and out["c"].q_value == 1.0


def test_pick_uncorrelated(spark):
    scored = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "factor_key string, score double")
    near = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.1), ("a", "c", 0.2)], "k1 string, k2 string, rho double")
    assert factorlab.pick_uncorrelated(scored, near) == ["a", "c"]


def test_linear_models_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60) / 10
    df = spark.createDataFrame([(1, [float(v) for v in r], float(t), 1.0) for r, t in zip(x, y, strict=True)], "fold_id int, x array<double>, label_value double, weight double")
    stats = mlpanel.gram(df, 2)
    full = np.c_[np.ones(60), x]
    for alpha in (0.0, 3.0):
        want = np.linalg.solve(full.T @ full + np.diag([0, alpha, alpha]), full.T @ y)
        _, b, w = mlpanel.solve_ridge(stats, 2, alpha)[0]
        assert np.allclose([b, *w], want)
    assert mlpanel.solve_elastic_net(stats, 2, 100.0, 1.0)[0][2] == [0.0, 0.0]
    flat = df.withColumn("x", F.array(F.lit(1.0), F.lit(1.0)))
    with pytest.raises(ValueError):
        mlpanel.solve_ridge(mlpanel.gram(flat, 2), 2)


def test_folds_by_hand():
    c = mlpanel.FoldConfig(train=10, validation=2, test=2, embargo=1, holdout=2)
    assert c.bounds(24) == [(1, 1, 10, 12, 13, 15, 16), (2, 1, 14, 16, 17, 19, 20)]
    with pytest.raises(ValueError):
        mlpanel.FoldConfig(10, 2, 2, step=3).bounds(24)


def test_cost_basis_by_hand(spark):
    day = lambda i: DAYS[i]
    rows = [("p", "x", "1", day(0), "buy", 10, 10.0, 1.0, 0.0), ("p", "x", "2", day(1), "sell", 4, 12.0, 1.0, 1.0), ("p", "x", "3", day(3), "sell", 12, 6.0, 0.0, 0.0), ("p", "x", "4", day(4), "sell", 1, 6.0, 0.0, 0.0)]
    fills = spark.createDataFrame(rows, "portfolio string, instrument_id string, fill_id string, session date, side string, quantity long, price double, fee double, tax double")
    splits = spark.createDataFrame([("p", "x", day(2), 2.0)], "portfolio string, instrument_id string, session date, ratio double")
    out = {r.fill_id: r for r in portfolio.cost_basis(fills, splits).collect()}
    assert out["2"].cost_of_sales == Decimal("40.4") and out["2"].realised == Decimal("5.6") and out["2"].held == 6
    assert out["3"].held == 0 and out["3"].cost_of_sales == Decimal("60.6") and out["3"].book_cost == 0
    assert out["4"].code == "short_sale"


def test_costs_and_ticks(spark):
    p = H.CostPolicy()
    r = spark.range(1).select(H.commission(F.lit(1000).cast("decimal(20,8)"), p), H.commission(F.lit(100_000).cast("decimal(20,8)"), p), H.commission(F.lit(0).cast("decimal(20,8)"), p), H.tick_round(F.lit("9.996").cast("decimal(20,6)"), F.lit("buy")), H.tick_round(F.lit("50.07").cast("decimal(20,6)"), F.lit("sell"))).first()
    assert [float(v) for v in r] == [20, 143, 0, 10.0, 50.0]


def test_parsing(spark):
    df = spark.createDataFrame([("113/01/05", "1,234.5", "tse:2330"), ("2024-1-5", "X12", "2330:otc"), ("x", "--", "a:b:c"), (None, None, None)], "d string, n string, k string")
    out = df.select(H.roc_date(F.col("d")), H.parse_number(F.col("n")), H.instrument_key(F.col("k"))).collect()
    assert out[0][0] == out[1][0] == dt.date(2024, 1, 5) and out[2][0] is None and out[3][0] is None
    assert [r[1] for r in out] == [1234.5, 12.0, None, None]
    assert tuple(out[0][2]) == ("tse", "2330") and tuple(out[1][2]) == ("otc", "2330") and out[2][2] is None


def test_price_views_by_hand(spark):
    df = bars(spark, 5, ("a",))
    acts = spark.createDataFrame([("a", "cash_dividend", DAYS[3], None, 10.2, "s", "1", 1), ("a", "stock_split", DAYS[2], 2.0, None, "s", "2", 1)], "instrument_id string, action_type string, ex_date date, ratio double, cash_amount double, source string, source_event_id string, revision int")
    out = {r.trade_date: r for r in actions.price_views(df, acts).collect()}
    assert out[DAYS[1]].split_factor == 0.5 and out[DAYS[2]].split_factor == 1.0
    assert out[DAYS[2]].cash_factor == pytest.approx((102 - 10.2) / 102) and out[DAYS[3]].cash_factor == 1.0


def test_fingerprint_and_versions(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "i int, s string")
    assert audit.fingerprint(a).first() == audit.fingerprint(b).first() != audit.fingerprint(a.distinct()).first()
    assert audit.fingerprint(a.limit(0)).first().rows == 0
    assert audit.require_version("a" * 64)
    with pytest.raises(ValueError):
        audit.require_version("latest")


def test_redact(spark):
    df = spark.sql("SELECT 'at /home/x/y.txt now' AS note, 's' AS my_token, named_struct('file_path', 'p', 'v', 1) AS s")
    assert audit.redact(df).first().asDict(True) == {"note": "at <path> now", "s": {"v": 1}}


def test_reconcile_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    assert {(r.k, r.detail) for r in audit.reconcile(a, b, ["k"], ["v"], "c").collect()} == {(2, "differs:v"), (3, "missing_remotely"), (4, "unknown_locally")}
    assert {(r.k, r.change, r.critical_change) for r in audit.table_diff(a, b, ["k"], ("v",)).collect()} == {(2, "changed", True), (3, "removed", False), (4, "added", False)}
    assert audit.metric_diff(spark.sql("SELECT 'r' AS id, 1.0D AS m"), spark.sql("SELECT 'r' AS id, 3.0D AS m"), "id").first().difference == 2.0


def test_targets(spark):
    df = spark.createDataFrame([(1, "a", 0.3), (1, "b", 0.2), (1, "c", None)], "decision_time int, instrument_id string, prediction double")
    hold = targets.build_targets(df, targets.TargetPolicy(k=3, short_list="hold_cash"))
    assert {r.reason for r in hold.collect()} == {"insufficient_candidates", "missing_prediction"}
    up = {r.instrument_id: r.weight for r in targets.build_targets(df, targets.TargetPolicy("threshold", t=0.25, cap=0.5)).collect()}
    assert up == {"a": 0.5, "b": 0.0, "c": 0.0}
    with pytest.raises(ValueError):
        targets.apply_coverage_policy(targets.build_targets(df.where("instrument_id = 'a'")), df, 0.8, on_fail="fail")
    first = targets.buy_and_hold(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "session int, instrument_id string")).collect()
    assert sum(r.weight for r in first) == pytest.approx(1) and len(first) == 3


def test_prediction_and_target_rules(spark):
    now = dt.datetime(2024, 1, 3)
    ledger = spark.createDataFrame([("a", now, "train", 1, now, now, 1.0), ("b", now, "test", 2, dt.datetime(2024, 1, 1), now, float("nan"))], "instrument_id string, decision_time timestamp, split_role string, fold_id int, fit_cutoff timestamp, available_at timestamp, prediction double")
    uni = spark.createDataFrame([("a", dt.date(2024, 1, 3), True)], "instrument_id string, trade_date date, eligible boolean")
    gone = spark.createDataFrame([("a", dt.date(2024, 1, 2))], "instrument_id string, delisting_date date")
    codes = {(r.instrument_id, r.code) for r in audit.prediction_violations(ledger, uni, gone).collect()}
    assert codes == {("a", "role_not_out_of_sample"), ("a", "fit_cutoff_not_before_decision"), ("b", "not_finite"), (None, "several_folds"), ("b", "outside_universe"), ("a", "delisted")}
    t = spark.createDataFrame([("a", 0.7, 1.0, dt.date(2024, 1, 4), now, now, True), ("b", 0.7, 0.0, dt.date(2024, 1, 5), now, now, False)], "instrument_id string, weight double, price double, session date, decision_time timestamp, available_at timestamp, eligible boolean")
    got = {(r.instrument_id, r.code) for r in audit.target_violations(t, "2024-01-04", "2024-01-04").collect()}
    assert got == {("b", "price_not_positive"), ("b", "wrong_session"), ("b", "not_eligible"), (None, "weights_above_one")}
    mixed = ledger.withColumn("experiment_id", F.col("instrument_id"))
    assert (None, "several_contracts") in {(r.instrument_id, r.code) for r in audit.prediction_violations(mixed, uni, gone).collect()}
    one = ledger.withColumn("experiment_id", F.lit(None).cast("string"))
    assert {(r.instrument_id, r.code) for r in audit.prediction_violations(one, uni, gone).collect()} == codes


def test_pretrade_rules(spark):
    orders = spark.createDataFrame([("p", "1", "a", "sell", 10, 100.0), ("p", "2", "b", "buy", 5, 100.0), ("p", "3", "c", "buy", 1, 100.0), ("p", "4", "a", "sell", 5, 100.0), ("q", "5", "a", "buy", 1, 1.0)], "portfolio string, order_id string, instrument_id string, side string, quantity long, price double")
    held = spark.createDataFrame([("p", "a", 14, 1400.0), ("p", "d", 4, 400.0)], "portfolio string, instrument_id string, held long, value double")
    accounts = spark.createDataFrame([("p", 1000.0, 530.0)], "portfolio string, nav double, cash double")
    flags = {r.order_id: r.flags for r in portfolio.pretrade_flags(orders, held, accounts, 0.35, 900.0, 0.9).collect()}
    # After order 1: 400 in a, 400 in d. Order 4 sells one share too many. Order 2: 500 and a fee of 20; order 3: 100 and 20 more.
    assert flags == {"1": ["notional_limit", "weight_limit"], "4": ["short_sale"], "2": ["weight_limit"], "3": ["insufficient_buying_power"], "5": ["valuation_missing"]}
    over = {r.order_id for r in portfolio.pretrade_flags(orders, held, accounts, 0.35, 900.0, 0.7).collect() if "gross_limit" in r.flags}
    # Gross after each order: 800, 300, 800 and 900 of 1,000.
    assert over == {"1", "2", "3"}


def test_target_limit_rules(spark):
    t = spark.createDataFrame([(1, "a", 0.5, 10.0, 100, 1000.0), (1, "b", 0.3, 10.0, 10, 1000.0), (2, "a", 0.1, 0.0, 100, 1000.0), (3, "a", 0.1, 10.0, None, 1000.0)], "decision_time int, instrument_id string, weight double, price double, volume long, nav double")
    p = spark.createDataFrame([(1, "a", 0.5, 50), (3, "a", 0.1, 10)], "decision_time int, instrument_id string, weight double, quantity int")
    got = {r.decision_time: (r.orders, r.over_volume, r.reasons) for r in portfolio.target_limits(t, p, max_single=0.6, min_cash=0.25, max_participation=0.5, max_orders=0).collect()}
    assert got == {1: (1, 1, "cash_buffer;volume_participation;order_count"), 2: (1, 1, "volume_participation;order_count"), 3: (0, 0, "")}


def test_scenarios_charge_each_fill(spark):
    fills = spark.createDataFrame([("daily", 1, "buy", 100, 10.0, 1000), ("daily", 1, "sell", 1000, 100.0, 1000)], "rebalance string, top_k int, side string, quantity long, price double, volume long")
    rows = {(r.slippage_bps, r.participation, r.commission_factor, r.rebalance, r.top_k): r for r in portfolio.scenario_costs(fills, portfolio.scenario_grid(spark)).collect()}
    assert len(rows) == len({r.scenario_id for r in rows.values()}) == 540
    # A tenth of the volume: 1,000 bought whole, 10,000 of 100,000 sold; two commissions of 20, tax of 30.
    r = rows[10.0, 0.1, 2.0, "daily", 1]
    assert (r.n_fills, r.unfilled, r.traded, r.costs) == (2, 1, 11_000.0, 2 * 40 + 30 + 11.0)
    assert rows[10.0, 0.1, 2.0, "weekly", 1].costs is None


def test_conformance_and_snapshot(spark):
    row = ("a", dt.date(2024, 1, 3), None, None, None, None, True, 1.0, None, True, 1.0, "healthy", None, None, dt.datetime(2024, 1, 3), True, False, 0.9, 0.8)
    df = spark.createDataFrame([row], "instrument_id string, session date, valid_from date, valid_to date, announced_at timestamp, decision_time timestamp, tradable boolean, limit_price double, limit_code string, market_open boolean, benchmark_level double, stream_status string, entitled_from date, entitled_to date, received_at timestamp, providers_agree boolean, used_fallback boolean, coverage double, minimum_coverage double")
    assert audit.conformance(df).first().codes == ["price_limit_without_code"]
    findings = spark.sql("SELECT 'error' AS severity")
    with pytest.raises(ValueError):
        universe.decision_snapshot(bars(spark, 2), findings, F.current_timestamp())
    assert universe.decision_snapshot(bars(spark, 2), findings.limit(0), F.lit("2024-01-01 12:00:00").cast("timestamp")).count() == 3


def test_normalize(spark):
    raw = spark.createDataFrame([("2024-01-02", "1111", 10, 5, 1.0, 2.0, 0.5, 1.5)], "date string, stock_id string, Trading_Volume long, Trading_money long, open double, max double, min double, close double")
    r = universe.normalize_prices(raw, "p").first()
    assert (r.high, r.low, r.volume, r.turnover, str(r.available_at)) == (2.0, 0.5, 10, 0, "2024-01-02 09:30:00") and len(r.checksum) == 64
    info = spark.createDataFrame([("2023-01-01", "Steel", "1111", "One", "twse"), ("2024-01-01", "Steel", "2222", "Two", "emerging"), ("2024-01-05", "Steel", "2222", "Two", "tpex")], "date string, industry_category string, stock_id string, stock_name string, type string")
    gone = spark.createDataFrame([("2024-02-01", "4444", "Four")], "date string, stock_id string, stock_name string")
    prices = spark.createDataFrame([("1111", dt.date(2023, 5, 1)), ("2222", dt.date(2024, 1, 1)), ("2222", dt.date(2024, 1, 8))], "instrument_id string, trade_date date")
    out = {r.instrument_id: r for r in universe.normalize_instruments(info, gone, prices).collect()}
    assert (out["1111"].market, out["2222"].market, out["4444"].market) == ("twse", "tpex", "unknown")
    assert out["2222"].listing_date == dt.date(2024, 1, 8) and out["4444"].name == "Four" and out["4444"].listing_date is None
    assert universe.normalize_calendar(raw.select("date")).first().status == "trading_day"
    ok = spark.sql("SELECT array() AS missing_fields, 5 AS latency_seconds, true AS entitled, true AS pit_complete, 0.9D AS coverage_ratio")
    assert universe.coverage_ok(ok, 0.8, 10).first().accepted and not universe.coverage_ok(ok, 0.95, 10).first().accepted


def test_signal_hysteresis(spark):
    rows = [("s", DAYS[i], float(v)) for i, v in enumerate([5, 6, 7, 8, 7, 6, 5, 4, 9])]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    assert [r.target for r in signals.breakout(df, 2, 2).orderBy("trade_date").collect()] == [0, 0, 1, 1, 1, 0, 0, 0, 1]


def test_benchmark_must_match(spark):
    r = spark.createDataFrame([("a", DAYS[1], 0.1)], "run_id string, trade_date date, ret double")
    levels = spark.createDataFrame([(DAYS[0], 1.0), (DAYS[1], 1.1), (DAYS[2], 1.2)], "trade_date date, level double")
    with pytest.raises(ValueError):
        portfolio.align_benchmark(r, levels)


OBS = "stream_id string, event_id long, sequence long, event_time timestamp, received_at timestamp"


def _arrivals():
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    return [("g", 1, 1, t(1), t(1)), ("g", 2, 3, t(2), t(2)), ("d", 1, 1, t(1), t(1)), ("d", 1, 1, t(1), t(2)), ("o", 1, 5, t(1), t(1)), ("o", 2, 4, t(2), t(2)), ("h", 1, 1, t(1), t(1)), ("h", 2, 2, t(50), t(50))]


def test_stream_health_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(_arrivals(), OBS)
    out = {r.stream_id: r.status for r in health.stream_health(df, F.lit("2024-01-01 00:01:00").cast("timestamp"), 30).collect()}
    assert out == {"g": "gap", "d": "duplicate", "o": "out_of_order", "h": "healthy"}
    assert health.stream_health(df, F.lit("2024-01-02").cast("timestamp"), 30).where("stream_id = 'h'").first().status == "stale"
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(OBS).parquet(str(tmp_path / "in"))
    q = health.stream_faults(live).writeStream.format("memory").queryName("faults_of").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream_id, r.fault) for r in spark.table("faults_of").where("fault is not null").collect()}
    assert got == {("g", "gap"), ("d", "duplicate"), ("o", "out_of_order")}


def test_streaming_dedup_and_alert_sink(spark, tmp_path):
    df = spark.createDataFrame(_arrivals(), OBS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = health.idempotent_ingest(spark.readStream.schema(OBS).parquet(str(tmp_path / "in")), ["stream_id", "event_id"])
    files.alert_sink(live, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 7


def test_alert_cooldown(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("x", t(0), False), ("x", t(10), False), ("x", t(70), False), ("x", t(80), True), ("x", t(90), False)], "fingerprint string, at timestamp, acknowledge boolean")
    assert [(r.decision, r.escalation) for r in health.dedup_alerts(df).orderBy("at").collect()] == [("raised", 1), ("suppressed", 1), ("raised", 2), ("acknowledged", 2), ("raised", 1)]


def test_provider_json_and_cached_bars(spark, tmp_path):
    row = {"date": "2024-01-02", "stock_id": "1111", "Trading_Volume": 5, "Trading_money": 6, "open": 1.0, "max": 2.0, "min": 0.5, "close": 1.5, "Trading_turnover": 1}
    for s in ("1111", "2222"):
        (tmp_path / f"Price__{s}.json").write_text(json.dumps({"status": 200, "msg": "ok", "data": [row | {"stock_id": s}, row | {"stock_id": s, "date": "2024-02-02"}]}, indent=1))
    assert {r.symbol for r in files.read_provider_json(spark, str(tmp_path / "*.json")).collect()} == {"1111", "2222"}
    out = files.read_cached_bars(spark, str(tmp_path), ["1111"], "2024-01-01", "2024-01-31").collect()
    assert [(r.instrument_id, r.close, str(r.available_at)) for r in out] == [("TWSE:1111", Decimal("1.5"), "2024-01-02 10:00:00")]


def test_csv_bars(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿日期,開盤價,最高價,最低價,收盤價,成交股數\n113/01/02,1,2,1,\"1,000\",\"5,000\"\n113/01/02,1,2,1,1.5,7\nbad,1,1,1,1,1\n113/01/03,0,1,1,1,1\n")
    good, bad = files.read_bars_csv(spark, str(tmp_path / "a.csv"))
    assert [(str(r.trade_date), r.close, r.volume) for r in good.collect()] == [("2024-01-02", 1.5, 7)]
    assert {r.reason for r in bad.collect()} == {"bad_date", "bad_price"}


def test_round_trips_of_files(spark, tmp_path):
    df = bars(spark, 3)
    files.write_panel(df.withColumn("y", F.year("trade_date")), str(tmp_path / "p"), ["y"])
    assert files.read_panel(spark, str(tmp_path / "p")).drop("y").exceptAll(df).count() == 0
    n = files.write_jsonl(df, str(tmp_path / "j"))
    assert n == 9 and files.read_jsonl(spark, str(tmp_path / "j"), "instrument_id string, close double", 9).count() == 9
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "j"), "instrument_id string", 8)
    rows, bad = files.read_typed(spark, "market", str(tmp_path / "j"))
    assert rows.count() == 9 and bad.count() == 0
    files.register_panel(df, "some_panel")
    assert spark.sql("SELECT count(*) AS n FROM some_panel").first().n == 9
    assert len(files.write_report(str(tmp_path / "r"), part=df)["part"]) == 9
    assert files.markdown_table(df.limit(1)).count("\n") == 2
    files.alert_sink(df, str(tmp_path / "alerts"))


def test_empty_tables(spark):
    none = bars(spark, 3).limit(0)
    assert features.compute_row_factors(none.withColumnRenamed("instrument_id", "symbol")).count() == 0
    assert universe.validate_daily_prices(none).count() == 0
    assert audit.violations(none, audit.bar_rules(), ["instrument_id"]).count() == 0


def test_scenario_outcomes_keep_failures_and_refuse_bad_grids(spark):
    # Bought at 10 and sold at 11, all of 100 shares at half of the volume, 50 at a quarter; plan 2 has no volume, plan 3 no fills.
    fills = spark.createDataFrame([("daily", 1, "buy", 100, 10.0, 200), ("daily", 1, "sell", 100, 11.0, 200), ("daily", 2, "buy", 100, 10.0, 0)], "rebalance string, top_k int, side string, quantity long, price double, volume long")
    rows = [(b, p, 1.0, "daily", k) for b in (0.0, 100.0) for p in (0.25, 0.5) for k in (1, 2, 3)]
    grid = spark.createDataFrame(rows, "slippage_bps double, participation double, commission_factor double, rebalance string, top_k int").withColumn("scenario_id", F.concat_ws("/", "slippage_bps", "participation", "top_k"))
    free = H.CostPolicy(rate="0", minimum="0", tax="0")
    out = portfolio.scenario_outcomes(fills, grid, 1000.0, free)
    got = {(r.slippage_bps, r.participation, r.top_k): r for r in out.collect()}
    assert len(got) == 12 and {(k[2], r.status, r.reason) for k, r in got.items()} == {(1, "completed", None), (2, "failed", "nothing_executed"), (3, "failed", "no_fills")}
    one = got[0.0, 0.5, 1]
    assert (one.total_return, one.turnover, one.slippage_cost, one.capacity) == (0.1, 2.1, 0.0, 1000.0)
    one = got[100.0, 0.25, 1]
    assert (one.total_return, one.turnover, one.slippage_cost, one.capacity) == pytest.approx((0.0395, 1.05, 10.5, 500.0))
    assert all(r.total_return is None and r.capacity is None for k, r in got.items() if k[2] > 1)
    again = portfolio.scenario_outcomes(fills.orderBy(F.desc("price")), grid.orderBy(F.desc("scenario_id")), 1000.0, free)
    assert {r.scenario_id: r.checksum for r in again.collect()} == {r.scenario_id: r.checksum for r in got.values()} and len({r.checksum for r in got.values()}) == 12
    with pytest.raises(ValueError, match="repeats"):
        portfolio.scenario_outcomes(fills, grid.unionByName(grid), 1000.0)
    with pytest.raises(ValueError, match="more than 11"):
        portfolio.scenario_outcomes(fills, grid, 1000.0, maximum=11)
    assert portfolio.scenario_outcomes(fills, grid, 1000.0, maximum=11, allow_large=True).count() == 12
