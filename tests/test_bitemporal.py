"""Knowledge and effective time together, against a loop over decisions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import actions, bitemporal

START = dt.date(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def moment(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tables(seed):
    rng = random.Random(seed)
    bars = [(i, day(d), 50.0 + rng.randrange(100), 1000 + d) for i in ("a", "b", "c") for d in range(40) if rng.random() < 0.9]
    acts = []
    for e in range(25):
        kind = rng.choice(["stock_split", "cash_dividend", "reverse_split"])
        for r in rng.sample(range(1, 7), rng.randrange(1, 5)):  # revisions arrive in any order, some at one moment
            acts.append((rng.choice(["a", "b"]) if e % 5 else "a", "s", f"e{e}", r, None if rng.random() < 0.1 else moment(rng.randrange(-5, 40)), kind, None if rng.random() < 0.1 else day(rng.randrange(45)), rng.choice([0.5, 2.0, 3.0, None]), rng.choice([1.0, 2.5, None])))
    acts = [(("a" if int(x[2][1:]) % 3 else "b"), *x[1:]) for x in acts]  # an event is of one instrument
    asked = [(i, day(rng.randrange(45)), moment(rng.randrange(-8, 45)), n) for n in range(300) for i in rng.choice(["a", "b", "c"])]
    return bars, acts, asked + asked[:5]


ACTIONS = "instrument_id string, source string, source_event_id string, revision int, available_at timestamp, action_type string, ex_date date, ratio double, cash_amount double"


def by_loop(bars, acts, asked):
    out = []
    for i, d, t, n in asked:
        latest = {}
        for a in acts:
            if a[0] == i and a[4] is not None and a[4] <= t and a[3] > latest.get(a[2], (0, 0, 0, 0))[3]:
                latest[a[2]] = a
        split = cash = 1.0
        for a in latest.values():
            if a[6] is None or a[6] <= d:
                continue
            if a[5] in actions.SPLITS and a[7]:
                split /= a[7]
            before = [b for b in bars if b[0] == i and b[1] < a[6]]
            if a[5] == "cash_dividend" and a[8] is not None and before:
                close = max(before, key=lambda b: b[1])[2]
                cash *= (close - a[8]) / close
        out.append((n, split, cash))
    return sorted(out)


@pytest.mark.parametrize("salts", [1, 3])
def test_price_views_as_of_every_decision(spark, salts):
    bars, acts, asked = tables(4)
    made = bitemporal.price_views_as_of(
        spark.createDataFrame(asked, "instrument_id string, trade_date date, decision_time timestamp, n int").repartition(3),
        spark.createDataFrame(bars, "instrument_id string, trade_date date, close double, volume long"), spark.createDataFrame(acts, ACTIONS), salts)
    got = sorted((r.n, r.split_factor, r.cash_factor) for r in made.collect())
    want = by_loop(bars, acts, asked)
    assert len(got) == len(want)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-12) and math.isclose(a[2], b[2], rel_tol=1e-12) for a, b in zip(got, want, strict=True))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_decision_time_equals_price_views(spark):
    bars, acts, _ = tables(5)
    b = spark.createDataFrame([(i, d, c, c, c, c, v) for i, d, c, v in bars], "instrument_id string, trade_date date, open double, high double, low double, close double, volume long")
    a = spark.createDataFrame(acts, ACTIONS)
    at = F.lit("2024-01-20 00:00:00").cast("timestamp")
    want = {(r.instrument_id, r.trade_date): r for r in actions.price_views(b, a, at).collect()}
    got = bitemporal.price_views_as_of(b.select("instrument_id", "trade_date", at.alias("decision_time")), b, a).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.instrument_id, r.trade_date]
        assert math.isclose(r.split_close, w.split_close, rel_tol=1e-12) and math.isclose(r.total_return_close, w.total_return_close, rel_tol=1e-12) and r.split_volume == w.split_volume


def test_knowledge_intervals(spark):
    rows = [("k", 1, moment(1)), ("k", 3, moment(5)), ("k", 2, moment(7)), ("k", 4, moment(9)), ("k", 5, moment(9)), ("k", 6, None), ("l", 1, moment(2)), ("l", 1, moment(3))]
    got = bitemporal.knowledge_intervals(spark.createDataFrame(rows, "key string, revision int, available_at timestamp"), ["key"]).collect()
    assert sorted((r.key, r.revision, r.known_from, r.known_to or moment(99)) for r in got) == [("k", 1, moment(1), moment(5)), ("k", 3, moment(5), moment(9)), ("k", 5, moment(9), moment(99)), ("l", 1, moment(2), moment(99))]


def test_blocks_make_up_their_range(spark):
    pairs = [(a, b) for a in range(1, 40) for b in range(a + 1, 41)]
    made = spark.createDataFrame(pairs, "a long, b long").select("a", "b", bitemporal._blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in made:
        assert sorted(m for x in r.x for m in range(x.number << x.level, (x.number + 1) << x.level)) == list(range(r.a, r.b))


def test_empty_tables(spark):
    bars, acts, asked = tables(6)
    d = spark.createDataFrame(asked[:3], "instrument_id string, trade_date date, decision_time timestamp, n int")
    b = spark.createDataFrame(bars, "instrument_id string, trade_date date, close double, volume long")
    a = spark.createDataFrame(acts, ACTIONS)
    assert {(r.split_factor, r.cash_factor) for r in bitemporal.price_views_as_of(d, b, a.limit(0)).collect()} == {(1.0, 1.0)}
    assert bitemporal.price_views_as_of(d.limit(0), b, a).count() == 0
    assert bitemporal.price_views_as_of(d, b.limit(0), a).count() == 3
