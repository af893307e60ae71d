"""Running sums by blocks against one window a key."""

import random

from pyspark.sql import Window, functions as F

from tessera.operators.scan import range_blocks, running_sums


def test_blocks_give_the_sums_of_one_window(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, None if rng.random() < 0.2 else rng.randrange(-50, 50)) for i in range(2_000)]
    rows += [("late", i, None if i < 5 else 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
    order = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(map(str, df.withColumn("total", F.sum("v").over(order)).collect()))
    for size in (1, 7, 100, 10_000):
        assert sorted(map(str, running_sums(df, ["k"], ["i"], F.floor(F.col("i") / size), {"total": "v"}).collect())) == want


def test_a_hot_key_is_spread_over_its_blocks(spark):
    """Every window over rows is partitioned by block; only the one over block totals is by key alone."""
    df = spark.range(1000).selectExpr("if(id < 0, 'none', 'all') k", "id i", "id v")
    plan = running_sums(df, ["k"], ["i"], F.floor(F.col("i") / 10), {"total": "v"})._jdf.queryExecution().executedPlan().toString()
    specs = [line.rsplit("], [", 2)[1:] for line in plan.splitlines() if "Window [" in line]
    by_block = ["_block" in keys for keys, _ in specs]
    assert sorted(by_block) == [False, True]  # the rows, and the totals
    exchanged = [line for line in plan.splitlines() if "hashpartitioning(k#" in line]
    assert sum("_block" in line for line in exchanged) >= 2 and sum("_block" not in line for line in exchanged) == 1


def test_empty(spark):
    assert running_sums(spark.createDataFrame([], "k string, i long, v long"), ["k"], ["i"], F.col("i"), {"t": "v"}).columns == ["k", "i", "v", "t"]


def test_fold_keeps_every_state_at_any_block(spark):
    from tessera.operators.scan import fold_in_blocks

    df = spark.createDataFrame([(i, list(range(i))) for i in (0, 1, 2, 3, 7, 20)], "k int, r array<int>")
    for block in (1, 3, 512):
        out = df.select("k", F.transform(fold_in_blocks("r", F.lit(0), lambda s, r: s * 2 + r, block), lambda o: F.struct(o["r"], o["s"])).alias("o"))
        for row in out.collect():
            s, want = 0, []
            for r in range(row.k):
                s = s * 2 + r
                want.append((r, s))
            assert [tuple(o) for o in row.o] == want


def test_folds_stay_in_the_jvm(spark):
    from tessera import catalog

    for name in ("cost_basis", "alert_decisions"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "InPandas" not in plan


def test_ranges_never_fall_and_are_even(spark):
    df = spark.createDataFrame([(f"o{i:05d}",) for i in range(3_000)] + [(None,), ("\u00e9",), ("\U0001f600",)], "i string").repartition(4)
    rows = df.select("i", range_blocks(df, "i", 8).alias("b")).collect()
    known = sorted(((r.i, r.b) for r in rows if r.i is not None))
    assert [b for _, b in known] == sorted(b for _, b in known) and {r.b for r in rows if r.i is None} == {None}
    sizes = [sum(b == k for _, b in known) for k in range(8)]
    assert min(sizes) > 100 and max(sizes) < 900
    none = spark.createDataFrame([], "i string")
    assert none.select(range_blocks(none, "i").alias("b")).collect() == []


def test_orders_of_one_portfolio_are_judged_alike_at_any_number_of_blocks(spark):
    from tessera.operators import portfolio

    rng = random.Random(5)
    rows = [("p" if rng.random() < 0.9 else "q", f"{i:04d}", rng.choice("abcd"), rng.choice(["buy", "sell"]), rng.randrange(1, 30), None if rng.random() < 0.05 else rng.randrange(10, 99) / 2) for i in range(400)]
    orders = spark.createDataFrame(rows, "portfolio string, order_id string, instrument_id string, side string, quantity int, price double").repartition(3)
    held = spark.createDataFrame([("p", "a", 400, 9000.0), ("p", "b", 100, 100.0), ("q", "c", 90, 2000.0)], "portfolio string, instrument_id string, held long, value double")
    accounts = spark.createDataFrame([("p", 60_000.0, 30_000.0), ("q", 20_000.0, 3_000.0)], "portfolio string, nav double, cash double")
    runs = [{r.order_id: r.flags for r in portfolio.pretrade_flags(orders, held, accounts, 0.2, 900.0, 0.6, blocks=n).collect()} for n in (1, 3, 50)]
    assert len(runs[0]) == 400 and runs[0] == runs[1] == runs[2]
    # One by one: what was sold and paid before each order.
    stock, sold, paid = {("p", "a"): 400, ("p", "b"): 100, ("q", "c"): 90}, {}, {"p": 0, "q": 0}
    for p, i, instrument, side, quantity, price in sorted(rows, key=lambda r: (r[3] != "sell", r[1])):
        key = (p, instrument)
        if side == "sell":
            sold[key] = sold.get(key, 0) + quantity
            assert ("short_sale" in runs[0][i]) == (sold[key] > stock.get(key, 0))
        elif price is not None:
            paid[p] += quantity * price
            assert paid[p] <= {"p": 30_000, "q": 3_000}[p] or "insufficient_buying_power" in runs[0][i]


def test_no_window_holds_all_orders_of_a_portfolio(spark):
    from tessera.operators import portfolio

    orders = spark.range(500).selectExpr("'p' portfolio", "id order_id", "'a' instrument_id", "'buy' side", "1 quantity", "10.0D price")
    held = spark.createDataFrame([], "portfolio string, instrument_id string, held long, value double")
    accounts = spark.createDataFrame([("p", 100.0, 50.0)], "portfolio string, nav double, cash double")
    plan = portfolio.pretrade_flags(orders, held, accounts)._jdf.queryExecution().executedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line and "order_id" in line]
    assert len(over) == 2 and all("_block" in line.rsplit("], [", 2)[1] for line in over)


def test_pretrade_flags_of_repeated_ids_do_not_depend_on_storage(spark):
    """Orders of one id, of which the cash pays the one that comes first: the same in whatever order they are stored."""
    from tessera.operators import portfolio

    rows = [("p", "7", "b", "buy", 1, 100.0), ("p", "7", "b", "buy", 1, 200.0)]
    held = spark.createDataFrame([("p", "z", 0, 0.0)], "portfolio string, instrument_id string, held int, value double")
    accounts = spark.createDataFrame([("p", 1e6, 150.0)], "portfolio string, nav double, cash double")
    found = []
    for own in (rows, rows[::-1]):
        orders = spark.createDataFrame(own, "portfolio string, order_id string, instrument_id string, side string, quantity int, price double").coalesce(1)
        found.append(sorted(tuple(r.flags) for r in portfolio.pretrade_flags(orders, held, accounts).collect()))
    assert found[0] == found[1] == [(), ("insufficient_buying_power",)]


def test_orders_are_shuffled_once_for_each_sum(spark):
    """No join deals the orders anew, even where nothing is small enough to broadcast unasked."""
    from tessera import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: catalog.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("pretrade_flags", "running_notional")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, sums in (("pretrade_flags", 2), ("running_notional", 1)):
        assert "SortMergeJoin" not in plans[name] and "ShuffledHashJoin" not in plans[name]
        assert plans[name].count("REPARTITION_BY_COL") == sums


def test_undivided_keys_give_the_sums_of_divided_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), i, None if rng.random() < 0.2 else rng.randrange(-50, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(4)
    want = sorted(map(str, running_sums(df, ["k"], ["i"], F.lit(0), {"total": "v"}).collect()))
    for divided in (F.col("k") == "a", F.col("k").isNull(), F.lit(True), F.lit(False)):
        assert sorted(map(str, running_sums(df, ["k"], ["i"], F.floor(F.col("i") / 50), {"total": "v"}, divided, of=df.select("k", "i", "v")).collect())) == want


def test_crowded_buckets_hold_all_keys_of_many_rows(spark):
    from tessera.operators.scan import crowded

    df = spark.range(40_000).selectExpr("if(id % 4 = 0, 'hot', concat('k', id)) k", "if(id % 4 = 0, null, 1) j")
    bucket, many = crowded(df, ["k", "j"], 5_000, 512)
    met = df.withColumn("_bucket", bucket).join(many, "_bucket").groupBy("_crowded").agg(F.count_if(F.col("k") == "hot").alias("hot"), F.count("*").alias("n")).collect()
    assert [r.hot for r in met] == [10_000] and met[0].n < 11_000
    assert crowded(df, ["k", "j"], 20_000, 512)[1].count() == 0


def test_crowded_positions_are_judged_like_others(spark):
    from tessera.operators import portfolio

    rng = random.Random(6)
    rows = [("p" if rng.random() < 0.9 else rng.choice(["q", None]), f"{rng.randrange(250):04d}", rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["buy", "sell", "swap", None]), rng.choice([None, *range(1, 30)]), rng.choice([None, 0.0, *(x / 2 for x in range(10, 60))])) for _ in range(500)]
    orders = spark.createDataFrame(rows, "portfolio string, order_id string, instrument_id string, side string, quantity int, price double").repartition(3)
    held = spark.createDataFrame([("p", "a", 400, 9000.0), ("p", None, 70, 100.0), ("q", "c", None, None), (None, "b", 5, 10.0)], "portfolio string, instrument_id string, held int, value double")
    accounts = spark.createDataFrame([("p", 20_000.0, 30_000.0), (None, 1.0, 1.0)], "portfolio string, nav double, cash double")
    runs = [sorted((str(r.portfolio), r.order_id, tuple(r.flags)) for r in portfolio.pretrade_flags(orders, held, accounts, 0.2, 400.0, 0.3, blocks=n, crowd=c).collect()) for n, c in ((1, 100_000), (7, 100_000), (7, 0), (50, 100))]
    assert len(runs[0]) == 500 and all(r == runs[0] for r in runs)
    assert {f for *_, flags in runs[0] for f in flags} == {"valuation_missing", "short_sale", "notional_limit", "weight_limit", "gross_limit", "insufficient_buying_power"}


def test_equal_orders_keep_one_turn_in_both_sums(spark):
    """Of equal orders the first has cash and room, the second neither; no order has one without the other."""
    from tessera.operators import portfolio

    orders = spark.createDataFrame([("p", f"{i:03d}", f"x{i}", "buy", 1, 100.0) for i in range(50) for _ in range(2)], "portfolio string, order_id string, instrument_id string, side string, quantity int, price double")
    held = spark.createDataFrame([], "portfolio string, instrument_id string, held int, value double")
    accounts = spark.createDataFrame([("p", 1_000.0, 180.0)], "portfolio string, nav double, cash double")
    found = sorted((r.order_id, tuple(r.flags)) for r in portfolio.pretrade_flags(orders, held, accounts, 0.1, 900.0, 100.0).collect())
    assert found == sorted((f"{i:03d}", ("weight_limit",) * k + ("insufficient_buying_power",) * (i > 0 or k == 1)) for i in range(50) for k in (0, 1))
