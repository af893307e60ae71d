"""Bucketed panels: plans without Exchange and Sort, and the same rows as unbucketed ones."""

from pyspark.sql import Window, functions as F

from tessera.operators.bucketed import SETTINGS, bucket_settings, write_bucketed
from tessera.plans.inputs import event_bars

SF = "/root/testdata/sf0.001"


def test_windows_and_joins_read_buckets_without_exchange(spark, tmp_path):
    bars = event_bars(spark, SF)
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    features = lambda t: t.select("instrument_id", "trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("r"))
    joined = lambda t, u: features(t).join(u.select("instrument_id", "trade_date", "open"), ["instrument_id", "trade_date"])
    one, two = (spark.table(write_bucketed(bars, str(tmp_path / n), buckets=4)) for n in "ab")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucket_settings(spark):
            plan = features(one)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort" not in plan
            met = joined(one, two)
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
            got = sorted(map(tuple, met.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == sorted(map(tuple, joined(bars, bars).collect()))
    assert all(spark.conf.get(k) != v for k, v in SETTINGS.items())
