"""Observations as JSON and back."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.functions.observations import decode_observations, encode_observation


def test_round_trip_and_bad_texts(spark):
    day, at = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 10, 0, 0, 123000)
    df = spark.createDataFrame([(1, day, 0.1 + 0.2, at), (2, day, None, None), (3, None, 1.0, at)], "id int, day date, v double, at timestamp")
    made = df.select("id", encode_observation(F.col("day"), "close", F.col("v"), F.col("at")).alias("text"))
    texts = {r.id: r.text for r in made.collect()}
    assert texts[3] is None and list(json.loads(texts[2])) == ["available_at", "field", "trade_date", "value"] and json.loads(texts[2])["value"] is None
    bad = spark.createDataFrame([(4, texts[1][:-5]), (5, '{"field": "close"}'), (6, ""), (7, '{"trade_date": "no day", "field": "x"}'), (8, '{"trade_date": "2024-01-02", "field": "x", "value": "much"}')], "id int, text string")
    rows, rejects = decode_observations(made.unionByName(bad), "text")
    assert sorted((r.id, r.available_at, r.field, r.trade_date, r.value) for r in rows.collect()) == [(1, at, "close", day, 0.1 + 0.2), (2, None, "close", day, None)]
    assert sorted(r.id for r in rejects.collect()) == [4, 5, 6, 7, 8]
