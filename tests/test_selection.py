"""Exact quantiles against Spark's own percentile, to the bit."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.operators.selection import exact_quantiles

POINTS = {"lo": 0.01, "q": 0.25, "median": 0.5, "hi": 0.99, "end": 1.0, "start": 0.0}


def bits(rows):
    return {r[0]: [None if v is None else struct.pack(">d", v + 0.0) for v in r[1:]] for r in rows}


@pytest.fixture(scope="module")
def rows(spark):
    ids = spark.range(0, 6000, 1, 7)
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    # A hot group of a heavy tail, one of few values with ties, one of a single value, one small, one under a null key, one of nulls.
    heavy = ids.select(F.lit("hot").alias("g"), (F.exp(u * 40) - F.exp((1 - u) * 40)).alias("x"))
    ties = ids.select(F.lit("ties").alias("g"), F.floor(u * 5).cast("double").alias("x"))
    flat = ids.select(F.lit("flat").alias("g"), F.lit(3.5).alias("x"))
    small = ids.limit(4).select(F.lit("small").alias("g"), u.alias("x"))
    none = ids.limit(3).select(F.lit("none").alias("g"), F.lit(None).cast("double").alias("x"))
    keyless = ids.select(F.lit(None).cast("string").alias("g"), F.when(F.col("id") % 9 > 0, u).alias("x"))
    odd = ids.limit(50).select(F.lit("odd").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(math.nan)).when(F.col("id") % 3 == 1, F.lit(-math.inf)).otherwise(u).alias("x"))
    return selection.stored(heavy.union(ties).union(flat).union(small).union(none).union(keyless).union(odd))


def expected(rows):
    return bits(rows.groupBy("g").agg(*(F.percentile("x", F.lit(p)).alias(n) for n, p in POINTS.items())).collect())


@pytest.mark.parametrize("most", [100_000, 50])
def test_equals_percentile_to_the_bit(spark, rows, most):
    assert bits(exact_quantiles(rows, ["g"], "x", POINTS, most, written=True).collect()) == expected(rows)


def test_many_groups_are_joined_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(selection, "FEW_GROUPS", 0)
    assert bits(exact_quantiles(rows, ["g"], "x", POINTS, 200).collect()) == expected(rows)


def test_no_pass_is_needed_for_the_result(spark, rows):
    assert bits(exact_quantiles(rows, ["g"], "x", POINTS, 50, passes=0).collect()) == expected(rows)


def test_brackets_shrink_below_the_bound(spark, rows, monkeypatch):
    seen = []
    ranked = selection._ranked
    monkeypatch.setattr(selection, "_ranked", lambda kept, by, points: seen.append(kept) or ranked(kept, by, points))
    exact_quantiles(rows.where("g = 'hot'"), ["g"], "x", {"median": 0.5}, 200, written=True).collect()
    assert 2 <= seen[0].count() <= 200


def test_whole_table_and_empty_table(spark, rows):
    one = exact_quantiles(rows.where("g = 'hot'"), [], "x", {"m": 0.5}, 100).collect()
    assert [r.m for r in one] == [r.m for r in rows.where("g = 'hot'").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()]
    assert exact_quantiles(rows.limit(0), ["g"], "x", {"m": 0.5}).collect() == []


def test_grid_that_differs_at_each_evaluation(spark, rows, monkeypatch):
    # Sketches are merged in the order their blocks arrive over the network, so a grid evaluated again may have other lines.
    moved = F.udf(lambda lines: lines and sorted(x * random.SystemRandom().uniform(0.5, 2.0) for x in lines), "array<double>")
    sketch = F.percentile_approx
    monkeypatch.setattr(selection.F, "percentile_approx", lambda *given: moved(sketch(*given)))
    hot = rows.where("g = 'hot'")
    got = exact_quantiles(hot, ["g"], "x", POINTS, 200, passes=2, written=True).collect()
    assert bits(got) == expected(hot)
