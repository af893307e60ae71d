"""Queries against their SQL on tables made from the smallest ones, where larger keys or more rows told them apart."""

import os

import pytest
from oracle import TABLES, duck, same
from pyspark.sql import functions as F

from tessera import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture
def folder(spark, tmp_path):
    """(tables to replace) -> a folder with them and the smallest tables."""

    def make(**changed):
        for name in TABLES:
            if name in changed:
                changed[name].toPandas().to_parquet(f"{tmp_path}/{name}.parquet", coerce_timestamps="us")
            else:
                os.symlink(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_quotes_of_parts_beyond_a_million(spark, folder):
    part = spark.read.parquet(f"{SF}/part.parquet")
    sf = folder(part=part.union(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)))
    assert same(QUERIES["decoded_quotes"](spark, sf), duck(sf), SQL["decoded_quotes"]) == ""


@pytest.mark.parametrize("name", ["price_findings", "issue_counts"])
def test_findings_do_not_build_the_bars_for_each_kind(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "events.parquet" not in plan


@pytest.mark.parametrize("name", ["linear_models", "experiment"])
def test_models_read_the_folds_once(spark, name):
    assert "events.parquet" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
