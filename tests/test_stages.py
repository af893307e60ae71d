"""Fitted transforms as ml stages: fit, save, load and transform give what the operators give."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import mlpanel
from tessera.operators.stages import FoldPreprocessor, RobustScaler


@pytest.fixture(scope="module")
def long(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007
    return spark.range(300).select("id", F.expr("date'2024-01-01' + cast(id % 20 as int)").alias("decision_date"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("flat").alias("feature_name"), F.when(F.col("id") % 3 == 2, 1.0).otherwise(u).alias("value")).where("id != 7").unionByName(spark.sql("select 1000L id, date'2024-01-03' decision_date, 'a' feature_name, cast(null as double) value"))


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_robust_scaler_saved_and_loaded(spark, long, tmp_path):
    made = Pipeline(stages=[RobustScaler(start="2024-01-01", end="2024-01-10")]).fit(long)
    want = mlpanel.apply_robust(long, mlpanel.fit_robust(long, "2024-01-01", "2024-01-10"))
    made.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert rows_of(made.transform(long)) == rows_of(again.transform(long)) == rows_of(want)
    assert {r[0] for r in again.transform(long).select("feature_name").distinct().collect()} == {"a", "b"}
    RobustScaler(start="2024-01-01", end="2024-01-02", byCol="g").save(str(tmp_path / "e"))
    assert RobustScaler.load(str(tmp_path / "e")).getOrDefault("byCol") == "g"


def test_fold_preprocessor_saved_and_loaded(spark, long, tmp_path):
    folds = long.select("id", (F.col("id") % 2).cast("int").alias("fold_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("role"), (F.col("id") % 11 == 0).alias("purged"), F.array("value", F.when(F.col("id") % 4 > 0, F.col("id") * 1.5), F.lit(None).cast("double")).alias("feature_vector"))
    model = FoldPreprocessor(lower=0.05, upper=0.95).fit(folds)
    want = mlpanel.apply_preprocessor(folds, mlpanel.fit_fold_preprocessor(folds.where("role = 'train' and not purged"), 0.05, 0.95))
    model.save(str(tmp_path / "f"))
    assert rows_of(type(model).load(str(tmp_path / "f")).transform(folds)) == rows_of(model.transform(folds))
    # A second fit sums in another order, so its last digits are its own.
    close = lambda df: {r.id: None if r.x is None else [v if v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for v in r.x] for r in df.collect()}
    assert {r.id: r.x for r in model.transform(folds).collect()} == close(want)


def test_a_model_refuses_a_table_that_is_not_small(spark, long):
    with pytest.raises(ValueError):
        RobustScaler(start="2024-01-01", end="2024-01-10", most=1).fit(long)
