"""Hash trees: whole against moved sums, and comparisons that open unequal ranges only."""

from pyspark.sql import functions as F

from tessera.operators import hashtree as T
from tessera.plans.inputs import table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_moved_sums_equal_a_whole_rehash(spark):
    orders = table(spark, SF, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    old, new, gone = orders.where("o_orderkey % 5 != 0"), orders.where("o_orderkey % 5 = 0"), orders.where("o_orderkey % 7 = 1 and o_orderkey % 5 != 0")
    made = T.merge_leaves(T.leaves(old, ["o_orderkey"]), T.leaves(new, ["o_orderkey"]), T.leaves(gone, ["o_orderkey"]))
    want = T.leaves(orders.join(gone, "o_orderkey", "left_anti"), ["o_orderkey"])
    assert rows_of(made.select(*want.columns)) == rows_of(want)
    assert T.merge_leaves(T.leaves(old, ["o_orderkey"]), removed=T.leaves(old, ["o_orderkey"])).count() == 0


def test_order_columns_and_repeats(spark):
    rows = [(1, "a", None), (2, "a:1", "b"), (2, "a:1", "b"), (3, None, "")]
    df = spark.createDataFrame(rows, "k int, x string, y string")
    root = lambda d: T.tree(T.leaves(d, ["k"])).where("depth = 0").first()
    assert root(df) == root(df.select("y", "k", "x").orderBy(F.desc("k"))) and root(df)["rows"] == 4
    assert root(df) != root(df.distinct()) and root(df) != root(df.where("k != 3").union(spark.createDataFrame([(3, "", None)], df.schema)))
    assert T.tree(T.leaves(df.limit(0), ["k"])).count() == 0


def test_comparison_reads_unequal_ranges_only(spark, tmp_path):
    left = table(spark, SF, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    some = left.orderBy("o_orderkey").limit(3).select("o_orderkey").collect()
    a, b, c = (r[0] for r in some)
    right = left.where(F.col("o_orderkey") != b).withColumn("o_custkey", F.when(F.col("o_orderkey") == a, -1).otherwise(F.col("o_custkey"))).unionByName(left.where(F.col("o_orderkey") == c).withColumn("o_orderkey", F.lit(-5).cast(left.schema["o_orderkey"].dataType)))
    for name, df in (("l", left), ("r", right)):
        T.write_ranges(df, ["o_orderkey"], str(tmp_path / name), 2)
    l, r = (spark.read.schema(left.schema.add("range", "string")).parquet(str(tmp_path / n)) for n in "lr")
    trees = [T.tree(T.leaves(d.drop("range"), ["o_orderkey"], 2), 2) for d in (l, r)]
    ranges = T.unequal_ranges(*trees, 2)
    assert 1 <= ranges.count() <= 3
    found = T.changed_rows(l, r, ranges, ["o_orderkey"])
    assert rows_of(found) == sorted([(a, "changed"), (b, "removed"), (-5, "added")])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("PartitionFilters: [range") == 2
    assert T.unequal_ranges(trees[0], trees[0], 2).count() == 0


def test_version_depends_on_every_part(spark):
    schema = spark.createDataFrame([(1, "a")], "k int, x string").schema
    ids = {T.version_id("r", schema), T.version_id("s", schema), T.version_id("r", schema, ("p",)), T.version_id("r", schema, (), {"a": 1}), T.version_id("r", spark.createDataFrame([(1,)], "k int").schema)}
    assert len(ids) == 5 and T.version_id("r", schema, ("p", "q")) == T.version_id("r", schema, ("q", "p"))
