"""Exact quantiles of groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.sources.scratch import scratch_folder

#: Values a group may have before it is narrowed, cells of the grid of a pass, groups that are broadcast, parts of a group beyond.
MOST, CELLS, FEW_GROUPS, SALTS = 100_000, 256, 10_000, 32


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the scratch folder and read back."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranks(p: float, n: Column) -> tuple[Column, Column, Column]:
    """The place p * (n - 1) and the whole ranks beside it, from 0."""
    place = (n - 1) * F.lit(float(p))
    return place, F.floor(place), F.ceil(place)


def _between(place: Column, low: Column, high: Column, a: Column, b: Column) -> Column:
    return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)


def _with_state(rows: DataFrame, state: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows with the state of their group, a row a group: broadcast if counted few, else a group is dealt to SALTS parts."""
    right = state.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), *(c for c in state.columns if c not in by))
    met = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    if few or not by:
        return rows.join(F.broadcast(right), met) if met else rows.crossJoin(F.broadcast(right))
    # Parts go by the partition that a row is read in, so that equal values are spread as well.
    left = rows.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    dealt = right.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(dealt, [*met, F.col("_s") == F.col("_t")])


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str], points: dict[str, float], few: bool) -> DataFrame:
    """State after a pass: a grid of approximate quantiles inside each bracket, then exact counts at two of its lines.

    The grid only proposes; a line is taken if the counts put both ranks on its inner side, so an ill grid costs a pass, not a result."""
    grid = [i / CELLS for i in range(CELLS + 1)]
    inside = lambda i: F.col("x").between(F.col(f"lo{i}"), F.col(f"hi{i}"))
    grids = _with_state(rows, state, by, few).groupBy(*by).agg(*(F.percentile_approx(F.when(inside(i), F.col("x")), grid, 10_000).alias(f"grid{i}") for i in range(len(points))))
    known = _with_state(grids, state, by, few)
    lines = []
    for i, p in enumerate(points.values()):
        _, low, high = _ranks(p, F.col("n"))
        share = lambda k, i=i: F.greatest(k - F.col(f"below{i}"), F.lit(0)) / (F.col(f"upto{i}") - F.col(f"below{i}")) * CELLS
        lines += [F.get(f"grid{i}", F.greatest(F.floor(share(low)).cast("int") - 1, F.lit(0))).alias(f"try_lo{i}"), F.get(f"grid{i}", F.least(F.ceil(share(high)).cast("int") + 1, F.lit(CELLS))).alias(f"try_hi{i}")]
    # Written once: sketches merged in another order propose other lines, and those kept must be those that were counted.
    tried = stored(known.select(*by, *(c for c in state.columns if c not in by), *lines))
    counts = [c for i in range(len(points)) for c in (F.count_if(F.col("x") < F.col(f"try_lo{i}")).alias(f"under{i}"), F.count_if(F.col("x") <= F.col(f"try_hi{i}")).alias(f"until{i}"))]
    counted = _with_state(_with_state(rows, tried, by, few).groupBy(*by).agg(*counts), tried, by, few)
    out = []
    for i, p in enumerate(points.values()):
        _, low, high = _ranks(p, F.col("n"))
        for ok, line, sum_, old, old_sum in ((F.col(f"under{i}") <= low, f"try_lo{i}", f"under{i}", f"lo{i}", f"below{i}"), (F.col(f"until{i}") > high, f"try_hi{i}", f"until{i}", f"hi{i}", f"upto{i}")):
            out += [F.when(ok, F.col(line)).otherwise(F.col(old)).alias(old), F.when(ok, F.col(sum_)).otherwise(F.col(old_sum)).alias(old_sum)]
    return counted.select(*by, "n", *out)


def exact_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], most: int = MOST, passes: int = 8, written: bool = False) -> DataFrame:
    """(by, one column a point): quantiles of the doubles in `value`, equal to `percentile` to the bit, where `percentile` keeps a whole group in one map.

    Groups of up to `most` values are ranked in one window. If one is larger, each pass narrows a bracket of every group and point about
    80 times, by mergeable sketches and exact counts, until brackets hold at most `most` values (or one value with its copies); only
    these are ranked. What is left after `passes` is ranked as it is, so results do not depend on the sketch. Nulls do not
    count; a group without values has nulls; NaN is above all. written: the input is a written table, else larger inputs are written once."""
    rows = df.select(*by, F.col(value).cast("double").alias("x"))
    counts = rows.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    size = counts.agg(F.max("n"), F.count("*")).first()
    if (size[0] or 0) <= most:
        return _ranked(rows.withColumn("point", F.lit(-1)), by, points)
    few = size[1] <= FEW_GROUPS
    rows = rows if written else stored(rows)
    state = stored(counts.select(*by, "n", *(c for i in range(len(points)) for c in (F.col("least").alias(f"lo{i}"), F.col("greatest").alias(f"hi{i}"), F.lit(0).cast("long").alias(f"below{i}"), F.col("n").alias(f"upto{i}")))))
    wide = lambda s: s.agg(*(F.max(F.when(~F.col(f"lo{i}").eqNullSafe(F.col(f"hi{i}")), F.col(f"upto{i}") - F.col(f"below{i}"))) for i in range(len(points)))).first()
    for _ in range(passes):
        if max(w or 0 for w in wide(state)) <= most:
            break
        state = stored(_narrowed(rows, state, by, points, few))
    inside = F.filter(F.array(*(F.when((F.col("n") == 0) | F.col("x").between(F.col(f"lo{i}"), F.col(f"hi{i}")), F.struct(F.lit(i).alias("point"), F.col("n").alias("n"), F.col(f"below{i}").alias("below"))) for i in range(len(points)))), lambda c: c.isNotNull())
    kept = _with_state(rows, state, by, few).select(*by, "x", F.explode(inside).alias("_c")).select(*by, "x", "_c.*")
    return _ranked(kept, by, points)


def _ranked(rows: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Quantiles from rows (by, point, x): all rows of a group as point -1, or the rows of each point's bracket with n and below."""
    given = "n" in rows.columns
    keys = [*by, "point", *(["n", "below"] if given else [])]
    values = rows.groupBy(*keys, "x").agg(F.count("x").alias("c"))
    own = Window.partitionBy(*by, "point")
    run = F.sum("c").over(own.orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto", run + F.col("below") if given else run)
    placed = placed if given else placed.withColumn("n", F.sum("c").over(own))
    at = lambda k: F.when((F.col("upto") - F.col("c") <= k) & (k < F.col("upto")), F.col("x"))
    found = []
    for i, p in enumerate(points.values()):
        _, low, high = _ranks(p, F.col("n"))
        own_point = (F.col("point") == i) | (F.col("point") == -1)
        found += [F.max(F.when(own_point, at(low))).alias(f"a{i}"), F.max(F.when(own_point, at(high))).alias(f"b{i}")]
    picked = placed.groupBy(*by).agg(F.max("n").alias("n"), *found)
    return picked.select(*by, *(_between(*_ranks(p, F.col("n")), F.col(f"a{i}"), F.col(f"b{i}")).alias(name) for i, (name, p) in enumerate(points.items())))
