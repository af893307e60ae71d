"""Running sums of keys of any size, by a prefix scan on two levels, and ordered folds of arrays with every state kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], block: Column, sums: dict[str, str | Column], divided: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """The rows with running sums {new name: column} of their key, each row included, in the order of `order`.

    block: an expression that never falls along the order (a month of a day, a range of a sequence). Each block of a key is
    summed on its own, so a key with all rows is spread over as many tasks as it has blocks; the totals, a row a
    block, are summed before each block and lead its rows, so no join follows and the rows are shuffled once. `order` has to
    tell rows of one key apart. Nulls add nothing; before the first value the sum is null.
    divided: true for all rows of the keys that are worth blocks; the others stay whole and need no totals. of: rows of the same keys,
    blocks and sums, to take the totals from where `df` takes long to make."""
    split = lambda rows: rows.withColumn("_block", block if divided is None else F.when(divided, block))
    counted = split(df if of is None else of)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (counted if divided is None else counted.where(divided)).groupBy(*by, "_block").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    carried = totals.select(*by, "_block", F.lit(True).alias("_carried"), *(F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums))
    # Dealt before the sums' columns are made, so those are not shuffled.
    rows = split(df).unionByName(carried, allowMissingColumns=True).repartition(*by, "_block")
    inside = Window.partitionBy(*by, "_block").orderBy(F.asc_nulls_last("_carried"), *order).rowsBetween(Window.unboundedPreceding, 0)
    whole = {n: F.sum(F.when(F.col("_carried"), F.col(f"_{n}")).otherwise(F.col(c) if isinstance(c, str) else c)).over(inside) for n, c in sums.items()}
    return rows.select("_carried", *df.columns, *(c.alias(n) for n, c in whole.items())).where("_carried is null").drop("_carried")


def crowded(df: DataFrame, by: list[str], limit: int, buckets: int = 4096) -> tuple[Column, DataFrame]:
    """(a bucket of the key, the `_bucket`s with more than `limit` rows and four times the mean): all keys with so many rows are in these.

    Rows are counted by bucket, so a task gives a row a bucket at most, however many keys there are, and the buckets can be broadcast."""
    bucket = F.coalesce(F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"), F.lit(0))  # never null, so a join adds no filter of its own
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_rows"))
    mean = counts.agg((F.sum("_rows") / buckets).alias("_mean"))
    return bucket, counts.join(F.broadcast(mean)).where(F.col("_rows") > F.greatest(F.lit(float(limit)), 4 * F.col("_mean"))).select("_bucket", F.lit(True).alias("_crowded"))


def range_blocks(df: DataFrame, column: str, blocks: int = 64) -> Column:
    """A number from 0 to blocks - 1 that never falls as the column rises, null for null; a block for running_sums().

    Splitters are drawn from the 16 * blocks values of least hash, which alone come to the driver. They set how even the blocks
    are, never a result. The column may have any type that sorts; values between splitters are found by halving."""
    drawn = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(16 * blocks)
    seen = sorted({r[0] for r in drawn.collect()})
    at = sorted({seen[len(seen) * i // blocks] for i in range(1, blocks)}) if seen else []

    def halved(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < F.lit(at[mid]), halved(lo, mid)).otherwise(halved(mid + 1, hi))

    return F.when(F.col(column).isNotNull(), halved(0, len(at)))


def fold_in_blocks(rows: str, start: Column, step: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """An array of (r, s): each element of the array `rows` with the state after it; step(state, element) gives the next state.

    For folds whose next state needs the whole of the last one. Appending copies the array so far, so a block collects its own states
    first and the blocks are joined at the end: n * block copies in place of n * n."""
    size = F.size(rows)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    kept = lambda outs, one: F.concat(outs, F.array(one))

    def inner(s: Column, part: Column) -> Column:
        none = F.transform(F.slice(part, 1, 0), lambda r: F.struct(r.alias("r"), s.alias("s")))
        moved = lambda a, r: step(a["s"], r)
        return F.aggregate(part, F.struct(s.alias("s"), none.alias("o")), lambda a, r: F.transform(F.array(moved(a, r)), lambda n: F.struct(n.alias("s"), kept(a["o"], F.struct(r.alias("r"), n.alias("s"))).alias("o")))[0])

    first = F.transform(F.slice(rows, 1, 0), lambda r: F.struct(r.alias("r"), start.alias("s")))
    nothing = F.slice(F.array(first), 1, 0)
    blocks = F.aggregate(starts, F.struct(start.alias("s"), nothing.alias("o")), lambda a, i: F.transform(F.array(inner(a["s"], F.slice(rows, i + 1, block))), lambda b: F.struct(b["s"].alias("s"), kept(a["o"], b["o"]).alias("o")))[0])
    # An array of one block, as most are, is folded without the steps that join blocks.
    return F.when(size <= block, inner(start, F.col(rows))["o"]).otherwise(F.flatten(blocks["o"]))
