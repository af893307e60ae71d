"""Hash trees of tables by range of key digests: appended and removed rows move sums, and a comparison reads unequal ranges only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

_WORDS = 4


def digest(*columns: str) -> Column:
    """sha256 of values as text, each with its length before it; null is `-`. Nested values are taken as JSON by the caller."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in columns)), 256)


def with_range(df: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """Rows with `range`, the first hex digits of the key's digest: 16^digits ranges, even ones whatever the keys."""
    return df.withColumn("range", F.substring(digest(*keys), 1, digits))


def leaves(df: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """(range, rows, w0..w3): of each range the rows and the sums of four 60-bit words of the row digests.

    Sums do not depend on order and are combined map-side, so a row that repeats 10^9 times is one entry a task. Columns are taken by
    name. A checksum against faults; it is no proof against rows made to collide."""
    rows = with_range(df.select(*sorted(df.columns)), keys, digits).select("range", digest(*sorted(df.columns)).alias("h"))
    word = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("range").agg(F.count("*").alias("rows"), *(F.sum(word(i)).cast("decimal(38,0)").alias(f"w{i}") for i in range(_WORDS)))


def merge_leaves(base: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Leaves of a table after rows came and went, from the leaves of those rows alone. Ranges without rows go."""
    minus = lambda df: df.select("range", *((-F.col(c)).alias(c) for c in df.columns if c != "range"))
    all_ = base
    for more in ([added] if added is not None else []) + ([minus(removed)] if removed is not None else []):
        all_ = all_.unionByName(more)
    sums = [F.sum("rows").alias("rows"), *(F.sum(f"w{i}").cast("decimal(38,0)").alias(f"w{i}") for i in range(_WORDS))]
    return all_.groupBy("range").agg(*sums).where(" or ".join(f"{c} != 0" for c in ("rows", *(f"w{i}" for i in range(_WORDS)))))


def tree(leaf: DataFrame, digits: int = 3) -> DataFrame:
    """(depth, range, rows, digest) of all nodes: a leaf's digest from its sums, a node's from at most 16 children. The root has depth 0; a table without rows has no node."""
    own = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *(F.col(f"w{i}").cast("string") for i in range(_WORDS))), 256)
    level = leaf.select("range", "rows", own.alias("digest"))
    out = level.select(F.lit(digits).alias("depth"), "range", "rows", "digest")
    for depth in range(digits - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.concat_ws(":", "range", "digest")))
        level = level.groupBy(F.substring("range", 1, depth).alias("up")).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(children, ","), 256).alias("digest")).withColumnRenamed("up", "range")
        out = out.unionByName(level.select(F.lit(depth).alias("depth"), "range", "rows", "digest"))
    return out


def unequal_ranges(left: DataFrame, right: DataFrame, digits: int = 3) -> DataFrame:
    """(range) of leaves that differ or that one side lacks. Level by level, only children of unequal nodes are compared."""
    up = None
    for depth in range(digits + 1):
        a, b = (t.where(F.col("depth") == depth).select("range", F.col("digest").alias(n)) for t, n in ((left, "_a"), (right, "_b")))
        if up is not None:
            a, b = (t.join(up, F.substring("range", 1, depth - 1) == F.col("_up"), "left_semi") for t in (a, b))
        found = a.join(b, "range", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("range")
        up = found.withColumnRenamed("range", "_up")
    return found


def write_ranges(df: DataFrame, keys: list[str], path: str, digits: int = 3) -> None:
    """Parquet with a folder a range, so that a comparison opens only the folders of unequal ranges."""
    with_range(df, keys, digits).repartition("range").write.partitionBy("range").parquet(path)


def changed_rows(left: DataFrame, right: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows added, removed or changed between two tables of `write_ranges`, reading the ranges given.

    There are at most 16^digits ranges, so they are listed on the driver and become a partition filter of both scans. Keys are unique and not null."""
    names = [r[0] for r in ranges.collect()]
    fields = [c for c in left.columns if c not in (*keys, "range")]
    a, b = (t.where(F.col("range").isin(names)).select(*keys, digest(*fields).alias(n)) for t, n in ((left, "_a"), (right, "_b")))
    both = a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*keys, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def version_id(root: str, schema: StructType, parents: tuple[str, ...] = (), config: dict | None = None) -> str:
    """The identity of a data set: its root digest, its fields, the versions that it was made from and the settings."""
    fields = sorted((f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields)
    return hashlib.sha256(json.dumps({"data": root, "schema": fields, "parents": sorted(parents), "config": config or {}}, sort_keys=True).encode()).hexdigest()
