"""Operator 10: sharding with size-tiered compaction, in DataFrame functions alone.

Arrivals are appended as small immutable shards. Shards of similar size that lie
close together are merged into files near the target size. Each step writes new
files beside the old and commits a manifest of the next version in one rename, so
a reader sees one version or the next, and a failed step leaves the last in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import shared_folder

#: Documents of an arrival, bytes of text of a merged shard, and neighbours among which shards are merged.
ARRIVAL, TARGET, NEIGHBOURS = 500, 64 << 20, 256

#: Shards up to which a plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_SHARDS = 50_000


def _paths(spark: SparkSession):
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.Path, fs.FileContext, spark._jsc.hadoopConfiguration()


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    path, _, conf = _paths(spark)
    at = path(f"{root}/manifests")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version (the newest): shard, folder, version that wrote it, docs, bytes."""
    number = versions(spark, root)[-1] if version is None else version
    return spark.read.parquet(f"{root}/manifests/v{number:06d}")


def commit(spark: SparkSession, root: str, shards: DataFrame, version: int) -> None:
    """Make `shards` the manifest of a version; fails if another writer has committed it."""
    path, context, conf = _paths(spark)
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    shards.coalesce(1).write.parquet(staged)
    to = path(f"{root}/manifests/v{version:06d}")
    to.getFileSystem(conf).mkdirs(to.getParent())
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.getFileContext(to.toUri(), conf).rename(path(staged), to, none)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("shard").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


def append(docs: DataFrame, root: str, arrival: int = ARRIVAL) -> int:
    """Write arrivals (runs of `arrival` doc_ids) as shards beside those that are there; returns the new version.

    Rows stay in the task that read them; a null doc_id goes to shard -1. docs: doc_id, text and any other
    columns, but `shard`, which is replaced."""
    spark = docs.sparkSession
    done = versions(spark, root)
    version = (done[-1] if done else 0) + 1
    folder = f"{root}/data/{uuid.uuid4().hex}"
    dealt = docs.withColumn("shard", F.coalesce(F.floor(F.col("doc_id") / F.lit(arrival)).cast("long"), F.lit(-1)))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    new = _sizes(_read(spark, folder, docs)).select("shard", F.lit(folder).alias("folder"), F.lit(version).alias("version"), "docs", "bytes")
    commit(spark, root, manifest(spark, root).unionByName(new) if done else new, version)
    return version


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The rows of a folder of shards; an empty one has the schema of `like`."""
    schema = like.drop("shard").schema.add("shard", "long")
    return spark.read.schema(schema).parquet(folder)


def tier(size: Column) -> Column:
    """Sizes of a tier lie within a factor of four."""
    return F.floor((F.length(F.bin(F.greatest(size, F.lit(1)))) - 1) / 2).cast("int")


def plan(shards: DataFrame, target: int = TARGET, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(folder, shard, into, merged): which shards are merged, named after the first of each run.

    A run takes neighbours of one tier until it reaches the target; a run of one stays as it is. Runs never
    leave a range of `neighbours` shard numbers, so ranges are planned in parallel."""
    own = ("tier", F.floor(F.col("shard") / F.lit(neighbours)))
    order = Window.partitionBy(*own).orderBy("shard", "folder").rowsBetween(Window.unboundedPreceding, -1)
    runs = shards.withColumn("tier", tier(F.col("bytes"))).withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / F.lit(target)))
    whole = Window.partitionBy(*own, "run")
    counted = runs.withColumn("into", F.min("shard").over(whole)).withColumn("many", (F.count("*").over(whole) > 1) & (F.col("bytes") < target))
    return counted.select("folder", "shard", "into", F.col("many").alias("merged"))


def compact(spark: SparkSession, root: str, like: DataFrame, target: int = TARGET, neighbours: int = NEIGHBOURS) -> int:
    """Merge by plan() and commit the next version; returns it. like: a frame with the columns of the documents."""
    version = versions(spark, root)[-1] + 1
    now = manifest(spark, root)
    steps = plan(now, target, neighbours)
    to = next(name for i in range(len(like.columns) + 1) if (name := f"into_{i}") not in like.columns)
    moved = steps.where("merged").select("folder", "shard", F.col("into").alias(to))
    folder = f"{root}/data/{uuid.uuid4().hex}"
    count = moved.count()
    small = F.broadcast(moved) if count <= BROADCAST_SHARDS else moved
    for source in [r["folder"] for r in now.select("folder").distinct().collect()]:  # one for each step so far
        rows = _read(spark, source, like).join(small.where(F.col("folder") == source).drop("folder"), "shard")
        dealt = rows.drop("shard").withColumnRenamed(to, "shard").repartition("shard")
        dealt.write.mode("append").partitionBy("shard").option("compression", "zstd").parquet(folder)
    kept = now.join(steps.where("not merged").select("folder", "shard"), ["folder", "shard"], "left_semi").select("shard", "folder", "version", "docs", "bytes")
    if count:
        new = _sizes(_read(spark, folder, like)).select("shard", F.lit(folder).alias("folder"), F.lit(version).alias("version"), "docs", "bytes")
        kept = kept.unionByName(new)
    commit(spark, root, kept, version)
    return version


def read(spark: SparkSession, root: str, like: DataFrame, version: int | None = None) -> DataFrame:
    """The documents of a version (the newest), each with shard, shard_version, shard_docs and shard_bytes."""
    shards = manifest(spark, root, version)
    count = shards.count()
    out = None
    for source in [r["folder"] for r in shards.select("folder").distinct().collect()]:
        own = shards.where(F.col("folder") == source).select("shard", F.col("version").alias("shard_version"), F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
        rows = _read(spark, source, like).join(F.broadcast(own) if count <= BROADCAST_SHARDS else own, "shard")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else like.drop("shard").selectExpr("*", "0L shard", "0 shard_version", "0L shard_docs", "0L shard_bytes").limit(0)


def sharded(docs: DataFrame, arrival: int = ARRIVAL, target: int = TARGET, root: str | None = None) -> DataFrame:
    """(doc_id, shard, shard_version, shard_docs, shard_bytes) of each document after its arrival and one compaction.

    docs: doc_id, text and any others. Null texts have no bytes; repeated rows are stored as often; an empty table
    commits empty manifests and gives no rows."""
    spark = docs.sparkSession
    root = root or shared_folder(spark)
    append(docs, root, arrival)
    compact(spark, root, docs, target)
    return read(spark, root, docs).select("doc_id", "shard", "shard_version", "shard_docs", "shard_bytes")


#: The result of sharded() with its defaults.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT CAST(coalesce(floor(doc_id / {ARRIVAL}), -1) AS BIGINT) AS shard, count(*) AS docs, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes
  FROM documents GROUP BY 1),
tiers AS (SELECT *, (length(bin(greatest(bytes, 1))) - 1) // 2 AS tier, CAST(floor(shard / {NEIGHBOURS}) AS BIGINT) AS near FROM sized),
runs AS (
  SELECT *, floor(coalesce(sum(bytes) OVER (PARTITION BY tier, near ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {TARGET}) AS run
  FROM tiers),
named AS (
  SELECT *, min(shard) OVER (PARTITION BY tier, near, run) AS first_shard,
         count(*) OVER (PARTITION BY tier, near, run) > 1 AND bytes < {TARGET} AS merged
  FROM runs),
ended AS (SELECT *, CASE WHEN merged THEN first_shard ELSE shard END AS into_shard FROM named),
final AS (SELECT into_shard, merged, sum(docs) AS docs, sum(bytes) AS bytes FROM ended GROUP BY 1, 2)
SELECT d.doc_id, e.into_shard AS shard, CASE WHEN e.merged THEN 2 ELSE 1 END AS shard_version,
       CAST(f.docs AS BIGINT) AS shard_docs, CAST(f.bytes AS BIGINT) AS shard_bytes
FROM documents d
JOIN ended e ON CAST(coalesce(floor(d.doc_id / {ARRIVAL}), -1) AS BIGINT) = e.shard
JOIN final f ON f.into_shard = e.into_shard AND f.merged = e.merged
"""
