"""Panels stored in buckets of their entity, sorted by session, so that later windows and joins by entity read them without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings under which a plan uses the order of bucket files, and joins by (entity, session) the buckets of the entity alone.
SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_bucketed(df: DataFrame, path: str, by: str = "instrument_id", order: str = "trade_date", buckets: int = 64, name: str | None = None) -> str:
    """Write a table of one file a bucket at `path` and return its name. Tables that meet later need the same number of buckets.

    Entities are hashed to buckets as a shuffle would; choose `buckets` so that one is some hundred megabytes. The one shuffle is
    paid here. An entity is never split, so a hot one makes its bucket large: keep such a table unbucketed."""
    name = name or f"panel_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, order).option("path", path).format("parquet").saveAsTable(name)
    return name


@contextmanager
def bucket_settings(spark: SparkSession) -> Iterator[None]:
    """The settings while plans are made (a plan is made when it is first run or explained); what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
