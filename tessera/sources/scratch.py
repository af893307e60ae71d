"""A folder that driver and executors share, for files that a query writes and reads back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, in the application's own part of it, which goes when the application's JVM ends in
    order (not when it is killed). A session in one process may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        path = f"{(root or os.path.join(tempfile.gettempdir(), 'tessera-scratch')).rstrip('/')}/{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)  # it takes folders that are there
        _OWN[application] = path
    return f"{_OWN[application]}/{uuid.uuid4().hex}"
