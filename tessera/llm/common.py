"""Helpers shared by the operators: flat views of Arrow text, ids, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null doc_id inside the jobs; it sorts before every other id.
NULL_ID = -(1 << 63)

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers; equal values stay equal."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row begins. Null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces_of(batch: pa.RecordBatch, text: str, most: int = 1 << 19):
    """Slices of a batch with at most about `most` bytes of text each; one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield batch.slice(at)


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """A whole-number column as int64."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in the flat bytes, and the first word of each row (one more at the end)."""
    gap = IS_SPACE[data]
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[starts] = True
        first[1:] &= gap[:-1] | cut[1:-1]
        last[:-1] &= gap[1:] | cut[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


class Kept(dict):
    """What a worker remembers between batches. It travels empty, and as a plain value: executors need no copy of the package."""

    def __reduce__(self) -> tuple:
        return Kept, ()


_POWERS = Kept()


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64; at least `size` of each."""
    if len(_POWERS.get("power", ())) <= size:
        power = np.full(size + 1, _ODD, np.uint64)
        back = np.full(size + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
        power[0] = back[0] = 1
        _POWERS["power"], _POWERS["back"] = np.multiply.accumulate(power), np.multiply.accumulate(back)
    return _POWERS["power"], _POWERS["back"]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes."""
    power, back = _powers(1 << max(1, len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * _MIX)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours."""
    have, out = 1, values
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and several share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable) -> Callable:
    """A function over batches that gives its memory back when it is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def tidied_group(run: Callable) -> Callable:
    """The same for a function of one group's table."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        _give_back()
        return out

    return wrapped


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def doc_back(column: str = "doc_id") -> Column:
    """The reverse of doc_key."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the text; null is empty."""
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256))


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows in a struct `row` beside own columns, so that no column of the documents can clash with them."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session in one process may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or os.path.join(tempfile.gettempdir(), "tessera-checkpoints")).rstrip("/")


_OWN: dict[str, str] = {}


def _deleted_at_the_end(spark: SparkSession, path: str) -> None:
    """Delete an existing folder when the application's JVM ends in order (not when it is killed)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def shared_folder(spark: SparkSession) -> str:
    """A new path below the application's own part of the shared folder, which goes when the application ends."""
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
        _deleted_at_the_end(spark, path)
        _OWN[application] = path
    return f"{_OWN[application]}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read back from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    _deleted_at_the_end(df.sparkSession, context._jsc.sc().getCheckpointDir().get())  # Spark's folder of this application
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them from there. The files go when the application ends."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_keyed(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the one row of `table` of each key; `copies` of table tells how many of the `total` rows have the key.

    Keys of over a thousandth of the rows are under a thousand in number, so they are broadcast and their rows stay
    where they are; the others are joined by shuffle, and none of them makes a large task."""
    hot = F.col("copies") * 1000 > total
    common = F.broadcast(table.where(hot).drop("copies"))
    others = rows.join(common.select(key), key, "left_anti").join(table.where(~hot).drop("copies"), key)
    return rows.join(common, key).unionByName(others)


def spread(spark: SparkSession, least: int = 16) -> int:
    """How many ways to deal rows out: the session's shuffle partitions, `least` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
