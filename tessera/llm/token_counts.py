"""Operator 9: token counts of documents by scanning flat, unindexed token files for separators.

A token file is one stream of ids, a separator after each document, cut into
blocks anywhere. Each block is searched on its own; a prefix scan over the blocks
of a file then tells where the document began that a block ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.byte_bpe import codec_of, shared_ranks
from tessera.llm.common import doc_back, doc_key, ids_of, pieces_of, stored, tidied

#: Tokens of a block, and the id after each document: the first that the rank file leaves free.
BLOCK, SEPARATOR = 1 << 18, 50256


def write_token_files(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(file, block, ids binary, docs array<long>): the documents of each input partition as one stream of 16-bit ids.

    Written once to the shared folder. `docs` names the documents that end in a block, in order; the ids
    themselves have no index. docs: doc_id, text; null texts are empty."""
    shared = shared_ranks(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = np.array([SEPARATOR], "<u2").tobytes()
    size = block * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file, number = codec_of(shared, public_tokenizers.PATTERN), TaskContext.get().partitionId(), 0
        stream, ended = bytearray(), []

        def block_row(ids: bytes, names: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.binary()), pa.array([names], pa.list_(pa.int64()))], names=["file", "block", "ids", "docs"])

        for batch in batches:
            for part in pieces_of(batch, "text"):
                for doc, text in zip(ids_of(part).tolist(), part.column(1).to_pylist(), strict=True):
                    stream += np.frombuffer(codec.ids(text or ""), "<u4").astype("<u2").tobytes()
                    while len(stream) >= size:  # the document goes on in the next block
                        yield block_row(bytes(stream[:size]), ended)
                        number, ended = number + 1, []
                        del stream[:size]
                    stream += end
                    ended.append(doc)
        if stream:
            yield block_row(bytes(stream), ended)

    return stored(docs.select(doc_key().alias("doc_id"), "text").mapInArrow(tidied(run), "file int, block int, ids binary, docs array<long>"))


def _ends(separator: int):
    """Of each block: its length and the places just after its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends = [], []
            for blob in batch.column(2):
                ids = np.frombuffer(blob.as_buffer() or b"", "<u2")
                lengths.append(len(ids))
                ends.append((np.flatnonzero(ids == separator) + 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(ends, pa.list_(pa.int64())), batch.column(3)], names=["file", "block", "length", "ends", "docs"])

    return run


def count_tokens(files: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, place, doc_id, n_tokens): tokens of each document of token files, separators left out.

    files: as write_token_files makes them. Documents may span any number of blocks. place counts the documents
    of a block; tokens after a file's last separator belong to no document."""
    found = files.select("file", "block", "ids", "docs").mapInArrow(tidied(_ends(separator)), "file int, block int, length long, ends array<long>, docs array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    last = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))
    carried = placed.withColumn("since", F.coalesce(F.max(last).over(before), F.lit(0).cast("long")))
    ends = F.transform("ends", lambda x: F.col("at") + x)
    starts = F.slice(F.concat(F.array("since"), ends), 1, F.size("ends"))
    sizes = F.transform(F.arrays_zip(ends.alias("stop"), starts.alias("start")), lambda x: x["stop"] - x["start"] - 1)
    rows = carried.where(F.size("ends") > 0).select("file", "block", F.posexplode(F.arrays_zip(sizes.alias("n_tokens"), F.col("docs").alias("doc_id"))).alias("place", "one"))
    return rows.select("file", "block", "place", doc_back("one.doc_id").alias("doc_id"), "one.n_tokens")


def token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of each document, by way of token files.

    docs: doc_id, text. Null and empty texts have no tokens; null and repeated doc_ids and repeated rows come out
    as they came in; other columns are ignored."""
    return count_tokens(write_token_files(docs, path, block)).select("doc_id", "n_tokens")
