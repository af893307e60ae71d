"""Operator 2: byte-level BPE by overlapping chunks.

A text up to `chunk` characters is one chunk. Longer ones are cut into chunks that
overlap; each is pre-tokenised on its own, in parallel. The pattern never looks
back, so once two neighbouring chunks share a pre-token boundary in their overlap,
they agree from there on: that is where they are stitched. Then the pieces of each
chunk are encoded. A text in which some overlap has no common boundary is encoded
in one go. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import doc_back, doc_key, pieces_of, spread, tidied

#: Characters of a chunk, and by how many it reaches into the next.
CHUNK, OVERLAP = 16_384, 1_024

#: A match that ends this close to a chunk's end might go on or differ in the whole text.
UNSURE = 4

#: Pieces whose ids a worker remembers, and their longest; then it starts anew.
REMEMBERED, LONGEST = 50_000, 64


class Codec:
    """Encodes pieces by ranks and decodes ids."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.pattern = pattern
        self.split = regex.compile(pattern).findall
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.piece = self.library._encode_single_piece
        self.tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.tokens[i] = token
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. The library splits short texts itself; its
        matcher isn't made for very long ones."""
        if len(text) > 4 * CHUNK:
            return self.encode(self.split(text))
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[x] for x in pieces])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for x in pieces:
                if x not in known and len(x) <= LONGEST:
                    known[x] = np.array(self.piece(x), "<u4").tobytes()
            return b"".join([known[x] if x in known else np.array(self.piece(x), "<u4").tobytes() for x in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str, last: bool) -> list[int]:
        """Where pre-tokens of a chunk start or end, as far as they are sure to hold in the whole text."""
        ends = np.cumsum([len(x) for x in self.split(text)])
        return [0, *(ends if last else ends[ends <= len(text) - UNSURE]).tolist()]


def codec_of(shared: Broadcast, pattern: str) -> Codec:
    """The codec of a broadcast rank file; it is kept beside the broadcast, which a worker keeps from task to task."""
    if getattr(shared, "codec", None) is None or shared.codec.pattern != pattern:
        shared.codec = Codec(shared.value, pattern)
    return shared.codec


def shared_ranks(df: DataFrame, path: str) -> Broadcast:
    """The rank file (under 1 MB) for the tasks; it is read on the driver alone."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _per_text(make: Callable[[str], bytes], column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, column):
                at = part.schema.get_field_index(column)
                made = pa.array([make(x) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if i != at] + [made], names=[n for n in part.schema.names if n != column] + [out])

    return run


def _cut(chunk: int, overlap: int):
    """Chunk rows of long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                owner, number, last, piece = [], [], [], []
                for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
                    n = -(-len(text) // chunk)
                    owner += [i] * n
                    number += range(n)
                    last += [k == n - 1 for k in range(n)]
                    piece += [text[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]
                keys = part.select(["doc_id", "digest"]).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(number, pa.int32()), pa.array(last, pa.bool_()), pa.array(piece, pa.string())], names=["doc_id", "digest", "number", "last", "piece"])

    return run


def _ends(shared: Broadcast, pattern: str, chunk: int, overlap: int):
    """The boundaries of each chunk within the overlaps, counted from where its own and the next chunk begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for part in pieces_of(batch, "piece"):
                head, tail = [], []
                for text, last in zip(part.column(4).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ends = codec.boundaries(text, last)
                    head.append([x for x in ends if x <= overlap])
                    tail.append([x - chunk for x in ends if x >= chunk])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["doc_id", "digest", "number", "head", "tail"])

    return run


def _stitched(shared: Broadcast, pattern: str, chunk: int):
    """Ids of each chunk's pieces from its own stitch to the next chunk's; of a text that falls apart, the chunk's own characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        # The public pattern looks ahead in white space alone: before a boundary after another character, what follows is of no account.
        simple = pattern == public_tokenizers.PATTERN
        for batch in batches:
            for part in pieces_of(batch, "piece"):
                apart, start, stop, text = (part.column(part.schema.get_field_index(n)).to_pylist() for n in ("apart", "start", "stop", "piece"))
                made = []
                for whole, a, b, t in zip(apart, start, stop, text, strict=True):
                    if whole:
                        made.append(t[:chunk].encode())
                    elif b is None or (simple and chunk + b > a and not t[chunk + b - 1].isspace()):
                        made.append(codec.ids(t[a : None if b is None else chunk + b]))
                    else:
                        made.append(codec.encode(_until(codec.split(t[a:]), chunk + b - a)))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in ("doc_id", "digest", "number", "apart")] + [pa.array(made, pa.binary())], names=["doc_id", "digest", "number", "apart", "made"])

    return run


def _until(pieces: list[str], length: int) -> list[str]:
    """The first pieces, as many as have `length` characters together."""
    ends = np.cumsum([len(x) for x in pieces])
    return pieces[: int(np.searchsorted(ends, length)) + 1] if length else []


def _joined(shared: Broadcast, pattern: str):
    """The ids of each long text from what its chunks made, as often as the text came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(1)[i].as_py()
                whole = b"".join({x["number"]: x["made"] for x in sorted(parts, key=lambda x: x["number"])}.values())
                ids = codec.ids(whole.decode()) if parts[0]["apart"] else whole
                for _ in range(sum(x["number"] == 0 for x in parts)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids) of each text; ids is binary, little-endian unsigned 32-bit integers.

    docs: doc_id, text. path: a rank file. Each match of `pattern` is encoded separately, without special tokens.
    Null texts are empty and have no ids; null and repeated doc_ids and repeated rows come out as they came in;
    other columns are ignored.
    """
    shared = shared_ranks(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

    def whole(text: str) -> bytes:
        return codec_of(shared, pattern).ids(text)

    texts = docs.select(doc_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk).mapInArrow(tidied(_per_text(whole, "text", "ids")), "doc_id long, ids binary")
    long = texts.where(F.length("text") > chunk).select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    keys = ["doc_id", "digest", "number"]
    # The one shuffle of texts: chunks of long ones, spread over all tasks.
    chunks = long.mapInArrow(tidied(_cut(chunk, overlap)), "doc_id long, digest binary, number int, last boolean, piece string").repartition(spread(docs.sparkSession), *keys)
    ends = chunks.mapInArrow(tidied(_ends(shared, pattern, chunk, overlap)), "doc_id long, digest binary, number int, head array<int>, tail array<int>")
    # Equal rows have equal chunks; one of each is enough here.
    one = ends.groupBy(*keys).agg(F.first("head").alias("head"), F.first("tail").alias("tail"))
    sync = docs.sparkSession.sql("""
        SELECT doc_id, digest, number, start, lead(start) OVER w AS stop,
               count_if(start IS NULL) OVER (PARTITION BY doc_id, digest) > 0 AS apart
        FROM (SELECT doc_id, digest, number,
                     CASE WHEN number = 0 THEN 0 ELSE array_min(array_intersect(head, lag(tail) OVER w)) END AS start
              FROM {one} WINDOW w AS (PARTITION BY doc_id, digest ORDER BY number))
        WINDOW w AS (PARTITION BY doc_id, digest ORDER BY number)""", one=one)
    ready = chunks.join(sync, keys).select(*keys, "apart", "piece", "start", "stop")
    made = ready.mapInArrow(tidied(_stitched(shared, pattern, chunk)), "doc_id long, digest binary, number int, apart boolean, made binary")
    again = made.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("number", "apart", "made")).alias("parts")).select("doc_id", "parts").mapInArrow(tidied(_joined(shared, pattern)), "doc_id long, ids binary")
    return short.unionByName(again).select(doc_back().alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows with `decoded` (binary): the bytes of their ids, one after another. Null ids decode to nothing."""
    shared = shared_ranks(encoded, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for part in pieces_of(batch, "ids"):
                made = [codec.decode(x or b"") for x in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(tidied(run), f"{fields}, decoded binary")


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return df.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
