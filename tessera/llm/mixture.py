"""Operator 8: mix sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. The cell weights are
raked to the targets of one axis after the other until all three agree; a document
is then kept with the probability that its cell's weight calls for.

Tokens are counted by a byte-pair vocabulary. Topics are learned: word counts are
hashed into a vector, weighted by how rare a dimension is, and clustered by k-means
over all documents; every document takes the topic of its nearest centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from tessera.llm.byte_bpe import codec_of, shared_ranks
from tessera.llm.common import carried, checkpointed, doc_key, flat_text, pieces_of, span_hashes, stored, tidied, words_of

AXES = ("source", "lang", "topic")

#: Topics, dimensions of hashed words, and rounds of k-means.
TOPICS, WIDTH, ROUNDS = 8, 256, 12

#: Cells up to which they are raked as one broadcast-size table on the driver's side of an aggregate; beyond, by joins.
SMALL_CELLS = 50_000


@dataclass(frozen=True)
class Topics:
    """Weights of the hashed dimensions and the centres of the topics, of length one."""

    weights: np.ndarray
    centres: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The nearest centre of each row of counts; the first of equals, so a text without words has topic 0."""
        return (weighted(counts, self.weights) @ self.centres.T).argmax(axis=1)


def word_counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the words of each dimension come in each row of flat text, and the words of each row."""
    rows = len(starts) - 1
    begin, end, first = words_of(data, starts)
    row = np.repeat(np.arange(rows), np.diff(first))
    kind = (span_hashes(data, begin, end) >> np.uint64(32)) % np.uint64(WIDTH)
    counts = np.bincount(row * WIDTH + kind.astype(np.int64), minlength=rows * WIDTH).reshape(rows, WIDTH)
    return counts, np.diff(first)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Damped counts times weights, as rows of length one (or zero)."""
    made = np.log1p(counts) * weights
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The counts in the first column of a batch, a row a document."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, WIDTH)


def fit_topics(vectors: DataFrame, seed: int = 5) -> Topics:
    """Weights and centres from all rows of a written table with `counts` (WIDTH little-endian unsigned 32-bit integers).

    Each round sums the vectors of each topic in the tasks; only sums (TOPICS x WIDTH numbers a task) come to the driver. Rounds start
    from rows that are unlike one another, among those of least hash; weights and every round take all rows."""
    vectors = vectors.select("counts")

    def summed(per_row, width: int) -> np.ndarray:
        """Sums of what per_row makes of counts (topics, values), over all tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((TOPICS, width))
            for batch in batches:
                if batch.num_rows:
                    topic, values = per_row(_rows(batch))
                    total += (topic == np.arange(TOPICS)[:, None]).astype(float) @ values
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TOPICS, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["topic", "sums"])

        out = np.zeros((TOPICS, width))
        for r in vectors.mapInArrow(tidied(run), "topic int, sums array<double>").collect():  # TOPICS rows a task
            out[r["topic"]] += r["sums"]
        return out

    one = np.ones(1)
    seen = summed(lambda c: (np.zeros(len(c), int), np.concatenate([c > 0, np.broadcast_to(one, (len(c), 1))], axis=1)), WIDTH + 1)[0]
    weights = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    first = [np.frombuffer(r["counts"], "<u4") for r in vectors.orderBy(F.xxhash64("counts", F.lit(seed)), "counts").limit(32 * TOPICS).collect()]
    centres = _spread_out(weighted(np.array(first).reshape(-1, WIDTH), weights))
    for _ in range(ROUNDS):
        model = Topics(weights, centres)
        sums = summed(lambda c, model=model: (model.of(c), weighted(c, weights)), WIDTH)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        if np.abs(now - centres).max() < 1e-4:
            break
        centres = now
    return Topics(weights, centres)


def _spread_out(vectors: np.ndarray) -> np.ndarray:
    """TOPICS vectors, each the one that is least like those before it; zeros if there are too few."""
    centres = np.zeros((TOPICS, vectors.shape[1]))
    if len(vectors):
        centres[0] = vectors[0]
        for k in range(1, min(TOPICS, len(vectors))):
            centres[k] = vectors[(vectors @ centres[:k].T).max(axis=1).argmin()]
    return centres


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with tokens (long) and counts (binary) for text. path: a rank file; tokens are those of its vocabulary."""
    shared: Broadcast = shared_ranks(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, public_tokenizers.PATTERN)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                counts, _ = word_counts(*flat_text(column))
                tokens = [len(codec.ids(x)) // 4 if x else 0 for x in column.to_pylist()]
                made = [pa.array(tokens, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in counts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in others), *made], names=[*(f.name for f in others), "tokens", "counts"])

    schema = StructType([*others]).add("tokens", LongType()).add("counts", BinaryType())
    return docs.mapInArrow(tidied(run), schema)


def annotated(vectors: DataFrame, name: str, topics: Topics) -> DataFrame:
    """Rows of counted() with a struct column (tokens long, topic int) for tokens and counts."""
    others = [f for f in vectors.schema.fields if f.name not in ("tokens", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pa.StructArray.from_arrays([batch.column(1), pa.array(topics.of(_rows(batch)).astype(np.int32))], names=["tokens", "topic"])
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], made], names=[*(f.name for f in others), name])

    schema = StructType([*others]).add(name, StructType().add("tokens", LongType()).add("topic", IntegerType()))
    return vectors.select("counts", "tokens", *(f.name for f in others)).mapInArrow(tidied(run), schema)


def cell_table(noted: DataFrame, name: str) -> DataFrame:
    """(source, lang, topic, tokens): a null source or language is the empty string."""
    return noted.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col(f"{name}.topic").alias("topic")).agg(F.sum(f"{name}.tokens").cast("double").alias("tokens")).where("tokens > 0")


def tempered(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """(axis, share): shares in proportion to the tokens of each value to a power (1: as found, 0: all equal)."""
    totals = cells.groupBy(axis).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("part"))
    return totals.crossJoin(totals.agg(F.sum("part").alias("whole"))).select(axis, (F.col("part") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """The cells with `weight`: shares whose sums over each axis meet the targets (axis, share).

    Values without a target keep no weight; targets without a cell are left out and the rest scaled to one. If the
    targets contradict one another (some cells are empty), the last axis is met exactly and the others as nearly as the
    sweeps allow. Up to SMALL_CELLS cells are raked as arrays; more by Spark, whose sweeps end in checkpoints, with only
    the largest deviation coming to the driver. Both ways give the same weights.
    """
    shares = {}
    for axis, target in targets.items():
        met = target.join(cells.select(axis).distinct(), axis)
        shares[axis] = met.crossJoin(met.agg(F.sum("share").alias("_sum"))).select(axis, (F.col("share") / F.col("_sum")).alias("share"))
    if cells.count() <= SMALL_CELLS:
        return _raked_arrays(cells, shares, sweeps, tolerance)
    return _raked_tables(cells, {axis: checkpointed(share) for axis, share in shares.items()}, sweeps, tolerance)


def _raked_arrays(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """The sweeps over a table of at most SMALL_CELLS rows, whose size the caller has counted."""
    rows = [tuple(r) for r in cells.select(*AXES, "tokens").collect()]
    goals, places = {}, {}
    for axis, share in shares.items():
        values = {r[0]: i for i, r in enumerate(sorted({(x[AXES.index(axis)],) for x in rows}))}
        goals[axis] = np.zeros(len(values))
        for r in share.collect():
            goals[axis][values[r[0]]] = r[1]
        places[axis] = np.array([values[x[AXES.index(axis)]] for x in rows], int)
    weight = np.array([x[3] for x in rows])
    for _ in range(sweeps if rows else 0):
        off = 0.0
        for axis, goal in goals.items():
            sums = np.bincount(places[axis], weight, len(goal))
            by = np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 0.0)
            weight = weight * by[places[axis]]
            off = max(off, float(np.abs(by[goal > 0] - 1).max(initial=0)))
        if off < tolerance:
            break
    fields = [cells.schema[a] for a in AXES]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", tokens double, weight double"
    return cells.sparkSession.createDataFrame([(*x, float(w)) for x, w in zip(rows, weight, strict=True) if w > 0], schema)


def _raked_tables(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    now = cells.withColumn("weight", F.col("tokens"))
    for _ in range(sweeps):
        for i, (axis, share) in enumerate(shares.items()):
            sums = now.groupBy(axis).agg(F.sum("weight").alias("_sum")).join(share, axis).select(axis, (F.col("share") / F.col("_sum")).alias("_by"))
            now = now.join(sums, axis).withColumn("weight", F.col("weight") * F.col("_by"))
            now = now.withColumn("_off", F.abs(F.col("_by") - 1)) if i == 0 else now.withColumn("_off", F.greatest("_off", F.abs(F.col("_by") - 1)))
            now = now.drop("_by")
        now = checkpointed(now.select(*AXES, "tokens", "weight", "_off"))
        if (now.agg(F.max("_off")).first()[0] or 0.0) < tolerance:
            break
    return now.drop("_off")


def with_probability(cells: DataFrame, keep: float) -> DataFrame:
    """The cells with `probability`: in proportion to weight over tokens, 1 at most, keeping a share `keep` of all tokens as expected."""
    ratio = F.col("weight") / F.col("tokens")
    whole, least, most = cells.agg(F.sum("tokens"), F.min(ratio), F.max(ratio)).first()
    if not whole or not most:
        return cells.withColumn("probability", F.lit(0.0))
    low, high = np.log(1e-12), np.log(1 / max(least, most * 1e-12))
    for _ in range(5):  # each round narrows the scale 32 times
        grid = np.linspace(low, high, 33) - 0.0
        kept = cells.agg(*(F.sum(F.least(F.lit(1.0), F.lit(float(np.exp(x))) * ratio) * F.col("tokens")) for x in grid)).first()
        over = next((i for i, v in enumerate(kept) if v >= keep * whole), 32)
        low, high = grid[max(0, over - 1)], grid[over]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(np.exp(high))) * ratio))


def drawn(doc_id, seed: int):
    """A number from 0 to 1 that depends on the document and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, powers: dict[str, float] | None = None, keep: float = 0.8, seed: int = 3, targets: dict[str, DataFrame] | None = None, path: str | None = None) -> DataFrame:
    """The rows with a struct column `mix`: tokens, topic, probability and kept.

    docs: doc_id, text, source, lang and any others. Targets are token shares of each axis: given as tables (axis, share),
    or tempered from the tokens found by `powers`. Topics are fitted on all documents.
    Nulls of source and language are one value of their own (the empty string); empty texts have no tokens and are kept with
    probability 1, as they weigh nothing; rows with equal doc_id share a draw; a column that is already called mix is replaced.
    Texts are tokenised once: tokens and word counts (a kilobyte a text before compression), then topics, are written to the shared
    folder, keyed by doc_id and the digest of the text.
    """
    kept = docs.drop("mix")
    digest = lambda: F.xxhash64(F.coalesce("text", F.lit("")))
    vectors = stored(counted(kept.select(doc_key().alias("_doc"), digest().alias("_text"), "source", "lang", "text"), path))
    noted = stored(annotated(vectors, "mix", fit_topics(vectors)))
    cells = checkpointed(cell_table(noted, "mix"))
    powers = powers or {"source": 0.7, "lang": 0.7, "topic": 0.5}
    fitted = checkpointed(with_probability(rake(cells, targets or {a: tempered(cells, a, powers[a]) for a in AXES}), keep))
    table = fitted.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), "probability")
    if fitted.count() <= SMALL_CELLS:
        table = F.broadcast(table)
    # What a text is made of depends on the text alone: one row for each text and id is joined back.
    own = noted.groupBy("_doc", "_text").agg(F.first("mix").alias("mix"))
    at = [F.coalesce("row.source", F.lit("")) == F.col("_s"), F.coalesce("row.lang", F.lit("")) == F.col("_l"), F.col("mix.topic") == F.col("_t")]
    chance = F.when(F.col("mix.tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("probability", F.lit(0.0)))
    made = carried(kept, _doc=doc_key(), _text=digest()).join(own, ["_doc", "_text"]).join(table, at, "left")
    return made.select("row.*", F.struct("mix.tokens", "mix.topic", chance.alias("probability"), (drawn(F.col("_doc"), seed) < chance).alias("kept")).alias("mix"))


def digest(df: DataFrame) -> DataFrame:
    """The query's columns."""
    return df.select("doc_id", "source", "lang", "mix.topic", "mix.tokens", "mix.probability", "mix.kept")
