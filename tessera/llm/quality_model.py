"""Operator 4: document quality by random Fourier features, ridge regression and isotonic calibration.

A document is a row of statistics of its text. Random cosines of the standardised
statistics approximate a Gaussian kernel. Each partition sums its part of the
normal equations, by fold; the sums solve the ridge scores. Scores of each fold
from the other folds are calibrated by pool-adjacent-violators over a fixed grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import IS_SPACE, doc_back, doc_key, flat_text, ids_of, pieces_of, span_hashes, tidied, tidied_group, words_of

#: Names of the statistics, in order.
STATISTICS = ("log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digit", "mark", "bang", "bar", "symbol", "line_ends", "high_bytes", "distinct_words", "distinct_lines", "top_capital_words", "long_words", "marked_words", "spaces", "entropy")

#: Cosines, penalty, folds, grid cells of the calibration, and the least score that counts as good.
COSINES, PENALTY, FOLDS, GRID, LEAST = 256, 1.0, 4, 1_000, 0.3

#: Tasks that sum the normal equations; each sends FOLDS matrices.
SUMMERS = 8

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    key = np.unique((row.astype(np.uint64) << np.uint64(42)) | (value >> np.uint64(22)))
    return np.bincount((key >> np.uint64(42)).astype(np.int64), minlength=rows)


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each row of flat text; an empty text has zeros. At most 2**22 rows at once."""
    rows = len(starts) - 1
    size = np.diff(starts)
    owner = np.repeat(np.arange(rows), size)
    begin, end, first = words_of(data, starts)
    word_row = np.repeat(np.arange(rows), np.diff(first))
    words, length = np.diff(first), (end - begin).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    share = lambda table: np.bincount(owner[table[data]], minlength=rows) * per_byte
    mean = np.bincount(word_row, length, rows) * per_word
    spread_ = np.sqrt(np.maximum(np.bincount(word_row, length**2, rows) * per_word - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    odd = np.concatenate([[0], np.cumsum(_SYMBOL[data] | (data == 33))])
    shouted = (upper[end] - upper[begin]) * 2 > end - begin
    marked = odd[end] > odd[begin]
    edge = np.unique(np.concatenate([starts[:-1][size > 0], np.flatnonzero(_LINE[data]) + 1]))
    edge = edge[edge < len(data)]
    line_row = owner[edge] if len(edge) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(data))
    lines = np.bincount(line_row, minlength=rows)
    counts = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256) * per_byte[:, None]
    entropy = -(counts * np.log(np.where(counts > 0, counts, 1))).sum(1)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, spread_, share(_UPPER), share(_DIGIT), share(_MARK),
        np.bincount(owner[data == 33], minlength=rows) * per_byte, np.bincount(owner[data == 124], minlength=rows) * per_byte,
        share(_SYMBOL), share(_LINE), np.bincount(owner[data > 127], minlength=rows) * per_byte,
        _distinct(word_row, span_hashes(data, begin, end), rows) * per_word,
        _distinct(line_row, span_hashes(data, edge, stop), rows) / np.maximum(lines, 1),
        np.bincount(word_row[shouted], minlength=rows) * per_word, np.bincount(word_row[length > 12], minlength=rows) * per_word,
        np.bincount(word_row[marked], minlength=rows) * per_word, share(IS_SPACE), entropy,
    ], axis=1)


@dataclass(frozen=True)
class Model:
    """Standardisation, cosines, weights (the last is the intercept), and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    seed: int

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = cosines(stats, self.mean, self.scale, self.seed) @ self.weights
        return np.interp(raw, self.knots, self.values)


def cosines(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a one for the intercept."""
    rng = np.random.default_rng(seed)
    width = stats.shape[1]
    slope = rng.normal(0, 1 / np.sqrt(width), (width, COSINES))
    shift = rng.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / COSINES) * np.cos(z @ slope + shift), np.ones((len(z), 1))], axis=1)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces_of(batch, "text"):
            found = statistics(*flat_text(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "stats"])


def _sums(mean: np.ndarray, scale: np.ndarray, seed: int):
    """A partition's part of the normal equations, by fold, a row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                stats = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                z = cosines(stats, mean, scale, seed)
                both = np.concatenate([z, part.column(1).to_numpy()[:, None].astype(float)], axis=1)
                fold = part.column(0).to_numpy()
                for f in np.unique(fold).tolist():
                    total[f] = total.get(f, 0) + z[fold == f].T @ both[fold == f]
        for f, rows in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), f, np.int32)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["fold", "line", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.array(x) for x in table["sums"].to_pylist()], axis=0)
    return pa.table({"fold": table["fold"].slice(0, 1), "line": table["line"].slice(0, 1), "sums": pa.array([total.tolist()])})


def isotonic(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest rising shares of `good` in `total`."""
    pools: list[list[float]] = []
    for n, g in zip(total.tolist(), good.tolist(), strict=True):
        pools.append([n, g, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, g2, c2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + g2, pools[-1][2] + c2]
    return np.concatenate([np.full(int(c), g / n) for n, g, c in pools])


def train(docs: DataFrame, labels: DataFrame, most: int = 1_000_000, seed: int = 11) -> Model:
    """Fit on labelled documents outside the held-out fifth.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; others are left out). most: about so many labelled rows
    are used, chosen by a hash of doc_id; with fewer, all are. Without labels every score is 0.5. The driver
    gets sums whose size depends on COSINES, FOLDS and GRID alone.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("good")).withColumn("rest", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).where("rest != 0")
    count = marks.count()
    if count > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * most / count))
    # Statistics are far smaller than texts, so they are what is joined to the labels.
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_statistics_of), "doc_id long, stats array<double>")
    stats = known.join(marks, "doc_id").select((F.col("rest") - 1).cast("int").alias("fold"), "good", "stats").persist()
    try:
        moments = {r["pos"]: (r["mean"], r["sd"]) for r in stats.select(F.posexplode("stats").alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).collect()}
        if not moments:
            return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(COSINES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]), seed)
        mean = np.array([moments[i][0] for i in range(len(STATISTICS))])
        scale = np.array([moments[i][1] if moments[i][1] > 1e-9 else 1.0 for i in range(len(STATISTICS))])
        sums = stats.coalesce(SUMMERS).mapInArrow(tidied(_sums(mean, scale, seed)), "fold int, line int, sums array<double>").groupBy("fold", "line").applyInArrow(tidied_group(_added), "fold int, line int, sums array<double>").collect()
        parts = np.zeros((FOLDS, COSINES + 1, COSINES + 2))
        for r in sums:
            parts[r["fold"], r["line"]] = r["sums"]
        penalty = np.diag([PENALTY] * COSINES + [1e-6])
        solve = lambda s: np.linalg.solve(s[:, :-1] + penalty, s[:, -1])
        whole = parts.sum(axis=0)
        others = np.stack([solve(whole - parts[f]) for f in range(FOLDS)])

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = cosines(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), mean, scale, seed)
                    raw = (z * others[batch.column(0).to_numpy()]).sum(axis=1)
                    cell = np.clip(np.floor((raw + 0.5) / 2 * GRID), 0, GRID - 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "good"])

        cells = sorted(tuple(r) for r in stats.mapInArrow(tidied(binned), "cell int, good int").groupBy("cell").agg(F.count("*"), F.sum("good")).collect())
    finally:
        stats.unpersist()
    at = np.array([c for c, _, _ in cells])
    values = isotonic(np.array([n for _, n, _ in cells], float), np.array([g for _, _, g in cells], float))
    return Model(mean, scale, solve(whole), (at + 0.5) / GRID * 2 - 0.5, values, seed)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    docs: doc_id, text. held_out: crc32 of doc_id as text is divisible by 5 (a null doc_id is not held out).
    Null texts are empty; repeated rows come out as often; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(part)), pa.array(model.score(statistics(*flat_text(part.column(1)))))], names=["doc_id", "score"])

    found = docs.select(doc_key().alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double").withColumn("doc_id", doc_back())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents predicted good; all columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                score = model.score(statistics(*flat_text(part.column(part.schema.get_field_index("text")))))
                yield part.filter(pa.array(score >= LEAST))

    return docs.mapInArrow(tidied(run), docs.schema)
