"""Operator 13: periodic runs of words, by a difference cover and a harmonic grid.

A run of period p and of three periods or more covers two neighbouring points of the grid p, 2p, 3p, ...
and all between them, so every run shows at a pair (i, i + p) of some grid; the grids of all periods
have about n ln n pairs. Pairs whose words agree at a few fixed places are extended in both
directions by longest common extensions. For these only the suffixes at places in a difference cover are
sorted: any two places reach two places of the cover with one small step, so an extension compares
that many words and then asks a sparse table of common prefixes for the least between two ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import NULL_ID, Kept, doc_back, doc_key, ids_of, pieces_of, tidied

#: A perfect difference set. Each difference modulo 31 is one of two members, so six of 31 places are sorted.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)

#: Least words of a run, and least length in periods.
LEAST, TIMES = 24, 3

#: Texts of up to so many words share one table of grid pairs; pairs of longer texts are made as they go, so many at a time.
SHARED, TOGETHER = 4_096, 1 << 21

#: Longest runs of a text that are remembered, so that their multiples are passed over; this changes no result.
KNOWN = 16

_GRIDS = Kept()


class Extensions:
    """Longest common extensions of a word sequence: how many words agree from two places on."""

    def __init__(self, words: np.ndarray) -> None:
        n = self.n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.full(CYCLE + 1, -1)])  # no word is -1, so comparing stops at the end
        member = np.zeros(CYCLE, bool)
        member[list(COVER)] = True
        places = np.flatnonzero(member[np.arange(n) % CYCLE])
        self.step = self._steps(member)
        # Ranks by the first CYCLE words, then by twice as many until all differ. The place a cycle on is sampled as well.
        slot = np.full(n + CYCLE + 1, len(places), np.int64)
        slot[places] = np.arange(len(places))
        levels = []
        if len(places):
            columns = np.stack([self.words[places + k] for k in range(CYCLE)])
            order = np.lexsort(columns[::-1])
            new = (columns[:, order[1:]] != columns[:, order[:-1]]).any(axis=0)
            rank = np.empty(len(places), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(new)])
            reach = CYCLE
            while True:
                levels.append(np.append(rank, -1))
                if rank.max() == len(places) - 1:
                    break
                next_slot = np.where(places + reach < n, slot[np.minimum(places + reach, n)], len(places))
                second = levels[-1][next_slot]
                order = np.lexsort((second, rank))
                new = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
                rank = np.empty(len(places), np.int64)
                rank[order] = np.concatenate([[0], np.cumsum(new)])
                reach *= 2
        self.rank = np.full(n + 1, -1, np.int64)
        self.tables = [np.zeros(0, np.int64)]
        if len(places):
            self.rank[places] = rank
            sorted_places = places[np.argsort(rank)]
            self.tables = self._sparse(self._neighbours(sorted_places, levels, slot, n))

    @staticmethod
    def _steps(member: np.ndarray) -> np.ndarray:
        """The least step that takes two places, by their remainders, into the cover."""
        step = np.full((CYCLE, CYCLE), -1, np.int64)
        at = np.arange(CYCLE)
        for s in range(CYCLE - 1, -1, -1):
            both = member[(at[:, None] + s) % CYCLE] & member[(at[None, :] + s) % CYCLE]
            step[both] = s
        return step

    def _neighbours(self, places: np.ndarray, levels: list[np.ndarray], slot: np.ndarray, n: int) -> np.ndarray:
        """Common prefixes of neighbours in sorted order: by whole powers of the cycle, then word by word."""
        a, b = places[:-1].copy(), places[1:].copy()
        size = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            alike = inside & (levels[k][slot[np.minimum(a, n)]] == levels[k][slot[np.minimum(b, n)]])
            jump = np.where(alike, CYCLE << k, 0)
            a, b, size = a + jump, b + jump, size + jump
        return size + self._compared(a, b, np.full(len(a), CYCLE))

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree, up to `most`."""
        size = np.zeros(len(a), np.int64)
        going = np.flatnonzero((most > 0) & (np.maximum(a, b) < self.n))
        t = 0
        while len(going):
            going = going[self.words[a[going] + t] == self.words[b[going] + t]]
            t += 1
            size[going] = t
            going = going[most[going] > t]
        return size

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        """Least values of all windows whose width is a power of two."""
        tables, width = [values], 1
        while 2 * width <= len(values):
            tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
            width *= 2
        return tables

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on; a and b differ, and lie in [0, n]."""
        step = self.step[a % CYCLE, b % CYCLE]
        size = self._compared(a, b, step)
        far = np.flatnonzero((size == step) & (np.maximum(a, b) + step < self.n))
        if len(far):
            low, high = self.rank[a[far] + step[far]], self.rank[b[far] + step[far]]
            low, high = np.minimum(low, high), np.maximum(low, high)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level).tolist():
                own = np.flatnonzero(level == k)
                least[own] = np.minimum(self.tables[k][low[own]], self.tables[k][high[own] - (1 << k)])
            size[far] += least
        return size


def checked(period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words after its first grid point that a run holds for certain beside their partners a period on, and the length that takes."""
    sure = np.maximum(LEAST, TIMES * period) - 2 * period + 1
    return sure, sure + period


def _pairs(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods low <= p < high whose certain words lie inside n words."""
    period = np.arange(low, high)
    count = np.maximum(0, (n - checked(period)[1]) // period + 1)
    p = np.repeat(period, count)
    return (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p, p


def _shared_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all periods for SHARED words, by the words that they need."""
    if "grid" not in _GRIDS:
        i, p = _pairs(1, SHARED // TIMES + 1, SHARED)
        need = i + checked(p)[1]
        order = np.argsort(need, kind="stable")
        _GRIDS["grid"] = i[order], p[order], need[order]
    return _GRIDS["grid"]


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (grid point, period) of all periods of a run in n words, some at a time."""
    if n <= SHARED:
        i, p, need = _shared_grid()
        most = np.searchsorted(need, n, "right")
        yield i[:most], p[:most]
        return
    low, last = 1, n // TIMES + 1
    while low < last:
        high = min(last, low + max(1, TOGETHER * low // n))
        yield _pairs(low, high, n)
        low = high


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of word numbers, by start, then period."""
    n = len(words)
    words = words.astype(np.int64)
    ahead = behind = None
    found, known = [], []
    for i, p in _grids(n) if n >= LEAST else ():
        for part in range(4):  # places spread over what a run is certain to hold
            at = i + checked(p)[0] * part // 4
            same = words[at] == words[at + p]
            i, p = i[same], p[same]
            if not len(i):
                break
        for start, stop, q in known:  # a pair inside a run, at a multiple of its period, extends to that same run
            other = (p % q != 0) | (i < start) | (i + 2 * p > stop)
            i, p = i[other], p[other]
        if len(i):
            if ahead is None:
                ahead, behind = Extensions(words), Extensions(words[::-1])
            stop = i + p + ahead.common(i, i + p)
            start = i - behind.common(n - i - p, n - i)
            long = stop - start >= np.maximum(LEAST, TIMES * p)
            found.append(np.unique(np.stack([start, stop, p], axis=1)[long], axis=0))
            known = sorted([*known, *found[-1].tolist()], key=lambda r: r[0] - r[1])[:KNOWN]
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(rows):
        return rows
    # The same stretch under multiples of its smallest period counts once.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    start, stop, period = rows[first].T
    order = np.lexsort((period, start))
    return np.stack([start, stop - start, period], axis=1)[order]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def greatest(runs: list[list[int]]) -> list[int] | None:
    """The run with the most periods; of equals the first, then the one of the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def looped_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The edit of the registered query: every tenth document by the checksum of its id repeats the words from some place on.

    A null id has no checksum, so its document stays."""
    if doc_id == NULL_ID:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, edit: Callable[[int, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, best, collapsed) of each document.

    docs: doc_id, text. Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; a null text has none. A run is a stretch of
    max(24, 3 * period) words or more, whose words one period apart are identical, that no neighbouring word extends; period is
    the smallest such. runs are sorted by start, then period; best is the run with the most periods (ties: smallest start,
    then period; null without runs). collapsed: the words that no run holds after its first period, joined by one
    space. edit: a change of a document's words before the search. Nothing is shuffled; repeated rows, null and repeated
    ids come out as they came in; other columns are ignored.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                counts, runs, best, collapsed = [], [], [], []
                for doc, text in zip(ids_of(part).tolist(), part.column(1).to_pylist(), strict=True):
                    words = (text or b"").split()
                    if edit:
                        words = edit(doc, words)
                    numbers: dict[bytes, int] = {}
                    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    own = runs_of(coded)
                    if len(own):
                        keep = ~repeated(own, len(words))
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    own = own.tolist()
                    counts.append(len(coded))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    top = greatest(own)
                    best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    one = "struct<start:long,length:long,period:long>"
    rows = docs.select(doc_key().alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id long, n_words long, runs array<{one}>, best {one}, collapsed string").withColumn("doc_id", doc_back())


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))

    listed = F.array_join(F.transform("runs", line), "")
    best = {c: F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")}
    periods = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best.values(), periods, F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
