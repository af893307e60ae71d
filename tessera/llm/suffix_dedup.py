"""Operator 5: remove bytes that repeat an earlier document, by suffix-array intervals.

Segments that may recur (see repeats.py) are sorted, in blocks of whole keys, into a
suffix order and its Burrows-Wheeler transform. Breadth-first backward extension then
derives the common-prefix values by increasing value and stops at the minimum length:
positions without a value by then share at least that many bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import doc_back, flat_text
from tessera.llm.repeats import Cut, Verdicts, Windows, _low, _member, cut_segments, judged, opened, segment_bytes, single_windows

#: Values that are read off the sorted order before backward extension takes over; its first intervals are the longest.
SEEDED = 6


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` symbols, at least; ties in any order.

    Sort keys carry their position in the low bits, so that values are sorted and not indices."""
    n = len(symbols)
    wide = max(1, n.bit_length())
    code = np.cumsum(np.bincount(symbols) > 0) - 1
    bits = max(1, int(code[-1]).bit_length())
    have = max(1, min(depth, (64 - wide) // bits))
    dense = np.concatenate([code[symbols].astype(np.uint64), np.zeros(have, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = (key << np.uint64(bits)) | dense[i : i + n]
    own, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << wide) - 1)
    packs = wide + have * bits <= 64
    while True:
        if packs:
            key = (key << np.uint64(wide)) | own
            key.sort()
            order = (key & mask).astype(np.int64)
            key >>= np.uint64(wide)
        else:  # over two million symbols: only if a single key has so many
            order = np.argsort(key)
            key = key[order]
        if have >= depth:
            return order
        fresh = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        packs = 3 * wide <= 64
        many = (64 - wide) // wide if packs else 2
        key = rank.copy()
        for j in range(1, many):
            key <<= np.uint64(wide)
            if j * have < n:
                key[: n - j * have] |= rank[j * have :]
        have *= many


def _starts(left: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Where the interval before each new boundary starts; left: each boundary's own place, else 0.

    Few boundaries look back step by step (late intervals are short); many, or long ones, take a scan."""
    low = new - 1
    if len(new) * 16 < len(left):
        open_ = np.flatnonzero((left[low] != low) & (low > 0))
        for _ in range(64):
            if not len(open_):
                return low
            low[open_] -= 1
            at = low[open_]
            open_ = open_[(left[at] != at) & (at > 0)]
    return np.maximum.accumulate(left)[new - 1]


def bounded_prefix_lengths(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the order, the common-prefix length with the place before, if below `least`; else -1.

    Beyond the first few, values come from the transform alone, by increasing value: where two neighbours in the
    occurrence list of one symbol are first parted by a boundary of value v, their images are parted by value v + 1.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the text is read as a ring
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    image = np.empty(n, np.int32)
    image[by_symbol] = np.arange(n, dtype=np.int32)
    following = np.full(n, -1, np.int32)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    lengths = np.full(n, -1, np.int8 if least < 128 else np.int32)
    seeded = min(SEEDED, least)
    ring = np.concatenate([symbols, np.resize(symbols, seeded)])
    lengths[0], alike = 0, np.ones(n - 1, bool)
    for value in range(seeded):
        now = ring[order + value]
        parted = alike & (now[1:] != now[:-1])
        lengths[1:][parted] = value
        alike &= ~parted
    new = np.flatnonzero(lengths == seeded - 1).astype(np.int32)
    left, turn = np.zeros(n, np.int32), np.empty(n, np.int32)
    known = np.flatnonzero(lengths >= 0).astype(np.int32)
    left[known] = known
    for value in range(seeded, least):
        left[new] = new
        new = new[new > 0]
        low = _starts(left, new)
        size = new - low
        edge = np.repeat(new, size)
        place = np.arange(len(edge), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        parted = following[place]
        target = image[place[parted >= edge]] + 1
        target = target[lengths[target] < 0]
        turn[target] = np.arange(len(target), dtype=np.int32)
        new = target[turn[target] == np.arange(len(target), dtype=np.int32)]
        if not len(new):
            break
        lengths[new] = value
    return lengths


def earliest_owner(segments: list[bytes], least_doc: np.ndarray, times: np.ndarray, length: int) -> Iterator[tuple[int, bytes]]:
    """For each segment with a window that recurs, its runs of windows as int64 pairs (first byte + end byte * 2**32, smallest document that has the window)."""
    sizes = np.array([len(x) for x in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = flat.astype(np.uint16) + 1
    symbols[starts[1:] - 1] = 0
    order = suffix_order(symbols, length)
    bound = bounded_prefix_lengths(symbols, order, length) >= 0
    bound[0] = True
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes + 1)
    window = np.arange(len(symbols)) <= (starts[1:] - 1 - length)[owner]
    doc = np.where(window, least_doc[owner], np.iinfo(np.int64).max)[order]
    edges = np.flatnonzero(bound)
    group = np.cumsum(bound, dtype=np.int32) - 1
    smallest = np.empty(len(symbols), np.int64)
    smallest[order] = np.minimum.reduceat(doc, edges)[group]
    many = np.empty(len(symbols), bool)
    many[order] = (np.diff(np.append(edges, len(symbols))) > 1)[group]
    recurs = np.zeros(len(segments), bool)
    recurs[owner[window & many]] = True
    recurs |= times > 1
    # Runs of windows with one owner, for all segments at once.
    fresh = window.copy()
    fresh[1:] &= (smallest[1:] != smallest[:-1]) | ~window[:-1]
    at = np.flatnonzero(fresh)
    stop = np.append(at[1:], len(symbols))
    last = np.minimum(stop - 1, (starts[1:] - 1 - length)[owner[at]])
    runs = np.stack([at - starts[owner[at]] + ((last - starts[owner[at]] + length) << 32), smallest[at]], axis=1).astype("<i8").tobytes()
    first = (np.searchsorted(owner[at], np.arange(len(segments) + 1)) * 16).tolist()
    for i in np.flatnonzero(recurs).tolist():
        yield i, runs[first[i] : first[i + 1]]


def _with_verdict(data: np.ndarray, starts: np.ndarray, how: Windows, buckets: int, told: Verdicts) -> tuple[np.ndarray, list[bytes]]:
    """Where the segments that have a verdict begin, and the verdicts."""
    cut = cut_segments(data, starts, how)
    cold = _member(cut.key, told.keys)[0]
    parts: list[Cut] = []
    if len(told.hot):
        bucket, low = _low(cut.key, buckets)
        warm = _member(low.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32)), told.hot)[0]
        single = single_windows(cut.where(warm), data, how, None)
        parts, cold = [single.where(_member(single.key, told.keys)[0])], cold & ~warm
    begin, found = [], []
    for part in [cut.where(cold), *parts]:
        for at, seg in zip(part.begin.tolist(), segment_bytes(data, part.begin, part.end, how.unit), strict=True):
            verdict = told.made.get(hashlib.md5(seg, usedforsecurity=False).digest())
            if verdict is not None:
                begin.append(at)
                found.append(verdict)
    return np.array(begin, np.int64), found


_FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<array<long>>, kept binary"


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Each document without the bytes that an earlier document has.

    docs: doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans, removed (array of [start, end) byte spans)
    and kept (binary), a row for each input row. A byte goes if a string of `length` bytes over it also starts
    in a document with a smaller doc_id; rows with equal doc_id do not repeat one another. Null texts are
    empty; a null doc_id sorts first; texts shorter than `length` are kept; other columns are ignored.
    """
    how = Windows("byte", length, max(1, length * 16 // 50))

    def exact(segments, least, times):
        return earliest_owner(segments, least, times, length)

    def apply(team: pa.Table, copies: dict, told: Verdicts, buckets: int) -> pa.Table:
        out = []
        for part in opened(team, 1 << 19):
            data, starts = flat_text(part.column(part.schema.get_field_index("text")))
            ids, size = part.column(1).to_numpy(), np.diff(starts)
            first = np.array([copies.get(d, (i,))[0] for d, i in zip(part.column(2).to_pylist(), ids.tolist(), strict=True)], np.int64)
            begin, found = _with_verdict(data, starts, how, buckets, told)
            whole = (first != ids) & (size >= length)
            runs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = np.repeat(begin, [len(x) // 16 for x in found]) if found else begin
            row = np.searchsorted(starts, at, side="right") - 1
            less = runs[:, 1] < ids[row]
            edge = at[less]
            lo, hi = edge + (runs[less, 0] & 0xFFFFFFFF), edge + (runs[less, 0] >> 32)
            change = np.bincount(np.concatenate([lo, starts[:-1][whole]]), minlength=len(data) + 1) - np.bincount(np.concatenate([hi, starts[1:][whole]]), minlength=len(data) + 1)
            gone = np.cumsum(change)[: len(data)] > 0
            # Runs of removed bytes, cut where a row ends.
            fresh, last = gone.copy(), gone.copy()
            fresh[1:] &= ~gone[:-1]
            last[:-1] &= ~gone[1:]
            inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
            fresh[inner] = gone[inner]
            last[inner - 1] = gone[inner - 1]
            a, b = np.flatnonzero(fresh), np.flatnonzero(last) + 1
            own = np.searchsorted(starts, a, side="right") - 1
            spans = np.bincount(own, minlength=len(ids)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[starts[1:]] - total[starts[:-1]]
            pairs = np.stack([a - starts[own], b - starts[own]], axis=1).ravel()
            inner_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * 2), pa.array(pairs, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)), inner_lists)
            rest = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(rest.tobytes()), pa.py_buffer(data[~gone].tobytes())])
            out.append(pa.table([part.column(1), pa.array(size), pa.array(removed.astype(np.int64)), pa.array(spans), lists, kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return judged(docs, how, exact, apply, _FIELDS).withColumn("doc_id", doc_back())


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """The same by comparing all windows; for tests."""
    order = lambda x: -(1 << 63) if x is None else x
    least: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            least[w] = min(least.get(w, 1 << 62), order(doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < order(doc):
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(data, gone, strict=True) if not x)).hexdigest()))
    return out
