"""Find where windows of a fixed length recur, without moving every window.

Each window (50 bytes, or 35 words) is represented by the least hash among the
shorter grams inside it, so equal windows always share that key. A run of
neighbouring windows with one key is a segment. Only keys seen more than once
are followed up: their segments go to the bucket of their key, an exact method
decides there which windows recur, and the verdicts return.

Documents are dealt into teams of a few megabytes. Teams tell buckets what they
hold (digests of whole texts, keys, segments), each thing once, and buckets answer
the teams that told it. So a text or passage that a third of all documents hold is
one entry per team, never a row per document, and nothing is looked up row by row.
Segments of a key that occurs very often are cut into single windows, each with a
key of its own, so no bucket has to hold all the contexts of a common gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from tessera.llm.common import doc_key, flat_text, ids_of, mix, pieces_of, sliding_min, span_hashes, spread, tidied, words_of

#: Bytes of text of a team, and of the texts whose keys fill a bucket (segments of the same texts take about as much).
TEAM, BUCKET = 8 << 20, 8 << 20

#: Occurrences from which the windows of a key are dealt one by one.
HOT = 4_096

#: What teams and buckets send one another.
MESSAGE = "team int, bucket int, kind int, parts array<binary>"
COPIES, FOLLOWED, VERDICTS = range(3)


@dataclass(frozen=True)
class Windows:
    """What a window is: `unit` "byte" or "word", its `length`, and the `gram` whose least hash is its key."""

    unit: str
    length: int
    gram: int


@dataclass
class Cut:
    """The segments of flat text: key, row, first unit (counted over all rows), windows, the byte span, and whether the
    gram of the key comes again within the segment (told for words only; bytes have no use for it)."""

    key: np.ndarray
    row: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    again: np.ndarray

    def where(self, keep: np.ndarray) -> Cut:
        return Cut(*(x[keep] for x in (self.key, self.row, self.at, self.windows, self.begin, self.end, self.again)))


def _again(grams: np.ndarray, least: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the grams from `at` on, `size` of them, hold the value `least` twice or more."""
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first - at, size)
    return np.add.reduceat((grams[place] == np.repeat(least, size)).astype(np.int64), first) > 1


def _gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` neighbours, from hashes of shorter runs."""
    grams, have = units, 1
    while have < gram:
        step = min(have, gram - have)
        grams = mix(grams[: len(grams) - step] * np.uint64(0x9E3779B97F4A7C15) + grams[step:])
        have += step
    return grams


def _byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` neighbouring bytes (8 to 16: as two overlapping words of eight)."""
    if not 8 <= gram <= 16:
        return _gram_hashes(data.astype(np.uint64), gram)
    words = np.empty(len(data) - 7, np.uint64)
    for i in range(min(8, len(words))):
        own = words[i::8]
        own[:] = data[i : i + 8 * len(own)].view("<u8")
    out = words[: len(words) - (gram - 8)] * np.uint64(0x9E3779B97F4A7C15)
    out += words[gram - 8 :]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def cut_segments(data: np.ndarray, starts: np.ndarray, how: Windows, words: tuple | None = None) -> Cut:
    """Segments of all rows of flat text. Rows shorter than a window have none. words: what words_of returns, if known."""
    if how.unit == "byte":
        begin, end, first = None, None, starts
        units = len(data)
    else:
        begin, end, first = words or words_of(data, starts)
        units = len(begin)
    none = np.zeros(0, np.int64)
    if units < how.length:
        return Cut(none.astype(np.uint64), none, none, none, none, none, none.astype(bool))
    grams = _byte_grams(data, how.gram) if how.unit == "byte" else _gram_hashes(span_hashes(data, begin, end), how.gram)
    least = sliding_min(grams, how.length - how.gram + 1)
    # Windows that begin in the last length - 1 units of a row would leave it.
    fresh = np.empty(len(least) + 1, bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:-1])
    size = np.diff(first)
    stop = np.maximum(first[1:] - (how.length - 1), first[:-1])
    edge = np.concatenate([first[:-1], stop])
    fresh[edge[edge < len(fresh)]] = True
    fresh[-1] = True
    at = np.flatnonzero(fresh)
    count = np.diff(at)
    at = at[:-1]
    row = np.searchsorted(first, at, side="right") - 1
    whole = (at < stop[row]) & (size[row] >= how.length)
    at, count, row = at[whole], count[whole], row[whole]
    last = at + count + how.length - 1
    spans = (at, last) if begin is None else (begin[at], end[last - 1])
    again = _again(grams, least[at], at, count + how.length - how.gram) if how.unit == "word" and len(at) else np.zeros(len(at), bool)
    return Cut(least[at], row, at, count, *spans, again)


def single_windows(cut: Cut, data: np.ndarray, how: Windows, words: tuple | None) -> Cut:
    """Each window as a segment of its own, whose key is the hash of the whole window."""
    row = np.repeat(cut.row, cut.windows)
    at = np.arange(len(row)) + np.repeat(cut.at - (np.cumsum(cut.windows) - cut.windows), cut.windows)
    begin, end = (at, at + how.length) if how.unit == "byte" else (words[0][at], words[1][at + how.length - 1])
    key = _gram_hashes(data.astype(np.uint64), how.length)[at] if how.unit == "byte" else _gram_hashes(span_hashes(data, *words[:2]), how.length)[at]
    return Cut(key, row, at, np.ones(len(row), np.int64), begin, end, np.zeros(len(row), bool))


def segment_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: str) -> list[bytes]:
    """The text of segments; words are joined by single spaces."""
    whole = data.tobytes()
    if unit == "byte":
        return [whole[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
    return [b" ".join(whole[b:e].split()) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]


def _low(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a key, and the 32 bits by which it is known there: chance pairs cost work and change no result."""
    return (key % np.uint64(buckets)).astype(np.int64), (key // np.uint64(buckets)).astype(np.uint32)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate([[len(values) > 0], values[1:] != values[:-1]]))
    return zip(values[edges].tolist(), edges.tolist(), np.append(edges, len(values))[1:].tolist(), strict=True)


def messages(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["team", "bucket", "kind", "parts"])


def _each(table: pa.Table, kind: int | None = None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(team, bucket, parts) of the messages of a kind."""
    for team, bucket, own, parts in zip(*(table[c].to_pylist() for c in ("team", "bucket", "kind", "parts")), strict=True):
        if kind is None or own == kind:
            yield team, bucket, parts


# --- teams -----------------------------------------------------------------------------------------------------------


def in_teams(docs: DataFrame, teams: int, carry: list[str]) -> DataFrame:
    """(team, doc_id, digest, packed, rest): the texts compressed, so that dealing them out moves less.

    `rest` has the columns of `carry`. A team is told by doc_id and text; repeats of a row within a batch go to
    the next teams, so that no row can fill one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            seen: dict[tuple[int, bytes], int] = {}
            for part in pieces_of(batch, "text", 4 << 20):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                digests = [hashlib.sha256(x).digest() for x in texts]
                ids, team = ids_of(part), []
                for doc, own in zip(ids.tolist(), digests, strict=True):
                    n = seen[doc, own] = seen.get((doc, own), -1) + 1
                    team.append((int.from_bytes(own[:6], "little") * 31 + (doc & 0xFFFFFFFFFFFF) * 0x9E3779B1 + n * 0x85EBCA6B >> 7) % teams)
                made = [pa.array(team, pa.int32()), part.column(0), pa.array(digests, pa.binary()), pa.array(list(map(squeeze, texts)), pa.binary()), part.column(2)]
                yield pa.RecordBatch.from_arrays(made, names=["team", "doc_id", "digest", "packed", "rest"])

    own = docs.select(doc_key().alias("doc_id"), "text", F.struct(F.lit(0).alias("_"), *(docs[c] for c in carry)).alias("rest"))
    schema = StructType().add("team", IntegerType()).add("doc_id", LongType()).add("digest", BinaryType()).add("packed", BinaryType()).add(own.schema["rest"])
    return own.mapInArrow(tidied(run), schema)


def opened(table: pa.Table, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a team with `text` (binary) in place of `packed`."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in table.to_batches():
        for part in pieces_of(batch, "packed", most):
            at = part.schema.get_field_index("packed")
            yield part.set_column(at, "text", pa.array([expand(x) for x in part.column(at).to_pylist()], pa.binary()))


def _tell_digests(buckets: int) -> Callable:
    """The texts of a team, each once: digest, smallest doc_id, rows."""

    def run(docs: pa.Table) -> pa.Table:
        team = docs["team"][0].as_py()
        found: dict[bytes, list[int]] = {}
        for digest, doc in zip(docs["digest"].to_pylist(), docs["doc_id"].to_pylist(), strict=True):
            own = found.setdefault(digest, [doc, 0])
            own[0], own[1] = min(own[0], doc), own[1] + 1
        names = sorted(found, key=lambda x: (int.from_bytes(x[:6], "little") % buckets, x))
        bucket = np.array([int.from_bytes(x[:6], "little") % buckets for x in names])
        numbers = np.array([found[x] for x in names], np.int64)
        return messages([(team, b, COPIES, [b"".join(names[lo:hi]), numbers[lo:hi].tobytes()]) for b, lo, hi in _runs(bucket)])

    return run


def _answer_digests(table: pa.Table) -> pa.Table:
    """For each text with copies, to the teams that hold it: digest, smallest doc_id of all, rows of all."""
    total: dict[bytes, list[int]] = {}
    held: dict[int, list[bytes]] = {}
    for team, _, (names, numbers) in _each(table):
        for i, (doc, n) in enumerate(np.frombuffer(numbers, np.int64).reshape(-1, 2).tolist()):
            digest = names[32 * i : 32 * i + 32]
            own = total.setdefault(digest, [doc, 0])
            own[0], own[1] = min(own[0], doc), own[1] + n
            held.setdefault(team, []).append(digest)
    bucket = table["bucket"][0].as_py()
    rows = []
    for team, names in held.items():
        if many := [x for x in names if total[x][1] > 1]:
            rows.append((team, bucket, COPIES, [b"".join(many), np.array([total[x] for x in many], np.int64).tobytes()]))
    return messages(rows)


def copies_of(answers: pa.Table) -> dict[bytes, list[int]]:
    """digest -> (smallest doc_id, rows) of the texts that have copies."""
    found = {}
    for _, _, (names, numbers) in _each(answers, COPIES):
        for i, own in enumerate(np.frombuffer(numbers, np.int64).reshape(-1, 2).tolist()):
            found[names[32 * i : 32 * i + 32]] = own
    return found


def _standing(docs: pa.Table, copies: dict[bytes, list[int]]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """One row of the team for each text whose smallest doc_id it has; that doc_id, and the rows that the text counts for."""
    seen, keep, doc, times = set(), [], [], []
    for i, (digest, own) in enumerate(zip(docs["digest"].to_pylist(), docs["doc_id"].to_pylist(), strict=True)):
        first, n = copies.get(digest, (own, 1))
        if own == first and digest not in seen:
            if n > 1:
                seen.add(digest)
            keep.append(i)
            doc.append(first)
            times.append(n)
    return docs.select(["packed"]).take(pa.array(keep, pa.int64())), np.array(doc, np.int64), np.array(times, np.int64)


def _tell_keys(how: Windows, buckets: int) -> Callable:
    """The keys of a team, each once, and about how often it has them: 1 for once, n for less than 2**n times."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return messages([])
        found = [np.zeros(0, np.uint64)]
        for part in opened(_standing(docs, copies_of(answers))[0]):
            cut = cut_segments(*flat_text(part.column(0)), how)
            found += [cut.key, cut.key[cut.again]]
        key, count = np.unique(np.concatenate(found), return_counts=True)
        bucket, low = _low(key, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, low, size = bucket[order], low[order], (np.floor(np.log2(count[order])) + 1).astype(np.uint8)
        team = docs["team"][0].as_py()
        return messages([(team, b, FOLLOWED, [low[lo:hi].tobytes(), size[lo:hi].tobytes()]) for b, lo, hi in _runs(bucket)])

    return run


def _answer_keys(table: pa.Table) -> pa.Table:
    """To each team those of its keys that occur more than once, and which of them are hot."""
    teams, lows, sizes = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
    for team, _, (low, size) in _each(table):
        lows.append(np.frombuffer(low, np.uint32))
        sizes.append(np.frombuffer(size, np.uint8))
        teams.append(np.full(len(sizes[-1]), team))
    low, size, team = np.concatenate(lows), np.concatenate(sizes), np.concatenate([np.zeros(0, np.int64), *teams])
    order = np.argsort(low, kind="stable")
    low, size, team = low[order], size[order], team[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    total = np.add.reduceat(np.left_shift(np.int64(1), size.astype(np.int64) - 1), first) if len(low) else np.zeros(0, np.int64)
    total = np.repeat(total, np.diff(np.append(first, len(low))))
    keep = total > 1
    low, team, hot = low[keep], team[keep], total[keep] >= HOT
    order = np.argsort(team, kind="stable")
    low, team, hot = low[order], team[order], hot[order]
    bucket = table["bucket"][0].as_py()
    return messages([(t, bucket, FOLLOWED, [low[lo:hi].tobytes(), hot[lo:hi].tobytes()]) for t, lo, hi in _runs(team)])


def _codes(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys a team follows as bucket * 2**32 + low, sorted, and which are hot."""
    code, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for _, bucket, (low, warm) in _each(answers, FOLLOWED):
        code.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        hot.append(np.frombuffer(warm, bool))
    code, hot = np.concatenate(code), np.concatenate(hot)
    order = np.argsort(code)
    return code[order], hot[order]


def _member(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted array, and where."""
    if not len(of):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(of, key), len(of) - 1)
    return of[at] == key, at


def followed_segments(data: np.ndarray, starts: np.ndarray, how: Windows, buckets: int, codes: np.ndarray, hot: np.ndarray) -> tuple[Cut, np.ndarray]:
    """The segments whose key is among the codes, those of hot keys window by window, and the codes of the hot ones met."""
    words = words_of(data, starts) if how.unit == "word" else None
    cut = cut_segments(data, starts, how, words)
    bucket, low = _low(cut.key, buckets)
    own = low.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))
    found, at = _member(own, codes)
    warm = found & hot[at] if len(hot) else np.zeros(len(found), bool)
    if not warm.any():
        return cut.where(found), codes[:0]
    parts = cut.where(found & ~warm), single_windows(cut.where(warm), data, how, words)
    return Cut(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("key", "row", "at", "windows", "begin", "end", "again"))), np.unique(own[warm])


def _tell_segments(how: Windows, buckets: int) -> Callable:
    """The segments of followed keys of a team, each once: key, smallest doc_id, occurrences, text."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return messages([])
        codes, hot = _codes(answers)
        rows, docs_of, times_of = _standing(docs, copies_of(answers))
        have: dict[bytes, list[int]] = {}
        met, at = [np.zeros(0, np.uint64)], 0
        for part in opened(rows):
            data, starts = flat_text(part.column(0))
            cut, warm = followed_segments(data, starts, how, buckets, codes, hot)
            met.append(warm)
            for seg, key, doc, n in zip(segment_bytes(data, cut.begin, cut.end, how.unit), cut.key.tolist(), docs_of[at + cut.row].tolist(), times_of[at + cut.row].tolist(), strict=True):
                old = have.get(seg)
                if old is None:
                    have[seg] = [key, doc, n]
                else:
                    old[1] = min(old[1], doc)
                    old[2] += n
            at += part.num_rows
        if not have:
            return messages([])
        segments = list(have)
        key = np.array([x[0] for x in have.values()], np.uint64)
        rest = np.array([x[1:] for x in have.values()], np.int64)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        warm, team = np.unique(np.concatenate(met)), docs["team"][0].as_py()
        squeeze = zstandard.ZstdCompressor(1).compress
        out = []
        for b, lo, hi in _runs(bucket[order]):
            own = order[lo:hi]
            texts = [segments[i] for i in own.tolist()]
            out.append((team, b, VERDICTS, [key[own].tobytes(), rest[own].tobytes(), np.array([len(x) for x in texts], "<u4").tobytes(), squeeze(b"".join(texts)), b"" if out else warm.tobytes()]))
        return messages(out)

    return run


def _answer_segments(exact: Callable, block: int) -> Callable:
    """Run `exact` over the segments of a bucket in blocks of whole keys, and tell each team what became of its segments."""

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        number: dict[bytes, int] = {}
        keys, least, times, held = [], [], [], []
        for team, _, (own_keys, rest, sizes, blob, warm) in _each(table):
            texts, at, mine = expand(blob), 0, []
            for key, (doc, n), size in zip(np.frombuffer(own_keys, np.uint64).tolist(), np.frombuffer(rest, np.int64).reshape(-1, 2).tolist(), np.frombuffer(sizes, "<u4").tolist(), strict=True):
                seg = texts[at : at + size]
                at += size
                i = number.setdefault(seg, len(number))
                if i == len(keys):
                    keys.append(key)
                    least.append(doc)
                    times.append(n)
                else:
                    least[i], times[i] = min(least[i], doc), times[i] + n
                mine.append(i)
            held.append((team, mine, warm))
        segments, key, doc, count = list(number), np.array(keys, np.uint64), np.array(least, np.int64), np.array(times, np.int64)
        order = np.argsort(key, kind="stable")
        verdict: list[bytes | None] = [None] * len(segments)
        start, size = 0, 0
        for _, lo, hi in _runs(key[order].view(np.int64)):
            size += sum(len(segments[i]) for i in order[lo:hi].tolist())
            if size > block or hi == len(order):
                own = order[start:hi]
                for i, made in exact([segments[i] for i in own.tolist()], doc[own], count[own]):
                    verdict[own[i]] = made
                start, size = hi, 0
        bucket, out = table["bucket"][0].as_py(), []
        squeeze = zstandard.ZstdCompressor(1).compress
        digest = [hashlib.md5(s, usedforsecurity=False).digest() if v is not None else b"" for s, v in zip(segments, verdict, strict=True)]
        for team, mine, warm in held:
            told = [i for i in mine if verdict[i] is not None]
            if told or warm:
                made = [verdict[i] for i in told]
                out.append((team, bucket, VERDICTS, [key[told].tobytes(), b"".join(digest[i] for i in told), np.array([len(x) for x in made], "<u4").tobytes(), squeeze(b"".join(made)), warm]))
        return messages(out)

    return run


@dataclass
class Verdicts:
    """What a team was told: the keys of its segments with a verdict (sorted), each segment's verdict by digest, and hot codes."""

    keys: np.ndarray
    made: dict[bytes, bytes]
    hot: np.ndarray


def verdicts_of(answers: pa.Table) -> Verdicts:
    expand = zstandard.ZstdDecompressor().decompress
    keys, made, hot = [np.zeros(0, np.uint64)], {}, [np.zeros(0, np.uint64)]
    for _, _, (key, digests, sizes, blob, warm) in _each(answers, VERDICTS):
        keys.append(np.frombuffer(key, np.uint64))
        hot.append(np.frombuffer(warm, np.uint64))
        whole, at = expand(blob), 0
        for i, size in enumerate(np.frombuffer(sizes, "<u4").tolist()):
            made[digests[16 * i : 16 * i + 16]] = whole[at : at + size]
            at += size
    return Verdicts(np.unique(np.concatenate(keys)), made, np.unique(np.concatenate(hot)))


def judged(docs: DataFrame, how: Windows, exact: Callable, apply: Callable, schema: StructType | str, carry: list[str] = (), block: int = 1 << 17) -> DataFrame:
    """What `apply` returns for the documents of each team, given what `exact` found of their segments.

    docs: doc_id, text, and the columns of `carry`. exact(segments, least doc_ids, occurrences) yields (segment number, verdict as bytes) of
    the segments with windows that recur. apply(team, copies, verdicts, buckets) gets a table of (team, doc_id, digest, packed,
    rest) and returns a table of `schema`.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ways = spread(docs.sparkSession)
    teams, buckets = max(ways, -(-size // TEAM)), max(ways, -(-size // BUCKET))
    dealt = in_teams(docs, teams, list(carry))
    to_team = dealt.groupBy("team")

    def told(answers: DataFrame | None, tell: Callable, answer: Callable) -> DataFrame:
        asked = to_team.applyInArrow(tell, MESSAGE) if answers is None else to_team.cogroup(answers.groupBy("team")).applyInArrow(tell, MESSAGE)
        return asked.groupBy("bucket").applyInArrow(answer, MESSAGE)

    copies = told(None, _tell_digests(buckets), _answer_digests)
    followed = told(copies, _tell_keys(how, buckets), _answer_keys)
    verdicts = told(copies.unionByName(followed), _tell_segments(how, buckets), _answer_segments(exact, block))

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        return apply(own, copies_of(answers), verdicts_of(answers), buckets)

    return to_team.cogroup(copies.unionByName(verdicts).groupBy("team")).applyInArrow(run, schema)
