"""Operator 7: remove passages that recur anywhere, located by phrase automata.

Segments that may recur (see repeats.py) meet in the bucket of their key, where the
windows that occur twice or more confirm the passages: maximal runs of such windows.
The passages go to the teams of documents that hold some of their keys; each team
compiles its own into Aho-Corasick automata, and all its documents are streamed
through them, which finds every occurrence.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tessera.llm.common import SPACES, doc_back
from tessera.llm.repeats import Verdicts, Windows, judged, opened

#: Passages in one automaton; more are spread over several, each streamed in turn.
PATTERNS = 10_000

#: Words to an automaton are two letters of this many; 0 stands for words that no passage has.
LETTERS = 1 << 9


def confirmed_passages(segments: list[bytes], times: np.ndarray, length: int) -> Iterator[tuple[int, bytes]]:
    """For each segment with windows of `length` words that occur twice or more: its passages, one per line."""
    seen: Counter = Counter()
    edges = []
    for own, n in zip(segments, times.tolist(), strict=True):
        gaps = np.flatnonzero(np.frombuffer(own, np.uint8) == 32)
        edges.append((np.concatenate([[0], gaps + 1]).tolist(), [*gaps.tolist(), len(own)]))
        for a, b in zip(edges[-1][0], edges[-1][1][length - 1 :], strict=False):
            seen[own[a:b]] += n
    for i, (own, (first, last)) in enumerate(zip(segments, edges, strict=True)):
        twice = np.array([seen[own[a:b]] > 1 for a, b in zip(first, last[length - 1 :], strict=False)], np.int8)
        if twice.any():
            runs = np.flatnonzero(np.diff(twice, prepend=0, append=0)).reshape(-1, 2).tolist()
            yield i, b"\n".join(own[first[a] : last[b + length - 2]] for a, b in runs)


class Automata:
    """Passages compiled for streaming. A word is two letters from separate alphabets, so nodes have few children and
    matches begin at words only."""

    def __init__(self, passages: list[bytes]) -> None:
        self.code: dict[bytes, str] = {}
        self.made = []
        for at in range(0, len(passages), PATTERNS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for passage in passages[at : at + PATTERNS]:
                words = passage.split(b" ")
                for w in words:
                    if w not in self.code:
                        n = len(self.code)
                        self.code[w] = chr(1 + n // LETTERS) + chr(0x20000 + n % LETTERS)
                automaton.add_word("".join([self.code[w] for w in words]), len(words))
            automaton.make_automaton()
            self.made.append(automaton)

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which of the words lie in an occurrence of a passage."""
        code = self.code
        stream = "".join([code.get(w, "\0\0") for w in words])
        hits = [(end, size) for automaton in self.made for end, size in automaton.iter(stream)]
        if not hits:
            return np.zeros(len(words), bool)
        end, size = np.array(hits, np.int64).T
        end = (end + 1) // 2
        change = np.bincount(end - size, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
        return np.cumsum(change)[: len(words)] > 0


def _judged(docs: DataFrame, length: int, carry: list[str], as_it_is: bool = False) -> DataFrame:
    """doc_id (a key that is never null), n_words, n_removed, removed, kept, and rest with the columns of `carry`.

    as_it_is: a text that loses no word is kept as it is, white space included."""
    how = Windows("word", length, max(1, length * 8 // 35))

    def exact(segments, least, times):
        return confirmed_passages(segments, times, length)

    def apply(team: pa.Table, copies: dict, told: Verdicts, buckets: int) -> pa.Table:
        passages = sorted({p for made in told.made.values() for p in made.split(b"\n")})
        automata = Automata(passages)
        rows: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        for part in opened(team, 1 << 20):
            for digest, text in zip(part.column(2).to_pylist(), part.column(part.schema.get_field_index("text")).to_pylist(), strict=True):
                words = text.split()
                if copies.get(digest, (0, 1))[1] > 1 and len(words) >= length:
                    gone = np.ones(len(words), bool)
                elif passages and len(words) >= length:
                    gone = automata.covered(words)
                else:
                    gone = np.zeros(0, bool)
                if gone.any():
                    change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                    left = [w for a, b in zip([0, *(x[1] for x in change)], [*(x[0] for x in change), len(words)], strict=True) for w in words[a:b]]
                else:
                    change, left = [], words
                kept = text if as_it_is and not change else b" ".join(left)
                for k, v in (("n_words", len(words)), ("n_removed", len(words) - len(left)), ("removed", change), ("kept", kept)):
                    rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        made = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
        return pa.table([team["doc_id"], *made[:3], made[3].cast(pa.string()), team["rest"]], names=["doc_id", *rows, "rest"])

    rest = docs.select(F.struct(F.lit(0).alias("_"), *(docs[c] for c in carry)).alias("rest")).schema["rest"]
    schema = StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("removed", ArrayType(ArrayType(LongType()))).add("kept", StringType()).add(rest)
    return judged(docs, how, exact, apply, schema, carry)


def phrase_dedup(docs: DataFrame, length: int = 35) -> DataFrame:
    """Each document without the words of passages that occur elsewhere as well.

    docs: doc_id, text. Returns doc_id, n_words, n_removed, removed (array of [start, end) word spans) and kept (string: words
    joined by one space), a row for each input row. A word goes if some `length` consecutive words over it
    also start anywhere else, in the same document or another; all copies go. Null texts have no words;
    null and repeated doc_ids count as documents of their own; other columns are ignored.
    """
    return _judged(docs, length, []).drop("rest").withColumn("doc_id", doc_back())


def without_phrases(docs: DataFrame, length: int = 35) -> DataFrame:
    """The documents with what phrase_dedup keeps as their text, n_chars counted anew; other columns as they came.

    Each row takes what its own text keeps, whatever other rows share its doc_id; rows that lose no word keep
    their text as it is, null included."""
    others = [c for c in docs.columns if c != "text"]
    none = next(f"_none{i}" for i in range(len(others) + 1) if f"_none{i}" not in others)
    own = _judged(docs.withColumn(none, F.col("text").isNull()), length, [*others, none], as_it_is=True)
    changed = {"text": F.when(~F.col(f"rest.{none}"), F.col("kept"))}
    if "n_chars" in others:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return own.select(*((changed[c] if c in changed else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 35) -> list[tuple]:
    """The same by comparing all windows; for tests."""
    split = [[w for w in "".join(" " if ord(c) in SPACES else c for c in text or "").split(" ") if w] for _, text in rows]
    count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if count[tuple(words[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((doc, len(words), sum(gone), hashlib.sha256(" ".join(w for w, x in zip(words, gone, strict=True) if not x).encode()).hexdigest()))
    return out
