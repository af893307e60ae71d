"""Operator 12: language identification by compression.

Each language has a zstandard raw-content dictionary made of slices of its own texts.
A text is compressed with each dictionary in turn; the language whose dictionary gives
the smallest code is the answer, and an answer whose lead over the next is narrow is rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import Kept, doc_back, doc_key, pieces_of, stored, tidied

#: Effort of the compressor; bytes compressed at a time, so that the dictionary counts throughout a long text.
LEVEL, BLOCK = 6, 2_048

#: Answer for texts without a letter.
UNKNOWN = "und"

#: Bytes as they are compressed: ASCII letters in lower case, other characters' bytes as they are, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_CODERS = Kept()


def prepared(text: str) -> bytes:
    """Lower-case words between single spaces; ASCII digits and marks are left out."""
    return b" ".join([b"", *text.lower().encode().translate(_LETTERS).split(), b""])


@dataclass
class LanguageModel:
    """Languages by falling number of learned documents (then by name), and a dictionary for each."""

    names: list[str]
    dictionaries: list[bytes]
    level: int = LEVEL

    def coders(self) -> list[zstandard.ZstdCompressor]:
        key = (self.level, *(hashlib.sha256(body).digest() for body in self.dictionaries))
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = [_coder(body, self.level) for body in self.dictionaries]
        return _CODERS[key]


def sizes_of(coders: list[zstandard.ZstdCompressor], text: str) -> list[int]:
    """Bytes of the whole text under each dictionary."""
    body = prepared(text)
    blocks = [body[at : at + BLOCK] for at in range(0, len(body), BLOCK)]
    return [sum([len(coder.compress(block)) for block in blocks]) for coder in coders]


def _coder(body: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(body.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def judge(sizes: list[int]) -> tuple[int, float, float]:
    """The smallest (the first of equal ones), its share of likelihood at one bit for each byte more, and its lead over the next, relative to the next."""
    best = min(sizes)
    at = sizes.index(best)
    others = sizes[:at] + sizes[at + 1 :]
    score = 1 / sum(2.0 ** max(best - s, -1000) for s in sizes)
    return at, score, 1 - best / min(others) if others else 1.0


def learn(docs: DataFrame, slices: int = 128, slice_chars: int = 1_024, most: int = 128, level: int = LEVEL) -> LanguageModel:
    """Dictionaries from the documents of each language.

    docs: text, lang; rows with a null in either, or without a letter, teach nothing. A bounded sample is kept: for each
    language `slices` different texts at most, chosen by a hash of the text (the least hash of each residue, so copies
    count once), and of each at most `slice_chars` characters from a place that the hash gives. The `most` languages with
    the most documents are learned. So the driver gets slices * slice_chars * most characters at most.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    least = stored(taught.groupBy("lang", F.pmod("h", F.lit(slices)).alias("part")).agg(F.min("h").alias("h"), F.count("*").alias("n")))
    named = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    names = [r.lang for r in named.collect()]
    wanted = least.where(F.col("lang").isin(names)).select("lang", "h")
    place = F.pmod("h", F.greatest(F.lit(1), F.length("text") - slice_chars + 1)).cast("int") + 1
    found = taught.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substr(F.col("text"), place, F.lit(slice_chars))).alias("part"))
    parts: dict[str, list[str]] = {name: [] for name in names}
    for r in sorted(found.collect()):
        parts[r.lang].append(r.part)
    return LanguageModel(names, [b"".join([prepared(p) for p in parts[name]]) for name in names], level)


def identify(docs: DataFrame, model: LanguageModel, least_lead: float = 0.02) -> DataFrame:
    """(doc_id, lang, best, score, lead, sizes) of each document.

    docs: doc_id, text. best: the language of the smallest code, `und` if the text is null or has no letter or nothing was
    learned (score and lead 0, sizes null); equal sizes go to the language learned from more documents, then to the
    lesser name. lang: the same, but null where the lead over the next language, as a share of its size, is under `least_lead`.
    score: 1 over the sum of 2 ** (smallest size - size) of all languages. sizes: bytes under each dictionary. Whole
    texts are compressed, in blocks; repeated rows and ids come out as they came in; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.dictionaries, model.level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*sent.value)
        coders = model.coders()
        for batch in batches:
            for part in pieces_of(batch, "text"):
                made = []
                for text in part.column(1).to_pylist():
                    if text is None or not model.names:
                        made.append((UNKNOWN, 0.0, 0.0, None))
                        continue
                    sizes = sizes_of(coders, text)
                    at, score, lead = judge(sizes)
                    made.append((model.names[at], score, lead, list(zip(model.names, sizes, strict=True))))
                best, score, lead, sizes = zip(*made, strict=True)
                columns = [part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64()), pa.array(sizes, pa.map_(pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "best", "score", "lead", "sizes"])

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text")
    found = docs.select(doc_key().alias("doc_id"), lettered).mapInArrow(tidied(run), "doc_id long, best string, score double, lead double, sizes map<string,long>")
    sure = F.when((F.col("best") == UNKNOWN) | (F.col("lead") >= least_lead), F.col("best"))
    return found.select(doc_back().alias("doc_id"), sure.alias("lang"), "best", "score", "lead", "sizes")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learned from documents outside the held-out fifth and applied to all.

    docs: doc_id, text, lang. Documents with a null id teach nothing."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), F.col("best").alias("lang_pred"), "score", F.col("lang").isNotNull().alias("accepted"))
