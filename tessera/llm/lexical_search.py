"""Operator 11: ranked lexical search by hashed max-sketches.

The index keeps a sketch of each document: its terms are hashed to coordinates, and a coordinate holds the maximum
over the terms that fall there. An impact grows with the term's occurrences, so the maximum of those is kept, rounded
up to one byte; nearly all coordinates are zero and only the others are stored. Beside the sketches it keeps how many
documents hold each term, and the totals.

A batch of queries looks its terms' coordinates up in all sketches at once. The sum of weight times greatest
impact bounds a document's score from above. The documents of the highest bounds are scored exactly from their
texts; the k-th best of those is a threshold, and only documents whose bound reaches it are scored after them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import doc_back, doc_key, ids_of, pieces_of, stored, text_digest, tidied

#: Coordinates of a sketch, a power of two.
WIDTH = 1 << 20

#: Documents of the highest bounds that are scored first, for each result wanted.
FIRST = 4

#: Bytes of query text in one batch of queries; candidates up to which they are broadcast; terms a task counts before it hands them on.
BATCH, FEW, TERMS = 4 << 20, 100_000, 250_000

#: Cells of a table of bounds, documents times queries.
CELLS = 1 << 21

#: Bytes of terms: digits, letters with A-Z in lower case, and all bytes of characters beyond ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _code_values() -> np.ndarray:
    """What each one-byte code stands for: small numbers as they are, then steps of eight hundredths."""
    values = [0]
    while len(values) < 256:
        values.append(max(values[-1] + 1, values[-1] * 108 // 100))
    return np.array(values, np.int64)


#: Occurrences of each code; the last is beyond what a text can hold.
CODES = _code_values()


def term_counts(text: bytes, block: int = 1 << 20) -> Counter:
    """Occurrences of each term of a whole text, taken in blocks that end between terms."""
    found: Counter = Counter()
    plain = text.translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + block)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def place_of(term: bytes, width: int) -> int:
    return xxhash.xxh3_64_intdigest(term) & (width - 1)


def sketch(counts: Counter, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of counts of one term or more: the coordinates that are not zero, and the code of each: the least that reaches the greatest count there."""
    places = np.fromiter((place_of(t, width) for t in counts), np.uint32, len(counts))
    codes = np.searchsorted(CODES, np.fromiter(counts.values(), np.int64, len(counts))).astype(np.uint8)
    order = np.argsort(places, kind="stable")
    places, codes = places[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[first], np.maximum.reduceat(codes, first)


@dataclass
class Index:
    """docs: the documents; rows: their sketches and the term counts of each task; n_docs, n_terms: documents with a term, and all their terms."""

    docs: DataFrame
    rows: DataFrame
    n_docs: int
    n_terms: int
    width: int


def build_index(docs: DataFrame, width: int = WIDTH) -> Index:
    """Sketch every document and count the documents of every term, in one pass. docs: doc_id, text.

    Documents without a term (null or empty texts among them) have no sketch. The rows are written to the shared folder:
    about five bytes a different term of each document, and each task's different terms with their documents."""
    schema = "doc_id long, digest binary, n long, places binary, codes binary, term binary, df long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(holders), pa.int64()), "digest": pa.nulls(len(holders), pa.binary()), "n": pa.nulls(len(holders), pa.int64()), "places": pa.nulls(len(holders), pa.binary()), "codes": pa.nulls(len(holders), pa.binary()), "term": pa.array(list(holders), pa.binary()), "df": pa.array(list(holders.values()), pa.int64())})
            holders.clear()
            return out

        for batch in batches:
            for part in pieces_of(batch, "text"):
                rows: list[tuple] = []
                for doc, digest, text in zip(ids_of(part).tolist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    counts = term_counts(text or b"")
                    if counts:
                        holders.update(counts.keys())
                        places, codes = sketch(counts, width)
                        rows.append((doc, digest, counts.total(), places.astype("<u4").tobytes(), codes.tobytes()))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names=["doc_id", "digest", "n", "places", "codes", "term", "df"])
                if len(holders) > TERMS:
                    yield handed()
        if holders:
            yield handed()

    keyed = docs.select(doc_key().alias("doc_id"), text_digest().alias("digest"), F.col("text").cast("binary").alias("text"))
    rows = stored(keyed.mapInArrow(tidied(run), schema))
    total = rows.where("term is null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(keyed, rows, total["docs"], total["terms"], width)


@dataclass
class Queries:
    """A batch of queries: item ids, each one's terms with their weights, and the terms by coordinate."""

    items: list
    terms: list[dict[bytes, int]]

    def tables(self, width: int) -> tuple[np.ndarray, ...]:
        """mask of all coordinates; the coordinates asked for, where the entries of each begin, and item and weight of each entry."""
        entries = sorted((place_of(t, width), i, w) for i, own in enumerate(self.terms) for t, w in own.items())
        places, items, weights = (np.array(x, np.int64) for x in zip(*entries, strict=True))
        asked, first = np.unique(places, return_index=True)
        mask = np.zeros(width, bool)
        mask[asked] = True
        return mask, asked, np.append(first, len(places)), items, weights


def _asked(index: Index, items: list[tuple]) -> Queries:
    """Terms of the items that occur in the index, with their weights."""
    spark = index.rows.sparkSession
    split = [list(term_counts((text or "").encode())) for _, text in items]
    wanted = spark.createDataFrame([(t,) for t in {t for own in split for t in own}], "term binary")
    known = index.rows.where("term is not null").select("term", "df").join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = {bytes(r.term): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in known.collect()}
    return Queries([i for i, _ in items], [{t: weight[t] for t in own if t in weight} for own in split])


def norm(n, n_docs: int, n_terms: int):
    """A document's m: its length against the mean."""
    return 10 + (90 * n * n_docs) // n_terms


def _bounds(part: pa.RecordBatch, tables: tuple, n_items: int, n_docs: int, n_terms: int) -> np.ndarray:
    """Upper bounds of the scores, documents by items."""
    mask, asked, first, entry_item, entry_weight = tables
    sizes = np.fromiter((len(x.as_buffer()) for x in part.column(4)), np.int64, part.num_rows)
    joined = lambda i: b"".join(part.column(i).to_pylist())
    places, codes = np.frombuffer(joined(3), "<u4"), np.frombuffer(joined(4), np.uint8)
    hit = np.flatnonzero(mask[places])
    doc = np.repeat(np.arange(part.num_rows), sizes)[hit]
    tf, m = CODES[codes[hit]], norm(part.column(2).to_numpy(), n_docs, n_terms)[doc]
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    at = np.searchsorted(asked, places[hit])
    count = first[at + 1] - first[at]
    entry = np.arange(count.sum()) + np.repeat(first[at] - (np.cumsum(count) - count), count)
    cell = np.repeat(doc, count) * n_items + entry_item[entry]
    # A sum stays under 2 ** 53, so doubles are exact.
    total = np.bincount(cell, entry_weight[entry] * np.repeat(impact, count), part.num_rows * n_items)
    return total.astype(np.int64).reshape(part.num_rows, n_items)


def _batches_of(batches: Iterator[pa.RecordBatch], n_items: int) -> Iterator[pa.RecordBatch]:
    most = max(1, CELLS // max(1, n_items))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _bound_rows(part: pa.RecordBatch, doc: np.ndarray, item: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(doc)
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows), pa.array(bound)], names=["item", "doc_id", "digest", "bound"])


BOUND = "item int, doc_id long, digest binary, bound long"


def _highest(sent, n_docs: int, n_terms: int, most: int):
    """For each item the `most` rows of the highest bounds above zero of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, tables = sent.value
        least = np.ones(n_items, np.int64)
        kept: list[pa.RecordBatch] = []

        def best() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept).combine_chunks()
            item, doc, bound = (rows.column(i).to_numpy() for i in (0, 1, 3))
            order = np.lexsort((doc, -bound, item))
            begin = np.searchsorted(item[order], np.arange(n_items))
            place = np.arange(len(order)) - begin[item[order]]
            last = order[place == most - 1]
            least[item[last]] = bound[last]
            return rows.take(pa.array(order[place < most])).combine_chunks().to_batches()[0]

        waiting = 0
        for part in _batches_of(batches, n_items):
            bounds = _bounds(part, tables, n_items, n_docs, n_terms)
            doc, item = np.nonzero(bounds >= least)
            if len(doc):
                kept.append(_bound_rows(part, doc, item, bounds[doc, item]))
                waiting += len(doc)
                if waiting > max(1 << 18, 2 * most * n_items):
                    kept, waiting = [best()], 0
        if kept:
            yield best()

    return run


def _reaching(sent, least: np.ndarray, n_docs: int, n_terms: int):
    """All rows whose bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, tables = sent.value
        for part in _batches_of(batches, n_items):
            bounds = _bounds(part, tables, n_items, n_docs, n_terms)
            doc, item = np.nonzero(bounds >= least)
            if len(doc):
                yield _bound_rows(part, doc, item, bounds[doc, item])

    return run


def _scored(index: Index, queries: Queries, pairs: DataFrame) -> DataFrame:
    """(item, doc_id, digest, score) of the pairs item and document, from the whole texts; scores of zero are left out."""
    n_docs, n_terms = index.n_docs, index.n_terms
    sent = index.rows.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in batches:
            for part in pieces_of(batch, "text"):
                rows = []
                for doc, digest, text, items in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counts = term_counts(text)
                    m = norm(counts.total(), n_docs, n_terms)
                    for item in items:
                        score = sum(w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t, w in terms[item].items() if t in counts)
                        if score > 0:
                            rows.append((item, doc, digest, score))
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item", "doc_id", "digest", "score"])

    wanted = stored(pairs.groupBy("doc_id", "digest").agg(F.collect_set("item").alias("items")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = index.docs.join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "text", "items")
    return texts.mapInArrow(tidied(run), "item int, doc_id long, digest binary, score long").distinct()


def _top(rows: DataFrame, by: str, most: int) -> DataFrame:
    """For each item the `most` rows that are highest by `by`, smaller ids first; ranked in 64 parts before the parts are brought together."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    order = [F.desc(by), "doc_id", "digest"]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def _search_batch(index: Index, items: list[tuple], k: int) -> DataFrame:
    spark = index.rows.sparkSession
    queries = _asked(index, items)
    if not any(queries.terms):
        return spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    sketches = index.rows.where("term is null").select("doc_id", "digest", "n", "places", "codes")
    sent = spark.sparkContext.broadcast((len(queries.items), queries.tables(index.width)))
    highest = sketches.mapInArrow(tidied(_highest(sent, index.n_docs, index.n_terms, FIRST * k)), BOUND)
    tried = _scored(index, queries, _top(highest, "bound", FIRST * k))
    least = np.ones(len(queries.items), np.int64)  # a score above zero
    for r in _top(tried, "score", k).where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    reaching = stored(sketches.mapInArrow(tidied(_reaching(sent, least, index.n_docs, index.n_terms)), BOUND))
    copies = reaching.groupBy("item", "doc_id", "digest").agg(F.count("*").alias("copies"))
    scored = _scored(index, queries, reaching).join(copies, ["item", "doc_id", "digest"])
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))  # more copies than results wanted can't all be results
    return _top(each, "score", k).select("item", "doc_id", "score", "rank")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest scores above zero (all, if fewer).

    items: item_id, text. Each row of items is a query of its own, also if its id or text is null or repeated; an item without a
    known term has no result. Equal scores go by doc_id, a null doc_id first; rows that share a doc_id are
    documents of their own. Scores are exact: no document is left out whose bound reaches the k-th best score. Items are
    taken in batches of about 4 MB of text, each of which reads all sketches twice.
    """
    spark = index.rows.sparkSession
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    batches = 1 + size // BATCH
    out = None
    if index.n_docs:
        for b in range(batches):
            own = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b).select("item_id", "text").collect()]
            if own:
                names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
                found = _search_batch(index, own, k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_back().alias("doc_id"), "score")
                out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents and search them for the items."""
    return search(build_index(docs), items, k)


#: The registered query over whole tables, in DuckDB SQL.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
own AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM own),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN own ON own.doc_id = tf.doc_id, total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
