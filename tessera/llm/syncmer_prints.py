"""Operator 3: document fingerprints from closed syncmers, in DataFrame functions alone.

A text is read as short pieces of its words. Of each run of `K` pieces (a k-mer),
the least piece hash is looked for; a k-mer whose least piece is its first or last
is an anchor. Whether a k-mer is one depends on nothing outside it, so an edit
leaves all anchors that it doesn't touch. The text is padded on both sides with a
piece that is never least, so short texts have anchors too. Anchors carry the cell
of their place; a match may drift by one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import NULL_ID, doc_back, doc_key, spread

#: Pieces of a k-mer, letters of a piece, k-mers of a cell, and bits of an anchor's hash.
K, PIECE, CELL, BITS = 8, 4, 64, 24

_PAD = (1 << 63) - 1


def piece_hashes(text: Column) -> Column:
    """Hashes of the pieces of a text, padded."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))
    pad = F.array_repeat(F.lit(_PAD), K - 1)
    return F.when(F.size(pieces) > 0, F.concat(pad, F.transform(pieces, lambda x: F.xxhash64(x)), pad)).otherwise(F.array().cast("array<long>"))


def anchors(hashes: Column) -> Column:
    """Cell and hash of each closed syncmer, in order, as cell * 2**BITS + hash."""
    inner = lambda i: F.least(*(F.get(hashes, i + j) for j in range(1, K - 1)))
    edge = lambda i: F.least(F.get(hashes, i), F.get(hashes, i + K - 1))
    whole = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(K))).bitwiseAND((1 << BITS) - 1)
    places = F.when(F.size(hashes) >= K, F.sequence(F.lit(0), F.size(hashes) - K)).otherwise(F.array().cast("array<int>"))
    chosen = F.filter(places, lambda i: edge(i) <= inner(i))
    return F.transform(chosen, lambda i: F.shiftleft(F.floor(i / CELL), BITS) + whole(i))


def fingerprint(codes: Column) -> Column:
    """Anchors as text: six hex digits each, a bar for each step to the next cell."""
    cell = lambda c: F.shiftright(c, BITS)

    def shown(c: Column, i: Column) -> Column:
        steps = cell(c) - F.when(i > 0, cell(F.get(codes, i - 1))).otherwise(F.lit(0))
        return F.concat(F.repeat(F.lit("|"), steps.cast("int")), F.lower(F.lpad(F.hex(c.bitwiseAND((1 << BITS) - 1)), BITS // 4, "0")))

    return F.array_join(F.transform(codes, shown), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of both that the other has in the same cell or beside it; two empty ones are alike."""
    drift = lambda x: F.concat(x, F.transform(x, lambda c: c + (1 << BITS)), F.transform(x, lambda c: c - (1 << BITS)))
    hits = F.size(F.array_intersect(a, drift(b))) + F.size(F.array_intersect(b, drift(a)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))), F.lit(1.0))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """The rows with the anchors of a text column; hashes are a column of their own, computed once a row."""
    return df.withColumn("_hashes", piece_hashes(F.col(text))).withColumn(out, anchors(F.col("_hashes"))).drop("_hashes")


def with_next(docs: DataFrame, ways: int) -> DataFrame:
    """The rows (doc_id, text) with the anchors of each text, and text and anchors of the next document.

    Documents are dealt into ranges of doc_id, so that no single task sorts all; the last of a range continues
    with the first of the next, the very last with the very first."""
    edges = docs.agg(F.percentile_approx("doc_id", [i / ways for i in range(1, ways)], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(x).cast("long") for x in sorted(set(edges)))) if edges else F.array().cast("array<long>")
    ranged = docs.withColumn("part", F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    # One row for each range: at most `ways`.
    first = ranged.groupBy("part").agg(F.min_by("text", F.struct("doc_id", "text")).alias("first_text"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    after = first.select("part", F.coalesce(F.lead("first_text").over(parts), F.first("first_text").over(parts)).alias("after_text"))
    led = with_anchors(ranged, "text", "codes").withColumn("next_text", F.lead("text").over(order)).withColumn("next_codes", F.lead("codes").over(order)).withColumn("inside", F.lead(F.lit(True)).over(order))
    inside = led.where("inside").select("doc_id", "text", "codes", "next_text", "next_codes")
    last = led.where("inside is null").join(after, "part").select("doc_id", "text", "codes", F.col("after_text").alias("next_text"))
    return inside.unionByName(with_anchors(last, "next_text", "next_codes"))


def document_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    docs: doc_id, text. Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (0 to 1). Edited: the last quarter of the code points, rounded down, gives way to as
    many, or all, of the next document by doc_id; after the last comes the first. Null texts are empty, with an
    empty fingerprint; a null doc_id sorts first; equal doc_ids sort by text; other columns are ignored.
    """
    texts = docs.select(doc_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(texts, spread(docs.sparkSession)).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    done = with_anchors(edited, "edited", "edited_codes")
    return done.select(doc_back().alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("codes")).alias("fingerprint"), fingerprint(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))


__all__ = ["NULL_ID", "anchors", "document_prints", "fingerprint", "likeness", "with_anchors", "with_next"]
