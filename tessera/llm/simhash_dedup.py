"""Operator 6: SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into four segments of 16 bits that form a ring. If two
fingerprints differ in at most three bits, some chain of consecutive segments
starts where the differences of its first l segments stay within l * 3 / 4: none
in the first, one in the first two, two in the first three. The first two
segments make the key of a candidate (the later side also tries each one-bit
change of the second); the third prunes before the full Hamming check. Keys of many
fingerprints are dealt again by the first three segments, with each change of the third
that the chain allows, so that no task holds all fingerprints of a common key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import SPACES, carried, checkpointed, doc_back, doc_key, flat_text, ids_of, join_keyed, mix, pieces_of, span_hashes, spread, stored, text_digest, tidied, tidied_group, words_of

#: Most differing bits of two linked fingerprints; the four segments of the ring are made for this bound.
BITS = 3

#: Fingerprints that begin with a key, from which on the key is dealt again by three segments.
HOT = 2_048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint_rows(data: np.ndarray, starts: np.ndarray, shingle: int, seed: int = 42) -> np.ndarray:
    """The fingerprint of each row of flat text."""
    data = _LOWER[data]
    begin, end, first = words_of(data, starts)
    # Words joined by single spaces, so that a shingle is one slice.
    sizes = end - begin
    to = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum() + len(sizes)), 32, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[to[owner] + offset] = data[begin[owner] + offset]
    text, stop = joined.tobytes(), to + sizes
    out = np.zeros(len(starts) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if hi == lo:
            continue
        width = min(shingle, hi - lo)
        values = [digest(text[b:e], seed) for b, e in zip(to[lo : hi - width + 1].tolist(), stop[lo + width - 1 : hi].tolist(), strict=True)]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        half = bits.sum(axis=0, dtype=np.int64) * 2 > len(values)
        out[i] = np.packbits(half, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp long) of each row, and the digest of its text if asked for; null texts are empty and have the fingerprint zero."""
    more = ["digest"] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 2 << 20):
                found = fingerprint_rows(*flat_text(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(part)), pa.array(found.view(np.int64)), *part.columns[2:]], names=["doc_id", "fp", *more])

    own = docs.select(doc_key().alias("doc_id"), "text", *([text_digest().alias("digest")] if digest else []))
    return own.mapInArrow(tidied(run), "doc_id long, fp long" + "".join(f", {x} binary" for x in more))


def _rotated(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit values with segment `start` (0..3, from the top) brought to the top."""
    shift = (start * 16).astype(np.uint64)
    return np.where(shift == 0, values, (values << shift) | (values >> ((np.uint64(64) - shift) % np.uint64(64))))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the first two segments of each chain, with the second as it is and with each bit changed."""
    changes = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).to_numpy()[at : at + 20_000].view(np.uint64)
            for start in range(4):
                top = _rotated(fp, np.full(len(fp), start)) >> np.uint64(32)
                key = ((top[:, None] ^ changes) | np.uint64(start << 32)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, 17).view(np.int64))], names=["key", "fp"])


def within(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pairs that pass the chain from `start` and the full check."""
    differ = _rotated(a ^ b, start)
    chain = (np.bitwise_count(differ >> np.uint64(48)) == 0) & (np.bitwise_count(differ >> np.uint64(32)) <= 1)
    chain &= np.bitwise_count(differ >> np.uint64(16)) <= 2
    chain[chain] = np.bitwise_count(differ[chain]) <= BITS
    return chain


#: Changes of up to two bits of a segment, with their number of bits.
_TWO = np.array([0, *(1 << i for i in range(16)), *(1 << i | 1 << j for i in range(16) for j in range(i))], np.uint64)


def _longer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the first three segments from keys of two: the third as it is and with all changes that leave two in all."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            key, fp = (batch.column(i).to_numpy()[at : at + 20_000].view(np.uint64) for i in (0, 1))
            start = (key >> np.uint64(32)).astype(np.int64)
            turned = _rotated(fp, start)
            spent = np.bitwise_count((turned >> np.uint64(32)) ^ (key & np.uint64(0xFFFFFFFF)))
            row, change = np.nonzero(np.bitwise_count(_TWO)[None, :] + spent[:, None] <= 2)
            third = (turned[row] >> np.uint64(16) & np.uint64(0xFFFF)) ^ _TWO[change]
            longer = start[row].astype(np.uint64) << np.uint64(48) | (key[row] & np.uint64(0xFFFFFFFF)) << np.uint64(16) | third
            yield pa.RecordBatch.from_arrays([pa.array(longer.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["key", "fp"])


def _group_links(fp: np.ndarray, start: int, key: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a key's fingerprints connect, at most one for each fingerprint: (member, root)."""
    exact = np.flatnonzero(_rotated(fp, np.full(len(fp), start)) >> np.uint64(64 - bits) == np.uint64(key & (1 << bits) - 1))
    root = np.arange(len(fp))
    for e in exact.tolist():
        near = np.flatnonzero(within(np.full(len(fp), fp[e]), fp, np.full(len(fp), start)))
        roots = np.unique(root[near])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _links(bits: int):
    """Links among the rows of each key of so many bits; rows arrive sorted by key, a key may span batches."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(key, prepend=-1) != 0) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        two = edge[size == 2]
        good = within(fp[two], fp[two + 1], key[two] >> bits)
        left, right = [fp[two][good]], [fp[two + 1][good]]
        for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = _group_links(fp[at : at + n], int(key[at]) >> bits, int(key[at]), bits)
            left.append(a)
            right.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield linked(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
        yield linked(key, fp)

    return run


def _first_keys() -> list:
    """The key of each chain's first two segments, as SQL expressions of fp."""
    turned = ["fp", "(fp << 16) | shiftrightunsigned(fp, 48)", "(fp << 32) | shiftrightunsigned(fp, 32)", "(fp << 48) | shiftrightunsigned(fp, 16)"]
    return [F.expr(f"shiftrightunsigned({x}, 32) | ({start}L << 32)") for start, x in enumerate(turned)]


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links of distinct fingerprints (`fp`) that connect all within reach of one another.

    A key with which `hot` fingerprints begin is dealt again by 48 bits; its links are the same."""
    ways = spread(nodes.sparkSession)
    keyed = nodes.select("fp").mapInArrow(tidied(_keys), "key long, fp long")
    common = stored(nodes.select(F.explode(F.array(*_first_keys())).alias("key")).groupBy("key").count().where(F.col("count") >= hot).select("key"))

    def linked(rows: DataFrame, bits: int) -> DataFrame:
        return rows.repartition(ways, "key").sortWithinPartitions("key").mapInArrow(tidied(_links(bits)), "a long, b long")

    found = linked(keyed, 32)
    if not common.isEmpty():
        longer = keyed.join(common, "key", "left_semi").mapInArrow(tidied(_longer_keys), "key long, fp long")
        found = linked(keyed.join(common, "key", "left_anti"), 32).unionByName(linked(longer, 48))
    return found.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node is connected with, by alternating large and small stars.

    Every round ends in a checkpoint; only its count and checksum come to the driver."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u != v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _rooted(own: DataFrame) -> DataFrame:
    """(fp, least, copies, root): each fingerprint with its first row (all columns but fp), its rows, and the fingerprint that names its group."""
    nodes = own.groupBy("fp").agg(F.min(F.struct(*[c for c in own.columns if c != "fp"])).alias("least"), F.count("*").alias("copies"))
    roots = components(links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    docs: doc_id, text. Fingerprints (16 lowercase hex digits) of word shingles link at three or fewer differing
    bits; component_id is the smallest doc_id that links reach. Null and empty texts have the fingerprint zero
    and link like any other; a null doc_id sorts first; repeated rows come out as often; other columns are ignored.
    """
    own = stored(fingerprints(docs, shingle))
    rooted = _rooted(own)
    groups = rooted.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    ids = stored(rooted.join(groups, "root").select("fp", "copies", "component_id"))
    return join_keyed(own, ids, "fp", own.count()).select(doc_back().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), doc_back("component_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each group, of its smallest doc_id and that id's least text digest; all columns as they came."""
    own = stored(fingerprints(docs, shingle, digest=True))
    first = _rooted(own).groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.doc_id").alias("doc"), F.col("first.digest").alias("digest"))
    keyed = carried(docs, doc=doc_key(), digest=text_digest())
    # Rows of one id and text share a group, so what remains of it are equal texts.
    return keyed.join(first, ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"]).select("row.*")


#: Node numbers (8 bytes each) up to which a table of them is broadcast, so that texts stay where they are; beyond, it is joined by shuffle.
SMALL_NODES = 1_000_000

#: Sampled fingerprints of a text, and the shingles that each samples.
SAMPLED, DRAWN = 32, 6


def shingle_sets(data: np.ndarray, starts: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each row's word shingles, sorted; fewer words are one shingle, none have none."""
    data = _LOWER[data]
    begin, end, first = words_of(data, starts)
    grams = span_hashes(data, begin, end)
    whole = grams.copy()
    for i in range(1, shingle):
        whole[: len(whole) - i] = mix(whole[: len(whole) - i] * np.uint64(31) + grams[i:])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo < shingle:  # hashed on its own, as its last words have no full run
            own = np.array([hash_of(grams[lo:hi])], np.uint64) if hi > lo else grams[:0]
        else:
            own = np.unique(whole[lo : hi - shingle + 1])
        out.append(own)
    return out


def hash_of(words: np.ndarray) -> int:
    """A hash of a few word hashes in order."""
    total = np.array([len(words)], np.uint64)
    for w in words:
        total = mix(total * np.uint64(31) + w)
    return int(total[0])


def sampled_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SAMPLED fingerprints, each of the DRAWN shingles that come first in an order of its own."""
    salts = mix(np.arange(1, SAMPLED + 1, dtype=np.uint64))
    placed = mix(hashes[None, :] ^ salts[:, None])
    if placed.shape[1] > DRAWN:
        placed = np.partition(placed, DRAWN - 1, axis=1)[:, :DRAWN]
    bits = np.unpackbits(placed[:, :, None].view(np.uint8), axis=2, bitorder="little")
    half = bits.sum(axis=1, dtype=np.int64) * 2 > placed.shape[1]
    return np.packbits(half, axis=1, bitorder="little").view("<u8")[:, 0] ^ salts


def _sampled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 2 << 20):
                sets = shingle_sets(*flat_text(part.column(1)), shingle)
                keys = [sampled_fingerprints(x) if len(x) else x for x in sets]
                node = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(node)], names=["key", "node"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 2 << 20):
                sets = [np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in shingle_sets(*flat_text(part.column(1)), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _alike(similarity: float):
    """The pairs whose shingle sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def _small(nodes: DataFrame) -> DataFrame:
    """The table, stored; to be broadcast if it has been counted to be small."""
    kept = stored(nodes)
    return F.broadcast(kept) if kept.count() <= SMALL_NODES else kept


def _near(pairs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have that similarity."""
    wanted = _small(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
    sets = stored(nodes.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(tidied(_sets(shingle)), "node long, set binary"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidied(_alike(similarity)), "a long, b long")


#: Members of a block of a group whose members are compared with one another.
BLOCK = 64


def _open(members: DataFrame, key: str) -> DataFrame:
    """(key, n): the keys whose members are in more than one component, and how many members they have."""
    return members.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(key, "n")


def second_candidates(met: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of nodes of different components that share two keys.

    met: key, node; roots: node, root (a node without a row is its own). Keys with members of one component are done. A node's other
    keys, at most SAMPLED, are taken two by two, which parts a group of many texts that are only somewhat alike. Members of what is left
    meet in cells of a block by a block, so a group of any size is spread over tasks, and none is cut."""
    own = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    left = own.join(_open(own, "key").select("key"), "key")
    listed = left.groupBy("node", "root").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    two = F.flatten(F.transform("keys", lambda k, i: F.transform(F.slice("keys", i + 2, SAMPLED), lambda m: F.xxhash64(k, m))))
    members = listed.select("node", "root", F.explode(two).alias("two"))
    sized = members.join(_open(members, "two"), "two").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = sized.withColumn("at", F.pmod(F.xxhash64("node", "two"), "blocks").cast("int"))
    others = F.explode(F.expr("sequence(0, blocks - 1)"))
    rows = placed.select("two", F.col("at").alias("i"), others.alias("j"), F.col("node").alias("a"), F.col("root").alias("ra"))
    columns = placed.select("two", others.alias("i"), F.col("at").alias("j"), F.col("node").alias("b"), F.col("root").alias("rb"))
    return rows.join(columns, ["two", "i", "j"]).where("a < b AND ra != rb").select("a", "b").distinct()


def second_cells(met: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cell, side, node, root): the pairs of second_candidates() as cells, without a row a pair.

    A cell is two blocks of one group (side 0 and 1; side 0 alone: a block with itself). A member is in as many cells as its
    group has blocks, and each pair of members in one cell. Groups of the same nodes are one."""
    own = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    left = own.join(_open(own, "key").select("key"), "key")
    listed = left.groupBy("node", "root").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    two = F.flatten(F.transform("keys", lambda k, i: F.transform(F.slice("keys", i + 2, SAMPLED), lambda m: F.xxhash64(k, m))))
    members = listed.select("node", "root", F.explode(two).alias("two"))
    # Two checksums and the count tell groups of the same nodes, of which one is taken.
    mark = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    groups = members.groupBy("two").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), mark(1).alias("p"), mark(2).alias("q")).where("lo < hi")
    once = groups.groupBy("n", "p", "q").agg(F.min("two").alias("two")).select("two", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(once, "two").withColumn("at", F.pmod(F.xxhash64("node", "two"), "blocks").cast("int"))
    met_by = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met_by.select(F.struct("two", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).alias("cell"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), "node", "root")


def _cell_links(similarity: float):
    """Links of one cell that connect what its pairs of that similarity connect, at most one fewer than it has members."""

    def run(table: pa.Table) -> pa.Table:
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("set")]
        size = np.array([len(x) for x in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)])
        group = np.unique(root, return_inverse=True)[1]
        a, b = [], []
        for x in range(len(node)):
            fits = (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x])) & (group != group[x]) & (np.arange(len(node)) > x)
            if side.any():
                fits &= side != side[x]
            if not fits.any():
                continue
            seen = np.zeros(len(values), np.int64)
            seen[flat[starts[x] : starts[x + 1]]] = 1
            run_of = np.concatenate([[0], np.cumsum(seen[flat])])
            both = run_of[starts[1:]] - run_of[starts[:-1]]
            for y in np.flatnonzero(fits & (both >= similarity * (size + size[x] - both))).tolist():
                if group[y] != group[x]:
                    a.append(min(node[x], node[y]))
                    b.append(max(node[x], node[y]))
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _cells_linked(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the cells' pairs of that similarity, enough to connect what they connect."""
    return cells.join(sets.select("node", "set"), "node").groupBy("cell").applyInArrow(tidied_group(_cell_links(similarity)), "a long, b long").distinct()


def _near_in_cells(cells: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """_cells_linked() with the sets of the cells' nodes."""
    wanted = _small(cells.select("node").distinct())
    return _cells_linked(cells, stored(nodes.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(tidied(_sets(shingle)), "node long, set binary")), similarity)


def open_nodes(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the nodes with two keys or more whose members are in more than one component."""
    own = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    left = own.join(_open(own, "key").select("key"), "key")
    return left.groupBy("node", "root").agg(F.count_distinct("key").alias("keys")).where("keys > 1").select("node", "root")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of (node, root, set)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            part = batch.slice(at, 1_000)
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column(2)]
            size = np.array([len(x) for x in sets])
            node, root = (np.repeat(part.column(i).to_numpy(), size) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).astype(np.int64))], names=["node", "root", "size", "token"])


def prefix_cells(sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(cell, side, node, root): cells that hold all pairs of nodes of different components whose sets have that Jaccard similarity.

    sets: node, root, set. Prefix filtering: with the shingles of each set in order of how few sets hold them, two such sets share one
    among the first size - ceil(similarity * size) + 1 of each, and in the smaller set it is early, among the first
    size - ceil(2 * similarity / (1 + similarity) * size) + 1. So many texts that are all somewhat alike meet by what few of them
    hold, not by what all hold. A shingle's early members meet one another and the late ones, blocks by blocks (see second_cells);
    late ones alone make no cell. Shingles of the same members are one."""
    rows = sets.select("node", "root", "set").mapInArrow(tidied(_tokens), "node long, root long, size long, token long")
    shared = rows.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    own = Window.partitionBy("node")
    ranked = rows.join(shared, "token").withColumn("left", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("holders", "token")))
    # What no other set holds comes first; `left` is the rest. The small number keeps a whole product whole.
    first = lambda share: F.col("at") <= F.col("left") - F.ceil(F.col("size") * share - 1e-6) + 1
    kept = ranked.where(first(similarity)).select("token", "node", "root", first(2 * similarity / (1 + similarity)).alias("early"))
    mark = lambda seed: F.sum(F.xxhash64("node", "early", F.lit(seed)).cast("decimal(38,0)"))
    groups = kept.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if("early").alias("n"), F.count("*").alias("m"), mark(1).alias("p"), mark(2).alias("q")).where("lo < hi AND n > 0")
    blocks = lambda n: F.ceil(n / block).cast("int")
    once = groups.groupBy("n", "m", "p", "q").agg(F.min("token").alias("token")).select("token", blocks(F.col("n")).alias("soon"), blocks(F.col("m") - F.col("n")).alias("later"))
    drawn = F.pmod(F.xxhash64("node", "token"), F.when(F.col("early"), F.col("soon")).otherwise(F.col("later"))).cast("int")
    placed = kept.join(once, "token").withColumn("at", drawn + F.when(F.col("early"), 0).otherwise(F.col("soon")))
    met_by = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("early"), F.col("soon") + F.col("later")).otherwise(F.col("soon")) - 1)))
    return met_by.select(F.struct("token", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).alias("cell"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), "node", "root")


def near_links(nodes: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): pairs of nodes whose sets of word shingles have at least that Jaccard similarity, enough to connect all that share two keys.

    nodes: node (long, one for each text), text. Each text has SAMPLED keys: the bit majorities of DRAWN of its shingles, those that come
    first in an order of the key's own (min-wise sampling, so two texts share a key with about the power DRAWN of their similarity).
    Each text is first held against the least and the greatest node of each of its keys: two candidates a member and key
    in a group of any size, which connects groups of copies. Then all texts with two keys whose members are not connected yet are joined
    by prefix filtering of the whole sets (prefix_cells), inside cells that give links, not pairs. The sets themselves decide. A pair is
    lost only if it shares fewer than two of the SAMPLED keys: under one in 1,000 at similarity 0.8."""
    keyed = stored(nodes.select("node", "text").mapInArrow(tidied(_sampled(shingle)), "key long, node long"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = stored(keyed.join(ends, "key"))
    pairs = met.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()
    pairs = stored(pairs)
    first = stored(_near(pairs, nodes, shingle, similarity))
    rest = _small(open_nodes(met.select("key", "node"), _small(components(first))))
    sets = stored(nodes.select("node", "text").join(rest.select("node"), "node", "left_semi").mapInArrow(tidied(_sets(shingle)), "node long, set binary").join(rest, "node"))
    cells = stored(prefix_cells(sets, similarity))
    if cells.isEmpty():
        return first
    return first.unionByName(_cells_linked(cells, sets, similarity))


def keep_distinct(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies; all columns as they came.

    First keep_one() leaves one text of those whose fingerprints link; then near_links() finds the pairs among the
    rest whose word shingles have at least that Jaccard similarity, and of what they connect the row of the smallest
    doc_id stays. Null texts are empty; a null doc_id sorts first; texts without words are copies of one another."""
    # Numbers given as the rows are written: different texts never share one.
    rest = stored(carried(keep_one(docs, shingle), doc=doc_key(), node=F.monotonically_increasing_id()))
    nodes = rest.select("node", "doc", F.col("row.text").alias("text"))
    found = components(near_links(nodes, shingle, similarity))
    whole = found.unionByName(found.select("root").distinct().select(F.col("root").alias("node"), "root")).distinct()
    grouped = whole.join(nodes.select("node", "doc"), "node")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc", "node")).alias("first"))
    gone = _small(grouped.join(first, "root").where(F.col("node") != F.col("first.node")).select("node"))
    return rest.join(gone, "node", "left_anti").select("row.*")


def brute_force(rows: list[tuple[int, str | None]], shingle: int = 3) -> list[tuple[int, str, int]]:
    """The same by comparing all pairs; for tests."""
    prints = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if ord(c) in SPACES else c for c in text or "")
        words = [w for w in lowered.split(" ") if w]
        width = min(shingle, len(words))
        values = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)] if words else []
        prints.append(sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values)))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= BITS:
                parent[root(i)] = root(j)
    least: dict[int, int] = defaultdict(lambda: 1 << 62)
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], doc)
    return [(doc, f"{prints[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows)]
