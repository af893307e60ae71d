"""Operator 1: approximate nearest neighbours by a navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard is
one task: it builds a hierarchical graph, kept as one row with flat neighbour
arrays, that any task can search. Queries go to all shards in blocks; the shards'
nearest are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import stored

#: Vectors of a shard (on average), queries of a block, links of a node (twice as many at the ground),
#: candidates kept while building, and while searching.
SHARD, BLOCK, LINKS, BUILD, SEARCH = 16_384, 256, 16, 96, 192

#: Blocks that meet a shard in one task; beyond that the shard is read by several tasks.
TOGETHER = 32


@dataclass
class Graph:
    """A shard: unit vectors, and for each level its nodes and their neighbours (-1: none), flat."""

    vectors: np.ndarray
    levels: list[np.ndarray]
    neighbours: list[np.ndarray]


def _beam(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes that a best-first walk over `table` finds for each query: (node, similarity), nearest first.

    entry: nodes to start from for each query (-1: none). table has a row for each node."""
    count = len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(vectors) + 1), bool)
    seen[rows, entry] = True
    seen[:, -1] = True  # the node -1 is always seen
    score = np.where(entry >= 0, np.einsum("qed,qd->qe", vectors[entry], queries), -np.inf)
    node = entry
    if node.shape[1] < width:
        pad = width - node.shape[1]
        node = np.pad(node, ((0, 0), (0, pad)), constant_values=-1)
        score = np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf)
    done = node < 0
    live = np.arange(count)
    while len(live):
        open_score = np.where(done[live], -np.inf, score[live])
        pick = open_score.argmax(1)
        going = open_score[np.arange(len(live)), pick] > -np.inf
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live, pick] = True
        near = table[node[live, pick]]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near = np.where(new, near, -1)
        near_score = np.where(new, np.einsum("qed,qd->qe", vectors[near], queries[live]), -np.inf)
        all_node = np.concatenate([node[live], near], 1)
        all_score = np.concatenate([score[live], near_score], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        best = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        node[live], score[live], done[live] = all_node[at, best], all_score[at, best], all_done[at, best]
    order = np.argsort(-score, axis=1, kind="stable")
    return node[rows, order], score[rows, order]


def _diverse(vectors: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by nearness, those nearer to the owner than to any chosen before; then the nearest others."""
    count, width = node.shape
    pair = np.einsum("qad,qbd->qab", vectors[node], vectors[node])
    chosen = np.zeros((count, width), bool)
    for c in range(width):
        blocked = (chosen[:, :c] & (pair[:, c, :c] > score[:, c : c + 1])).any(1)
        chosen[:, c] = ~blocked & (node[:, c] >= 0)
    place = np.argsort(np.where(chosen, 0, np.where(node >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(node, place, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def build_graph(unit: np.ndarray, seed: int = 7) -> Graph:
    """Insert vectors batch by batch: each batch walks the graph so far, level by level from the top."""
    n = len(unit)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 4)
    order = np.argsort(-level, kind="stable")  # high nodes first, so each level's graph is whole before it is walked
    padded = np.concatenate([unit, np.zeros((1, unit.shape[1]), unit.dtype)])  # row -1
    tables = [np.full((n + 1, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(level.max(initial=0)) + 1)]
    at = 0
    while at < n:
        size = min(max(1, at // 2), 512, n - at)
        batch = order[at : at + size]
        entry = np.full((size, 1), order[0], np.int64)
        for lv in range(len(tables) - 1, -1, -1):
            inside = level[batch] >= lv
            width = BUILD if inside.any() else 1
            if at:
                node, score = _beam(padded, tables[lv], padded[batch], entry, width)
                if inside.any():
                    _link(padded, tables[lv], batch[inside], node[inside], score[inside])
                entry = node[:, :LINKS]
        at += size
    graph = [np.flatnonzero(level >= lv) for lv in range(len(tables))]
    return Graph(unit, graph, [t[nodes] for t, nodes in zip(tables, graph, strict=True)])


def _link(vectors: np.ndarray, table: np.ndarray, own: np.ndarray, node: np.ndarray, score: np.ndarray) -> None:
    """Link new nodes with diverse candidates, both ways; full nodes choose again among old and new links."""
    most = table.shape[1]
    to = _diverse(vectors, node, score, min(most, LINKS))
    table[own, : to.shape[1]] = to
    back, source = to.ravel(), np.repeat(own, to.shape[1])
    source, back = source[back >= 0], back[back >= 0]
    order = np.argsort(back, kind="stable")
    source, back = source[order], back[order]
    owner, first, count = np.unique(back, return_index=True, return_counts=True)
    for lo in range(0, len(owner), 256):
        o, f, c = owner[lo : lo + 256], first[lo : lo + 256], count[lo : lo + 256]
        wide = np.full((len(o), int(c.max())), -1, np.int64)
        place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        wide[np.repeat(np.arange(len(o)), c), place] = source[f[0] : f[0] + int(c.sum())]
        have = np.concatenate([table[o], wide], 1)
        near = np.where(have >= 0, np.einsum("qed,qd->qe", vectors[have], vectors[o]), -np.inf)
        by = np.argsort(-near, axis=1, kind="stable")
        have, near = np.take_along_axis(have, by, 1), np.take_along_axis(near, by, 1)
        full = (have >= 0).sum(1) > most
        table[o[~full]] = have[~full, :most] if have.shape[1] >= most else np.pad(have[~full], ((0, 0), (0, most - have.shape[1])), constant_values=-1)
        if full.any():
            table[o[full]] = _diverse(vectors, have[full], near[full], most)


def search_graph(graph: Graph, queries: np.ndarray, width: int) -> np.ndarray:
    """Nodes near each query, nearest first (-1: none)."""
    padded = np.concatenate([graph.vectors, np.zeros((1, graph.vectors.shape[1]), graph.vectors.dtype)])
    entry = np.full((len(queries), 1), graph.levels[-1][0], np.int64)
    for lv in range(len(graph.levels) - 1, -1, -1):
        table = np.full((len(padded), graph.neighbours[lv].shape[1]), -1, np.int32)
        table[graph.levels[lv]] = graph.neighbours[lv]
        entry, _ = _beam(padded, table, queries, entry, width if lv == 0 else 8)
    return entry


def _usable(column: str):
    """Not null, not empty, all components finite, and not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


_INDEX = "dim int, shard int, ids binary, vectors binary, keep binary, levels array<binary>, neighbours array<binary>"


def _build(table: pa.Table) -> pa.Table:
    """The index row of a shard. Equal vectors are one node; `keep` tells each row's node."""
    ids = table["vec_id"].to_numpy()
    dim = table["dim"][0].as_py()
    raw = np.array(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], raw[order]
    node, where = np.unique(raw, axis=0, return_inverse=True)
    graph = build_graph(_unit(node).astype(np.float32))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()]), "vectors": pa.array([raw.tobytes()]), "keep": pa.array([where.astype("<i4").tobytes()]), "levels": pa.array([[x.astype("<i4").tobytes() for x in graph.levels]]), "neighbours": pa.array([[x.astype("<i4").tobytes() for x in graph.neighbours]])})


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """An index row for each shard. vectors: vec_id, embedding (array of float or double); unusable rows are left out."""
    usable = vectors.where(_usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    shards = max(1, -(-usable.count() // shard))
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _searcher(k: int, width: int):
    def search_shard(index: pa.Table, blocks: pa.Table) -> pa.Table:
        """The nearest in one shard of the queries of some blocks."""
        out_q, out_v, out_s = ([np.zeros(0, t)] for t in ("<i8", "<i8", "<f8"))
        if index.num_rows and blocks.num_rows:
            row = index.slice(0, 1).to_pylist()[0]
            ids, unit = np.frombuffer(row["ids"], "<i8"), _unit(np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]))
            where = np.frombuffer(row["keep"], "<i4")
            levels = [np.frombuffer(x, "<i4") for x in row["levels"]]
            flat = [np.frombuffer(x, "<i4").reshape(len(lv), -1) for x, lv in zip(row["neighbours"], levels, strict=True)]
            members = np.argsort(where, kind="stable")  # ids ascend within a node
            first = np.searchsorted(where[members], np.arange(where.max() + 2))
            graph = Graph(unit[members[first[:-1]]].astype(np.float32), levels, flat)
            for block in blocks.to_pylist():
                query_ids = np.frombuffer(block["query_ids"], "<i8")
                wanted = _unit(np.frombuffer(block["query_vectors"], "<f8").reshape(-1, row["dim"]))
                for i, nodes in enumerate(search_graph(graph, wanted.astype(np.float32), width)):
                    # Copies of a vector are one node; k + 1 of them are enough, the query itself included.
                    own = np.concatenate([members[first[j] : min(first[j] + k + 1, first[j + 1])] for j in nodes[nodes >= 0].tolist()])
                    own = own[ids[own] != query_ids[i]]
                    score = np.clip((unit[own] * wanted[i]).sum(axis=1), -1.0, 1.0)
                    best = np.lexsort((ids[own], -score))[:k]
                    out_q.append(np.full(len(best), query_ids[i]))
                    out_v.append(ids[own[best]])
                    out_s.append(score[best])
        return pa.table([np.concatenate(x) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    return search_shard


def _blocks(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    raw = np.array(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": table["block"].slice(0, 1), "query_ids": pa.array([table["query_id"].to_numpy().astype("<i8").tobytes()]), "query_vectors": pa.array([raw.tobytes()])})


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = SEARCH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, nearest first, ties to the smaller vec_id.

    queries: query_id, embedding. A candidate with the query's own id takes no part; score is the cosine in double
    precision on the original vectors; vectors of another length are no candidates. Unusable queries have no rows.
    Queries meet the shards in blocks, never row by row.
    """
    usable = queries.where(_usable("embedding") & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    count = max(1, -(-usable.count() // block))
    blocks = usable.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")).groupBy("dim", "block").applyInArrow(_blocks, "dim int, block int, query_ids binary, query_vectors binary")
    teams = -(-count // TOGETHER)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    sent = blocks.withColumn("team", F.pmod("block", F.lit(teams))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ready = index.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
    found = ready.groupBy("dim", "shard", "team").cogroup(sent.groupBy("dim", "shard", "team")).applyInArrow(_searcher(k, width), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by `every`, among all others.

    vectors: vec_id, embedding. Null, empty and zero vectors and those with null or non-finite components take no
    part, as rows with a null vec_id; fewer than k candidates are all returned; a vec_id that comes twice is two
    candidates; other columns are ignored.
    """
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(stored(build_index(vectors)), queries, k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours (query_id, vec_id) that were found."""
    hit = truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, truth.count())


def brute_force(rows: list[tuple[int, list[float]]], every: int = 50, k: int = 5) -> list[tuple[int, int, int, float]]:
    """All cosines; for tests and for recall."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    ids = np.array([i for i, _ in good])
    out = []
    for q in np.flatnonzero(ids % every == 0).tolist():
        score = (unit * unit[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out
