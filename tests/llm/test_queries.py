"""The registered queries and the pipeline, on the smallest tables."""

import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import duck, same  # noqa: E402

from tessera.llm import catalog, hnsw_search, phrase_dedup, simhash_dedup, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
Q = catalog.queries()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in catalog.documents(spark, SF).collect()]


def test_queries_in_order():
    assert [n.split("_")[0] for n in Q] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name,brute", [("op5_suffix_dedup", suffix_dedup.brute_force), ("op6_simhash_dedup", simhash_dedup.brute_force), ("op7_phrase_dedup", phrase_dedup.brute_force)])
def test_against_brute_force(spark, texts, name, brute):
    assert rows(Q[name](spark, SF)) == sorted(brute(texts))


def test_search_recall(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(q, v) for q, _, v, _ in hnsw_search.brute_force(vectors)}
    got = {(r.query_id, r.vec_id) for r in Q["op1_hnsw_search"](spark, SF).collect()}
    assert len(want & got) / len(want) >= 0.95


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert same(Q[name](spark, SF), duck(SF), catalog.oracle_sql()[name]) == ""


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = catalog.documents(spark, SF)
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            kept = {r.doc_id for r in docs.collect()}
            taught = {d: q for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5}
            assert all(taught.get(d, 1) for d in kept) and sum(d in kept for d, q in taught.items() if q) >= 0.95 * sum(taught.values())
        if i == 1:
            first = {}
            for d, t in sorted((r.doc_id, r.text) for r in docs.collect()):
                assert t not in first
                first[t] = d
    assert docs.count() > 0


def test_quality_stage_drops_held_out_bad_documents(spark):
    """Of the documents that are labelled bad and were not learned from, a tenth at most stays."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, catalog.documents(spark, sf), sf).select("doc_id").collect()}
    bad = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert bad and sum(d in kept for d in bad) <= 0.1 * len(bad)
