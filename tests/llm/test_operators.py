"""Small cases of each corpus operator against brute force: nulls, empties, ties, repeats, long texts, clashing names."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, common, hnsw_search, mixture, phrase_dedup, quality_model, shard_store, simhash_dedup, suffix_dedup, syncmer_prints, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, first string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, periodic and very long texts, nulls and odd white space."""
    rng = random.Random(seed)
    passage, other = words(rng, 60), words(rng, 45)
    base = words(rng, 200)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base.replace(" ", "\n", 1), base + " more", words(rng, 30) + " " + passage + " " + words(rng, 20), passage, words(rng, 10) + "\x0b" + passage, "ha " * 150, "x" * 500, "x" * 480, other + " " + words(rng, 5) + " " + other, words(rng, 3000), "Ünï " + " " + "code \U0001f600 " * 20, words(rng, 34), words(rng, 35), "a" * 49, "b" * 50, "b" * 50]
    rows = [(i * 3 if i != 4 else None, t, "en", "s", 0, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5]]  # one row twice


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in corpus()]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup(docs, pairs, length):
    same(suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, length)), suffix_dedup.brute_force(pairs, length))


@pytest.mark.parametrize("length", [35, 12])
def test_phrase_dedup(docs, pairs, length):
    same(phrase_dedup.digest(phrase_dedup.phrase_dedup(docs, length)), phrase_dedup.brute_force(pairs, length))


def test_without_phrases_keeps_columns(docs):
    out = phrase_dedup.without_phrases(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 30").first().text == ""


def test_prefix_lengths_equal_direct_ones():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 400).astype(np.uint16)
    text[100:180] = text[300:380]
    text[-1] = 0
    order = suffix_dedup.suffix_order(text, 30)
    got = suffix_dedup.bounded_prefix_lengths(text, order, 30)
    ring = np.concatenate([text, text])
    for i in range(1, len(text)):
        a, b = ring[order[i - 1] : order[i - 1] + 400], ring[order[i] : order[i] + 400]
        common = int(np.argmax(a != b)) if (a != b).any() else 400
        assert got[i] == (common if common < 30 else -1)


def test_simhash(docs, pairs):
    rows = [(-(1 << 63) if d is None else d, t) for d, t in pairs]
    want = [(None if d == -(1 << 63) else d, f, None if c == -(1 << 63) else c) for d, f, c in simhash_dedup.brute_force(rows)]
    same(simhash_dedup.simhash_groups(docs), want)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_join_keyed_finds_all_rows(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(3_000)], "doc_id long, fp long")
    table = rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    got = common.join_keyed(rows, table, "fp", 3_000)
    assert sorted(got.columns) == ["doc_id", "fp", "least"]
    assert {(r.doc_id, r.least) for r in got.collect()} == {(i, 0 if i % 3 == 0 else i) for i in range(3_000)} and got.count() == 3_000


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 2])
def test_simhash_links_all_within_three_bits(spark, hot):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4) for _ in range(6)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df, hot)).collect()}
    nodes = sorted(r.fp for r in df.collect())
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(found.get(n, n) == root(n) for n in nodes)


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (64, 16), (40, 2)])
def test_bpe_round_trip(docs, pairs, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, len(x := whole.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs]
    same(byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs, chunk=chunk, overlap=overlap))), want)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_token_counts(docs, pairs, block):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same(token_counts.token_counts(docs, block=block), [(d, len(whole.encode_ordinary(t or ""))) for d, t in pairs])


def test_syncmer_prints(docs, pairs):
    out = syncmer_prints.document_prints(docs).collect()
    rows = sorted(((-(1 << 63) if d is None else d), t or "") for d, t in pairs)
    want = {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        want.setdefault(d, set()).add((len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    for r in out:
        assert (r.n_chars, r.edited_sha256) in want[-(1 << 63) if r.doc_id is None else r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in out}
    assert by[15].fingerprint == by[18].fingerprint and by[0].fingerprint == "" == by[3].fingerprint
    assert by[48].near_edited > 0.5 > by[48].near_next and len(out) == len(pairs)


def test_syncmer_anchors_equal_brute_force(spark):
    k = syncmer_prints.K
    rng = np.random.default_rng(1)
    hashes = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 40)]
    df = spark.createDataFrame([(hashes,)], "h array<long>")
    got = [c >> syncmer_prints.BITS for c in df.select(syncmer_prints.anchors(F.col("h"))).first()[0]]
    want = [i // syncmer_prints.CELL for i in range(len(hashes) - k + 1) if min(hashes[i], hashes[i + k - 1]) <= min(hashes[i + 1 : i + k - 1])]
    assert got == want


@pytest.mark.parametrize("n", [0, 3, 400])
def test_hnsw(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one very common vector
        rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, []), (2200, [None] * 16), (2250, [1.0] * 4), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in hnsw_search.search(hnsw_search.build_index(df, shard=150), df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")).collect()]
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 16]
    want = hnsw_search.brute_force(good) if good else []
    assert len(got) == len(want)
    truth = {(q, v): s for q, _, v, s in want}
    mine = {(q, v): s for q, _, v, s in got}
    assert not want or len(truth.keys() & mine.keys()) / len(truth) >= 0.95
    assert all(abs(truth[x] - mine[x]) < 1e-12 for x in truth.keys() & mine.keys())
    if n > 100:
        spark_truth = spark.createDataFrame([(q, v) for q, _, v, _ in want], "query_id long, vec_id long")
        found = spark.createDataFrame(got, "query_id long, rank int, vec_id long, score double")
        assert hnsw_search.recall(found, spark_truth) >= 0.95


def test_nearest_neighbours_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank, r.score) for r in hnsw_search.nearest_neighbours(df).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in quality_model.scores(docs, quality_model.train(docs, labels)).collect()}
    held = [(r.quality, out[r.doc_id]) for r in labels.collect() if out[r.doc_id].held_out]
    assert np.mean([a == b.predicted for a, b in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.train(docs, none)
    assert {r.score for r in quality_model.scores(docs, model).collect()} == {0.5}
    assert quality_model.keep_good(docs, model).columns == docs.columns
    assert list(quality_model.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))) == [0.0, 0.5, 0.5, 1.0]


def test_raking_meets_targets(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", k, float(rng.randrange(10, 100))) for i in range(3) for j in range(2) for k in range(2)], "source string, lang string, topic int, tokens double")
    goal = {"source": spark.createDataFrame([("s0", 0.5), ("s1", 0.3), ("s2", 0.2)], "source string, share double"), "lang": mixture.tempered(cells, "lang", 0.0), "topic": mixture.tempered(cells, "topic", 1.0)}
    out = mixture.rake(cells, goal)
    for axis, table in goal.items():
        got = {r[0]: r[1] for r in out.groupBy(axis).agg(F.sum("weight")).collect()}
        assert all(abs(got[r[0]] - r[1]) < 1e-3 for r in table.collect())
    kept = mixture.with_probability(out, 0.5).agg(F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens"), F.max("probability")).first()
    assert abs(kept[0] - 0.5) < 1e-3 and kept[1] <= 1


def test_mix_sources(docs):
    out = mixture.mix_sources(docs.withColumn("mix", F.lit(1)))
    rows = mixture.digest(out).collect()
    assert len(rows) == docs.count() and all(r.probability == 1.0 for r in rows if r.tokens == 0)
    assert all(0 <= r.probability <= 1 for r in rows)


def test_shard_store(spark, docs, tmp_path):
    root = str(tmp_path / "store")
    assert shard_store.append(docs, root, arrival=6) == 1
    assert shard_store.append(docs.where("doc_id > 40").withColumn("doc_id", F.col("doc_id") + 1000), root, arrival=6) == 2
    before = shard_store.manifest(spark, root).count()
    assert shard_store.compact(spark, root, docs, target=2_000) == 3
    assert shard_store.versions(spark, root) == [1, 2, 3] and shard_store.manifest(spark, root).count() < before
    now = shard_store.read(spark, root, docs)
    assert now.count() == docs.count() + docs.where("doc_id > 40").count()
    assert shard_store.read(spark, root, docs, 1).count() == docs.count()
    assert now.select(*docs.columns).where("doc_id < 1000 or doc_id is null").exceptAll(docs).count() == 0
    with pytest.raises(Exception, match="exist"):
        shard_store.commit(spark, root, shard_store.manifest(spark, root), 3)


EMPTY = [suffix_dedup.suffix_dedup, phrase_dedup.phrase_dedup, simhash_dedup.simhash_groups, syncmer_prints.document_prints, byte_bpe.encode, token_counts.token_counts, mixture.mix_sources, shard_store.sharded]


@pytest.mark.parametrize("operator", EMPTY, ids=lambda f: f.__name__)
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_topics_are_fitted_on_all_documents(spark):
    """Weights of all 20,100 texts, and centres that one more round over all of them leaves as they are or ROUNDS have moved."""
    texts = [f"a{i % 97} b{i % 89} c{i % 83} {'rare' if i == 20_050 else 'd'}" for i in range(20_100)]
    df = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    vectors = common.stored(mixture.counted(df))
    fitted = mixture.fit_topics(vectors)
    counts = np.array([np.frombuffer(r.counts, "<u4") for r in vectors.collect()])
    assert len(counts) == 20_100
    assert np.allclose(fitted.weights, np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1)
    out = mixture.annotated(vectors, "mix", fitted)
    assert out.columns == ["doc_id", "source", "lang", "mix"] and out.count() == 20_100
    assert {r.doc_id: r.mix.topic for r in out.collect()} == dict(zip([r.doc_id for r in vectors.select("doc_id").collect()], fitted.of(counts).tolist(), strict=True))
