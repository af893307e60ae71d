"""Lexical search, language identification and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, language_id, lexical_search, periodic_runs

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, item_id long, n long, term string, digest string, item string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, 7, 7, "x", "x", "x", "x") for d, t, lang in rows], DOCS).repartition(3)


# Ranked lexical search.


def ranked(docs, items, k=10):
    split = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    split = [(d, c) for d, c in split if c]
    n_docs, n_terms = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in split:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scores)[:k])]
    return out


def odd_documents(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "É", "é", "ZEBRA", "zebra", "x1", "1x", "naïve", "日本", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 10, 40, 400]))) for _ in range(60)]
    texts += [None, "", " \n\x00--", "a_b~c", "The" * 3, "zebra " * 5000, "w1\x7fw2", "w1 w2"]
    docs = [(rng.choice([None, *range(30)]), t) for t in texts]
    docs += [(4, "zebra x1")] * 15 + [(i, "copied w7 w8 zebra") for i in range(100, 130)]
    items = [(1, "the zebra"), (1, "the zebra"), (1, "w7 copied"), (None, "W1 w2 w3 w3 É"), (3, None), (4, ""), (5, "nowhere"), (6, "naïve 日本 x1"), (7, " ".join(vocabulary))]
    return docs, items


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.mark.parametrize("width", [16, 1 << 10, 1 << 20])
def test_search_is_exact_at_any_width(spark, width):
    docs, items = odd_documents(width)
    index = lexical_search.build_index(frame(spark, [(d, t, "en") for d, t in docs]), width)
    got = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string").repartition(2))
    assert order(got.collect()) == order(ranked(docs, items))


def test_search_in_batches_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BATCH", 30)
    monkeypatch.setattr(lexical_search, "FEW", 0)
    monkeypatch.setattr(lexical_search, "TERMS", 5)
    monkeypatch.setattr(lexical_search, "CELLS", 3)
    docs, items = odd_documents(3)
    got = lexical_search.ranked_search(frame(spark, [(d, t, "en") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert order(got.collect()) == order(ranked(docs, items, 3))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.ranked_search(none, item).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.ranked_search(none, item).count() == lexical_search.ranked_search(one, item.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.ranked_search(one, item).collect()] == ranked([(1, "a b")], [(1, "a")])


def test_bounds_hold_and_are_narrow(spark):
    """No bound is under its score, and at the full width the sum of bounds is near the sum of scores."""
    docs = catalog.documents(spark, SF)
    index = lexical_search.build_index(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    queries = lexical_search._asked(index, items)
    sent = spark.sparkContext.broadcast((len(items), queries.tables(index.width)))
    sketches = index.rows.where("term is null").select("doc_id", "digest", "n", "places", "codes")
    bounds = sketches.mapInArrow(lexical_search._reaching(sent, np.ones(len(items), np.int64), index.n_docs, index.n_terms), lexical_search.BOUND).persist()
    exact = lexical_search._scored(index, queries, bounds)
    both = exact.join(bounds, ["item", "doc_id", "digest"], "left").agg(F.sum((F.coalesce("bound", F.lit(-1)) < F.col("score")).cast("int")).alias("low"), F.sum("bound").alias("bounds"), F.sum("score").alias("scores")).first()
    assert both.low == 0 and both.bounds <= 1.02 * both.scores


def test_codes_reach_their_counts():
    counts = np.array([*range(1, 3000), 10**6, 2**31])
    at = np.searchsorted(lexical_search.CODES, counts)
    assert (lexical_search.CODES[at] >= counts).all() and (lexical_search.CODES[at - 1] < counts).all() and 2**31 < lexical_search.CODES[-1] < 9 * 10**9


# Language identification.


def test_languages_of_the_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in catalog.documents(spark, SF).collect()}
    rows = catalog.op12_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    sure = [r for r in held if r.accepted]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert len(sure) >= 0.95 * len(held) and sum(r.lang_pred == lang[r.doc_id] for r in sure) >= 0.99 * len(sure)


def own_language(rng, letters, n=80):
    fixed = random.Random(letters.lower())
    vocabulary = ["".join(fixed.choices(letters, k=fixed.randrange(3, 8))) for _ in range(40)]
    return " ".join(rng.choices(vocabulary, k=n))


def language_rows():
    rng = random.Random(2)
    rows = [(i, own_language(rng, "abcd"), "aa") for i in range(20)] + [(i + 20, own_language(rng, "éèçß"), "bb") for i in range(10)]
    return [*rows, (None, own_language(rng, "abcd"), "aa"), (50, None, "aa"), (51, "", "bb"), (52, "123 --- \n", "aa"), (53, "a", None), (54, own_language(rng, "abcd", 40_000), None), (55, own_language(rng, "éèçß", 60), None), (55, own_language(rng, "ABCD", 60), None), *[(60, own_language(random.Random(9), "éèçß"), "bb")] * 5]


def test_sizes_by_plain_compression(spark):
    rows = language_rows()
    docs = frame(spark, rows)
    model = language_id.learn(docs)
    assert model.names == ["aa", "bb"]  # 21 and 15 documents
    assert model.dictionaries[1].count(language_id.prepared(own_language(random.Random(9), "éèçß"))) == 1  # copies teach once
    coders = model.coders()
    want = []
    for doc, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            want.append((doc, None if text is None else len(text), "und", 0.0, 0.0, None))
            continue
        body = language_id.prepared(text)
        sizes = [sum(len(c.compress(body[i : i + 2048])) for i in range(0, len(body), 2048)) for c in coders]
        best = model.names[sizes.index(min(sizes))]
        want.append((doc, len(text), best, 1 / sum(2.0 ** max(min(sizes) - s, -1000) for s in sizes), 1 - min(sizes) / max(sizes), dict(zip(model.names, sizes, strict=True))))
    got = [(r.doc_id, r.best, r.score, r.lead, r.sizes) for r in language_id.identify(docs, model).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted([(d, b, s, m, z) for d, _, b, s, m, z in want], key=key)
    assert {r[1] for r in got if r[0] == 54} == {"aa"} and sorted(r[1] for r in got if r[0] == 55) == ["aa", "bb"]


def test_narrow_leads_are_rejected_and_ties_go_to_the_commoner(spark):
    model = language_id.LanguageModel(["zz", "aa"], [b" same words here ", b" same words here "])
    one = frame(spark, [(1, "same words here", None)])
    assert [(r.best, r.lang, r.score) for r in language_id.identify(one, model).collect()] == [("zz", None, 0.5)]
    assert language_id.identify(one, model, least_lead=0.0).first().lang == "zz"


def test_languages_of_empty_or_untaught_tables(spark):
    assert language_id.languages(frame(spark, []).limit(0)).count() == 0
    untaught = language_id.languages(frame(spark, [(1, "some text", None), (None, "more", "en")])).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


# Periodic runs.


def plain_runs(w):
    n, seen, out = len(w), set(), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in catalog.documents(spark, "/root/testdata/sf0.001").collect()]
    got = [tuple(r) for r in catalog.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(plain_digest(d, t) for d, t in docs) and any(r[1] for r in got)


def test_runs_of_odd_documents(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a", "a " * 24, "a " * 23, "é b " * 40, " ".join("ab" * 30), ("x y z " * 9 + "q ") * 5, " ".join(rng.choices("ab", k=300)), "w\x0bw\x0c" * 100, "long " * 9000, "x" * 5000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "b " * 30, "en"), (3, "c d " * 20, "en"), (3, "c d " * 20, "en")]
    got = periodic_runs.digest(periodic_runs.periodic_runs(frame(spark, rows), periodic_runs.looped_tail)).collect()
    assert order(got) == order(plain_digest(d, t) for d, t, _ in rows)
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def random_words(rng, n):
    w = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 10 else 0):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        for i in range(a, min(n, a + rng.randrange(n))):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("shared", [4096, 50])
def test_runs_by_brute_force(monkeypatch, shared):
    monkeypatch.setattr(periodic_runs, "SHARED", shared)
    monkeypatch.setattr(periodic_runs, "TOGETHER", 1 << 21 if shared > 50 else 64)
    monkeypatch.setattr(periodic_runs, "_GRIDS", {})
    rng = random.Random(shared)
    for _ in range(300):
        w = random_words(rng, rng.choice([0, 1, 23, 24, 25, 40, 70, 120, 300]))
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64)).tolist()] == plain_runs(w)


def test_extensions_by_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        w = random_words(rng, rng.choice([1, 5, 31, 62, 200]))
        ext = periodic_runs.Extensions(np.array(w, np.int64))
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(w) + 1) for j in range(len(w) + 1) if i != j], strict=True))
        want = [next(k for k in range(len(w) + 1) if max(i, j) + k == len(w) or w[i + k] != w[j + k]) for i, j in zip(a, b, strict=True)]
        assert ext.common(a, b).tolist() == want


def test_cover_takes_every_pair_of_places_into_itself():
    assert {(x - y) % periodic_runs.CYCLE for x in periodic_runs.COVER for y in periodic_runs.COVER} == set(range(periodic_runs.CYCLE))
