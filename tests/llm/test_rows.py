"""Rows that share a doc_id, or have none, are judged by their own texts."""

import hashlib
import random

from tessera.llm import phrase_dedup, simhash_dedup, suffix_dedup


DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, first string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def same(df, want):
    def key(r):
        return tuple((x is None, x if x is not None else 0) for x in r)

    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def shared(seed=4):
    """Null ids and one repeated id with different texts, of which some hold a passage that recurs."""
    rng = random.Random(seed)
    passage, other = words(rng, 60), words(rng, 45)
    late = words(rng, 900) + " " + passage
    rows = [(None, late), (None, words(rng, 50)), (None, words(rng, 1000)), (1, words(rng, 20) + " " + passage), (7, late[:40] + " " + other), (7, words(rng, 30)), (7, words(rng, 80) + " " + other), (7, words(rng, 200) + " " + passage), (9, other)]
    return [*rows, rows[2], rows[2], (9, rows[3][1])]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t), str(i), "f") for i, (d, t) in enumerate(rows)], DOCS).repartition(3)


def test_phrases_of_rows_that_share_an_id(spark):
    same(phrase_dedup.digest(phrase_dedup.phrase_dedup(table(spark, shared()))), phrase_dedup.brute_force(shared()))


def test_bytes_of_rows_that_share_an_id(spark):
    same(suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, shared()))), suffix_dedup.brute_force(shared()))


def test_near_dedup_keeps_one_row_of_a_group(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    rows = [(None, a), (None, a), (3, a), (None, b), (4, b), (5, c), (5, c), (5, d), (6, d), (2, d), (8, None), (8, ""), (None, "")]
    got = simhash_dedup.keep_one(table(spark, [(i, t or "") for i, t in rows])).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got) == sorted([(-1, a), (-1, b), (5, c), (2, d), (-1, "")])


def test_rows_that_share_an_id_keep_their_own_text(spark):
    rows = shared()
    left = {(d, t): k for (d, t), k in zip(rows, phrase_dedup.brute_force(rows), strict=True)}
    got = phrase_dedup.without_phrases(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        d, t = rows[int(r.spans)]
        assert d == r.doc_id and r.n_chars == len(r.text)
        assert r.text == t if not left[d, t][2] else hashlib.sha256(r.text.encode()).hexdigest() == left[d, t][3]
