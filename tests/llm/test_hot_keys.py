"""Keys that occur often are cut into single windows, and the result stays the same."""

import random

import pytest

from tessera.llm import phrase_dedup, repeats, suffix_dedup


@pytest.mark.parametrize("operator", [suffix_dedup, phrase_dedup], ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_hot_keys(spark, monkeypatch, operator):
    monkeypatch.setattr(repeats, "HOT", 3)
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    common, passage = words(12), words(50)
    rows = [(i, f"{words(rng.randrange(40))} {common} {words(30)} {passage if i % 3 == 0 else common} {words(3)}") for i in range(30)]
    rows += [(50, passage), (51, passage), (51, passage), (None, passage + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    run = operator.suffix_dedup if operator is suffix_dedup else operator.phrase_dedup
    key = lambda r: (r[0] is None, str(r))
    assert sorted((tuple(r) for r in operator.digest(run(df)).collect()), key=key) == sorted(operator.brute_force(rows), key=key)
