"""The near-dedup stage against all pairs of five-word shingle sets."""

import random

from tessera.llm import simhash_dedup


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def corpus(seed=8):
    """Bases with copies of some changed words each, unrelated texts, short ones, nulls and repeated ids."""
    rng = random.Random(seed)
    rows = []
    for g in range(40):
        base = words(rng, rng.randrange(60, 400))
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0.0, 0.003, 0.01, 0.015, 0.05]))):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (None, "four words are few"), (502, "four words are few"), (503, "Four words are FEW"), (7, "another text of this id here"), (7, "and one more of the same id")]
    return rows


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, node long, first string").repartition(3)
    out = simhash_dedup.keep_distinct(df)
    assert out.columns == df.columns
    kept = [r.node for r in out.collect()]
    sets = [shingles(t) for _, t in rows]
    # No clean text goes: what is missing is near to something that is there or linked to it.
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or near(sets[i], sets[j]):
                parent[root(i)] = root(j)
    groups = {root(i) for i in range(len(rows))}
    assert {root(i) for i in kept} == groups
    assert len(kept) <= len(groups) * 1.01 + 1
    assert len(set(kept)) == len(kept)


def test_pairs_that_share_a_boilerplate(spark):
    """Texts that are all alike to 0.7; each has one partner at 0.8 and more, which must be found."""
    rng = random.Random(3)
    common = words(rng, 330)
    rows = []
    for g in range(100):
        shared = words(rng, 34)
        for _ in range(2):
            rows.append((len(rows), " ".join(common + shared + words(rng, 40))))
    sets = [shingles(t) for _, t in rows]
    want = {(i, i + 1) for i in range(0, 200, 2)}
    assert all(near(sets[i], sets[j]) for i, j in want) and not near(sets[0], sets[2])
    df = spark.createDataFrame(rows, "node long, text string").repartition(3)
    got = {(r.a, r.b) for r in simhash_dedup.near_links(df).collect()}
    assert got == want


def test_second_candidates_are_all_unconnected_pairs_of_two_keys(spark):
    """At any block, against all pairs."""
    rng = random.Random(4)
    keys = {n: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for n in range(120)}
    roots = {n: n % 7 for n in range(120) if n % 3}
    root = lambda n: roots.get(n, n)
    want = {(a, b) for a in keys for b in keys if a < b and root(a) != root(b) and len(keys[a] & keys[b]) > 1}
    met = spark.createDataFrame([(k, n) for n, own in keys.items() for k in own], "key long, node long").repartition(3)
    rooted = spark.createDataFrame(list(roots.items()), "node long, root long")
    for block in (2, 5, 1000):
        assert sorted(map(tuple, simhash_dedup.second_candidates(met, rooted, block).collect())) == sorted(want)
    assert simhash_dedup.second_candidates(met, spark.createDataFrame([(n, 0) for n in keys], "node long, root long")).count() == 0


def test_inner_pairs_of_a_key_are_connected(spark):
    """A chain whose members are each near only to the next: neither is an end of most keys."""
    rng = random.Random(6)
    text = words(rng, 300)
    rows = []
    for i in range(40):
        rows.append((i * 7919 % 1009, " ".join(text)))
        text = words(rng, 30) + text[:-30]
    near_ones = [(a, b) for a, x in rows for b, y in rows if a < b and near(shingles(x), shingles(y))]
    assert len(near_ones) >= 39
    df = spark.createDataFrame(rows, "node long, text string").repartition(3)
    got = {(r.a, r.b) for r in simhash_dedup.near_links(df).collect()}
    assert got <= set(near_ones)
    assert len({r.root for r in simhash_dedup.components(spark.createDataFrame(sorted(got), "a long, b long")).collect()}) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.keep_distinct(df).count() == 0


def test_cells_hold_the_second_candidates_once(spark):
    """At any block the pairs of the cells are those of second_candidates(); rows do not grow with the pairs, and a near group gives a forest."""
    rng = random.Random(4)
    keys = {n: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for n in range(120)}
    met = spark.createDataFrame([(k, n) for n, own in keys.items() for k in own], "key long, node long").repartition(3)
    rooted = spark.createDataFrame([(n, n % 7) for n in range(120) if n % 3], "node long, root long")
    want = {tuple(r) for r in simhash_dedup.second_candidates(met, rooted).collect()}
    for block in (2, 5, 1000):
        cells = {}
        for r in simhash_dedup.second_cells(met, rooted, block).collect():
            cells.setdefault(r.cell, []).append(r)
        got = {(a.node, b.node) for own in cells.values() for a in own for b in own if a.node < b.node and a.root != b.root and (a.side != b.side or not any(r.side for r in own))}
        assert got == want
    many = spark.createDataFrame([(k, n) for n in range(600) for k in range(8)], "key long, node long")
    alone = spark.createDataFrame([], "node long, root long")
    assert simhash_dedup.second_cells(many, alone).count() <= 600 * 10
    texts = spark.createDataFrame([(n, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {'' if n < 300 else 'one two three four five six seven eight nine ten'}") for n in range(600)], "node long, text string")
    made = simhash_dedup._near_in_cells(simhash_dedup.second_cells(many, alone), texts, 5, 0.8)
    roots = {r.node: r.root for r in simhash_dedup.components(made).collect()}
    assert made.count() < 6000 and {roots.get(n, n) for n in range(600)} == {0, 300}


def test_prefix_cells_hold_all_near_pairs_and_few_of_a_family(spark):
    """At any block; a family that is alike to 0.7 makes few cells."""
    rng = random.Random(11)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(3)) if t]
    family = words(rng, 300)
    for _ in range(400):
        own = list(family)
        for at in rng.sample(range(300), 11):
            own[at] = f"other{rng.randrange(40)}"
        rows.append((len(rows), " ".join(own)))
    start = len(rows) - 400
    df = spark.createDataFrame(rows, "node long, text string").repartition(3)
    sets = df.mapInArrow(simhash_dedup._sets(5), "node long, set binary").selectExpr("node", "node % 3 as root", "set").localCheckpoint()
    own = {r.node: set(memoryview(r.set).cast("I")) for r in sets.collect()}
    some = sorted(own)[: start + 60]
    want = {(a, b) for a in some for b in some if a < b and a % 3 != b % 3 and near(own[a], own[b])}
    assert len(want) > 30
    for block in (2, 64):
        cells = {}
        for r in simhash_dedup.prefix_cells(sets.where(f"node < {len(some)}"), 0.8, block).collect():
            cells.setdefault(r.cell, []).append(r)
        held = {(a.node, b.node) for own_ in cells.values() for a in own_ for b in own_ if a.node < b.node and a.root != b.root and (a.side != b.side or not any(r.side for r in own_))}
        assert want <= held
    # 400 members of the family: a few rows each, where cells by shared keys have rows of the square.
    family_cells = simhash_dedup.prefix_cells(sets.where(f"node >= {start}"), 0.8).count()
    keyed = df.where(f"node >= {start}").mapInArrow(simhash_dedup._sampled(5), "key long, node long")
    by_keys = simhash_dedup.second_cells(keyed, spark.createDataFrame([], "node long, root long")).count()
    assert family_cells < 2 * 400 and by_keys > 10 * family_cells
