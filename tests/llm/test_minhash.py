import itertools
import random

import numpy as np
import pytest

from apitables.llm import components as links
from apitables.llm import minhash
from apitables.llm.components import components

from . import brute


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [[" ".join(rng.choices(vocabulary, k=rng.choice([3, 30, 120])))] for _ in range(30)]
    rows = [r[0] for r in rows]
    for source in rows[:10]:
        w = source.split()
        for _ in range(3):
            near = list(w)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append(" ".join(near) if len(w) >= 120 else source)
    # Far variants of one text: they share buckets, but few pass the threshold.
    base = rng.choices(vocabulary, k=200)
    for n in [0, 0, 1, 2, 8, 16, 20, 24, 28, 30] * 6:
        far = list(base)
        for at in rng.sample(range(200), n):
            far[at] = rng.choice(vocabulary)
        rows.append(" ".join(far))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("hot", [4, 10**9])
def test_classes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    rows = _texts()
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute.classes(rows)
    # Weights move similarities near the threshold a little; classes may differ for pairs between 0.75 and 0.85 only.
    sets = {i: brute.shingles(t) for i, t in rows}
    for a in want:
        for b in want:
            similarity = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if similarity >= 0.85:
                assert got[a] == got[b]
    strict = brute.classes(rows, 0.75)
    for i, c in got.items():
        assert strict[i] == strict[c]


@pytest.mark.parametrize("hot", [4, 10**9])
def test_edited_copies_in_a_large_group(spark, monkeypatch, hot):
    """A third of the rows belong to one group; its edited copies have a plain similarity of 0.80 to 0.88 to the rest."""
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(20000)]
    base = rng.choices(vocabulary, k=300)
    texts = [" ".join(base)] * 60
    for n in [4, 4, 5, 5, 6, 6] * 7:
        near = list(base)
        for at in rng.sample(range(10, 290, 10), n):
            near[at] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choices(vocabulary, k=300)) for _ in range(204)]
    rows = list(enumerate(texts))
    sets = [brute.shingles(t) for t in texts]
    weak = [i for i in range(60, 102) if 0.8 <= len(sets[i] & sets[0]) / len(sets[i] | sets[0]) <= 0.88]
    assert len(weak) >= 12
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute.classes(rows)


def test_far_variants_take_few_rounds_and_comparisons(spark, monkeypatch):
    """Variants of one text that share its buckets: a bound on their shingles rules most pairs out before bags are read."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(20000)]
    base = rng.choices(vocabulary, k=120)
    texts = []
    for n in [1] * 20 + [5, 6, 7] * 60:
        near = list(base)
        for at in rng.sample(range(120), n):
            near[at] = rng.choice(vocabulary)
        texts += [" ".join(near)]
    rows = list(enumerate(texts))
    pairs, verified = [], minhash.verified

    def counted(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = [brute.shingles(t) for t in texts]
    for i, c in got.items():
        assert c == got[c] <= i
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]):
            assert got[a] == got[b]
    assert len({got[i] for i in range(20)}) == 1
    assert len(pairs) <= 3 and sum(pairs) <= 400


def test_samples_agree_as_often_as_weights():
    rng = np.random.default_rng(1)
    rates = []
    for _ in range(60):
        u = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
        a, b = rng.uniform(0.5, 2, len(u)), rng.uniform(0.5, 2, len(u))
        same = minhash.sample(u, np.log(a).astype(np.float32)) == minhash.sample(u, np.log(b).astype(np.float32))
        rates.append(same.mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(rates)) < 0.02


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60000))
    rows = [(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "", "d"), (5, "...", "e"), (6, "one two", "f"), (7, "One, two!", "g"), (8, long, "h"), (8, long, "h"), (9, long + " more", "i"), (None, "one two", "j"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("doc_id", "text", "id", "id AS node", "id AS class", "id AS bucket")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (8, 8), (9, 8), (None, None), (None, None)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(300, 400)] + [(i, i + 1) for i in range(600, 640)] + [(900, 900), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_links_that_are_stars_are_not_walked(spark, monkeypatch):
    monkeypatch.setattr(links, "_large", None)
    stars = [(1, i) for i in range(2, 40)] + [(50, 41), (41, 60), (70, 70), (None, 1), (1, 2)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 40)} | {41: 41, 50: 41, 60: 41, 70: 70}
