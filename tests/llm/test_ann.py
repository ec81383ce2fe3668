import numpy as np
from pyspark.sql import functions as F

from apitables.llm import ann

SHAPE = "vec_id long, embedding array<float>, label int, id string"


def _nearest(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_recall_ranks_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SHAPE)
    found = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    want = _nearest(rows, range(0, 3000, 20), 20)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    vectors = np.array([v for _, v in rows], np.float32).astype(float)
    for q, list_ in got.items():
        assert [r for r, _, _ in list_] == list(range(1, 21)) and q not in {v for _, v, _ in list_}
        assert [(-s, v) for _, v, s in list_] == sorted((-s, v) for _, v, s in list_)
        assert np.allclose([s for *_, s in list_], [vectors[q] @ vectors[v] for _, v, _ in list_], rtol=1e-12)


def test_equal_and_unusable_vectors(spark):
    good = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5]), (120, [0.0, -1.0])]
    bad = [(140, None), (160, []), (180, [0.0, 0.0]), (200, [float("nan"), 1.0]), (220, [float("inf"), 1.0]), (240, [None, 1.0]), (260, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in good + bad], SHAPE)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = _nearest(good, [0, 20, 40, 100, 120], 20)
    assert {q: [(v, s) for _, v, s in sorted(x)] for q, x in got.items()} == want
    assert ann.search(df.limit(0), F.lit(True)).collect() == [] and ann.search(df, F.lit(False)).collect() == []
    assert ann.search(df.where("vec_id = 100"), F.lit(True)).collect() == []


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIN", 16)
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SHAPE)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = _nearest(rows, range(0, 400, 20), 20)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
