import math

import numpy as np
import pytest

from apitables.llm import whitening


def brute(rows, top=32):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    c = (n * x - s) / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    e, vec = e[order], vec[:, order]
    keep = [i for i in range(len(e)) if e[i] > 1e-12 * e[0]][:top]
    return kept, dev, c, e, vec, keep


def check(spark, rows, top=32):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df, top=top).collect()
    kept, dev, c, e, vec, keep = brute(rows, top)
    assert len(got) == len(kept) * len(keep)
    trace = e.sum()
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == len(kept) and r["identity_error"] <= 1e-4
    for k, i in enumerate(keep):
        mine = sorted(by[k + 1], key=lambda r: (r["vec_id"], r["deviation"]))
        want = sorted(zip((kk for kk, _ in kept), dev, c @ vec[:, i] / math.sqrt(e[i])), key=lambda t: (t[0], t[1]))
        assert [(r["vec_id"], r["deviation"]) for r in mine] == [(a, b) for a, b, _ in want]
        sign = 1 if sum(r["whitened"] * w for r, (_, _, w) in zip(mine, want)) >= 0 else -1
        assert max(abs(r["whitened"] - sign * w) for r, (_, _, w) in zip(mine, want)) < 1e-6
        assert abs(mine[0]["explained"] - e[i] / trace) <= 1e-4 * e[i] / trace


def test_matches_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 6)) @ rng.standard_normal((6, 6))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(base)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (7, rows[7][1])]
    check(spark, rows)
    check(spark, rows, top=3)


def test_rank_deficient_and_tiny(spark):
    rows = [(i, [float(i % 5), float(i % 5), 1.0]) for i in range(40)]
    check(spark, rows)
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        whitening.whiten(df)
