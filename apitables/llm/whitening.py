"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Rows whose vector is null or holds a null or non-finite entry are dropped. Each remaining entry c becomes the integer
x = floor(64 c) + 1000000; the fit list is all remaining rows, repeated ones included, with n rows and per-dimension
sums S. Rows are centred as (n x - S) / n, from exact integers, and written once.

The bidiagonalisation alternates two products with the centred rows X: p = X v, summed row by row in each task, and
X^T p, summed over tasks. One pass over the written rows per step yields both. The left vectors u = X w are carried as
their coefficients w on the driver (d numbers each), so reorthogonalising them against all earlier ones, like the
right vectors, is full and exact in the d-dimensional space; nothing of size n leaves the executors. A step whose
residual vanishes (the Krylov space is exhausted) restarts from a fresh direction orthogonal to all earlier ones, so
after d steps the d x d bidiagonal B holds the whole spectrum: X = U B V^T. The SVD of B gives the singular values s
and, through V, the components; eigenvalues of the covariance are e = s^2 / n.

Components are numbered from 1 by falling e; those with e below 1e-12 of the largest carry no variance to whiten
and are not returned. All remaining vectors must have one length; otherwise a ValueError names the lengths found. An
empty fit list, or one of a single row, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apitables.session import materialize

SCALE, OFFSET = 64, 1_000_000
TOP = 32
FLOOR = 1e-12


def _matrix(batch: pa.RecordBatch, column: str = "c") -> np.ndarray:
    values = batch.column(column)
    if not len(values):
        return np.zeros((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _products(z: np.ndarray):
    """A task's share of X^T (X z) for each column of z, and of the rows' squared norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(z)
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                total += x.T @ (x @ z)
        yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]}, schema=pa.schema([("g", pa.list_(pa.float64()))]))

    return run


def _gram_times(rows: DataFrame, z: np.ndarray) -> np.ndarray:
    """X^T X z by one pass over the written rows: X z in each task, then X^T of it, summed."""
    parts = rows.select("c").mapInArrow(_products(z), "g array<double>")
    summed = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(z.size)
    for r in summed:
        out[r["i"]] = r["v"]
    return out.reshape(z.shape)


def _fresh(basis: list[np.ndarray], d: int, seed: int) -> np.ndarray | None:
    """A unit vector orthogonal to `basis`, or None if it spans everything."""
    rng = np.random.default_rng(seed)
    for _ in range(8):
        v = rng.standard_normal(d)
        for _ in range(2):
            for b in basis:
                v -= (b @ v) * b
        norm = np.linalg.norm(v)
        if norm > 1e-8:
            return v / norm
    return None


def bidiagonalise(rows: DataFrame, d: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of the centred rows, by d steps of GKL."""
    vs, ws, gws, alphas, betas = [], [], [], [], []
    v = _fresh([], d, seed)
    beta, scale = 0.0, 0.0
    for j in range(d):
        g = _gram_times(rows, v[:, None])[:, 0]                   # X^T (X v_j)
        # u_j = (X v_j - beta u_{j-1}) reorthogonalised, kept as X w_j; G w_j follows from the same products.
        w, gw = v.copy(), g.copy()
        if ws:
            w -= beta * ws[-1]
            gw -= beta * gws[-1]
            for _ in range(2):
                for wi, gwi in zip(ws, gws):
                    c = wi @ gw                                   # u_i . u  (G symmetric)
                    w -= c * wi
                    gw -= c * gwi
        alpha = float(np.sqrt(max(w @ gw, 0.0)))
        scale = max(scale, alpha)
        if alpha <= 1e-12 * max(scale, 1.0):
            alpha, w, gw = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, gw = w / alpha, gw / alpha
        vs.append(v)
        ws.append(w)
        gws.append(gw)
        alphas.append(alpha)
        if j == d - 1:
            break
        r = gw - alpha * v                                        # X^T u_j - alpha v_j
        for _ in range(2):
            for b in vs:
                r -= (b @ r) * b
        beta = float(np.linalg.norm(r))
        if beta <= 1e-10 * max(scale, 1.0):
            beta, v = 0.0, _fresh(vs, d, seed + j + 1)
            if v is None:
                break
        else:
            v = r / beta
        betas.append(beta)
    k = len(alphas)
    b = np.diag(alphas) + np.diag(betas[: k - 1], 1)
    _, s, qt = np.linalg.svd(b)
    return s, np.column_stack(vs) @ qt.T


def clean(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is whole and finite, with x = floor(64 c) + 1000000 as longs."""
    c = F.col(vector)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf"))
    x = F.transform(c, lambda e: F.when(finite(e), F.floor(e.cast("double") * SCALE) + OFFSET))
    # The guard inside the transform holds whatever order the optimiser gives the filter and the projection.
    return embeddings.withColumn("__x", F.when(c.isNotNull() & F.forall(c, finite), x)).where(F.col("__x").isNotNull())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP, seed: int = 0) -> DataFrame:
    """Per remaining row and component up to `top`: key, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    kept = clean(embeddings, vector)
    stats = kept.agg(F.count("*").alias("n"), F.min(F.size("__x")).alias("lo"), F.max(F.size("__x")).alias("hi")).first()
    n = stats["n"]
    if n and stats["lo"] != stats["hi"]:
        raise ValueError(f"vectors of lengths {stats['lo']} to {stats['hi']}: whitening needs one length")
    d = stats["lo"] or 0
    schema = f"{key} {embeddings.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n < 2 or d == 0:
        return spark.createDataFrame([], schema)
    sums = kept.select(F.posexplode("__x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s")).collect()
    total = [0] * d
    for r in sums:
        total[r["j"]] = int(r["s"])
    s_lit = F.array(*(F.lit(v).cast("bigint") for v in total))
    nx = lambda v, j: F.lit(n).cast("decimal(38,0)") * v.cast("decimal(38,0)") - F.get(s_lit, j).cast("decimal(38,0)")
    rows = materialize(kept.select(
        F.col(key).alias("__key"),
        F.transform("__x", lambda v, j: nx(v, j).cast("double") / F.lit(float(n))).alias("c"),
        F.aggregate(F.transform("__x", lambda v, j: nx(v, j) * nx(v, j)), F.lit(0).cast("decimal(38,0)"), lambda a, b: a + b).alias("dev"),
    ))
    sigma, vectors = bidiagonalise(rows, d, seed)
    e = sigma**2 / n
    trace = float(rows.agg(F.sum("dev").cast("double").alias("t")).first()["t"]) / n**3
    keep = [i for i in range(len(e)) if e[i] > FLOOR * e[0]][:top]
    comps = vectors[:, keep] / np.sqrt(e[keep])                    # d x k: whitening projections
    cov = _gram_times(rows, comps) if keep else np.zeros((d, 0))    # X^T X P
    identity = comps.T @ cov / n - np.eye(len(keep))
    error = float(np.abs(identity).max()) if keep else 0.0
    proj = F.array(*(F.array(*(F.lit(float(comps[j, k])) for j in range(d))) for k in range(len(keep))))
    whitened = F.transform(proj, lambda p: F.aggregate(F.zip_with("c", p, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))
    ratios = F.array(*(F.lit(float(e[i] / trace)) for i in keep))
    out = rows.select("__key", "dev", F.posexplode(F.arrays_zip(whitened.alias("w"), ratios.alias("r"))).alias("k", "z"))
    return out.select(
        F.col("__key").alias(key), (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"),
        F.col("dev").cast("bigint").alias("deviation"), F.col("z.w").alias("whitened"), F.col("z.r").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
