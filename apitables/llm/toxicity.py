"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other training texts are unlabelled: nobody says that they are clean. A
linear classifier is trained in numpy to least non-negative risk,

    prior * risk+(positives) + max(0, risk-(unlabelled) - prior * risk-(positives)),

with the logistic loss; where the bracket is negative, the step goes against it. The class prior is the share of toxic
rows among the labelled training rows.

Features are words and word beginnings of 4 to 8 bytes; each of the FEATURES that tell positives from unlabelled texts
best counts by its presence and by its rate in the text. Fitting uses a bounded sample: POSITIVES and UNLABELLED
documents that come first by a hash of their ids, up to SAMPLE_BYTES each. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apitables.llm.sampling import bounded
from apitables.llm.texts import slices, span_hashes, utf8, word_spans
from apitables.session import materialize

POSITIVES, UNLABELLED, SAMPLE_BYTES = 4000, 8000, 32 << 20
#: Features at most; positives that must have one, and standard deviations by which their share must exceed the usual one.
FEATURES, LEAST_POSITIVES, LEAST_WORTH = 512, 5, 3.0
BEGINNINGS = [4, 5, 6, 7, 8]
STEPS, RATE, DECAY = 600, 0.05, 1e-4


@dataclass
class Model:
    """Sorted feature hashes; weights of their presence and of their rate; bias."""

    features: np.ndarray
    presence: np.ndarray
    rate: np.ndarray
    bias: float


def _hashes(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    low, starts, ends, first = word_spans(*utf8(column))
    return span_hashes(low, starts, ends, BEGINNINGS), first


def _counted(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature, presence-and-rate value for each feature of each text, and words of each text."""
    hashes, first = _hashes(column)
    n = np.diff(first)
    keys = []
    for h in hashes:
        at = np.minimum(np.searchsorted(features, h), max(0, len(features) - 1))
        hit = np.flatnonzero(features[at] == h) if len(features) else np.zeros(0, np.int64)
        keys.append((np.searchsorted(first, hit, "right") - 1) * max(1, len(features)) + at[hit])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    text, feature = np.divmod(key, max(1, len(features)))
    return text, feature, np.log1p(500 * count / (n[text] + 50)), n


def _loss_slope(margin: np.ndarray) -> np.ndarray:
    """Slope of ln(1 + exp(-margin))."""
    return -1 / (1 + np.exp(np.clip(margin, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights, the last one a bias, of least non-negative risk: full-batch Adam from zero."""
    x_p, x_u = (np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float32) for x in (positive, unlabelled))
    w, m, v = (np.zeros(x_p.shape[1], np.float32) for _ in range(3))
    for step in range(1, STEPS + 1):
        z_p, z_u = x_p @ w, x_u @ w
        bracket = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        toward = prior * x_p.T @ _loss_slope(z_p) / len(x_p)
        away = -(x_u.T @ _loss_slope(-z_u)) / len(x_u) + prior * x_p.T @ _loss_slope(-z_p) / len(x_p)
        slope = (toward + away if bracket >= 0 else -away) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A classifier from the rows of `df` where `learn` holds; `labels` has the key and the label (1: toxic).

    A document with several labels is toxic if one of them says so. Without a toxic example the model scores 0 words of
    evidence: every text gets the prior, or 0 if there is no label at all.
    """
    rows = df.where(learn & F.col(key).isNotNull())
    # A row is told apart by its key and a hash of its text, so that rows sharing a key are sampled one by one.
    row_id = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.crc32(F.col(text).cast("binary")).alias("h2")).alias("id")
    ids = rows.select(F.col(key).alias("key"), row_id, F.octet_length(text).alias("size"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    marked = materialize(ids.join(known, "key", "left"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).toLocalIterator()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    prior = toxic / max(1, toxic + clean)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    if not toxic:
        return empty
    texts = rows.select(row_id, F.col(text).alias("text"))
    positive = bounded(marked.where("toxic = 1").select(F.lit(1).alias("kind"), "id", "size"), texts, POSITIVES, SAMPLE_BYTES)
    unlabelled = bounded(marked.select(F.lit(0).alias("kind"), "id", "size"), texts, UNLABELLED, SAMPLE_BYTES)
    sample = materialize(positive.unionByName(unlabelled))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, first = _hashes(part.column("text"))
            kind = part.column("kind").to_numpy()
            of = np.repeat(np.arange(part.num_rows), np.diff(first))
            h, text = np.concatenate(hashes), np.tile(of, len(hashes))
            h, text = h[h != 0], text[h != 0]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, toxic = h[once], kind[text[once]]
            u, at = np.unique(h, return_index=True)
            if len(u):
                yield pa.record_batch({"h": pa.array(u.view(np.int64)), "p": pa.array(np.add.reduceat(toxic, at).astype(np.int64)), "u": pa.array(np.add.reduceat(1 - toxic, at).astype(np.int64))})

    sizes = {r["kind"]: r["n"] for r in sample.groupBy("kind").agg(F.count("*").alias("n")).toLocalIterator()}
    n_p, n_u = sizes[1], sizes[0]
    told = sample.mapInArrow(present, "h bigint, p bigint, u bigint").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= min(LEAST_POSITIVES, n_p))
    usual = (F.col("u") + 1) / (n_u + 2)
    worth = (F.col("p") / n_p - usual) / F.sqrt(usual * (1 - usual) / n_p)
    features = np.sort(told.where(worth >= LEAST_WORTH).orderBy(worth.desc(), "h").limit(FEATURES).select("h").toArrow()["h"].to_numpy().view(np.uint64))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text, feature, value, _ = _counted(part.column("text"), features)
            at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=part.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.record_batch({"kind": part.column("kind"), "feature": lists[0], "value": lists[1]})

    found = sample.mapInArrow(extract, "kind int, feature array<int>, value array<float>").toArrow()
    x = np.zeros((found.num_rows, 2 * len(features)), np.float32)
    for i, (f, value) in enumerate(zip(found["feature"], found["value"])):
        f = f.values.to_numpy()
        x[i, f], x[i, len(features) + f] = 1, value.values.to_numpy()
    kind = found["kind"].to_numpy()
    w = train(x[kind == 1], x[kind == 0], prior)
    return Model(features, w[: len(features)], w[len(features) : -1], float(w[-1]))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for each row of `df`: the chance that the whole text is toxic. Null and empty texts have the score of no evidence."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "text"):
            text, feature, value, _ = _counted(part.column("text"), model.features)
            z = np.bincount(text, weights=model.presence[feature] + model.rate[feature] * value, minlength=part.num_rows) + model.bias
            yield pa.record_batch({"id": part.column("id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))})

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(rate, f"id {kind}, score double")
