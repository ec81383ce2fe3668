"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then sent down to a leaf and indexed there. A query walks the
tree with a priority queue, most similar centroid first, and its first `visits` leaves are searched exactly. How many
leaves that takes is calibrated: for some queries the true neighbours are found by comparing them with all vectors,
and visits are widened until the leaves visited hold the wanted share of them.

Equal vectors are one entry with its k + 1 smallest ids, which is all that a list of k neighbours can need, so a vector
that a third of all rows share is compared once. Leaves are packed into bins of bounded size; large leaves are split over
several, and the queries of a bin into blocks, so no task meets an unbounded group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apitables.session import materialize

#: Vectors that the tree is fitted on, and numbers in them, at most.
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
FANOUT, LEAF, ROUNDS = 8, 64, 8
#: Queries that visits are calibrated with, and the share of true neighbours that must be reached.
CALIBRATION, RECALL = 200, 0.97
BIN, BLOCK = 4096, 2000


@dataclass
class Tree:
    """Centroids by node; children of node i are children[i] (none: a leaf, with number leaf[i])."""

    centers: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child's, from the root down."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centers[self.children[node]]
                near = ((c**2).sum(axis=1) / 2 - x[rows] @ c.T).argmin(axis=1)
                todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def order(self, affinity: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a query meets; `affinity` has its inner product with each centroid."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-affinity[child], child))
        return found


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = ((centers**2).sum(axis=1) / 2 - x @ centers.T).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers, ((centers**2).sum(axis=1) / 2 - x @ centers.T).argmin(axis=1)


def fit(x: np.ndarray) -> Tree:
    """A tree over the rows of x; nodes of LEAF rows or fewer, or of equal rows, are leaves."""
    rng = np.random.default_rng(9)
    tree = Tree(x.mean(axis=0, keepdims=True), [[]], [-1])
    centers, todo, leaves = [tree.centers[0]], [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        kids = []
        if len(rows) > LEAF:
            found, near = _k_means(x[rows], FANOUT, rng)
            parts = [np.flatnonzero(near == i) for i in range(FANOUT)]
            if max(map(len, parts)) < len(rows):
                kids = [(found[i], rows[p]) for i, p in enumerate(parts) if len(p)]
        if not kids:
            tree.leaf[node] = leaves
            leaves += 1
        for center, part in kids:
            tree.children[node].append(len(centers))
            todo.append((len(centers), part))
            centers.append(center)
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centers = np.array(centers)
    return tree


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _best(query: np.ndarray, entry: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best rows of each query, ties to the smaller entry."""
    order = np.lexsort((entry, -score, query))
    q = query[order]
    opens = np.flatnonzero(np.diff(q, prepend=q[0] - 1 if len(q) else 0))
    place = np.arange(len(q)) - np.repeat(opens, np.diff(np.append(opens, len(q))))
    return order[place < n]


def _scored(q: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and of x that may be among the n best of that row of q, ties included."""
    s = q @ x.T
    if len(x) > n:
        edge = np.partition(s, len(x) - n, axis=1)[:, len(x) - n, None]
        return np.nonzero(s >= edge - 1e-9 * (1 + np.abs(edge)))
    return np.nonzero(np.ones_like(s, bool))


def _truth(index: DataFrame, ids: np.ndarray, queries: np.ndarray, n: int) -> list[np.ndarray]:
    """Leaves of the n nearest entries of each calibration query, from comparing it with all entries but its own."""
    sent = index.sparkSession.sparkContext.broadcast((ids, queries))
    dims = queries.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        for batch in batches:
            entry, x = batch.column("vid").to_numpy(), _matrix(batch.column("vector"), dims)
            leaf = batch.column("leaf").to_numpy()
            a, b = _scored(q, x, n + 1)
            other = own[a] != entry[b]
            a, b = a[other], b[other]
            new = [a, entry[b], (q[a] * x[b]).sum(axis=1), leaf[b]]
            kept = [np.concatenate(p) for p in zip(kept, new)]
            top = _best(kept[0], kept[1], kept[2], n)
            kept = [p[top] for p in kept]
        yield pa.record_batch({"query": pa.array(kept[0]), "vid": pa.array(kept[1]), "score": pa.array(kept[2]), "leaf": pa.array(kept[3])})

    found = index.select("vid", "vector", "leaf").mapInArrow(nearest, "query bigint, vid bigint, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vid"))
    top = found.withColumn("place", place).where(F.col("place") <= n).select("query", "leaf").toArrow()
    query, leaf = top["query"].to_numpy(), top["leaf"].to_numpy()
    return [leaf[query == i] for i in range(len(queries))]


def calibrated(tree: Tree, queries: np.ndarray, truth: list[np.ndarray], recall: float = RECALL) -> int:
    """The least number of leaves, widened step by step, at which the visited leaves hold the share `recall` of the truth."""
    total = sum(map(len, truth))
    affinity = queries @ tree.centers.T
    rank = []
    for a, leaves in zip(affinity, truth):
        at = {leaf: i for i, leaf in enumerate(tree.order(a, tree.leaves))}
        rank += [at[leaf] for leaf in leaves.tolist()]
    ranks = np.array(rank)
    visits = 1
    while visits < tree.leaves and (ranks < visits).sum() < recall * total:
        visits += max(1, visits // 8)
    return min(visits, tree.leaves)


def _bins(index: DataFrame) -> DataFrame:
    """(leaf, bin, parts): leaves in tree order packed into bins of some BIN entries; a larger leaf has several bins of its own."""
    sizes = index.groupBy("leaf").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = F.col("n") > BIN
    return sizes.select("leaf", F.when(large, -1 - F.col("leaf")).otherwise(F.floor(before / BIN)).cast("bigint").alias("bin"), F.when(large, F.ceil(F.col("n") / BIN)).otherwise(1).cast("int").alias("parts"))


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds its k nearest other rows that were found.

    Nearest is the largest inner product in double precision, ties to the smaller id. Rows whose vector is null, empty,
    zero, or holds a null or a number that is not finite take no part, nor do rows with a null id or a length other than
    the most common one (of equally common ones the shortest). A repeated id is one row, with one of its vectors.
    """
    spark = df.sparkSession
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    valid = df.where(F.col(key).isNotNull() & _usable(vector)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), queries.alias("asks")).dropDuplicates(["id"])
    common = valid.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], shape)
    dims = common["dims"]
    valid = materialize(valid.where(F.size("vector") == dims))
    entries = materialize(valid.groupBy("vector").agg(F.min("id").alias("vid")))
    rows = materialize(valid.join(entries, "vector").select("id", "vid", "asks"))
    first = F.row_number().over(Window.partitionBy("vid").orderBy("id")) <= k + 1
    ids = rows.withColumn("first", first).where("first").groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    picked = entries.orderBy(F.xxhash64("vid")).limit(min(SAMPLE, max(1, SAMPLE_NUMBERS // dims))).toArrow()
    tree = fit(_matrix(picked["vector"].combine_chunks(), dims))
    sent = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.assign(_matrix(batch.column("vector"), dims))
            yield pa.record_batch({"vid": batch.column("vid"), "vector": batch.column("vector"), "leaf": pa.array(leaf)})

    kind = df.schema[vector].dataType.simpleString()
    index = materialize(entries.select("vid", "vector").mapInArrow(assign, f"vid bigint, vector {kind}, leaf int"))
    asked = rows.where("asks").select("vid").distinct()
    asking = materialize(index.join(asked, "vid").select("vid", "vector"))
    trial = asking.orderBy(F.xxhash64("vid", F.lit(1))).limit(CALIBRATION).toArrow()
    if not trial.num_rows:
        return spark.createDataFrame([], shape)
    trial_vectors = _matrix(trial["vector"].combine_chunks(), dims)
    visits = calibrated(tree, trial_vectors, _truth(index, trial["vid"].to_numpy(), trial_vectors, k), recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            affinity = _matrix(batch.column("vector"), dims) @ tree.centers.T
            leaves = [tree.order(a, visits) for a in affinity]
            of = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in leaves]))
            yield pa.record_batch({"vid": batch.column("vid").take(of), "leaf": pa.array(np.concatenate(leaves), pa.int32())})

    bins = materialize(_bins(index))
    binned = index.join(bins, "leaf").withColumn("part", F.pmod(F.xxhash64("vid"), "parts").cast("int"))
    wanted = asking.mapInArrow(route, "vid bigint, leaf int").join(bins, "leaf").groupBy("bin", "parts", "vid").agg(F.collect_list("leaf").alias("leaves"))
    wanted = materialize(wanted)
    blocks = wanted.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = wanted.join(blocks, "bin").join(asking, "vid").select("bin", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.pmod(F.xxhash64("vid"), "blocks").cast("int").alias("block"), "vid", "vector", "leaves")
    right = binned.join(blocks, "bin").select("bin", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "vid", "vector", "leaf")

    def compare(asks: pa.Table, there: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asks.num_rows and there.num_rows:
            q, x = (_matrix(t["vector"].combine_chunks(), dims) for t in (asks, there))
            query, entry, leaf = asks["vid"].to_numpy(), there["vid"].to_numpy(), there["leaf"].to_numpy()
            lists = asks["leaves"].combine_chunks()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            visited = lists.flatten().to_numpy()
            for one in np.unique(leaf).tolist():
                here = np.flatnonzero(leaf == one)
                asking_ = of[visited == one]
                for i in range(0, len(asking_), 256):
                    block = asking_[i : i + 256]
                    a, b = _scored(q[block], x[here], k + 1)
                    a, b = block[a], here[b]
                    found = [query[a], entry[b], (q[a] * x[b]).sum(axis=1)]
                    out = [np.concatenate(p) for p in zip(out, found)]
                if len(out[0]) > 1_000_000:
                    top = _best(*out, k + 1)
                    out = [p[top] for p in out]
            top = _best(*out, k + 1)
            out = [p[top] for p in out]
        return pa.table({"query": out[0], "vid": out[1], "score": out[2]})

    group = ["bin", "part", "block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, "query bigint, vid bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vid"))
    top = found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    near = top.join(ids, "vid").groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"))))).alias("near"))
    answers = rows.where("asks").join(near, rows["vid"] == near["query"]).select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.sort_array(F.filter("near", lambda x: x["vec_id"] != F.col("id"))), 1, k)).alias("place", "x"))
    return answers.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
