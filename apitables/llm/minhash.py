"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by Jaccard similarity.

A text is the weighted set of its five-word shingles. A shingle weighs (1 + ln tf) * idf, where idf runs from 1 (in
every document) to 2 (in none); document frequencies are counted over all documents in 2**SLOTS_LOG2 hashed slots, so
the table that every task holds has a fixed size. Texts of fewer than five words have one shingle, of all their words.
A candidate is a link if its weighted or its plain Jaccard similarity reaches the threshold: idf lowers the weighted one
of edited copies in large groups, whose common shingles weigh less than the edits.

Rows with the same text are one node. Nodes that share a band meet in a bucket. A bucket is worked off in rounds: its
first nodes are compared with all its members of other classes that a bound does not rule out, then they leave it; the classes are merged, and
buckets whose members are all in one class are done. So every two members are compared or already connected, no pairs
are made within a group beyond these, and a bucket of copies costs one comparison for each member. Members of large
buckets that a bound shows to be unlike all others there leave beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apitables.llm.components import stars
from apitables.llm.texts import mix, shingles, slices, utf8, words
from apitables.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
SLOTS_LOG2 = 20
POOL_LOG2 = 16
#: Members that one leader's chunk holds in the comparison; leaders of a bucket in the first round, and how many times
#: as many in each next one; members beyond which a bucket is thinned out first.
CHUNK, LEADERS, GROWTH, HOT = 500, 1, 64, 32
#: Bits of the set of a text's shingles that tells how many of them another text lacks at least.
SKETCH_LOG2 = 10
#: Bits of the set that keeps most documents without candidates out of the shuffle of bags.
SIEVE_LOG2 = 24


@lru_cache(1)
def draws() -> tuple[np.ndarray, ...]:
    """The pool of (1/r, beta, ln c, r) that a shingle's hash picks from, and a multiplier and odd number per sample."""
    rng = np.random.default_rng(20)
    u = rng.random((5, 1 << POOL_LOG2))
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (1 / r).astype(np.float32), u[4].astype(np.float32), np.log(c).astype(np.float32), r.astype(np.float32), odd


def sample(u: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of one non-empty weighted set: BANDS * ROWS hashes of (shingle, level)."""
    inverse, beta, log_c, r, odd = draws()
    least, out = np.full(len(odd), np.inf, np.float32), np.zeros(len(odd), np.uint64)
    rows = np.arange(len(odd))
    for a in range(0, len(u), 2048):
        part = u[a : a + 2048]
        i = ((part[None, :] * odd[:, None]) >> np.uint64(64 - POOL_LOG2)).astype(np.intp)
        t = np.floor(log_w[a : a + 2048][None, :] * inverse[i] + beta[i])
        value = log_c[i] - r[i] * (t - beta[i] + np.float32(1))
        best = value.argmin(axis=1)
        lower = value[rows, best] < least
        least = np.where(lower, value[rows, best], least)
        out = np.where(lower, mix(part[best] ^ (t[rows, best].astype(np.int64).astype(np.uint64) * odd)), out)
    return out


def bag(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts and their weights."""
    u, n = np.unique(hashes, return_counts=True)
    return u, n, ((1 + np.log(n)) * idf[u & np.uint64(len(idf) - 1)]).astype(np.float32)


def inverse_frequencies(df: DataFrame, text: str, shingle: int = SHINGLE) -> np.ndarray:
    """idf of each slot, from the number of documents whose shingles hit it: 2**SLOTS_LOG2 floats at any size of `df`."""
    size = 1 << SLOTS_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(size, np.int64), 0
        for part in slices(batches, text):
            hashes, at = shingles(*words(part.column(text)), shingle)
            slots = (hashes & np.uint64(size - 1)).astype(np.int64)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pairs = np.sort(of << SLOTS_LOG2 | slots)
            pairs = pairs[np.diff(pairs, prepend=-1) != 0]
            totals += np.bincount(pairs & (size - 1), minlength=size)
            n += part.num_rows
        hit = np.flatnonzero(totals)
        yield pa.record_batch({"slot": pa.array(np.append(hit, -1), pa.int32()), "n": pa.array(np.append(totals[hit], n))})

    counts = df.select(text).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    slots, n = found["slot"].to_numpy(), found["n"].to_numpy()
    frequency = np.zeros(size)
    frequency[slots[slots >= 0]] = n[slots >= 0]
    total = max(1, int(n[slots < 0].sum()))
    return (1 + np.log((1 + total) / (1 + frequency)) / np.log(1 + total)).astype(np.float32)


def signatures(df: DataFrame, key: str, text: str, idf, shingle: int = SHINGLE) -> DataFrame:
    """id, hash of the text in two halves, total weight and number of distinct shingles, band hashes, a bit set of the shingles; without words: no bands; null text: null halves."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        tag = np.arange(BANDS, dtype=np.uint64)
        for part in slices(batches, text):
            column = part.column(text)
            data, offsets = utf8(column)
            raw, null = data.tobytes(), column.is_null().to_numpy(zero_copy_only=False)
            hashes, at = shingles(*words(column), shingle)
            ids = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            filled = np.flatnonzero(np.diff(at))
            sketch = np.zeros((part.num_rows, 1 << SKETCH_LOG2), bool)
            samples, weight, size = np.zeros((len(filled), BANDS, ROWS), np.uint64), np.zeros(part.num_rows, np.float64), np.zeros(part.num_rows, np.int64)
            for i, d in enumerate(filled.tolist()):
                u, _, w = bag(hashes[at[d] : at[d + 1]], table)
                samples[i] = sample(u, np.log(w)).reshape(BANDS, ROWS)
                weight[d], size[d] = w.sum(dtype=np.float64), len(u)
                # The low 32 bits are what bags compare.
                sketch[d, (u & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - SKETCH_LOG2)] = True
            band = np.broadcast_to(tag, samples.shape[:2])
            for j in range(ROWS):
                band = mix(band * np.uint64(31) + samples[:, :, j])
            ends = np.zeros(part.num_rows + 1, np.int32)
            ends[1:][filled] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            starts = np.arange(part.num_rows + 1, dtype=np.int32) << SKETCH_LOG2 - 6
            sketches = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.packbits(sketch, axis=1).reshape(-1).view(np.int64)))
            yield pa.record_batch({"id": part.column(key).cast(pa.int64()), "h1": pa.array(halves[:, 0], mask=null), "h2": pa.array(halves[:, 1], mask=null), "weight": pa.array(weight), "size": pa.array(size), "bands": bands, "sketch": sketches})

    return df.select(key, text).mapInArrow(sign, "id bigint, h1 bigint, h2 bigint, weight double, size bigint, bands array<bigint>, sketch array<bigint>")


def bags(df: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """node, and its distinct shingles (low 32 bits) with counts as packed arrays, of the nodes in `wanted`.

    A bit set of fixed size over hashes of the wanted nodes lets a task skip nearly all other documents before they are
    shuffled; the join decides. Repeated rows of one node and text give one row.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << SIEVE_LOG2))
    bits = wanted.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << SIEVE_LOG2 - 6, np.int64)
    sieve[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(sieve)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches, text):
            at = part.column("slot").to_numpy()
            part = part.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
            known = len(seen)
            data, offsets = utf8(part.column(text))
            raw, fresh = data.tobytes(), []
            for node, a, b in zip(part.column(key).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                seen.add((node, xxhash.xxh3_64_intdigest(raw[a:b])))
                fresh.append(len(seen) > known)
                known = len(seen)
            part = part.filter(pa.array(fresh, pa.bool_()))
            hashes, at = shingles(*words(part.column(text)), shingle)
            sets = [np.unique((hashes[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True) for a, b in zip(at, at[1:])]
            yield pa.record_batch({"node": part.column(key).cast(pa.int64()), "items": pa.array([u.tobytes() for u, _ in sets], pa.binary()), "counts": pa.array([n.astype(np.uint32).tobytes() for _, n in sets], pa.binary())})

    rows = df.where(F.col(key).isNotNull()).select(key, text, F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(1 << SIEVE_LOG2)).alias("slot"))
    return rows.mapInArrow(pack, "node bigint, items binary, counts binary").join(wanted, "node", "left_semi").distinct()


def _bounded(members: DataFrame, found: DataFrame, idf, threshold: float) -> DataFrame:
    """`members` with `shared` and `common` in place of `n`, the members of the bucket: the weight and the number of shingles that a node can have in common with
    another member of its bucket at most.

    In large buckets they leave out the shingles that no other node of the large buckets has; nodes that keep less than
    the threshold's share of both go. So pairs of far variants of one text, which are many and in vain, are not compared.
    """
    inside = members.where(F.col("n") > HOT)
    nodes = inside.select("node").distinct()

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shingle of some nodes once, with how many of them have it; node and share mean something if it is one."""
        table = idf.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("items")]
                counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("counts")]
                weights = [(1 + np.log(n)) * table[u & np.uint32(len(table) - 1)] for u, n in zip(sets, counts)]
                share = np.concatenate([w / w.sum(dtype=np.float64) for w in weights])
                item, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                node = np.repeat(part.column("node").to_numpy(), [len(u) for u in sets])
                yield pa.record_batch({"item": pa.array(item.view(np.int32)), "n": pa.array(n, pa.int64()), "node": pa.array(node[first]), "share": pa.array(share[first], pa.float64())})

    one = found.join(nodes, "node", "left_semi").mapInArrow(items, "item int, n bigint, node bigint, share double").groupBy("item")
    own = one.agg(F.sum("n").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    alone = own.groupBy("node").agg(F.sum("share").alias("share"), F.count("*").alias("own"))
    left, common = F.lit(1.0) - F.coalesce("share", F.lit(0.0)), F.col("size") - F.coalesce("own", F.lit(0))
    least = threshold * (1 - 1e-6)
    kept = inside.join(alone, "node", "left").where((left >= least) | (common >= least * F.col("size"))).select("bucket", "node", "weight", "size", "bands", "sketch", (left * F.col("weight")).alias("shared"), common.alias("common"))
    return members.where(F.col("n") <= HOT).select("bucket", "node", "weight", "size", "bands", "sketch", F.col("weight").alias("shared"), F.col("size").alias("common")).unionByName(kept)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of weighted and plain Jaccard similarity; each side is (sorted distinct items, weights).

    The weighted one is the sum of lesser weights over the sum of greater ones.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    n = int(same.sum())
    common = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64)
    return max(float(common / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common)), n / (len(a[0]) + len(b[0]) - n))


def verified(pairs: DataFrame, found: DataFrame, idf, threshold: float) -> DataFrame:
    """The links (u, v) of the pairs (a, b, u, v) of nodes a, b whose weighted or plain Jaccard similarity reaches the threshold.

    A leader's members are dealt over chunks of some CHUNK rows, and its own bag is sent to each chunk once; a task
    streams over them in order and holds one leader at a time.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    none = F.lit(None).cast("bigint")
    members = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), "b", "u", "v", F.col("b").alias("node"))
    heads = chunks.select("a", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), none.alias("b"), none.alias("u"), none.alias("v"), F.col("a").alias("node"))
    rows = members.unionByName(heads).join(found, "node").select("a", "chunk", "b", "u", "v", "items", "counts")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        head = None

        def side(items: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
            u, n = np.frombuffer(items, np.uint32), np.frombuffer(counts, np.uint32)
            return u, (1 + np.log(n)) * table[u & np.uint32(len(table) - 1)]

        for batch in batches:
            left, right = [], []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                a, b = columns[0][i].as_py(), columns[2][i].as_py()
                bag_ = side(columns[5][i].as_buffer(), columns[6][i].as_buffer())
                if b is None:
                    head = a, bag_
                elif head and head[0] == a and similarity(head[1], bag_) >= threshold:
                    left.append(columns[3][i].as_py())
                    right.append(columns[4][i].as_py())
            yield pa.record_batch({"u": pa.array(left, pa.int64()), "v": pa.array(right, pa.int64())})

    return rows.mapInArrow(compare, "u bigint, v bigint")


def _differing(a: str, b: str) -> Column:
    """How many shingles only one of the bit sets `a` and `b` has, at least."""
    return reduce(add, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1 << SKETCH_LOG2 - 6)))


def _unresolved(members: DataFrame) -> DataFrame:
    """`members` with the largest class of their bucket as `main`, of the buckets that hold more than one class."""
    sizes = members.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("bucket", "main")
    return members.join(mixed, "bucket")


def _moved(members: DataFrame, merge: DataFrame) -> DataFrame:
    """`members` with the classes of `merge` (class, into) replaced by those that they went into."""
    return members.join(merge, "class", "left").withColumn("class", F.coalesce("into", "class")).drop("into")


def _order() -> list[Column]:
    """Members of a bucket's largest class come before others: they are compared with the fewest."""
    return [F.col("class") != F.col("main"), F.col("node")]


def _leaders(todo: DataFrame, n: int) -> DataFrame:
    """The first n members of each bucket, and the place in the order where the last of them stands."""
    bucket = Window.partitionBy("bucket")
    first = todo.withColumn("at", F.row_number().over(bucket.orderBy(*_order()))).where(F.col("at") <= n).drop("at")
    return first.withColumn("last", F.max(F.struct(*_order())).over(bucket))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(id, class_id) for each row of `df`: its near-duplicate class, named by the least id in it.

    A null text is alone in its class. Texts without a word, such as the empty one, are alike only if they are equal. A
    row with a null id has a null class. Rows that share an id are one document, in the class of each of its texts.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark: SparkSession = df.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(df, text, shingle))
    signed = materialize(signatures(df, key, text, idf, shingle))
    nodes = signed.where("id IS NOT NULL AND h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("node"))
    signed = materialize(signed.join(nodes, ["h1", "h2"], "left").select("id", F.coalesce("node", "id").alias("node"), "weight", "size", "bands", "sketch"))

    # Bands meet with a hash of their row; what else the row has joins those that meet another.
    every = signed.where("id = node").select("node", "weight", "size", "bands", "sketch").distinct().withColumn("mark", F.xxhash64("weight", "size", "bands", "sketch"))
    placed = every.select("node", "mark", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    members = materialize(placed.join(shared, "bucket").join(every, ["node", "mark"]).drop("mark"))
    found = materialize(bags(df, materialize(members.select("node").distinct()), key, text, shingle))
    members = materialize(_bounded(members, found, idf, threshold))

    merges, leaders = [], LEADERS
    todo = materialize(_unresolved(members.withColumn("class", F.col("node"))))
    while not todo.isEmpty():
        lead = materialize(_leaders(todo, leaders))
        heads = lead.select("bucket", F.col("node").alias("a"), "last", *[F.col(c).alias(f"{c}_a") for c in ("class", "weight", "shared", "size", "common", "bands", "sketch")])
        # Similarity is at most what two nodes can share over what is left of both weights, or of both sets. A shingle
        # that only one of them has weighs 1 at least; counting these costs more, so it comes last.
        least, most = F.lit(threshold / (1 + threshold) * (1 - 1e-6)), F.lit((1 - threshold) / (1 + threshold) * (1 + 1e-6))
        weights, sizes = F.col("weight") + F.col("weight_a"), F.col("size") + F.col("size_a")
        weighted = F.least("shared", "shared_a", "weight", "weight_a") >= least * weights
        plain = F.least("common", "common_a", "size", "size_a") >= least * sizes
        alike = _differing("sketch", "sketch_a") <= F.greatest(F.when(weighted, most * weights), F.when(plain, most * sizes))
        # Of two leaders of a bucket, the one with the smaller id is the head.
        other = (F.col("class_a") != F.col("class")) & ((F.struct(*_order()) > F.col("last")) | (F.col("a") < F.col("node")))
        # Two nodes may share many buckets; the first of these is theirs.
        own = F.col("bucket") == F.element_at(F.array_intersect("bands", "bands_a"), 1)
        pairs = heads.join(todo, "bucket").where(other & (weighted | plain) & own & alike).select("a", F.col("node").alias("b"), F.col("class_a").alias("u"), F.col("class").alias("v"))
        # Links are between classes, so a round handles none of the nodes that earlier ones have merged.
        merged = stars(materialize(verified(materialize(pairs.distinct()), found, idf, threshold)))
        merges.append(merged.select(F.col("u").alias("class"), F.col("v").alias("into")))
        rest = todo.drop("main").join(lead.select("bucket", "node"), ["bucket", "node"], "left_anti")
        todo = materialize(_unresolved(_moved(rest, merges[-1])))
        leaders *= GROWTH
    own = signed.withColumn("class", F.col("node"))
    for merge in merges:
        own = _moved(own, merge)
    return own.select("id", F.when(F.col("id").isNotNull(), F.col("class")).alias("class_id"))
