"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, where only oversized buckets split further.

A row's hash is 60 bits of the MD5 of its key. A bucket of prefix length d is split on bit d + 1 only while it holds
more bytes than the limit and more than one row, so a shard is the shortest prefix that fits. Byte counts are summed
once per directory cell, with map-side combine; the levels above a cell are sums over cells, not over rows. Cells that
even the directory's last bit leaves too large are taken on by a further directory, with more bits and only their rows.
Built-in functions only; nothing is collected but the table's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apitables.llm.texts import free
from apitables.session import materialize

BITS = 60
#: Bits of the first directory beyond those that even shards would need, of later directories, and at most.
SPARE, STEP, MOST = 3, 8, 20


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _directory(rows: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(cell, depth): for each prefix of `last` bits the depth of its shard, null if none in first..last is small enough."""
    cells = rows.groupBy(F.expr(f"shiftright(hash, {BITS - last})").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    cells = materialize(cells)
    above = cells.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {last} - depth)"))
    fits = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows")).where((F.col("total") <= limit) | (F.col("rows") == 1))
    shards = above.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return materialize(cells.select("cell").join(shards, "cell", "left"))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """All rows and columns of `df` with n_bytes, shard_depth (int), shard_prefix and shard_page (long).

    The three name a shard; its texts add up to `limit` UTF-8 bytes at most, unless it is one row that is larger. Null
    and empty texts have no bytes. Rows with equal hashes, such as repeated keys, cannot be told apart by bits: if they
    exceed the limit they are dealt over pages 1, 2, ... of their shard in order of text; all others are on page 0.
    An empty table gives no rows. Columns of `df` with the names above are replaced.
    """
    base = df.drop("n_bytes", "shard_depth", "shard_prefix", "shard_page")
    hash_, bytes_ = free(base, "hash_bits"), "n_bytes"
    out = base.withColumn(hash_, key_hash(F.col(key))).withColumn(bytes_, F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint")))
    rows = materialize(out.select(F.col(hash_).alias("hash"), F.col(bytes_).alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    first, last = 0, min(MOST, max(1, math.ceil(math.log2(max(2, total / limit))) + SPARE))
    depth = F.lit(None).cast("int")
    while True:
        cells = _directory(rows, first, last, limit)
        cell, found = free(out, "shard_cell"), free(out, "shard_found")
        out = out.withColumn(cell, F.expr(f"shiftright({hash_}, {BITS - last})"))
        out = out.join(cells.select(F.col("cell").alias(cell), F.col("depth").alias(found)), cell, "left").drop(cell)
        depth = F.coalesce(depth, F.col(found))
        left = cells.where("depth IS NULL").select("cell")
        if left.isEmpty() or last == BITS:
            break
        rows = materialize(rows.withColumn("cell", F.expr(f"shiftright(hash, {BITS - last})")).join(left, "cell", "left_semi").drop("cell"))
        first, last = last + 1, min(BITS, last + STEP)
    names = [c for c in out.columns if c in (*base.columns, hash_, bytes_)]
    out = out.select(*names, depth.alias("shard_depth"))
    page = F.lit(0).cast("bigint")
    if last == BITS and not left.isEmpty():
        # Rows of equal hash: those beyond half the limit have a page each, the others fill pages from half the limit's marks.
        large = F.col(bytes_) * 2 > limit
        order = Window.partitionBy(hash_, large).orderBy(F.xxhash64(text), text)
        before = F.sum(bytes_).over(order.rowsBetween(Window.unboundedPreceding, -1))
        small = F.floor(2 * F.coalesce(before, F.lit(0)) / F.lit(limit))
        stuck = out.where("shard_depth IS NULL").withColumn("shard_page", (1 + F.when(large, 2 * F.row_number().over(order) + 1).otherwise(2 * small)).cast("bigint"))
        out = out.where("shard_depth IS NOT NULL").withColumn("shard_page", page).unionByName(stuck)
        out = out.withColumn("shard_depth", F.coalesce("shard_depth", F.lit(BITS)))
    else:
        out = out.withColumn("shard_page", page)
    return out.withColumn("shard_prefix", F.expr(f"shiftright({hash_}, {BITS} - shard_depth)")).select(*base.columns, bytes_, "shard_depth", "shard_prefix", "shard_page")


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> None:
    """Write `df` as Parquet with a folder for each shard."""
    shard = ["shard_depth", "shard_prefix", "shard_page"]
    assign_shards(df, key, text, limit).repartition(*shard).write.partitionBy(*shard).parquet(folder)
