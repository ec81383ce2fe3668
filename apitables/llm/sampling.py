"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded(ids: DataFrame, texts: DataFrame, docs: int, size: int) -> DataFrame:
    """(kind, text): of each kind at most `docs` rows, those that come first by a hash of the id, up to `size` UTF-8 bytes.

    `ids` has kind, id and size, `texts` id and text; rows without id are left out. The id should tell rows apart (the
    callers pass the key with a hash of the text). A row larger than `size` by itself is skipped; the others are taken
    while the bytes of those before them are under `size`, so one long text never ends the sample early. Rows are
    counted first, and only those whose hash lies in twice the share that is needed are ranked, so the ranking of a hot
    kind stays small. The ids that are picked are sent to the texts, which are not shuffled; rows that share a picked id
    are reduced to one by a map-side aggregate, so a repeated hot id adds one row, not all of its copies.
    """
    rows = ids.where(F.col("id").isNotNull() & (F.coalesce("size", F.lit(0)) <= size)).select(
        "kind", "id", F.coalesce("size", F.lit(0)).alias("size"), F.xxhash64("id").alias("order"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    share = F.col("order") / F.lit(2.0**64) + 0.5
    near = rows.join(F.broadcast(counts), "kind").where(share <= 2.0 * docs / F.col("n"))
    by = Window.partitionBy("kind").orderBy("order", "id", "size")
    picked = near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= docs)
    picked = picked.withColumn("before", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < size)
    return texts.join(F.broadcast(picked.select("kind", "id").distinct()), "id").dropDuplicates(["kind", "id"]).select("kind", "text")
