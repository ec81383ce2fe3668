from pyspark.sql import functions as F

from apitables.llm import sharding

SHARD = ["shard_depth", "shard_prefix", "shard_page"]


def _sizes(df):
    return {tuple(r[:3]): (r[3], r[4]) for r in df.groupBy(*SHARD).agg(F.sum("n_bytes"), F.count("*")).collect()}


def test_shards_fit_and_only_oversized_buckets_split(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 90 AS INT)) AS text", "'a' AS hash_bits", "'b' AS cell")
    got = sharding.assign_shards(df, limit=4000)
    sizes = _sizes(got)
    assert sum(n for _, n in sizes.values()) == 3000 and all(size <= 4000 for size, _ in sizes.values())
    parents = {}
    for (depth, prefix, _), (size, _) in sizes.items():
        for d in range(depth):
            parents[d, prefix >> (depth - d)] = parents.get((d, prefix >> (depth - d)), 0) + size
    assert all(size > 4000 for size in parents.values())
    assert set(got.columns) == {*df.columns, "n_bytes", *SHARD}


def test_later_directories_and_pages(spark):
    same = spark.range(50).selectExpr("CAST(7 AS BIGINT) AS doc_id", "repeat('y', 90) AS text")
    large = spark.range(3).selectExpr("CAST(7 AS BIGINT) AS doc_id", "repeat('z', 600) AS text")
    huge = spark.range(1).selectExpr("CAST(8 AS BIGINT) AS doc_id", "repeat('h', 5000) AS text")
    odd = spark.createDataFrame([(None, None), (None, ""), (9, None)], "doc_id long, text string")
    got = sharding.assign_shards(same.union(large).union(huge).union(odd), limit=1000)
    sizes = _sizes(got)
    assert sum(n for _, n in sizes.values()) == 57
    assert all(size <= 1000 or n == 1 for size, n in sizes.values())
    assert {r["shard_page"] for r in got.where("doc_id <> 7").collect()} == {0}


def test_empty_table_and_files(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS doc_id", "repeat('x', 50) AS text")
    assert sharding.assign_shards(df.limit(0)).collect() == []
    sharding.write_shards(df, str(tmp_path / "out"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and all(size <= 2000 for size, _ in _sizes(back).values())
