"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apitables.llm import ann, chat, collocations, decontam, langid, linededup, minhash, sample_encode, secrets, sharding, token_counts, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; one document of each class is kept."""
    classes = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.selectExpr("id AS doc_id", "class_id", "id = class_id AS kept")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


@query
def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole document, and whether decoding each gives the document back."""
    encoded = sample_encode.encode(table(spark, sf_dir, "documents"), verify=True)
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_samples"),
        F.transform("ids", lambda x: F.size(x).cast("bigint")).alias("n_pieces"),
        F.transform("ids", lambda x: F.xxhash64(x)).alias("ids_hash"),
        "log_prob", "log_inclusion", "round_trip",
    )


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learnt from two of three folds."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, fold("doc_id", 3) != 1)
    return langid.predict(documents, model).select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that speaks in control strings, read back from their formatted text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.to_json(F.struct("role", "text")).alias("record"))
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("turn"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    formatted = chat.format_turns(chat.canonical_turns(turns.unionByName(own)))
    return chat.digests(formatted).withColumnRenamed("id", "conv_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from the labels of four of five folds."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(documents, model).select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside an occurrence of a 13-word window of a benchmark item."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines of three-line windows that occurred before."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, for shards of 1 MiB of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=1 << 20).select("doc_id", "n_bytes", "shard_depth", "shard_prefix", "shard_page")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document under the fixed vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language, by their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and random-string secret spans of every whole document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole, finite embedding projected on the first 32 principal components and scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
