"""A corpus pipeline of the training-data operators: language, repeated lines, near copies, benchmarks, pieces.

Each stage works on all documents that its predecessor kept; `run` writes each stage's result as Parquet and reads it
back. All but the last return the columns of `documents`, and further columns that came with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apitables.llm import decontam, langid, linededup, minhash, sample_encode
from apitables.session import materialize

#: Posterior probability below which a language is not accepted.
LEAST_POSTERIOR = 0.5
#: Rows of one Arrow batch at most. Spark's default of 10,000 documents is tens of MB, held several times over by each
#: task of an executor and by its Python worker.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch of this session; a caller's smaller bound stays. 0 or less is no bound."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with columns c0, c1, ... so that no name clashes, and the new names of doc_id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    return docs.toDF(*names), at["doc_id"], at["text"]


def _named(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learnt from the labelled ones stay; null texts and texts without letters go.

    If no document has a language, nothing is learnt, and all texts with a letter stay.
    """
    _small_batches(spark)
    model = langid.fit(docs, F.lit(True))
    plain, key, text = _numbered(docs)
    if not model.languages:
        return docs.where(langid.has_letter("text"))
    judged = langid.predict(plain, model, key, text, keep=tuple(plain.columns))
    return _named(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out; a document that loses all its text goes. n_chars follows."""
    _small_batches(spark)
    plain, key, text = _numbered(docs)
    cut = linededup.dedup_lines(plain, key, text)
    kept = _named(cut.where((F.col("n_removed") == 0) | (F.trim(F.translate(text, "\n\t\r", "   ")) != "")), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class of texts stays: the one with the least id, then with the least hash of the row.

    Rows are told apart by all their columns, not by their ids, so a repeated id loses no text. Rows without an id are
    compared like others, and come after those with an id. Rows without a text all stay.
    """
    _small_batches(spark)
    plain, key, text = _numbered(docs)
    rest = [c for c in plain.columns if c not in (key, text)]
    keyed = plain.withColumn("row_key", F.xxhash64(key, text, F.to_json(F.struct(*rest)) if rest else F.lit(0))).where(F.col(text).isNotNull())
    classes = minhash.near_duplicates(keyed, "row_key", text).distinct().withColumnRenamed("id", "row_key")
    ids = keyed.select("row_key", key).distinct()
    order = F.struct(F.col(key).isNull(), key, "row_key")
    kept = classes.join(ids, "row_key").groupBy("class_id").agg(F.min(order).alias("first")).select("first.row_key")
    # Rows that are equal in full become one in each task, before the join brings them together.
    chosen = keyed.dropDuplicates(["row_key"]).join(kept, "row_key", "left_semi")
    return _named(chosen, docs).unionByName(docs.where("text IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a twentieth of their words or more lie in windows of benchmark items."""
    _small_batches(spark)
    plain, key, text = _numbered(docs)
    judged = decontam.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key, text, keep=tuple(plain.columns))
    return _named(judged.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their log probabilities and inclusion scores, and whether they decode to it."""
    _small_batches(spark)
    return sample_encode.encode(docs, verify=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_sampling", pieces),
]

#: Language models, sampling by hash and chance are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
