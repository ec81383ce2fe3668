"""Landed responses and landed source definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import with_json
from ..functions.urls import identifier_violation, path_violation
from ..session import configure

RESPONSES = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("endpoint", T.StringType()),
    T.StructField("response_ord", T.LongType()), T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
])

DEFINITION = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("base_url", T.StringType()), T.StructField("auth_type", T.StringType()),
    T.StructField("env_vars", T.ArrayType(T.StringType())),
    T.StructField("endpoints", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("path", T.StringType())]))),
])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_responses(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Responses landed as parquet or JSON lines; columns the files lack are NULL, pages 0."""
    frame = spark.read.schema(RESPONSES).format(format).load(path)
    return frame.withColumn("response_ord", F.coalesce("response_ord", F.lit(0)))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bodies landed one per file as `<source>/<endpoint>[.<page>].<extension>`, all answered 200."""
    files = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
             .select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file")))
    parts = F.split("file", "/")
    name = F.split(F.element_at(parts, -1), r"\.")
    return files.select(
        F.element_at(parts, -2).alias("source"), name[0].alias("endpoint"),
        F.when(F.size(name) > 2, name[1].cast("long")).otherwise(0).alias("response_ord"),
        F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), "body",
        F.lit(None).cast("long").alias("elapsed_ms"))


def _endpoint_problem(endpoints: Column) -> Column:
    """The first bad endpoint of a definition: its name, its path, or a name used before; NULL if there is none."""
    names = F.transform(endpoints, lambda e: F.coalesce(e["name"], F.lit("")))

    def problem(e: Column, i: Column) -> Column:
        name, path = F.coalesce(e["name"], F.lit("")), F.coalesce(e["path"], F.lit(""))
        return F.coalesce(
            F.concat(F.lit("endpoint name "), identifier_violation(name)),
            F.concat(F.lit("path `"), path, F.lit("` "), path_violation(path)),
            F.when(F.array_position(names, name) <= i, F.concat(F.lit("duplicate endpoint name `"), name, F.lit("`"))))

    return F.try_element_at(F.filter(F.transform(endpoints, problem), lambda p: p.isNotNull()), F.lit(1))


def judge_definitions(files: DataFrame) -> DataFrame:
    """Add `doc`, the parsed definition, and `reason`, why it is unusable, to (file, text) rows."""
    parsed = with_json(files, "text", "_v", "_valid").withColumn(
        "doc", F.from_json("text", DEFINITION, {"mode": "PERMISSIVE"}))
    reason = (
        F.when(~F.col("_valid"), "not valid JSON")
        .when(F.col("doc.name").isNull(), "not a source definition: `name` is missing")
        .when(F.col("doc.name") != F.col("file"),
              F.concat(F.lit("declared name `"), F.col("doc.name"), F.lit("` does not match the file name `"),
                       F.col("file"), F.lit("`")))
        .when(F.col("doc.base_url").isNull(), "not a source definition: `base_url` is missing")
        .otherwise(_endpoint_problem(F.col("doc.endpoints")))
    )
    return parsed.withColumn("reason", reason).drop("_v", "_valid")


def split_definitions(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, quarantine), both sorted by name; a bad document never hides a good one."""
    good = judged.filter(F.col("reason").isNull()).select("doc.*").withColumn(
        "kind", F.coalesce("kind", F.lit("api"))).withColumn("auth_type", F.coalesce("auth_type", F.lit("none")))
    bad = judged.filter(F.col("reason").isNotNull()).select(F.col("file").alias("name"), "reason")
    return good.orderBy("name"), bad.orderBy("name")


def load_with_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Source definitions landed as one JSON document per file, split into good and bad.

    The good ones come as one row per source (name, kind, base_url, auth_type, env_vars,
    endpoints), the others as (name, reason). A name is the file's, and a document must declare
    the same one. A missing folder is an empty one.
    """
    configure(spark)
    if not _exists(spark, path):
        nothing = spark.createDataFrame([], DEFINITION)
        return nothing, spark.createDataFrame([], "name string, reason string")
    files = (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
        .select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("file"), F.col("value").alias("text"))
    )
    return split_definitions(judge_definitions(files))


def catalog_of(definitions: DataFrame) -> DataFrame:
    """One row per (source, endpoint), in the definition's order."""
    return definitions.select(
        F.col("name").alias("source"), "kind", "base_url", "auth_type", "env_vars",
        F.posexplode("endpoints").alias("ordinal", "e"),
    ).select("source", "kind", "base_url", "auth_type", "env_vars", F.col("e.name").alias("endpoint"),
             F.col("e.path").alias("path"), "ordinal")
