"""The recorded contracts, stored as JSON lines partitioned by source.

Text lines keep a damaged contract local: a line that cannot be read makes its own source
unreadable and no other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.infer import KINDS
from ..session import configure, materialize
from .landed import _exists

NODES = T.StructType([
    T.StructField("endpoint", T.StringType()), T.StructField("table_ord", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.StringType())), T.StructField("depth", T.IntegerType()),
    T.StructField("name", T.StringType()), T.StructField("record_name", T.StringType()),
    T.StructField("declares", T.BooleanType()), T.StructField("members", T.ArrayType(T.StringType())),
    T.StructField("optional", T.BooleanType()), T.StructField("first_ord", T.DecimalType(38, 0)),
    T.StructField("step_rank", T.IntegerType()), T.StructField("label", T.StringType()),
])
_STORED = T.StructType([*NODES, T.StructField("_bad", T.StringType()), T.StructField("source", T.StringType())])


class Registry(NamedTuple):
    """Readable recorded nodes, and (source, message) of sources that cannot be read.

    A source in neither has nothing recorded.
    """

    nodes: DataFrame
    unreadable: DataFrame


def write_registry(registry: DataFrame, path: str) -> None:
    """Replace the recorded tables of every source in `registry`; other sources stay untouched."""
    configure(registry.sparkSession)
    rows = registry.select("source", *NODES.names)
    # The rows may come from the very files about to be replaced.
    materialize(rows).repartition("source", "endpoint").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("source").json(path)


def read_registry(spark: SparkSession, path: str) -> Registry:
    """Recorded tables, with the sources that are damaged told apart from those never recorded."""
    if not _exists(spark, path):
        return Registry(spark.createDataFrame([], T.StructType([T.StructField("source", T.StringType()), *NODES])),
                        spark.createDataFrame([], "source string, message string"))
    rows = spark.read.schema(_STORED).option("columnNameOfCorruptRecord", "_bad").json(path)
    unknown = F.exists("members", lambda m: ~m.isin(*KINDS, "unknown"))
    problem = (
        F.when(F.col("_bad").isNotNull(), "a line is not a schema node")
        .when(F.col("endpoint").isNull() | F.col("path").isNull() | F.col("members").isNull(), "a schema node is incomplete")
        .when(unknown, "a schema node has an unknown type")
    )
    checked = materialize(rows.withColumn("message", problem))
    lines = checked.filter("message IS NOT NULL").groupBy("source").agg(F.min("message").alias("message"))
    roots = checked.groupBy("source", "endpoint").agg(
        F.max(F.when((F.size("path") == 0) & (F.col("members") == F.array(F.lit("record"))), 1).otherwise(0)).alias("rooted"))
    rootless = roots.filter("rooted = 0").groupBy("source").agg(F.lit("a table is not a record").alias("message"))
    unreadable = lines.unionByName(rootless).groupBy("source").agg(F.min("message").alias("message"))
    nodes = checked.drop("_bad", "message").join(unreadable, "source", "left_anti")
    return Registry(nodes.select("source", *NODES.names), unreadable)


def registry_state(sources: DataFrame, registry: Registry) -> DataFrame:
    """`missing`, `unreadable` or `ok` per source."""
    recorded = registry.nodes.select("source").distinct().withColumn("_ok", F.lit(True))
    return (
        sources.select("source").distinct().join(recorded, "source", "left").join(registry.unreadable, "source", "left")
        .select("source", F.when(F.col("message").isNotNull(), "unreadable").when(F.col("_ok"), "ok")
                .otherwise("missing").alias("state"), "message"))
