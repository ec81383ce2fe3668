"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A repeated key keeps its last value instead of making the body invalid. Nothing else is set for the caller.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true"}

_own: list[tempfile.TemporaryDirectory] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the one runtime setting that the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: this application's, below the cluster's `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder, because there the driver and the
    executors are one process; it goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="apitables-"))
        folder = _own[0].name
    return f"{folder.rstrip('/')}/apitables/{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; its results must have been used by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and read it back.

    Unlike a cached block the files survive the loss of an executor, and unlike a checkpointed RDD they carry a size, so
    later joins broadcast them only while they are small. `clear_shared` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
