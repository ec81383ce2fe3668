"""The listing of all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import ENDPOINT, join_keyed
from ..operators.screen import is_success
from ..functions.json import with_json


def check_connectivity(catalog: DataFrame, responses: DataFrame) -> DataFrame:
    """(source, connected): every endpoint answered, always with 2xx and a JSON body.

    Nothing is inferred, so bodies are only validated.
    """
    valid = with_json(responses.select(*ENDPOINT, "status", F.when(is_success(F.col("status")), F.col("body")).alias("_b")),
                      "_b", "_v", "_valid")
    answered = valid.groupBy(*ENDPOINT).agg(F.every("_valid").alias("ok"))
    return join_keyed(catalog.select(*ENDPOINT), answered, ENDPOINT, "left").groupBy("source").agg(
        F.every(F.coalesce("ok", F.lit(False))).alias("connected"))


def list_sources(sources: DataFrame, catalog: DataFrame, recorded: DataFrame, connected: DataFrame | None = None) -> DataFrame:
    """One row per source: kind, url, endpoints, types and, if given, connected; sorted by name.

    `sources` has source, kind and base_url. A source without endpoints is not connected.
    """
    counts = catalog.groupBy("source").agg(F.count("*").alias("endpoints"))
    typed = recorded.select("source").distinct().withColumn("types", F.lit(True))
    out = join_keyed(join_keyed(sources.select("source", "kind", F.col("base_url").alias("url")), counts, ["source"], "left"),
                     typed, ["source"], "left")
    columns = ["source", "kind", "url", F.coalesce("endpoints", F.lit(0)).alias("endpoints"),
               F.coalesce("types", F.lit(False)).alias("types")]
    if connected is not None:
        out = join_keyed(out, connected.select("source", "connected"), ["source"], "left")
        columns.append(F.coalesce("connected", F.lit(False)).alias("connected"))
    return out.select(*columns).orderBy("source")
