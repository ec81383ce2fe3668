"""Recording contracts: outcomes per endpoint, schemas carried forward, and the publish gate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.infer import path_stats, profile, record_counts, unify
from ..operators.keyed import ENDPOINT, join_keyed
from ..operators.naming import normalise, registry_violations, unqualify
from ..operators.screen import NOT_RECORDS, is_success, status_message, unwrap, with_page
from ..session import materialize
from ..sources.registry import write_registry


class Sampled(NamedTuple):
    """What one pass over the responses tells about each endpoint."""

    nodes: DataFrame     # inferred schema
    endpoints: DataFrame  # source, endpoint, record_count, is_record, status_failure, json_status, json_type


def sample(responses: DataFrame, depth: int | None = None) -> Sampled:
    """Profile the responses. Bodies are parsed once; a second, filtered scan words failed statuses."""
    profiled = materialize(profile(unwrap(responses), ENDPOINT, depth))
    nodes = materialize(unify(path_stats(profiled)))
    root = nodes.filter("depth = 0").select(*ENDPOINT, (F.col("members") == F.array(F.lit("record"))).alias("is_record"))
    invalid = profiled.filter(F.col("issue") & F.col("kind").startswith("json")).groupBy(*ENDPOINT).agg(
        F.min(F.struct("first_ord", "kind")).alias("_json"))
    url = F.col("url") if "url" in responses.columns else F.col("endpoint")
    failed = with_page(responses).filter(~F.coalesce(is_success(F.col("status")), F.lit(False))).groupBy(*ENDPOINT).agg(
        F.min(F.struct(F.greatest(F.lit(0), F.least(F.coalesce("response_ord", F.lit(0)), F.lit(10**12 - 1))).alias("page"), status_message(url, F.col("status"), F.col("body")).alias("text"))).alias("_status"))
    out = record_counts(profiled)
    for part in (root, invalid, failed):
        out = join_keyed(out, part, ENDPOINT, "left")
    json_page = F.floor(F.col("_json.first_ord") / F.lit(str(10**26)).cast("decimal(27,0)")).cast("long")
    status_first = F.col("_status").isNotNull() & (F.col("_json").isNull() | (F.col("_status.page") <= json_page))
    words = F.split("_json.kind", " ", 3)
    return Sampled(nodes, materialize(out.select(
        *ENDPOINT, "record_count", F.coalesce("is_record", F.lit(False)).alias("is_record"),
        F.when(status_first, F.col("_status.text")).alias("status_failure"),
        F.when(~status_first, words[1]).alias("json_status"),
        F.when(~status_first, words[2]).alias("json_type"))))


def introspect(catalog: DataFrame, sampled: Sampled, recorded: DataFrame) -> DataFrame:
    """Outcome per endpoint: `inferred`, `no_records` or `failed`.

    Columns: source, endpoint, ordinal, outcome, record_count, kept_schema, detail. `recorded`
    holds the registry's nodes.
    """
    known = recorded.select(*ENDPOINT).distinct().withColumn("_known", F.lit(True))
    joined = join_keyed(join_keyed(catalog.select(*ENDPOINT, "ordinal"), sampled.endpoints, ENDPOINT, "left"),
                        known, ENDPOINT, "left")
    failure = (
        F.when(F.col("record_count").isNull(), "no response has landed")
        .when(F.col("status_failure").isNotNull(), F.col("status_failure"))
        .when(F.col("json_type").isNotNull(),
              F.concat(F.lit("response is not valid JSON (content type: "), F.col("json_type"), F.lit(")")))
        .when((F.col("record_count") > 0) & ~F.col("is_record"), NOT_RECORDS)
    )
    judged = joined.withColumn("detail", failure)
    outcome = F.when(F.col("detail").isNotNull(), "failed").when(F.col("record_count") == 0, "no_records").otherwise("inferred")
    return judged.withColumn("outcome", outcome).select(
        *ENDPOINT, "ordinal", "outcome", F.when(F.col("outcome") == "inferred", F.col("record_count")).alias("record_count"),
        F.when(F.col("outcome") == "no_records", F.coalesce("_known", F.lit(False))).alias("kept_schema"), "detail")


def carry_forward(fresh: DataFrame, recorded: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The schemas to record: fresh ones, and the recorded ones of endpoints without records.

    `table_ord` is the endpoint's place in the catalog; recorded record names become positional again.
    """
    place = outcomes.select(*ENDPOINT, F.col("ordinal").cast("int").alias("table_ord"), "outcome")
    inferred = join_keyed(fresh, place.filter("outcome = 'inferred'").drop("outcome"), ENDPOINT, "inner")
    kept = join_keyed(unqualify(recorded).drop("table_ord"),
                      place.filter("outcome = 'no_records'").drop("outcome"), ENDPOINT, "inner")
    return inferred.unionByName(kept.select(*inferred.columns))


def publishable(outcomes: DataFrame) -> DataFrame:
    """Sources to write: no endpoint failed and at least one has a schema, fresh or kept."""
    return outcomes.groupBy("source").agg(
        F.every(F.col("outcome") != "failed").alias("clean"),
        F.count_if((F.col("outcome") == "inferred") | F.coalesce("kept_schema", F.lit(False))).alias("tables"),
    ).withColumn("publish", F.col("clean") & (F.col("tables") > 0))


def contracts_to_publish(catalog: DataFrame, sampled: Sampled, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, registry nodes of the sources that pass the gate).

    A contract that cannot be written fails its source: its endpoints that would have been written are `failed`, with
    the first problem of their own table, or else of the source, as detail.
    """
    outcomes = introspect(catalog, sampled, recorded)
    gate = publishable(outcomes).filter("publish").select("source")
    tables = materialize(carry_forward(sampled.nodes, recorded, outcomes).join(gate, "source", "left_semi"))
    problems = materialize(registry_violations(tables).groupBy("source", "endpoint").agg(F.min("problem").alias("own")))
    whole = problems.groupBy("source").agg(F.min("own").alias("any"))
    told = join_keyed(join_keyed(outcomes, problems, ENDPOINT, "left"), whole, ["source"], "left")
    bad = F.col("any").isNotNull()
    judged = told.select(
        *ENDPOINT, "ordinal", F.when(bad, "failed").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~bad, F.col("record_count")).alias("record_count"), F.when(~bad, F.col("kept_schema")).alias("kept_schema"),
        F.when(bad, F.concat(F.lit("cannot write the types file: "), F.coalesce("own", "any"))).otherwise(F.col("detail")).alias("detail"))
    return judged, normalise(tables.join(whole.select("source"), "source", "left_anti"))


def publish(catalog: DataFrame, sampled: Sampled, recorded: DataFrame, path: str) -> DataFrame:
    """Record the contracts of every source that passes the gate, whole sets at once."""
    outcomes, nodes = contracts_to_publish(catalog, sampled, recorded)
    write_registry(nodes, path)
    return outcomes
