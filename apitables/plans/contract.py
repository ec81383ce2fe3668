"""Checking contracts: drift per endpoint, the step report and its roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import diff_schemas
from ..operators.keyed import ENDPOINT, join_keyed
from ..operators.screen import NOT_RECORDS, is_success
from ..session import materialize
from ..sources.registry import Registry, registry_state
from .introspect import Sampled


def unmatched_tables(recorded: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recorded tables no endpoint of their source is named like."""
    return join_keyed(recorded.filter("depth = 0").select(*ENDPOINT), catalog.select(*ENDPOINT), ENDPOINT, "left_anti")


def contract_outcomes(catalog: DataFrame, sampled: Sampled, registry: Registry) -> DataFrame:
    """Per endpoint with a JSON answer: `passed` or `failed`, and why.

    One endpoint's change lines are joined into its detail; `diff_schemas` has them as rows.
    """
    state = registry_state(catalog, registry)
    known = registry.nodes.filter("depth = 0").select(*ENDPOINT).withColumn("known", F.lit(True))
    changes = diff_schemas(registry.nodes, join_keyed(sampled.nodes, registry.nodes.select(*ENDPOINT).distinct(),
                                                      ENDPOINT, "left_semi"))
    lines = changes.groupBy(*ENDPOINT).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("change_ord", "line"))), lambda c: c["line"]), "\n").alias("lines"))
    answered = catalog.select(*ENDPOINT)
    for part in (sampled.endpoints, known, lines):
        answered = join_keyed(answered, part, ENDPOINT, "left")
    answered = answered.filter("status_failure IS NULL AND json_type IS NULL AND record_count IS NOT NULL")
    answered = join_keyed(answered, state, ["source"], "left")
    name = lambda text: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in text])
    failure = (
        F.when(F.col("state") == "unreadable", name(["cannot read the types file: ", "$message"]))
        .when((F.col("record_count") == 0) & F.col("known").isNull(),
              name(["nothing to verify: no records sampled, and no table recorded for `", "$endpoint", "` yet"]))
        .when(F.col("record_count") == 0, None)
        .when(F.col("state") == "missing", name(["no types file; introspect `", "$source", "` to record the contract"]))
        .when(F.col("known").isNull(), name(["table `", "$endpoint", "` is missing from the types file; introspect `",
                                             "$source", "` to update it"]))
        .when(~F.col("is_record"), NOT_RECORDS)
        .otherwise(F.col("lines"))
    )
    judged = answered.withColumn("_failure", failure)
    return judged.select(
        *ENDPOINT, F.when(F.col("_failure").isNull(), "passed").otherwise("failed").alias("outcome"),
        F.coalesce("_failure", F.when(F.col("record_count") == 0, "no records sampled")).alias("detail"))


def answers(responses: DataFrame) -> DataFrame:
    """Status and total latency of each endpoint's good responses."""
    return responses.filter(is_success(F.col("status"))).groupBy(*ENDPOINT).agg(
        F.max("status").alias("status"), F.sum("elapsed_ms").alias("elapsed_ms"))


def test_report(sources: DataFrame, catalog: DataFrame, responses: DataFrame, sampled: Sampled,
                registry: Registry) -> DataFrame:
    """One row per step: source, endpoint, ordinal, step, step_no, outcome, detail.

    `sources` has source and `problem` (NULL when its definition loaded). Steps 1 and 2 (config,
    endpoints) belong to the source, 3 and 4 (connected, contract) to each endpoint. A failed step
    skips every later one.
    """
    counts = catalog.groupBy("source").agg(F.count("*").alias("endpoints"))
    heads = materialize(join_keyed(sources.select("source", "problem"), counts, ["source"], "left"))
    broken = F.col("problem").isNotNull()
    bare = F.col("endpoints").isNull()
    step = lambda no, name, outcome, detail: F.struct(
        F.lit(no).alias("step_no"), F.lit(name).alias("step"), outcome.alias("outcome"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    globals_ = heads.select(
        "source", none.alias("endpoint"), F.lit(None).cast("int").alias("ordinal"),
        F.inline(F.array(
            step(1, "config", F.when(broken, "failed").otherwise("passed"), F.col("problem")),
            step(2, "endpoints", F.when(broken, "skipped").when(bare, "failed").otherwise("passed"),
                 F.when(broken, none).when(bare, "no endpoints configured").otherwise(F.col("endpoints").cast("string"))))))

    contracts = contract_outcomes(catalog, sampled, registry).select(
        *ENDPOINT, F.col("outcome").alias("_contract"), F.col("detail").alias("_why"))
    each = catalog.select(*ENDPOINT, F.col("ordinal").cast("int").alias("ordinal"))
    for part in (sampled.endpoints, answers(responses), contracts):
        each = join_keyed(each, part, ENDPOINT, "left")
    each = join_keyed(each, heads.select("source", broken.alias("_off")), ["source"], "left")
    failure = (
        F.when(F.col("record_count").isNull(), "no response has landed")
        .when(F.col("status_failure").isNotNull(), F.col("status_failure"))
        .when(F.col("json_type").isNotNull(), F.concat(
            F.lit("HTTP "), F.col("json_status"), F.lit(" but the response is not valid JSON (content type: "),
            F.col("json_type"), F.lit(")")))
    )
    judged = each.withColumn("_failure", failure)
    connected = F.when(F.col("_off"), "skipped").when(F.col("_failure").isNotNull(), "failed").otherwise("passed")
    good = F.concat(F.col("status").cast("string"), F.lit(", "), F.coalesce("elapsed_ms", F.lit(0)).cast("string"), F.lit("ms"))
    locals_ = judged.select(
        "source", "endpoint", "ordinal",
        F.inline(F.array(
            step(3, "connected", connected, F.when(connected == "failed", F.col("_failure")).when(connected == "passed", good)),
            step(4, "contract", F.when(connected == "passed", F.col("_contract")).otherwise("skipped"),
                 F.when(connected == "passed", F.col("_why"))))))
    return globals_.unionByName(locals_)


def ordered_steps(steps: DataFrame) -> DataFrame:
    return steps.orderBy("source", F.col("ordinal").asc_nulls_first(), "endpoint", "step_no")


def rollup(steps: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Per source: `passed` (every step, no unmatched table) and `connected` (drift ignored)."""
    orphans = unmatched.groupBy("source").agg(F.count("*").alias("unmatched"))
    ok = F.col("outcome") == "passed"
    rolled = steps.groupBy("source").agg(
        F.every(ok).alias("_steps"), F.every(ok | (F.col("step") == "contract")).alias("connected"))
    return join_keyed(rolled, orphans, ["source"], "left").select(
        "source", (F.col("_steps") & F.col("unmatched").isNull()).alias("passed"), "connected",
        F.coalesce("unmatched", F.lit(0)).alias("unmatched"))
