"""Response bodies, catalogs and contracts derived from the given tables.

Records are paged by ranges of a unique key, so a page holds at most `PAGE` of them, however the
other columns are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apitables.operators.infer import infer_schema
from apitables.operators.naming import normalise
from apitables.plans.introspect import Sampled, sample
from apitables.session import configure, materialize
from apitables.sources.registry import Registry

PAGE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the oracles' zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become documents to parse.

    The test tables are files of one row group; parsing their rows costs far more than dealing them over the cores.
    """
    scan = table(spark, sf_dir, name)
    return scan.repartition(max(scan.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))


def page_of(key: str) -> Column:
    return F.floor(F.col(key) / PAGE).cast("long")


def landed(df: DataFrame, source: Column, endpoint: Column, order: Column, body: Column, *more: Column) -> DataFrame:
    """Rows as good responses, one each."""
    return df.select(
        source.alias("source"), endpoint.alias("endpoint"), order.cast("long").alias("response_ord"),
        F.lit(200).alias("status"), F.lit("application/json").alias("content_type"), body.alias("body"),
        F.lit(7).cast("long").alias("elapsed_ms"), *more)


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an API would page them: bare arrays and two kinds of envelopes in turn."""
    pages = table(spark, sf_dir, "orders").groupBy(page_of("o_orderkey").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")))).alias("rows"))
    rows = F.to_json("rows")
    shape = F.col("page") % 3
    body = (
        F.when(shape == 0, rows)
        .when(shape == 1, F.concat(F.lit('{"data":'), rows, F.lit(',"total":'), F.size("rows").cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"items":'), rows, F.lit("}")))
    )
    return landed(pages, F.lit("shop"), F.lit("orders"), F.col("page"), body)


def segment(column: str = "c_mktsegment") -> Column:
    return F.lower(column)


# What an endpoint of the sample world answers, by segment and nation. Two segments never fail.
STEADY = ["machinery", "furniture"]


def answer_kind(source: str, nation: str) -> str:
    """SQL for the kind of answer; the oracles use the same rule on plain columns."""
    steady = ", ".join(f"'{s}'" for s in STEADY)
    return (f"CASE WHEN {nation} % 12 = 2 THEN 'empty' WHEN {source} IN ({steady}) THEN 'good' "
            f"WHEN {nation} % 12 = 0 THEN 'busy' WHEN {nation} % 12 = 1 THEN 'html' WHEN {nation} % 12 = 4 THEN 'lost' "
            f"WHEN {nation} % 12 = 3 THEN 'numbers' ELSE 'good' END")


def _customer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "*", segment().alias("source"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("endpoint"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per market segment, an endpoint per nation its customers come from."""
    return _customer_groups(spark, sf_dir).groupBy("source", "endpoint", F.col("c_nationkey").alias("ordinal")).agg(
        F.lit("api").alias("kind")).select(
        "source", "endpoint", "ordinal", "kind", F.concat(F.lit("http://"), F.col("source"), F.lit("/v1")).alias("base_url"),
        F.concat(F.lit("/"), F.col("endpoint")).alias("path"))


def world_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every endpoint's customers in pages; failing, empty and non-record endpoints by arithmetic."""
    pages = _customer_groups(spark, sf_dir).groupBy("source", "endpoint", "c_nationkey", page_of("c_custkey").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("rows"))
    kind = F.expr(answer_kind("source", "c_nationkey"))
    body = (
        F.when(kind == "busy", "busy").when(kind == "html", "<html></html>").when(kind == "empty", "[]").when(kind == "lost", "cut off")
        .when(kind == "numbers", F.to_json("rows.c_custkey")).otherwise(F.to_json("rows"))
    )
    return (
        landed(pages, F.col("source"), F.col("endpoint"), F.col("page"), body, kind.alias("answer"))
        .withColumn("status", F.when(F.col("answer") == "busy", 503).when(F.col("answer") != "lost", 200))
        .withColumn("content_type", F.when(F.col("answer") == "html", "text/html").otherwise(F.col("content_type")))
        .drop("answer"))


def recorded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the endpoints answered when their contracts were recorded.

    One segment was never recorded, nor was every sixth nation; every fourth nation had its balance
    as text; tables of every tenth nation have since lost their endpoint.
    """
    rows = _customer_groups(spark, sf_dir).filter((F.col("source") != "household") & (F.col("c_nationkey") % 6 != 5))
    text = F.when(F.col("c_nationkey") % 4 == 1, F.to_json(F.struct("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal")))
                  ).otherwise(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")))
    names = F.explode(F.when(F.col("c_nationkey") % 10 == 0, F.array(F.col("endpoint"), F.concat(F.lit("old_"), F.col("endpoint"))))
                      .otherwise(F.array("endpoint")))
    return landed(rows.withColumn("table", names), F.col("source"), F.col("table"), F.col("c_custkey"), text)


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    """The recorded contracts; one segment's can no longer be read."""
    nodes = materialize(normalise(infer_schema(recorded_bodies(spark, sf_dir))))
    damaged = nodes.filter("source = 'building'").select("source").distinct().withColumn("message", F.lit("damaged"))
    return Registry(nodes.filter("source <> 'building'"), damaged)


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Sampled, Registry]:
    responses = world_responses(spark, sf_dir)
    return catalog(spark, sf_dir), responses, sample(responses), registry(spark, sf_dir)


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nested documents (l_returnflag, ord, doc); the discount is dropped where it is 0."""
    rows = documents(spark, sf_dir, "lineitem")
    doc = F.struct(
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"),
        F.array("l_quantity", "l_extendedprice").alias("amounts"),
        F.array(F.struct(F.col("l_partkey").alias("id"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("off")),
                F.struct(F.col("l_suppkey").alias("id"), F.lit(None).cast("double").alias("off"))).alias("refs"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    return rows.select("l_returnflag", F.col("l_orderkey").alias("ord"), F.to_json(doc).alias("doc"))


def contact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of five sources, with nested records.

    Both have `address` and `home.geo`. In odd sources the addresses are alike and share a
    declaration; in even ones they differ and contest the name.
    """
    odd = lambda nation: F.col(nation) % 5 % 2 == 1
    source = lambda nation: F.concat(F.lit("s"), F.col(nation) % 5)
    home = lambda balance: F.struct(F.struct(F.col(balance).alias("lat")).alias("geo")).alias("home")
    c = documents(spark, sf_dir, "customer")
    customers = landed(c, source("c_nationkey"), F.lit("customer"), F.col("c_custkey"), F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("city"), F.col("c_nationkey").alias("zip")).alias("address"),
        home("c_acctbal"))))
    s = documents(spark, sf_dir, "supplier")
    suppliers = landed(s, source("s_nationkey"), F.lit("supplier"), F.col("s_suppkey"), F.to_json(F.struct(
        F.col("s_suppkey").alias("id"),
        F.struct(F.col("s_name").alias("city"), F.when(odd("s_nationkey"), F.col("s_nationkey")).alias("zip")).alias("address"),
        home("s_acctbal"))))
    return customers.unionByName(suppliers)
