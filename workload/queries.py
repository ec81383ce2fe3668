"""One registered query per operator, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from apitables.functions.json import value_kind, with_json
from apitables.functions.text import error_snippet, is_iso_date, is_iso_datetime, is_tz_offset, path_text
from apitables.functions.urls import identifier_violation, in_scope, join_url, path_violation
from apitables.operators.diff import diff_schemas, with_fingerprint
from apitables.operators.infer import (
    column_profile, flatten, infer_column, infer_schema, optionality, path_stats,
)
from apitables.operators.naming import (
    contract_lines, dedupe_records, hoist, normalise, registry_violations, render_contract, unqualify,
)
from apitables.operators.rules import first_violation
from apitables.operators.screen import explode_records, record_sets, screen_status
from apitables.operators.sums import conforms, enum_report, parse_enum, tag_variant
from apitables.operators.tableset import TableSet, load
from apitables.plans import contract, introspect, listing
from apitables.session import shared_folder
from apitables.sources.landed import judge_definitions, split_definitions
from apitables.sources.registry import read_registry, registry_state, write_registry
from apitables.sources.rest import fetch
from apitables.sources.typed import load_report, load_source, load_table

from .bodies import (
    catalog, contact_tables, documents, landed, nested_lines, order_pages, registry, recorded_bodies, table, world, world_responses,
)

def _path():
    return path_text(F.col("path")).alias("path")


# --- screening -----------------------------------------------------------

def json_validity(spark, sf_dir):
    props = F.col("props")
    forms = {"whole": props, "cut": F.expr("substring(props, 1, length(props) - 1)"), "trailing": F.concat(props, F.lit(" x")),
             "two": F.concat(props, F.lit(","), props), "listed": F.concat(F.lit("["), props, F.lit("]")),
             "bracket": F.concat(props, F.lit("]"))}
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = documents(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(F.create_map(*pairs)).alias("form", "text"))
    pages = documents(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("html").alias("form"), F.col("html").alias("text"))
    return with_json(rows.unionByName(pages), "text", "v", "valid").select("id", "form", "valid")


def _event_responses(spark, sf_dir):
    status = (F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "purchase", 204)
              .when(F.col("event_type") == "signup", 301).when(F.col("event_type") == "view", 404).otherwise(500))
    events = table(spark, sf_dir, "events")
    return landed(events, F.lit("shop"), F.concat(F.lit("/events/"), F.col("event_id")), F.lit(0), F.col("props"),
                  "event_id", status.alias("code")).drop("status").withColumnRenamed("code", "status")


def status_screen(spark, sf_dir):
    return screen_status(_event_responses(spark, sf_dir)).select("event_id", "ok", F.coalesce("message", F.lit("")).alias("message"))


def error_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", error_snippet(F.col("text")).alias("snippet"))


def envelope_detect(spark, sf_dir):
    rows = record_sets(order_pages(spark, sf_dir))
    return rows.select(F.col("response_ord").alias("page"), "name", F.coalesce("envelope", F.lit("none")).alias("envelope"), "record_count")


def envelope_unwrap(spark, sf_dir):
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return explode_records(order_pages(spark, sf_dir)).select(
        get("o_orderkey", "bigint"), get("o_custkey", "bigint"), get("o_orderstatus", "string"),
        get("o_totalprice", "double"), F.col("response_ord").alias("page"), F.col("rec_ord").cast("long").alias("place"))


def records_guard(spark, sf_dir):
    rows = introspect.sample(world_responses(spark, sf_dir)).endpoints
    return rows.filter("record_count > 0").select("source", "endpoint", "is_record", "record_count")


# --- inference -----------------------------------------------------------

def path_stats_events(spark, sf_dir):
    stats = path_stats(column_profile(documents(spark, sf_dir, "events"), "props", ["event_type"], "event_id"))
    return stats.select("event_type", _path(), "kind", "n")


def path_stats_lineitem(spark, sf_dir):
    stats = path_stats(column_profile(nested_lines(spark, sf_dir), "doc", ["l_returnflag"], "ord"))
    return stats.select("l_returnflag", _path(), "kind", "n")


def node_flatten(spark, sf_dir):
    records = explode_records(order_pages(spark, sf_dir))
    nodes = flatten(records, ["source", "endpoint", "response_ord"])
    return nodes.groupBy(F.col("response_ord").alias("page"), _path(), "kind").agg(F.count("*").alias("n"))


def value_kinds(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    forms = {
        "int": key, "point": F.concat(key, F.lit(".0")), "exponent": F.concat(key, F.lit("e3")),
        "unsigned": F.concat(F.lit("18446744073709"), F.lpad(F.pmod("o_orderkey", F.lit(500000)).cast("string"), 6, "0")),
        "huge": F.concat(F.lit("9"), key, F.lit("00000000000000000000")), "negative": F.concat(F.lit("-1"), key),
        "text": F.concat(F.lit('"'), key, F.lit('"')), "bool": F.lit("true"), "null": F.lit("null"),
        "array": F.concat(F.lit("["), key, F.lit("]")), "record": F.concat(F.lit('{"a":'), key, F.lit("}")),
        "date": F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"')),
        "datetime": F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"')),
    }
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = documents(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.create_map(*pairs)).alias("form", "text"))
    return rows.select("o_orderkey", "form", value_kind(F.parse_json("text")).alias("kind"))


def iso_kinds(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = {
        "day": day, "plain": stamp, "zulu": F.concat(stamp, F.lit("Z")), "fraction": F.concat(stamp, F.lit(".25z")),
        "colon": F.concat(stamp, F.lit("+02:00")), "short": F.concat(stamp, F.lit("-0530")), "hours": F.concat(stamp, F.lit("+14")),
        "space": F.regexp_replace(stamp, "T", " "), "month": F.concat(F.lit("2024-13-"), F.date_format("ts", "dd")),
        "packed": F.regexp_replace(day, "-", ""), "minutes": F.substring(stamp, 1, 16), "line": F.concat(day, F.lit("\n")),
        "offset": F.concat(stamp, F.lit("+24")), "dot": F.concat(stamp, F.lit(".Z")), "low": F.lower(stamp),
    }
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.create_map(*pairs)).alias("form", "text"))
    text = F.col("text")
    return rows.select("event_id", "form", is_iso_date(text).alias("is_date"), is_iso_datetime(text).alias("is_datetime"),
                       is_tz_offset(F.substring(text, 20, 10)).alias("is_offset"))


def infer_events(spark, sf_dir):
    nodes = infer_column(documents(spark, sf_dir, "events"), "props", ["event_type"], "event_id")
    return nodes.select("event_type", _path(), "label", "optional")


def _optional_docs(spark, sf_dir):
    rows = documents(spark, sf_dir, "customer")
    doc = F.concat(F.lit('{"id":'), F.col("c_custkey"),
                   F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(',"bal":'), F.col("c_acctbal"))),
                   F.when(F.col("c_custkey") % 7 == 0, ',"seg":null').otherwise(F.concat(F.lit(',"seg":"'), F.col("c_mktsegment"), F.lit('"'))),
                   F.lit(',"gone":null}'))
    return rows.select("c_nationkey", "c_custkey", doc.alias("doc"))


def infer_optional(spark, sf_dir):
    nodes = infer_column(_optional_docs(spark, sf_dir), "doc", ["c_nationkey"], "c_custkey")
    return nodes.filter("depth = 1").select("c_nationkey", _path(), "label", "optional")


def optional_fields(spark, sf_dir):
    stats = path_stats(column_profile(_optional_docs(spark, sf_dir), "doc", [], "c_custkey"))
    return optionality(stats, [], "'record'").select(_path(), "optional")


def infer_union(spark, sf_dir):
    key = F.col("p_partkey")
    value = (F.when(key % 4 == 0, F.col("p_size").cast("string")).when(key % 4 == 1, F.concat(F.lit('"'), "p_name", F.lit('"')))
             .when(key % 4 == 2, F.lit('"2024-01-15"')).otherwise(F.col("p_retailprice").cast("string")))
    docs = documents(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit('{"v":'), value, F.lit("}")).alias("doc"))
    return infer_column(docs, "doc", ["p_brand"], "p_partkey").filter("depth = 1").select("p_brand", "label", "optional")


def infer_null_array(spark, sf_dir):
    key = F.col("s_suppkey")
    value = (F.when(key % 3 == 0, "[]").when(key % 3 == 1, F.concat(F.lit("[null,"), F.col("s_acctbal"), F.lit("]")))
             .otherwise(F.concat(F.lit('["'), "s_name", F.lit('",null]'))))
    docs = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit('{"v":'), value, F.lit("}")).alias("doc"))
    return infer_column(docs, "doc", ["s_nationkey"], "s_suppkey").filter("depth = 1").select("s_nationkey", "label")


def infer_nested(spark, sf_dir):
    nodes = infer_column(nested_lines(spark, sf_dir), "doc", ["l_returnflag"], "ord", "line")
    return nodes.select("l_returnflag", _path(), "label", "optional")


def infer_responses(spark, sf_dir):
    return infer_schema(order_pages(spark, sf_dir)).select("source", "endpoint", _path(), "label", "optional")


# --- diff ----------------------------------------------------------------

def _halves(spark, sf_dir):
    orders = documents(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    where = (F.lit("shop"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), F.col("o_orderkey"))
    stored = landed(orders.filter(early), *where, F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(True).alias("rush"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.struct("o_custkey").alias("buyer"))))
    fresh = landed(orders.filter(~early), *where, F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("by hand")).alias("note"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.struct("o_custkey", F.col("o_orderstatus").alias("state")).alias("buyer"))))
    return infer_schema(stored), infer_schema(fresh)


def schema_diff(spark, sf_dir):
    changes = diff_schemas(*_halves(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("source", "endpoint").orderBy("change_ord"))
    return changes.select("endpoint", place.cast("long").alias("place"), "op", F.col("path_text").alias("path"), F.coalesce("from_label", F.lit("")).alias("was"),
                          F.coalesce("to_label", F.lit("")).alias("now"), "line")


def diff_nested_suppressed(spark, sf_dir):
    rows = documents(spark, sf_dir, "customer")
    where = (F.lit("shop"), F.lower("c_mktsegment"), F.col("c_custkey"))
    stored = landed(rows, *where, F.to_json(F.struct(
        F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("city"), F.col("c_nationkey").alias("zip")).alias("addr")).alias("c"),
        F.array("c_nationkey").alias("tags"), F.array("c_name").alias("w"))))
    fresh = landed(rows, *where, F.to_json(F.struct(
        F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("addr")).alias("c"),
        F.array("c_name").alias("tags"), F.array("c_name").alias("w"))))
    changes = diff_schemas(infer_schema(stored), infer_schema(fresh))
    return changes.select("endpoint", "line")


def fingerprints(spark, sf_dir):
    rows = documents(spark, sf_dir, "customer")
    shape = F.col("c_nationkey") % 3
    body = (F.when(shape == 0, F.to_json(F.struct(F.struct(F.col("c_custkey").alias("a"), F.col("c_name").alias("b")).alias("x"))))
            .when(shape == 1, F.to_json(F.struct(F.struct(F.col("c_name").alias("b"), F.col("c_nationkey").alias("a")).alias("x"))))
            .otherwise(F.to_json(F.struct(F.struct(F.col("c_name").alias("a"), F.col("c_name").alias("b")).alias("x")))))
    nodes = with_fingerprint(infer_schema(landed(rows, F.lit("shop"), F.concat(F.lit("n"), F.col("c_nationkey")), F.col("c_custkey"), body)))
    return nodes.filter("depth = 0").groupBy("fingerprint").agg(
        F.min("endpoint").alias("first_endpoint"), F.count("*").alias("endpoints")).drop("fingerprint")


# --- registry ------------------------------------------------------------

def _contacts(spark, sf_dir):
    return normalise(infer_schema(contact_tables(spark, sf_dir)))


def record_names(spark, sf_dir):
    rows = _contacts(spark, sf_dir).filter("depth > 0 AND array_contains(members, 'record')")
    return rows.select("source", "endpoint", _path(), "record_name", "declares")


def record_declarations(spark, sf_dir):
    hoisted = hoist(infer_schema(contact_tables(spark, sf_dir)))
    return dedupe_records(hoisted).select("source", "name", F.col("reached.endpoint").alias("endpoint"),
                                          path_text(F.col("reached.path")).alias("path"))


def contract_text(spark, sf_dir):
    return render_contract(_contacts(spark, sf_dir))


def contract_line_rows(spark, sf_dir):
    rows = contract_lines(_contacts(spark, sf_dir))
    return rows.groupBy("source", "text").agg(F.count("*").alias("n"))


def unqualified_names(spark, sf_dir):
    rows = unqualify(_contacts(spark, sf_dir)).filter("array_contains(members, 'record')")
    return rows.select("source", "endpoint", _path(), "label")


def registry_problems(spark, sf_dir):
    parts = documents(spark, sf_dir, "part")
    body = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct("p_size").alias("int"))))
    docs = landed(parts, F.lit("parts"), F.col("p_brand"), F.col("p_partkey"),
                  F.coalesce(body, F.to_json(F.struct(F.col("p_partkey").alias("part no")))))
    numbers = landed(parts, F.lit("parts"), F.lower("p_type"), F.col("p_partkey"), F.to_json(F.array("p_size")))
    return registry_violations(infer_schema(docs.unionByName(numbers))).select("endpoint", "problem")


def registry_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    nodes = _contacts(spark, sf_dir)
    write_registry(nodes, path)
    # Replacing one source must leave the others as they are.
    write_registry(nodes.filter("source = 's1' AND endpoint = 'customer'"), path)
    return read_registry(spark, path).nodes.select("source", "endpoint", _path(), "label", "optional")


def registry_states(spark, sf_dir):
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    write_registry(normalise(infer_schema(recorded_bodies(spark, sf_dir))), path)
    # One source's file is damaged by half a line.
    spark.range(1).selectExpr("'{\"endpoint\": ' AS value").write.mode("append").text(f"{path}/source=building")
    return registry_state(catalog(spark, sf_dir), read_registry(spark, path)).select("source", "state")


def publish_registry(spark, sf_dir):
    # Two segments are sound; the contracts of one of them have a table name that cannot be written.
    cat, _, sampled, recorded = world(spark, sf_dir)
    odd = F.when((F.col("source") == "furniture") & (F.col("endpoint") == "n3"), "n 3").otherwise(F.col("endpoint"))
    sampled = introspect.Sampled(*[df.withColumn("endpoint", odd) for df in sampled])
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    outcomes = introspect.publish(cat.withColumn("endpoint", odd), sampled, recorded.nodes, path)
    there = read_registry(spark, path).nodes.filter("depth = 0").groupBy("source").agg(F.count("*").alias("tables"))
    told = outcomes.groupBy("source").agg(F.count_if(F.col("outcome") == "failed").alias("failed"),
                                          F.max(F.when(F.col("detail").startswith("cannot write"), F.col("detail"))).alias("problem"))
    return told.join(there, "source", "left").select("source", "failed", F.coalesce("problem", F.lit("")).alias("problem"),
                                                     F.coalesce("tables", F.lit(0)).alias("tables"))


# --- jobs ----------------------------------------------------------------

def introspect_outcomes(spark, sf_dir):
    cat, _, sampled, recorded = world(spark, sf_dir)
    rows = introspect.introspect(cat, sampled, recorded.nodes)
    return rows.select("source", "endpoint", "ordinal", "outcome", F.coalesce("record_count", F.lit(-1)).alias("record_count"),
                       F.coalesce("kept_schema", F.lit(False)).alias("kept_schema"), F.coalesce("detail", F.lit("")).alias("detail"))


def carry_forward(spark, sf_dir):
    cat, _, sampled, recorded = world(spark, sf_dir)
    outcomes = introspect.introspect(cat, sampled, recorded.nodes)
    rows = introspect.carry_forward(sampled.nodes, recorded.nodes, outcomes)
    return rows.filter("depth = 1").select("source", "endpoint", _path(), "label")


def publish_gate(spark, sf_dir):
    cat, _, sampled, recorded = world(spark, sf_dir)
    return introspect.publishable(introspect.introspect(cat, sampled, recorded.nodes)).select("source", "clean", "tables", "publish")


def _steps(spark, sf_dir):
    cat, responses, sampled, recorded = world(spark, sf_dir)
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("source")).distinct()
    # One definition failed to load, and one source has no endpoints.
    sources = segments.select("source", F.when(F.col("source") == "furniture", "cannot parse").alias("problem")).unionByName(
        segments.filter("source = 'machinery'").select(F.lit("bare").alias("source"), F.lit(None).cast("string").alias("problem")))
    return contract.test_report(sources, cat, responses, sampled, recorded), cat, recorded


def contract_steps(spark, sf_dir):
    steps, _, _ = _steps(spark, sf_dir)
    return steps.select("source", F.coalesce("endpoint", F.lit("")).alias("endpoint"), "step", "outcome",
                        F.coalesce("detail", F.lit("")).alias("detail"))


def source_rollup(spark, sf_dir):
    steps, cat, recorded = _steps(spark, sf_dir)
    return contract.rollup(steps, contract.unmatched_tables(recorded.nodes, cat))


def orphan_tables(spark, sf_dir):
    return contract.unmatched_tables(registry(spark, sf_dir).nodes, catalog(spark, sf_dir))


def source_connectivity(spark, sf_dir):
    return listing.check_connectivity(catalog(spark, sf_dir), world_responses(spark, sf_dir))


def source_listing(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    connected = listing.check_connectivity(cat, world_responses(spark, sf_dir))
    return listing.list_sources(cat.select("source", "kind", "base_url").distinct(), cat, registry(spark, sf_dir).nodes, connected)


# --- rules and URLs ------------------------------------------------------

def path_violations(spark, sf_dir):
    url = F.col("url")
    tail = F.regexp_replace(url, r"^https?://[^/]*", "")
    forms = {"absolute": url, "host": F.regexp_replace(url, r"^https?:", ""), "path": tail,
             "up": F.concat(tail, F.lit("/../x")), "back": F.concat(F.lit("\\"), tail), "query": F.concat(F.lit("/s?u="), url, F.lit("/../x"))}
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.create_map(*pairs)).alias("form", "path"))
    return rows.select("page_id", "form", F.coalesce(path_violation(F.col("path")), F.lit("")).alias("problem"))


def first_violations(spark, sf_dir):
    name = F.regexp_extract("url", r"^https?://[^/]*/([^/]*)/", 1)
    rows = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("host"), "page_id",
        F.when(F.col("page_id") % 9 == 4, F.upper(name)).otherwise(F.concat(name, F.lit("_"), F.col("page_id") % 5)).alias("name"),
        F.when(F.col("page_id") % 7 == 3, F.col("url")).otherwise("/ok").alias("path"))
    return first_violation(
        rows, ["host"], "page_id",
        [F.concat(F.lit("endpoint name "), identifier_violation(F.col("name"))),
         F.concat(F.lit("path "), path_violation(F.col("path")))],
        unique="name", duplicate="duplicate endpoint name")


def _links(spark, sf_dir):
    return documents(spark, sf_dir, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def url_join(spark, sf_dir):
    base = F.regexp_extract("url", r"^(https?://[^/]*/[^/]*)/", 1)
    return _links(spark, sf_dir).select("page_id", F.col("place").cast("long").alias("place"), join_url(base, F.col("href")).alias("joined"),
                                        join_url(F.concat(base, F.lit("/?x=1")), F.concat(F.lit("/"), "href")).alias("slashed"))


def link_scope(spark, sf_dir):
    origin = F.regexp_extract("url", r"^(https?://[^/]*)/", 1)
    scheme, host = F.regexp_extract("url", r"^(https?):", 1), F.regexp_extract("url", r"^https?://([^/]*)", 1)
    base = F.concat(origin, F.lit("/shop"))
    port = F.when(scheme == "http", ":80").otherwise(":443")
    other = F.when(scheme == "http", "https").otherwise("http")
    forms = {
        "below": F.concat(base, F.col("href")), "root": F.concat(origin, F.col("href")), "base": base,
        "sibling": F.concat(base, F.lit("2"), F.col("href")), "scheme": F.concat(other, F.lit("://"), host, F.lit("/shop"), F.col("href")),
        "host": F.concat(scheme, F.lit("://x."), host, F.lit("/shop"), F.col("href")),
        "port": F.concat(F.upper(scheme), F.lit("://"), F.upper(host), port, F.lit("/shop"), F.col("href")),
        "other_port": F.concat(scheme, F.lit("://"), host, F.lit(":8081/shop"), F.col("href")),
        "up": F.concat(base, F.lit("/.."), F.col("href")), "coded": F.concat(base, F.lit("/%2e%2E"), F.col("href")),
        "query": F.concat(base, F.col("href"), F.lit("?next=/../x")),
    }
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = _links(spark, sf_dir).select("page_id", "place", base.alias("base"), F.explode(F.create_map(*pairs)).alias("form", "link"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "form", in_scope(F.col("link"), F.col("base")).alias("inside"))


def link_scope_normalised(spark, sf_dir):
    """Each link of `pages` spelt in ways that only a URL parser reads right: escapes that leave the base, and
    harmless spellings of a link below it."""
    origin = F.regexp_extract("url", r"^(https?://[^/]*)/", 1)
    scheme, host = F.regexp_extract("url", r"^(https?):", 1), F.regexp_extract("url", r"^https?://([^/]*)", 1)
    base = F.concat(origin, F.lit("/shop"))
    forms = {
        "userinfo": F.concat(scheme, F.lit("://evil.example\\@"), host, F.lit("/shop"), F.col("href")),
        "tab_up": F.concat(base, F.lit("/.\t."), F.col("href")),
        "backslash_up": F.concat(base, F.lit("/x\\..\\.."), F.col("href")),
        "inner_up": F.concat(base, F.lit("/a/.."), F.col("href")),
        "coded_single": F.concat(base, F.lit("/%2E"), F.col("href")),
        "encoded_host": F.concat(scheme, F.lit("://%"), F.hex(F.substring(host, 1, 1)), F.substring(host, 2, 1 << 20), F.lit("/shop"), F.col("href")),
        "backslashes": F.concat(scheme, F.lit(":\\\\"), host, F.lit("\\shop"), F.col("href")),
        "padded": F.concat(F.lit("  "), base, F.col("href"), F.lit("\n")),
        "zero_port": F.concat(scheme, F.lit("://"), host, F.lit(":0080/shop"), F.col("href")),
    }
    pairs = [x for name, text in forms.items() for x in (F.lit(name), text)]
    rows = _links(spark, sf_dir).select("page_id", "place", "url", base.alias("base"), F.explode(F.create_map(*pairs)).alias("form", "link"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "form", in_scope(F.col("link"), F.col("base")).alias("inside"))


def echo(url, headers, timeout):
    """Stands in for the network: every third answer is an error."""
    code = int(url.rsplit("/", 1)[1])
    return (404 if code % 3 == 0 else 200), "text/plain", f"{url} {len(headers)} {timeout:.0f}"


def rest_endpoints(spark, sf_dir):
    cat = table(spark, sf_dir, "supplier").select(
        F.lit("suppliers").alias("source"), F.col("s_name").alias("endpoint"),
        F.concat(F.lit("http://h"), "s_nationkey", F.lit("/api/")).alias("base_url"), F.concat(F.lit("/items/"), "s_suppkey").alias("path"),
        F.lit("none").alias("auth_type"), F.array().cast("array<string>").alias("env_vars"))
    return screen_status(fetch(cat, echo, timeout=9)).select("endpoint", "status", "ok", "body")


def quarantine(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("supplier-"), F.col("s_suppkey"))
    kind = F.col("s_suppkey") % 8
    ends = lambda *pairs: F.lit(',"endpoints":[' + ",".join(f'{{"name":"{n}","path":"{p}"}}' for n, p in pairs) + "]}")
    head = F.concat(F.lit('{"name":"'), name, F.lit('","base_url":"http://h/'), F.col("s_nationkey"), F.lit('"'))
    text = (
        F.when(kind == 1, F.concat(F.lit('{"name":"'), name, F.lit('"')))
        .when(kind == 2, F.concat(F.lit('{"name":"x'), name, F.lit('","base_url":"http://h"}')))
        .when(kind == 3, F.concat(F.lit('{"name":"'), name, F.lit('"}')))
        .when(kind == 4, F.lit('{"base_url":"http://h"}'))
        .when(kind == 5, F.concat(head, ends(("low", "/low"), ("Low", "../x"))))
        .when(kind == 6, F.concat(head, ends(("low", "/low"), ("high", "//x"), ("low", "/low"))))
        .when(kind == 7, F.concat(head, ends(("low", "/low"), ("high", "/high"), ("low", "/2"), ("", ""))))
        .otherwise(F.concat(head, ends(("low", "/low"), ("high", "/high")))))
    good, bad = split_definitions(judge_definitions(s.select(name.alias("file"), text.alias("text"))))
    return good.select("name", F.lit("good").alias("verdict")).unionByName(bad.withColumnRenamed("reason", "verdict"))


# --- table sets, typed loads and sum types -------------------------------

def _shop(spark, sf_dir):
    db = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "supplier")}
    return TableSet.empty().with_(load(db, "db_"))


def ts_join_collapse(spark, sf_dir):
    out = _shop(spark, sf_dir).join("db_orders.o_custkey", "db_customer.c_custkey", "sales", "o_", "c_")
    return out["sales"].select("o_o_orderkey", "c_c_name", "c_c_mktsegment", "o_o_totalprice")


def ts_relate_orphans(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return (_shop(spark, sf_dir).with_({"large": large}).relate("db_customer.c_custkey", "large.o_custkey")
            .orphan_rows("db_customer.c_custkey", "large.o_custkey").select("c_custkey", "c_name"))


def ts_extend(spark, sf_dir):
    out = _shop(spark, sf_dir).extend("db_customer", "full_name", F.concat_ws(" ", "c_name", "c_mktsegment"))
    return out["db_customer"].select("c_custkey", "full_name")


def ts_split(spark, sf_dir):
    out = _shop(spark, sf_dir).split("db_orders", {"open": F.col("o_orderstatus") == "O", "big": F.col("o_totalprice") > 250000})
    merged = out.extend("open", "part", F.lit("open")).extend("big", "part", F.lit("big")).extend("db_orders_rest", "part", F.lit("rest"))
    return merged.merge(["open", "big", "db_orders_rest"], "all")["all"].select("o_orderkey", "part")


def ts_merge(spark, sf_dir):
    shop = _shop(spark, sf_dir).merge(["db_customer", "db_supplier"], "contacts")
    return shop["contacts"].select(F.coalesce("c_name", "s_name").alias("name"), F.coalesce("c_acctbal", "s_acctbal").alias("balance"),
                                   F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


STATES = {"O": "Open", "F": "Filled"}


def enum_parse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(parse_enum(F.col("o_orderstatus"), STATES), F.lit("none")).alias("state"))


def enum_unmatched(spark, sf_dir):
    return enum_report(table(spark, sf_dir, "orders"), "o_orderstatus", STATES)


def variant_tag(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.when(key % 3 != 1, F.col("p_name")).alias("title"),
        F.when(key % 3 != 0, F.col("p_size")).alias("size"))
    tagged = tag_variant(rows, {"Titled": ["brand", "title"], "Sized": ["brand", "size"]})
    return tagged.select("p_partkey", F.coalesce("tag", F.lit("none")).alias("tag"), F.coalesce("Titled.title", F.lit("")).alias("title"),
                         F.coalesce("Sized.size", F.lit(-1)).alias("size"))


def union_conform(spark, sf_dir):
    key = F.col("e.event_id")
    rows = table(spark, sf_dir, "events").alias("e").select("event_id", F.when(key % 4 == 0, F.col("user_id").cast("string"))
                                                            .when(key % 4 == 1, F.concat(F.lit('"'), "event_type", F.lit('"')))
                                                            .when(key % 4 == 2, F.col("props")).otherwise("true").alias("text"))
    v = F.parse_json("text")
    return rows.select("event_id", conforms(v, ["string", "number"]).alias("id"), conforms(v, ["bool"]).alias("flag"))


def _dated_orders(spark, sf_dir):
    orders = documents(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-31"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    wide = F.when(F.col("o_orderkey") % 5 == 0, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(F.col("o_orderkey").cast("decimal(20,0)"))
    return landed(orders, F.lit("shop"), F.lit("orders"), F.col("o_orderkey"), F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), day.alias("day"), wide.alias("wide"),
        F.concat(stamp, F.lit("-0530")).alias("at"), stamp.alias("local"),
        F.struct(F.col("o_custkey").alias("id"), F.array(day, F.lit("2024-01-15")).alias("days")).alias("buyer"))))


def typed_load(spark, sf_dir):
    responses = _dated_orders(spark, sf_dir)
    rows = load_table(explode_records(responses), infer_schema(responses))
    return rows.select("id", "price", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("lost")).alias("day"),
                       F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), F.col("buyer.id").alias("buyer"))


def typed_load_unsigned(spark, sf_dir):
    responses = _dated_orders(spark, sf_dir)
    rows = load_table(explode_records(responses), infer_schema(responses))
    kinds = F.lit(" ".join(f"{n}:{t}" for n, t in rows.select("wide", "local").dtypes))
    return rows.select("id", F.col("wide").cast("string").alias("wide"), F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("local"), kinds.alias("kinds"))


def typed_load_report(spark, sf_dir):
    responses = _dated_orders(spark, sf_dir)
    return load_report(explode_records(responses), infer_schema(responses))


def ts_load_source(spark, sf_dir):
    responses = contact_tables(spark, sf_dir)
    tables = TableSet.empty().with_(load_source(explode_records(responses), infer_schema(responses), "s1", "one_"))
    rows = [tables[n].select(F.lit(n).alias("name"), "id", F.col("address.city").alias("city"), F.col("home.geo.lat").alias("lat")) for n in sorted(tables.tables)]
    return rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]


def _deep_orders(spark, sf_dir, levels):
    orders = documents(spark, sf_dir, "orders")
    inner = F.concat(F.lit('{"key":'), F.col("o_orderkey"), F.lit(',"who":['), F.col("o_custkey"), F.lit("]}"))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"d":' * levels), inner, F.lit("}" * levels))).otherwise(
        F.concat(F.lit('{"d":{"flat":"'), F.col("o_orderstatus"), F.lit('"}}')))
    return landed(orders, F.lit("shop"), F.lit("deep"), F.col("o_orderkey"), body)


def infer_deep(spark, sf_dir):
    # Twelve levels take a second round, 140 many; the path's length stands for its steps.
    out = None
    for levels in (12, 140):
        nodes = infer_schema(_deep_orders(spark, sf_dir, levels)).select(
            F.lit(levels).alias("levels"), F.col("depth").cast("long").alias("depth"), F.try_element_at("path", F.lit(-1)).alias("step"), "label", "optional")
        out = nodes if out is None else out.unionByName(nodes)
    return out.select("levels", "depth", F.coalesce("step", F.lit("")).alias("step"), "label", "optional")


def flatten_deep(spark, sf_dir):
    nodes = flatten(explode_records(_deep_orders(spark, sf_dir, 12)))
    return nodes.groupBy(F.size("path").cast("long").alias("depth"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("step"), "kind").agg(F.count("*").alias("n"))


def infer_nested_array_order(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"'), "o_orderstatus", F.lit('",'), F.col("o_custkey"))).otherwise(
        F.concat(F.col("o_custkey"), F.lit(',"'), "o_orderstatus", F.lit('"')))
    rows = documents(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.concat(F.lit('{"v":[[[['), first, F.lit("]]]]}")).alias("doc"))
    return infer_column(rows, "doc", ["o_orderpriority"], "o_orderkey").filter("depth = 1").select("o_orderpriority", "label")


QUERIES = {
    f.__name__: f for f in (
        json_validity, status_screen, error_snippets, envelope_detect, envelope_unwrap, records_guard,
        path_stats_events, path_stats_lineitem, node_flatten, value_kinds, iso_kinds, infer_events, infer_optional,
        optional_fields, infer_union, infer_null_array, infer_nested, infer_responses,
        schema_diff, diff_nested_suppressed, fingerprints,
        record_names, record_declarations, contract_text, contract_line_rows, unqualified_names, registry_problems,
        registry_roundtrip, registry_states,
        introspect_outcomes, carry_forward, publish_gate, publish_registry, contract_steps, source_rollup, orphan_tables,
        source_connectivity, source_listing,
        path_violations, first_violations, url_join, link_scope, link_scope_normalised, quarantine, rest_endpoints,
        ts_join_collapse, ts_relate_orphans, ts_extend, ts_split, ts_merge, enum_parse, enum_unmatched, variant_tag,
        union_conform, typed_load, typed_load_unsigned, typed_load_report, ts_load_source,
        infer_deep, flatten_deep, infer_nested_array_order,
    )
}
