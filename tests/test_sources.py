import datetime
import json

import pytest
from pyspark.sql import functions as F

from apitables.operators.infer import infer_schema
from apitables.operators.screen import explode_records, screen_status
from apitables.sources.landed import catalog_of, load_with_quarantine, read_bodies, read_responses
from apitables.sources.rest import fetch
from apitables.sources.typed import load_report, load_source, load_table

from .helpers import responses


def test_landed_responses(spark, tmp_path):
    df = responses(spark, ("a", {"x": 1}), {"endpoint": "b", "status": 404, "body": ""})
    df.write.parquet(str(tmp_path / "p"))
    df.drop("response_ord").write.json(str(tmp_path / "j"))
    for fmt in ("parquet", "json"):
        got = read_responses(spark, str(tmp_path / fmt[0]), fmt)
        rows = screen_status(got).orderBy("endpoint").collect()
        assert [(r.endpoint, r.ok, r.message, r.response_ord) for r in rows] == [
            ("a", True, None, 0), ("b", False, "request to `b` failed with status 404: (empty body)", 0)]
    (tmp_path / "files" / "shop").mkdir(parents=True)
    (tmp_path / "files" / "shop" / "users.json").write_text('[{"id":1},\n{"id":2}]')
    (tmp_path / "files" / "shop" / "orders.3.json").write_text("{}")
    rows = read_bodies(spark, str(tmp_path / "files")).collect()
    assert {(r.source, r.endpoint, r.response_ord) for r in rows} == {("shop", "users", 0), ("shop", "orders", 3)}


def test_quarantine(spark, tmp_path):
    folder = tmp_path / "defs"
    assert [df.count() for df in load_with_quarantine(spark, str(folder))] == [0, 0]
    folder.mkdir()
    doc = {"name": "shop", "base_url": "http://h", "endpoints": [{"name": "b", "path": "/b"}, {"name": "a", "path": "/a"}]}
    (folder / "shop.json").write_text(json.dumps(doc))
    (folder / "able.json").write_text(json.dumps({"name": "able", "base_url": "http://a", "auth_type": "bearer", "env_vars": ["T"]}))
    (folder / "torn.json").write_text('{"name": "torn"')
    (folder / "other.json").write_text(json.dumps(doc))
    (folder / "ports.json").write_text(json.dumps({"name": "ports", "base_url": "http://p", "endpoints": [{"name": "a", "path": "/a"}, {"name": "a"}, {"name": "B"}]}))
    (folder / "list.json").write_text("[]")
    (folder / "urlless.json").write_text('{"name": "urlless"}')
    good, bad = load_with_quarantine(spark, str(folder))
    assert [(r.name, r.kind, r.auth_type) for r in good.collect()] == [("able", "api", "bearer"), ("shop", "api", "none")]
    assert {r.name: r.reason for r in bad.collect()} == {
        "list": "not a source definition: `name` is missing",
        "other": "declared name `shop` does not match the file name `other`",
        "ports": "duplicate endpoint name `a`", "torn": "not valid JSON", "urlless": "not a source definition: `base_url` is missing"}
    assert [(r.endpoint, r.path, r.ordinal) for r in catalog_of(good).orderBy("ordinal").collect()] == [
        ("b", "/b", 0), ("a", "/a", 1)]


def test_typed_table(spark):
    body = [{"no": 4, "day": "2024-02-29", "at": "2024-02-28t23:30:00-0130", "mix": 1, "log": {"miles": [1, 2], "day": "2024-02-31"}, "two words": True, "wide": 1},
            {"no": 5, "day": "2024-02-31", "at": "2024-02-29T10:00:00z", "mix": "x", "log": {"miles": [], "day": "2024-01-02"}, "two words": None, "wide": 18446744073709551615},
            {"no": 6, "day": None, "at": "2024-02-29T10:00:00", "mix": None, "log": {"miles": [3, 9223372036854775808], "day": "2024-02-30"}, "rate": 0.5, "local": "2024-02-29T10:00:00.25"}]
    df = responses(spark, ("t", body))
    records, nodes = explode_records(df), infer_schema(df)
    table = load_table(records, nodes)
    assert dict(table.dtypes) == {
        "no": "bigint", "day": "date", "at": "timestamp", "mix": "variant", "log": "struct<day:date,miles:array<decimal(20,0)>>", "two words": "boolean",
        "wide": "decimal(20,0)", "rate": "double", "local": "timestamp_ntz"}
    rows = table.drop("mix", "at").orderBy("no").collect()
    assert [r.day for r in rows] == [datetime.date(2024, 2, 29), None, None]
    assert [r.wide for r in rows] == [1, 2**64 - 1, None]
    assert [r.log.miles for r in rows] == [[1, 2], [], [3, 2**63]]
    assert rows[2].local == datetime.datetime(2024, 2, 29, 10, 0, 0, 250000)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        at = [r.s for r in load_table(records, nodes).orderBy("no").select(F.unix_timestamp("at").alias("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert at == [1709168400, 1709200800, 1709200800]
    lost = {r["column"]: (r.present, r.lost) for r in load_report(records, nodes).collect()}
    assert lost == {"no": (3, 0), "day": (2, 1), "at": (3, 0), "mix": (2, 0), "log.day": (3, 2), "log.miles[]": (4, 0), "two words": (1, 0),
                    "wide": (2, 0), "rate": (1, 0), "local": (1, 0)}
    with pytest.raises(ValueError):
        load_table(records, infer_schema(responses(spark, ("t", [1]))))


def test_whole_source(spark):
    df = responses(spark, ("boats", [{"no": 4}]), ("crews", {"name": "Ib"}), ("tally", [1]), {"source": "other", "endpoint": "boats", "body": {"x": 1}})
    tables = load_source(explode_records(df), infer_schema(df), "shop", "s_")
    assert {n: [tuple(r) for r in t.collect()] for n, t in tables.items()} == {"s_boats": [(4,)], "s_crews": [("Ib",)]}


def fake_transport(url, headers, timeout):
    if url.endswith("/tides"):
        return 404, "text/plain", "no such page"
    if url.endswith("/down"):
        raise OSError("no route")
    return 200, "application/json", json.dumps({"url": url, "headers": sorted(headers), "timeout": timeout})


def test_rest_endpoints(spark):
    token, base = ["APITABLES_TEST_TOKEN"], "http://h/v2"
    rows = [("plain", base, "/low", "none", None), ("keyed", base + "/", "low", "api_key", token), ("bearer", base, "", "bearer", token),
            ("gone", base, "tides", None, None), ("down", base, "down", None, None), ("up", base, "../x", "bearer", token),
            ("unset", base, "low", "api_key", ["APITABLES_UNSET"])]
    catalog = spark.createDataFrame([("s", *r) for r in rows], "source string, endpoint string, base_url string, path string, auth_type string, env_vars array<string>")
    df = fetch(catalog, fake_transport, timeout=7, per_task=2)
    assert df.rdd.getNumPartitions() == 4
    got = {r.endpoint: r for r in df.collect()}
    body = {e: json.loads(got[e].body) for e in ("plain", "keyed", "bearer")}
    assert body["plain"] == {"url": "http://h/v2/low", "headers": [], "timeout": 7.0}
    assert body["keyed"]["url"] == "http://h/v2/low" and body["keyed"]["headers"] == ["X-Api-Key"]
    assert body["bearer"] == {"url": "http://h/v2", "headers": ["Authorization"], "timeout": 7.0}
    assert (got["gone"].status, got["gone"].body) == (404, "no such page")
    assert {e: (got[e].status, got[e].body) for e in ("down", "up", "unset")} == {
        "down": (None, "no route"), "up": (None, "path must not contain `..` segments"), "unset": (None, "environment variable `APITABLES_UNSET` is not set")}
    assert {r.endpoint for r in screen_status(df).filter("NOT ok AND message IS NOT NULL").collect()} == {"gone", "down", "up", "unset"}
