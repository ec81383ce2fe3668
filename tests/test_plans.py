import pytest

from apitables.operators.infer import infer_schema
from apitables.operators.naming import normalise
from apitables.plans.contract import ordered_steps, rollup, test_report as report, unmatched_tables
from apitables.plans.introspect import publish, publishable, sample
from apitables.plans.listing import check_connectivity, list_sources
from apitables.sources.registry import read_registry, registry_state, write_registry

from .helpers import as_labels, responses

USER = [{"id": 1, "name": "Ada"}]
# source -> {endpoint: (response overrides)}
FRESH = {
    "ok": {"users": {"body": [{"id": 1}, {"id": 2}]}, "orders": {"body": {"data": [{"id": 1}], "total": 1}}},
    "broken": {"users": {"body": USER}, "orders": {"status": 500, "body": "x" * 300}},
    "quiet": {"users": {"body": []}, "orders": {"body": [{"id": 1, "o": {"a": 1}}]}},
    "empty": {"users": {"body": []}},
    "drift": {"users": {"body": [{"id": "x"}]}},
    "html": {"users": {"body": "<p>", "content_type": "text/html"}, "raw": {"body": "", "content_type": None}},
    "numbers": {"users": {"body": [1, 2, 3]}},
    "new": {"users": {"body": USER}},
    "damaged": {"users": {"body": USER}},
    "orphan": {"users": {"body": USER}},
    "grown": {"users": {"body": USER}, "extra": {"body": USER}, "void": {"body": {"rows": []}}},
    "silent": {"users": None},
}
RECORDED = {
    "ok": {"users": [{"id": 1}]}, "quiet": {"users": [{"id": 1, "home": {"a": 1}}], "gone": USER},
    "drift": {"users": [{"id": 1}]}, "orphan": {"users": USER, "orders": USER},
    "grown": {"users": USER}, "numbers": {"users": USER}, "damaged": {"users": USER},
}


def build(spark, spec):
    return responses(spark, *[{"source": s, "endpoint": e, **r} for s, es in spec.items() for e, r in es.items() if r])


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registry")) + "/r"
    bodies = {s: {e: {"body": b} for e, b in es.items()} for s, es in RECORDED.items()}
    assert registry_state(spark.createDataFrame([("a",)], "source string"), read_registry(spark, path)).first().state == "missing"
    write_registry(normalise(infer_schema(build(spark, bodies))), path)
    with open(f"{path}/source=damaged/part-bad.json", "w") as f:
        f.write("table users {\n")
    catalog = spark.createDataFrame(
        [(s, e, i, "api", f"http://{s}/v1", "/" + e) for s, es in FRESH.items() for i, e in enumerate(es)],
        "source string, endpoint string, ordinal int, kind string, base_url string, path string")
    fresh = build(spark, FRESH)
    return path, catalog, fresh, sample(fresh), read_registry(spark, path)


def test_report_steps(spark, world):
    path, catalog, fresh, sampled, registry = world
    sources = spark.createDataFrame(
        [(s, None) for s in FRESH if s != "new"] + [("new", "cannot parse"), ("bare", None), ("lost", "bad name")],
        "source string, problem string")
    steps = report(sources, catalog, fresh, sampled, registry).cache()
    rows = ordered_steps(steps).collect()
    got = {(r.source, r.endpoint, r.step): (r.outcome, r.detail) for r in rows}
    assert got["ok", None, "config"] == ("passed", None) and got["ok", None, "endpoints"] == ("passed", "2")
    assert got["ok", "users", "connected"] == ("passed", "200, 5ms")
    assert got["ok", "users", "contract"] == ("passed", None)
    assert got["ok", "orders", "contract"] == ("failed", "table `orders` is missing from the types file; introspect `ok` to update it")
    assert got["broken", "orders", "connected"] == ("failed", "request to `orders` failed with status 500: " + "x" * 256 + "…")
    assert got["broken", "orders", "contract"] == ("skipped", None)
    assert got["broken", "users", "contract"] == ("failed", "no types file; introspect `broken` to record the contract")
    assert got["quiet", "users", "contract"] == ("passed", "no records sampled")
    assert got["empty", "users", "contract"] == ("failed", "nothing to verify: no records sampled, and no table recorded for `users` yet")
    assert got["drift", "users", "contract"] == ("failed", "~ id: int -> string")
    assert got["html", "users", "connected"] == ("failed", "HTTP 200 but the response is not valid JSON (content type: text/html)")
    assert got["html", "raw", "connected"] == ("failed", "HTTP 200 but the response is not valid JSON (content type: unknown)")
    assert got["html", "users", "contract"] == ("skipped", None)
    assert got["numbers", "users", "contract"] == ("failed", "response does not describe records (cannot infer a table schema)")
    assert got["damaged", "users", "contract"][1].startswith("cannot read the types file: ")
    assert got["grown", "void", "contract"][1].startswith("nothing to verify")
    assert got["new", None, "config"] == ("failed", "cannot parse") and got["new", None, "endpoints"] == ("skipped", None)
    assert got["new", "users", "connected"] == got["new", "users", "contract"] == ("skipped", None)
    assert got["bare", None, "endpoints"] == ("failed", "no endpoints configured")
    assert got["silent", "users", "connected"] == ("failed", "no response has landed")
    assert [(r.endpoint, r.step) for r in rows if r.source == "ok"] == [
        (None, "config"), (None, "endpoints"), ("users", "connected"), ("users", "contract"),
        ("orders", "connected"), ("orders", "contract")]

    orphans = unmatched_tables(registry.nodes, catalog)
    assert {(r.source, r.endpoint) for r in orphans.collect()} == {("quiet", "gone"), ("orphan", "orders")}
    rolled = {r.source: (r.passed, r.connected) for r in rollup(steps, orphans).collect()}
    assert rolled["ok"] == (False, True) and rolled["drift"] == (False, True)
    assert rolled["orphan"] == (False, True) and rolled["html"] == (False, False)
    assert rolled["bare"] == rolled["lost"] == rolled["new"] == (False, False)
    assert rolled["quiet"] == (False, True)
    # The listing's shortcut agrees with the full report.
    quick = check_connectivity(catalog, fresh)
    good = {r.source: r.connected for r in quick.collect()}
    assert all(good[s] == rolled[s][1] for s in good if s != "new")

    listed = list_sources(sources.selectExpr("source", "'api' AS kind", "'u' AS base_url"), catalog, registry.nodes, quick).collect()
    assert [r.source for r in listed] == sorted(r.source for r in listed)
    by = {r.source: r for r in listed}
    assert (by["quiet"].endpoints, by["quiet"].types, by["quiet"].connected) == (2, True, True)
    assert (by["bare"].endpoints, by["bare"].types, by["bare"].connected) == (0, False, False)


def test_introspection_publishes_whole_sources(spark, world):
    path, catalog, fresh, sampled, registry = world
    outcomes = publish(catalog, sampled, registry.nodes, path).cache()
    got = {(r.source, r.endpoint): (r.outcome, r.record_count, r.kept_schema) for r in outcomes.collect()}
    assert got["ok", "users"] == ("inferred", 2, None) and got["ok", "orders"] == ("inferred", 1, None)
    assert got["broken", "users"] == ("inferred", 1, None) and got["broken", "orders"][0] == "failed"
    assert got["quiet", "users"] == ("no_records", None, True) and got["empty", "users"] == ("no_records", None, False)
    assert got["numbers", "users"][0] == got["html", "raw"][0] == got["silent", "users"][0] == "failed"
    gate = {r.source: r.publish for r in publishable(outcomes).collect()}
    assert {s for s, p in gate.items() if p} == {"ok", "quiet", "drift", "new", "damaged", "orphan", "grown"}

    after = read_registry(spark, path)
    tables = {}
    for r in after.nodes.filter("depth = 0").collect():
        tables.setdefault(r.source, set()).add(r.endpoint)
    assert tables == {"ok": {"users", "orders"}, "quiet": {"users", "orders"}, "drift": {"users"}, "new": {"users"},
                      "damaged": {"users"}, "orphan": {"users"}, "grown": {"users", "extra"},
                      "numbers": {"users"}}
    kept = as_labels(after.nodes.filter("source = 'quiet' AND endpoint = 'users'"))
    assert kept == {"": "users", "id": "int", "home": "home", "home.a": "int"}
    assert after.unreadable.isEmpty()
    # What was published is what the next check finds, so nothing drifts.
    again = report(spark.createDataFrame([("ok", None), ("drift", None)], "source string, problem string"),
                   catalog.filter("source IN ('ok', 'drift')"), fresh, sampled, after)
    assert {r.outcome for r in again.collect()} == {"passed"}
