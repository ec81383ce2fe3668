import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from apitables.functions.json import is_strict_json
from apitables.functions.text import is_iso_date, is_iso_datetime, is_tz_offset
from apitables.operators.infer import column_profile, flatten, infer_column, infer_schema, path_stats, profile
from apitables.operators.screen import explode_records, record_sets, unwrap

from .helpers import as_labels, responses, schema_of

DATES = ["1987-12-31", "2031-02-30"]
DATETIMES = [f"1987-11-30{t}23:59:59{tail}" for t, tail in [("T", ""), ("T", "Z"), ("t", "z"), ("T", ".5"), ("T", ".000001z"), ("T", "-11:45"), ("T", "+0930"), ("T", "+05")]]
PLAIN = ["1987-00-31", "1987-13-31", "1987-12-00", "1987-12-32", "19871231", "1987-12-31 23:59:59", "1987-12-31T24:00:00", "1987-12-31T23:60:00",
         "1987-12-31T23:59", "1987-12-31T23:59:59.", "1987-12-31T23:59:59.Z", "1987-12-31T23:59:59 Z", "1987-12-31T23:59:59+25",
         "1987-12-31T23:59:59-0361", "1987-12-31\n", "\n1987-12-31", "lighthouse", ""]


def test_date_lookalikes(spark):
    df = spark.createDataFrame([(s,) for s in DATES + DATETIMES + PLAIN], "s string")
    got = {r.s: (r.d, r.t) for r in df.select("s", is_iso_date(F.col("s")).alias("d"),
                                              is_iso_datetime(F.col("s")).alias("t")).collect()}
    assert all(got[s] == (True, False) for s in DATES)
    assert all(got[s] == (False, True) for s in DATETIMES)
    assert all(got[s] == (False, False) for s in PLAIN)


def test_offsets(spark):
    cases = {"+05": True, "-2359": True, "+09:59": True, "-24": False, "+5": False, "+0560": False, "05:00": False, "-05:00\n": False}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.ok for r in df.select("s", is_tz_offset(F.col("s")).alias("ok")).collect()} == cases


def test_strict_json(spark):
    good = ['{"a":1}', "[1]", "1", '"x"', " null ", "[]", "{}", '{"a":1,"a":2}', '{"a":"]"}', "[[1],[2]]"]
    bad = ['{"a":1} x', "[1] [2]", "1,2", "", " ", "1]", '{"a":1}]', "1} {", "NaN", "01", "<html>", '{"a":', "1] [2",
           "1]]", "1]]]", "1]]] x", '{"a":1}]]]', "1],[2", "1]], [[2", "1]],2] x", ",", "1,", "[[[1]]]]"]
    good += ["[[[1]]]", "[[[[]]]]", '{"a":[[[1]]]}', '["]]]"]']
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    got = {r.s: r.ok for r in df.select("s", is_strict_json(F.col("s")).alias("ok")).collect()}
    assert got == {**{s: True for s in good}, **{s: False for s in bad}}
    issues = column_profile(df, "s", keys=["s"]).filter("issue").select("s").collect()
    assert {r.s for r in issues} == set(bad)


def test_each_kind_as_a_field(spark):
    buoy = {"number": 7, "colour": "red", "draught": 0.25, "lit": False, "owner": None, "serviced": "1999-07-04",
            "seen": "1999-07-04T05:06:07+0100"}
    assert schema_of(spark, buoy, "buoy") == {
        "": "buoy", "number": "int", "colour": "string", "draught": "float", "lit": "bool", "owner": "null",
        "serviced": "date", "seen": "datetime"}


def test_numbers(spark):
    body = ('{"a":1.0,"b":1e3,"c":9223372036854775808,"d":18446744073709551615,"e":18446744073709551616,'
            '"f":-9223372036854775809,"g":-3}')
    got = as_labels(infer_schema(responses(spark, ("t", body))))
    assert [got[k] for k in "abcdefg"] == ["float", "float", "int", "int", "float", "float", "int"]


def test_records_below_records(spark):
    got = schema_of(spark, {"hull": {"length": 9, "keel": {"depth": 1.5, "iron": True}}, "port": "Hven"})
    assert got == {"": "t", "hull": "hull", "hull.length": "int", "hull.keel": "keel", "hull.keel.depth": "float",
                   "hull.keel.iron": "bool", "port": "string"}


# Values of a field `v` in one record, and its label.
ARRAYS = [
    ([], "unknown[]"), ([None, None], "null[]"), ([False], "bool[]"), ([0.5, 3], "float[]"), (["k", None], "(string | null)[]"),
    ([True, "k", 4], "(bool | string | int)[]"), ([[], [[]]], "unknown[][][]"), ([["k"], [2], []], "(string | int)[][]"),
    ([{"mast": 1}, {"boom": 0.5, "mast": 2}], "v[]"),
]
# Values of `v` in successive records.
UNIONS = [
    ([2.5, 1], "float"), ([False, "k"], "bool | string"), ([4, "k", 0.5], "float | string"), (["k", "1999-07-04"], "string"),
    (["1999-07-04T05:06:07Z", "1999-07-04"], "datetime | date"), (["1999-07-04T05:06:07Z", "1999-07-04", "k"], "string"),
    ([6, "1999-07-04", "k"], "int | string"), (["k", {"mast": 1}], "string | v"), ([[2], False, None], "int[] | bool?"),
]


def test_arrays_and_unions(spark):
    # One endpoint per case. A second array keeps a body from being read as an envelope.
    bodies = [{"v": value, "w": []} for value, _ in ARRAYS] + [[{"v": v} for v in values] for values, _ in UNIONS]
    nodes = infer_schema(responses(spark, *[(f"{i:02}", b) for i, b in enumerate(bodies)]))
    got = {(int(r.endpoint), tuple(r.path)): r.label + ("?" if r.optional else "") for r in nodes.collect()}
    assert [got[i, (".v",)] for i in range(len(bodies))] == [label for _, label in ARRAYS + UNIONS]
    last = len(ARRAYS) - 1
    assert got[last, (".v", "[]", ".mast")] == "int" and got[last, (".v", "[]", ".boom")] == "float?"


def test_optionality(spark):
    got = schema_of(spark, [{"sail": "jib", "crew": 2, "log": [1]}, {"crew": None, "sail": "genoa"}, {"log": [], "sail": "spinnaker", "flag": None}])
    assert {k: got[k] for k in ("sail", "crew", "log", "flag")} == {"sail": "string", "crew": "int?", "log": "int[]?", "flag": "null?"}
    assert schema_of(spark, [{"flag": None}] * 3)["flag"] == "null"
    got = schema_of(spark, [{"berth": {"row": 1}}, {}, {"berth": {"side": "N", "row": 2}}])
    assert (got["berth"], got["berth.row"], got["berth.side"]) == ("berth?", "int", "string?")


def test_member_order_inside_one_record(spark):
    got = schema_of(spark, {"v": [[{"x": "s"}], [{"x": 1}, {"x": True}]], "w": []})
    assert got["v[][].x"] == "string | int | bool"
    got = schema_of(spark, {"v": [[[[["s", 1]]]]], "w": []})
    assert got["v"] == "(string | int)[][][][][]"


def test_envelopes(spark):
    df = responses(spark, ("boats", {"fleet": [{"no": 4}, {"no": 5}, {"no": 6}]}), ("marks", {"count": 9, "list": [{"no": 4}], "next": None}),
                   ("pair", {"left": [0.5], "right": ["k"]}), ("bare", [{"no": 4}, {"no": 5}]), ("single", {"no": 4, "at": {"x": []}}),
                   ("crewed", {"no": 4, "crew": ["Ib"]}), ("void", []), ("shell", {"fleet": [], "count": 0}), ("nil", "null"))
    rows = explode_records(df).groupBy("endpoint", "envelope").count().collect()
    assert {(r.endpoint, r.envelope, r["count"]) for r in rows} == {
        ("boats", "fleet", 3), ("marks", "list", 1), ("pair", None, 1), ("bare", None, 2), ("single", None, 1), ("crewed", "crew", 1), ("nil", None, 1)}
    sets = {(r.endpoint, r.name, r.record_count) for r in record_sets(df).collect()}
    assert sets == {("boats", "fleet", 3), ("marks", "list", 1), ("pair", "pair", 1), ("bare", "bare", 2), ("single", "single", 1),
                    ("crewed", "crew", 1), ("void", "void", 0), ("shell", "fleet", 0), ("nil", "nil", 1)}
    got = as_labels(infer_schema(df.filter("endpoint = 'pair'")))
    assert got == {"": "pair", "left": "float[]", "left[]": "float", "right": "string[]", "right[]": "string"}
    roots = infer_schema(df).filter("depth = 0").collect()
    assert {r.endpoint: r.label for r in roots if r.members != ["record"]} == {"crewed": "string", "nil": "null"}


def test_depth_adapts(spark):
    deep = lambda n, inner: '{"d":' * n + inner + "}" * n
    df = responses(spark, {"endpoint": "t", "body": deep(20, '[[1,"x"],[{}]]')}, ("t2", {"a": 1}),
                   {"endpoint": "t", "response_ord": 1, "body": deep(6, '{"e":[true]}')},
                   {"endpoint": "t", "response_ord": 2, "body": deep(8, "{}")},
                   {"endpoint": "pit", "body": deep(140, "1")}, {"endpoint": "abyss", "body": deep(1200, "1")})
    stats = profile(unwrap(df))
    got = {(r.endpoint, "/".join(r.path), r.kind): r.n for r in stats.collect()}
    d = lambda n: "/".join([".d"] * n)
    assert got["t", "", "record"] == 3 and got["t", d(6), "record"] == 3 and got["t", d(8), "record"] == 2
    assert got["t", d(6) + "/.e/[]", "bool"] == 1 and got["t", d(19), "record"] == 1
    assert (got["t", d(20), "array"], got["t", d(20) + "/[]", "array"]) == (1, 2)
    assert [got["t", d(20) + "/[]/[]", k] for k in ("int", "string", "record")] == [1, 1, 1]
    assert got["pit", d(140), "int"] == 1 and got["pit", d(139), "record"] == 1
    # The JSON reader itself ends at a thousand levels: such a body is not JSON to it, as a whole.
    assert [k for e, *k in got if e == "abyss"] == [["", "json 200 application/json"]]
    records = explode_records(df)
    flat = flatten(records.filter("endpoint <> 'abyss'")).groupBy("endpoint", F.array_join("path", "/").alias("p"), "kind").count().collect()
    assert {(r.endpoint, r.p, r.kind): r["count"] for r in flat} == {k: n for k, n in got.items() if k[0] != "abyss"}
    with pytest.raises(Exception, match="nested deeper"):
        infer_schema(df, depth=4).collect()


def _random_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice([None, True, 3, 2.5, "text", "other"])
    if kind == 6:
        return [_random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: _random_value(rng, depth - 1) for k in rng.sample("abcd", rng.randrange(4))}


def _expected(records):
    """Members and optionality of every path, from a plain listing of all values with their places."""
    first, present, nulls, parents = {}, Counter(), Counter(), Counter()
    todo = [((), record, (i,)) for i, record in enumerate(records)]
    while todo:
        path, value, at = todo.pop()
        kind = {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", list: "array", dict: "record"}[type(value)]
        first.setdefault(path, {})
        first[path][kind] = min(at, first[path].get(kind, at))
        present[path] += 1
        nulls[path] += kind == "null"
        parents[path] += kind == "record"
        if kind == "array":
            first.setdefault((*path, "[]"), {})
            todo += [((*path, "[]"), x, (*at, i)) for i, x in enumerate(value)]
        if kind == "record":
            todo += [((*path, "." + k), x, at) for k, x in value.items()]
    out = {}
    for path, kinds in first.items():
        field = bool(path) and path[-1] != "[]"
        if {"int", "float"} <= kinds.keys():
            kinds["float"] = min(kinds["float"], kinds.pop("int"))
        if field and nulls[path] < present[path]:
            kinds.pop("null", None)
        optional = field and (present[path] < parents[path[:-1]] or 0 < nulls[path] < present[path])
        out[path] = tuple(sorted(kinds, key=kinds.get)) or ("unknown",), optional
    return out


def test_matches_a_plain_listing_in_any_partitioning(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(40):
        records = [{k: _random_value(rng, 3) for k in rng.sample("abcd", rng.randrange(1, 4))} for _ in range(12)]
        want[g] = _expected(records)
        rows += [(g, i, json.dumps(r)) for i, r in enumerate(records)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i long, j string").repartition(7)
    got = {}
    for r in infer_column(df, "j", ["g"], "i").collect():
        got.setdefault(r.g, {})[tuple(r.path)] = (tuple(r.members), r.optional)
    assert got == want


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, '{"a":1}'), (None, '{"b":1}'), ("x", '{"a":"s"}')], "k string, j string")
    got = {(r.k, tuple(r.path)): (r.label, r.optional) for r in infer_column(df, "j", ["k"]).collect()}
    assert got[(None, (".a",))] == ("int", True) and got[("x", (".a",))] == ("string", False)
    assert got[(None, ())] == ("record", False)
    with pytest.raises(ValueError, match="rename the key column `kind`"):
        infer_column(df.withColumnRenamed("k", "kind"), "j", ["kind"])


def test_issue_rows_are_counted(spark):
    df = responses(spark, {"endpoint": "a", "status": 500, "body": "x"}, ("b", "<p>"), ("c", []), ("d", {"x": 1}))
    rows = profile(unwrap(df)).filter("issue").collect()
    assert {(r.endpoint, r.kind, r.n) for r in rows} == {("a", "status", 1), ("b", "json 200 application/json", 1), ("c", "empty", 1)}
    assert path_stats(profile(unwrap(df))).count() == 2


def test_few_rounds_write_deep_containers(spark, monkeypatch):
    from apitables.operators import infer

    written, write = [], infer.materialize
    monkeypatch.setattr(infer, "materialize", lambda df: written.append(df.schema) or write(df))
    deep = {"key": 1, "": [{"a.b": None}]}
    for i in range(40):
        deep = {"d": deep} if i % 9 else {"d": [deep, i]}
    found = schema_of(spark, [deep, {"d": 1}])
    frontiers = [s for s in written if "record" in s.names]
    assert len(frontiers) == 2 and all(s["prefix"].dataType.simpleString() == "string" for s in frontiers)
    assert len(found) == 1 + 40 + 5 + 4
