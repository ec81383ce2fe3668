from pyspark.sql import functions as F

from apitables.functions.text import path_text
from apitables.operators.infer import infer_schema
from apitables.operators.naming import contract_lines, normalise, registry_violations, render_contract, unqualify

from .helpers import responses

# Per source: its tables, and the names of its record declarations (tables go by name). A second array field keeps
# objects with one array from being read as envelopes.
CASES = {
    "plain": ({"boats": [{"no": 4, "built": "1999-07-04", "berth": {"row": 1, "side": "N"}}, {"no": 5, "built": "1999-07-04"}]}, {"berth"}),
    # Alike below two fields: one declaration serves both.
    "alike": ({"trips": {"start": {"mark": {"lat": 0.5}}, "finish": {"mark": {"lat": 1.5}}}}, {"start", "mark", "finish"}),
    # Unlike below two fields: the name is contested, and so each is called after its parent.
    "unlike": ({"trips": {"start": {"mark": {"lat": 0.5}}, "finish": {"mark": {"code": "k"}}}}, {"start", "start.mark", "finish", "finish.mark"}),
    "two_tables": ({"boats": {"crew": {"cook": True, "bunk": {"no": 1}}}, "huts": {"crew": {"smith": 1, "bunk": {"no": 2}}}},
                   {"boats.crew", "huts.crew", "bunk"}),
    # A table's own name is taken.
    "self": ({"boats": {"boats": {"no": 4}}}, {"boats.boats"}),
    "neighbour": ({"boats": {"huts": {"no": 4}}, "huts": {"no": 4}}, {"boats.huts"}),
    # Two shapes at one path: the qualified name is taken as well.
    "numbered": ({"trips": [{"leg": {"miles": 1}}, {"leg": [{"knots": 2}]}]}, {"trips.leg", "trips.leg2"}),
    "passed_on": ({"boats": {"deck": {"hatch": {"no": 1}}}, "huts": {"deck": {"hatch": {"wide": 0.5}}}},
                  {"boats.deck", "boats.deck.hatch", "huts.deck", "huts.deck.hatch"}),
    "sole_parents": ({"boats": {"rig": {"stay": {"no": 1}}}, "huts": {"roof": {"stay": {"wide": 0.5}}}}, {"rig", "rig.stay", "roof", "roof.stay"}),
    "dot_in_field": ({"boats": {"boats.deck": {"no": 1}}}, {"boats.deck"}),
    "dot_first": ({"a_boats": {"deck": {"no": 1}}, "huts": {"deck": {"wide": 0.5}, "a_boats.deck": {"tall": 2}}},
                  {"a_boats.deck", "huts.deck", "huts.a_boats.deck"}),
    "number_taken": ({"trips": [{"trips.way2": {"gale": 1}, "way": {"miles": 1}}, {"trips.way2": {"gale": 1}, "way": [{"knots": 2}]}]},
                     {"trips.way2", "trips.way", "trips.way3"}),
    "number_before": ({"trips": [{"leg": {"miles": 1}, "stop": {"trips.leg2": {"gale": 1}}}, {"leg": [{"knots": 2}], "stop": {"trips.leg2": {"gale": 1}}}]},
                      {"trips.leg", "trips.leg2", "stop", "stop.trips.leg2"}),
}

PLAIN = """table boats {
  berth: berth?
  built: date
  no: int
}

record berth {
  row: int
  side: string
}
"""


def test_record_names(spark):
    rows = [{"source": source, "endpoint": table, "body": body}
            for source, (tables, _) in CASES.items() for table, body in tables.items()]
    registry = normalise(infer_schema(responses(spark, *rows))).cache()
    got = {}
    for r in registry.filter("declares").collect():
        got.setdefault(r.source, []).append(r.record_name)
    for source, (_, want) in CASES.items():
        assert sorted(got[source]) == sorted(want), source
    texts = {r.source: r.text for r in render_contract(registry).collect()}
    assert texts["plain"] == PLAIN
    assert "  a_boats.deck: huts.a_boats.deck\n" in texts["dot_first"]
    assert "  leg: trips.leg | trips.leg2[]\n" in texts["numbered"]
    assert contract_lines(registry).filter("source = 'plain'").count() == PLAIN.count("\n") - 1  # the blank line is no row
    plain = unqualify(registry.filter("source = 'dot_first'"))
    labels = {(r.endpoint, r.p): r.label for r in plain.select("endpoint", path_text(F.col("path")).alias("p"), "label").collect()}
    assert labels["huts", "deck"] == "deck" and labels["huts", "a_boats.deck"] == "a_boats.deck"


def test_violations(spark):
    nodes = infer_schema(responses(spark, ("tally", "17"), ("gap", {"two words": 1}), ("taken", {"bool": {"no": 1}}),
                                   ("9th", {"no": 1}), ("sound", {"deck": {"no": 1}})))
    got = {(r.endpoint, r.problem) for r in registry_violations(
        nodes.unionByName(nodes.filter("endpoint = 'sound' and depth = 0")),
        spark.createDataFrame([("shop",), ("bare",)], "source string")).collect()}
    rule = "cannot be represented (names must match [A-Za-z_][A-Za-z0-9_.-]*)"
    assert got == {
        ("tally", "the top-level type must be a record"), ("gap", f"field name `two words` {rule}"),
        ("taken", "record name `bool` collides with a primitive type name"),
        ("9th", f"table name `9th` {rule}"), ("sound", "duplicate table name `sound`"),
        (None, "at least one table is required")}
