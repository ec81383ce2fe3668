from apitables.operators.diff import diff_schemas, ordered_changes, with_fingerprint
from apitables.operators.infer import infer_schema

from .helpers import responses


# A second array keeps single-array objects from being read as envelopes.
CASES = [
    ({"no": 4, "rig": None}, {"no": 5, "rig": None}, []),
    ({"no": 4}, {"no": False}, ["~ no: int -> bool"]),
    ([{"no": 4, "oars": 2.5}], [{"no": 4}, {"no": 5, "motor": True}], ["- oars: float", "+ motor: bool?"]),
    ([{"no": 4}, {}], [{"no": 4}], ["~ no: int? -> int"]),
    ({"deck": {"hatch": {"no": 4}}}, {"deck": {"hatch": {"no": "k"}}}, ["~ deck.hatch.no: int -> string"]),
    ({"log": [1], "w": []}, {"log": [None], "w": []}, ["~ log[]: int -> null"]),
    ({"log": [True], "w": []}, {"log": [], "w": []}, ["~ log[]: bool -> unknown"]),
    ({"deck": [[1]], "w": [], "x": []}, {"deck": {"hatch": {"no": 4}}, "w": [], "x": []}, ["~ deck: int[][] -> deck"]),
    ({"rig": "k"}, {"rig": {"stay": {"no": 4}}, "log": {"no": 1}}, ["~ rig: string -> rig", "+ log: log"]),
    ([{"deck": {"no": 4}}, {"deck": "k"}], [{"deck": {"no": 0.5}}, {"deck": "k"}], ["~ deck: deck | string -> deck | string"]),
    ([{"deck": {"no": 4}}, {"deck": "k"}], [{"deck": "k"}, {"deck": {"no": 9}}], []),
    ([{"deck": {"no": 4}}, {}], [{"deck": {"no": False}}], ["~ deck: deck? -> deck", "~ deck.no: int -> bool"]),
    ([{"log": [1], "w": []}, {"w": []}], [{"log": ["k"], "w": []}], ["~ log: int[]? -> string[]", "~ log[]: int -> string"]),
    ({"legs": [{"mark": {"lat": 1}, "to": [["k"]]}], "w": []}, {"legs": [{"mark": {"lat": "N"}, "to": [[1]]}], "w": []},
     ["~ legs[].mark.lat: int -> string", "~ legs[].to[][]: string -> int"]),
    ([{"no": 4}, {"no": 4, "deck": {"oak": 1}}], [{"no": "k", "aft": 1, "deck": {"oak": 1, "teak": 2}}],
     ["~ no: int -> string", "~ deck: deck? -> deck", "+ deck.teak: int", "+ aft: int"]),
    ("false", {"no": 4}, ["~ response: bool -> t"]),
    ([["k"]], [[[1]]], ["~ []: string -> int[]"]),
]


def test_change_lines(spark):
    # One endpoint per case, so that all cases take one job.
    schemas = [infer_schema(responses(spark, *[{"source": f"{i:02}", "endpoint": "t", "body": case[side]}
                                               for i, case in enumerate(CASES)])) for side in (0, 1)]
    got = [[] for _ in CASES]
    for r in ordered_changes(diff_schemas(*schemas)).collect():
        got[int(r.source)].append(r.line)
    assert got == [case[2] for case in CASES]


def test_fingerprint_ignores_names_and_member_order(spark):
    body = {"bow": {"x": ["k", 4], "y": {"z": None}}, "stern": {"y": {"z": None}, "x": [4, "k"]}, "mast": {"x": ["k", 4], "y": {"z": "k"}}}
    fp = {tuple(r.path): r.fingerprint
          for r in with_fingerprint(infer_schema(responses(spark, ("t", body)))).collect()}
    assert fp[(".bow",)] == fp[(".stern",)] != fp[(".mast",)]
    assert fp[(".bow", ".y")] == fp[(".stern", ".y")] != fp[(".mast", ".y")]
