import pytest
from pyspark.sql import functions as F

from apitables.operators.sums import conforms, enum_report, parse_enum, tag_variant
from apitables.operators.tableset import TableSet, load


@pytest.fixture
def tables(spark):
    harbour = {"visits": spark.createDataFrame([(71, 5), (72, 6)], "visit int, boat int"),
               "boats": spark.createDataFrame([(5, "Ran", "DK")], "boat int, name string, flag string")}
    tolls = {"paid": spark.createDataFrame([(71, 2.5), (73, 9.0)], "visit int, amount double")}
    return TableSet.empty().with_(load(harbour, "h_")).with_(load(tolls, "t_"))


def test_stages(tables):
    out = tables.pipe(
        lambda t: t.join("h_visits.visit", "t_paid.visit", "tolls", "v_", "p_"),
        lambda t: t.relate("tolls.v_boat", "h_boats.boat"),
        lambda t: t.extend("h_boats", "sign", F.concat_ws("/", "flag", "name")))
    assert set(out.tables) == {"tolls", "h_boats"}
    assert out["tolls"].columns == ["v_visit", "v_boat", "p_visit", "p_amount"]
    assert [tuple(r) for r in out["tolls"].collect()] == [(71, 5, 71, 2.5)]
    assert out["h_boats"].first().sign == "DK/Ran"
    assert out.orphan_rows("tolls.v_boat", "h_boats.boat").count() == 0
    assert set(tables.tables) == {"h_visits", "h_boats", "t_paid"}
    related = tables.relate("h_visits.boat", "h_boats.boat")
    assert [r.visit for r in related.orphan_rows("h_visits.boat", "h_boats.boat").collect()] == [72]
    for wrong in (lambda: tables.with_({"t_paid": tables["t_paid"]}), lambda: tables.relate("h_visits.keel", "h_boats.boat"),
                  lambda: tables.join("h_visits.visit", "h_boats.boat", "o"), lambda: tables.orphan_rows("h_visits.visit", "h_boats.boat")):
        with pytest.raises(ValueError):
            wrong()


def test_split_and_merge(spark):
    rows = TableSet.empty().with_({"t": spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")})
    parts = rows.split("t", {"low": F.col("x") < 3, "two": F.col("x") == 2})
    assert {n: parts[n].count() for n in parts.tables} == {"low": 2, "two": 0, "t_rest": 2}
    back = parts.extend("low", "y", F.lit(1)).merge(["low", "two", "t_rest"], "all")
    assert sorted((r.x or 0, r.y) for r in back["all"].collect()) == [(0, None), (1, 1), (2, 1), (3, None)]


def test_sum_types(spark):
    mooring = {"Quay": ["place", "ring"], "Buoy": ["place", "depth"]}
    df = spark.createDataFrame([(1, "N", "r4", None), (2, "S", None, 9), (3, "E", "r5", 7), (4, None, None, None)],
                               "id int, place string, ring string, depth int")
    rows = {r.id: r for r in tag_variant(df, mooring).collect()}
    assert [rows[i].tag for i in (1, 2, 3, 4)] == ["Quay", "Buoy", None, None]
    assert rows[1].Quay.ring == "r4" and rows[1].Buoy is None and rows[2].Buoy.depth == 9
    lights = spark.createDataFrame([("fl",), ("fl",), ("??",), ("oc",)], "s string")
    mapping = {"fl": "Flashing", "oc": "Occulting"}
    assert [r.v for r in lights.select(parse_enum(F.col("s"), mapping).alias("v")).collect()] == ["Flashing", "Flashing", None, "Occulting"]
    assert [tuple(r) for r in enum_report(lights, "s", mapping).collect()] == [("??", 1)]
    vals = spark.createDataFrame([(x,) for x in ['7', '"k"', '0.5', 'false', 'null', '"1999-07-04"', '{}']], "j string")
    v = F.parse_json("j")
    got = [(r.a, r.b) for r in vals.select(conforms(v, ["string", "number"]).alias("a"), conforms(v, ["datetime"]).alias("b")).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, False), (False, False), (True, True), (False, False)]
