from pyspark.sql import functions as F

from apitables.functions.text import error_snippet, has_scheme, is_name
from apitables.functions.urls import identifier_violation, in_scope, join_url, path_violation
from apitables.operators.rules import catalog_violations


def values(spark, inputs, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_identifiers_and_paths(spark):
    assert values(spark, ["z", "0", "_", "log_book_7"], identifier_violation) == [None] * 4
    bad = "may only contain lowercase letters, digits, and underscores"
    assert values(spark, ["", "logBook", "log book", "log.book", "log/book", "bjørn", "log\n"], identifier_violation) == ["must not be empty"] + [bad] * 6
    good = ["", "tides", "/tides/", "tides/2/low?at=noon&in=//x/..", "tides#../..", "..tides/tides..", "tides:low/x", "/?u=ftp://h", "tides/:low"]
    assert values(spark, good[:-3] + good[-1:], path_violation) == [None] * (len(good) - 2)
    host, absolute = "must not start with `//`, which replaces the host", "must be a path relative to the base URL, not an absolute URL"
    up, back = "must not contain `..` segments", "must not contain backslashes"
    cases = {"ftp://tides/x": absolute, "gopher:x": absolute, "//tides/x": host, "//\\x": back, "tides\\..": back, "..": up, "tides/../x": up, "tides/..#x": up}
    assert values(spark, list(cases), path_violation) == list(cases.values())
    assert values(spark, ["ftp:", "z9+-.:x", "9z:", "z/y:x", "", ":x"], has_scheme) == [True, True, False, False, False, False]
    assert values(spark, ["Z", "_", "z.9-_", "9z", "z z", "", "z\n", "-z"], is_name) == [True, True, True, False, False, False, False, False]


def test_join_and_scope(spark):
    bases, paths = ["ftp://tides/v2", "ftp://tides/v2/"], ["low", "/low", "///low", "low?at=/noon"]
    df = spark.createDataFrame([(b, p) for b in bases for p in paths], "b string, p string")
    got = {r.u for r in df.select(join_url(F.col("b"), F.col("p")).alias("u")).collect()}
    assert got == {"ftp://tides/v2/low", "ftp://tides/v2/low?at=/noon"}
    assert values(spark, ["", "/"], lambda p: join_url(F.lit("ftp://tides/v2"), p)) == ["ftp://tides/v2"] * 2
    base = "https://tides.example/v2"
    cases = {f"{base}/low": True, "HTTPS://Tides.Example:443/v2/low": True, base: True, f"{base}2/low": False, "http://tides.example/v2/low": False,
             "https://tides.example:444/v2/low": False, "https://example/v2/low": False, f"{base}/../low": False, f"{base}/%2e./low": False,
             f"{base}/low..high": True, f"{base}/low?to=../x": True, "v2/low": False, "": False,
             f"{base}/low tide": True, f"{base}/[low]|{{high}}": True, f"{base}/a b/../../x": False, "https://tides.example/v 2": False}
    assert values(spark, list(cases), lambda u: in_scope(u, F.lit(base))) == list(cases.values())


def test_snippets(spark):
    texts = ["", " \n  ", "x", "é" * 256, "é" * 257, " " + "a" * 300]
    assert values(spark, texts, error_snippet) == [
        "(empty body)", "(empty body)", "x", "é" * 256, "é" * 256 + "…", " " + "a" * 255 + "…"]


def test_first_violation(spark):
    rows = [("twice", 0, "low", "/1"), ("twice", 1, "low", "/2"), ("twice", 2, "LOW", "/3"), ("host", 0, "low", "//x"), ("host", 1, "low", "/"),
            ("fine", 0, "low", ""), ("case", 0, "low", "/"), ("case", 1, "hIgh", "//x"), ("case", 2, "low", "/"),
            ("both", 0, "low", "/"), ("both", 1, "high", "/"), ("both", 2, "high", "..")]
    df = spark.createDataFrame(rows, "source string, ordinal int, endpoint string, path string")
    got = {r.source: (r.ordinal, r.endpoint, r.problem) for r in catalog_violations(df).collect()}
    assert got == {
        "twice": (1, "low", "duplicate endpoint name"),
        "host": (0, "low", "path `//x` must not start with `//`, which replaces the host"),
        "case": (1, "hIgh", "endpoint name may only contain lowercase letters, digits, and underscores"),
        "both": (2, "high", "path `..` must not contain `..` segments")}
