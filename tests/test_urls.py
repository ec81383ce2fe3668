import pytest
from pyspark.sql import functions as F

from apitables.functions.urls import in_scope, normalise

BASE = "http://h/api"
CASES = [
    ("http://h/api/x", True), ("http://evil.example\\@h/api/x", False), ("http://h/api/.\t./x", False),
    ("http://h/api/x\\..\\..\\y", False), ("http://h/api/a/../b", True), ("http://h/api/%2E/b", True),
    ("http://h/api/%2e%2E/b", False), ("HTTP://H:80/api/z", True), ("http://h:8080/api/z", False), ("http://%68/api/q", True),
    ("http:\\\\h\\api\\w", True), ("  http://h/api/s\n", True), ("http://h/api", True), ("http://h/api2", False),
    ("http://h/", False), ("http://u:p@h/api/x", True), ("http://h/api/..", False), ("http://h/api/x/..", True),
    ("https://h/api/x", False), ("http://h:99999/api/x", False), (None, False), ("nonsense", False), ("http://h/api/x?next=/../y", True),
]


def test_scope_after_normalising(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "u string")
    got = [r[0] for r in df.select(in_scope(F.col("u"), F.lit(BASE))).collect()]
    assert got == [want for _, want in CASES]


@pytest.mark.parametrize("url,path", [("http://h/a/./b/../c/", "/a/c/"), ("http://h", "/"), ("http://h/a/%2e%2e", "/"), ("http://h/../../x", "/x")])
def test_dot_segments(spark, url, path):
    assert spark.range(1).select(normalise(F.lit(url))["path"]).first()[0] == path


def test_the_plan_does_not_multiply_the_parse(spark):
    df = spark.createDataFrame([("http://h/api/a/../b", BASE)], "u string, b string").select(in_scope(F.col("u"), F.col("b")).alias("inside"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("[A-Za-z0-9+.-]*):, 1)") <= 8 and df.first()[0]
