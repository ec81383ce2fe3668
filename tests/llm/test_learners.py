import random

import numpy as np
from pyspark.sql import functions as F

from apitables.llm import langid, toxicity
from apitables.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = QUERIES["op3_language_id"](spark, SF)
    assert [f.simpleString().split(":")[1] for f in got.schema] == ["bigint", "boolean", "string", "double"]
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == truth.count() and right >= 0.97


def test_language_edge_cases(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("12 34 !", "de"), ("", None), ("the dog", None), ("the dog " * 30000, None)])] + [(5, "the dog", None, "y"), (None, "die katze", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").withColumn("score", F.lit("s"))
    model = langid.fit(df, F.lit(True))
    got = langid.predict(df, model)
    found = {(r["id"], r["lang_pred"]) for r in got.collect()}
    assert found == {(0, "en"), (1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "en"), (None, "de")}
    assert got.count() == len(rows) and all(0 <= r["score"] <= 1 for r in got.collect())
    empty = df.limit(0)
    nothing = langid.fit(empty, F.lit(True))
    assert nothing.languages == [] and langid.predict(empty, model).collect() == []
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, sf)
    known = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    toxic, clean = known[known.toxic == 1].score.to_numpy(), known[known.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() >= 0.95
    assert (toxic >= 0.5).mean() >= 0.85 and (clean >= 0.5).mean() <= 0.1


def test_risk_is_never_negative_and_separates():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (300, 2))
    unlabelled = np.vstack((rng.normal(2, 1, (200, 2)), rng.normal(-2, 1, (800, 2))))
    w = toxicity.train(positive.astype(np.float32), unlabelled.astype(np.float32), 0.2)
    z = unlabelled @ w[:-1] + w[-1]
    assert (z[:200] > 0).mean() > 0.9 and (z[200:] < 0).mean() > 0.95


def test_toxicity_edge_cases(spark):
    rng = random.Random(0)
    plain = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (["scum", "vermin"] if i % 4 == 0 else [])), "x") for i in range(400)]
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, "scum vermin " + "w1 " * 50000 + "scum vermin " * 2000, "x"), (0, rows[0][1], "y"), (None, "scum vermin", "x")]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(0, 300)] + [(0, 1, 0), (5, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels, F.lit(True))
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    score = {r["id"]: r["score"] for r in got}
    assert all(score[i] >= 0.5 for i in range(300, 400, 4))
    assert all(score[i] < 0.5 for i in range(301, 400, 4))
    assert score[1000] == score[1001] < 0.5 <= score[1002] and score[None] >= 0.5
    none = toxicity.fit(df, labels.limit(0), F.lit(True))
    assert all(r["score"] < 0.01 for r in toxicity.score(df, none).collect())
    assert toxicity.score(df.limit(0), model).collect() == [] and toxicity.fit(df.limit(0), labels, F.lit(True)).features.size == 0
