import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest

from apitables.llm.oracles import ORACLES
from apitables.llm.queries import QUERIES
from apitables.session import materialize
from tests.compare import compare, connect

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == [*range(1, 14)]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        rows = list(want.items())
        if name == "language_id":
            want = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            want = {i: t for i, t in brute.cut_lines(rows).items() if t == dict(rows)[i] or t.strip()}
        elif name == "minhash_near_dedup":
            kept = brute.classes(rows)
            want = {i: t for i, t in rows if kept[i] == i}
        elif name == "benchmark_decontamination":
            found = brute.contamination(rows, items)
            want = {i: t for i, t in rows if not found[i][1] or 20 * found[i][1] < found[i][0]}
        else:
            got = out.collect()
            assert {r["doc_id"] for r in got} == set(want) and all(r["round_trip"] for r in got)
            break
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want and out.columns == columns
        docs = out


def test_stages_handle_odd_rows(spark):
    text = "the dog and the cat are in the house of the man\n" * 3
    rows = [(1, text, "en", "s", 3, "i", 1.0), (1, text, "en", "s", 3, "i", 1.0), (2, None, "en", None, None, None, None), (3, "", None, "s", 0, "i", 0.0), (None, "der hund", "de", "s", 8, "i", 1.0), (4, "der hund und die katze sind im haus", "de", None, None, None, None), (5, "x " * 60000, None, "s", 1, "i", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = materialize(stage(spark, docs, SF))
            assert docs.columns == columns
        got = sorted((r["doc_id"] or -1) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
        assert got == ([] if empty else [-1, 1, 4, 5])


def test_near_dedup_decides_by_row(spark):
    rng = random.Random(4)
    text = [" ".join(rng.choices([f"w{i}" for i in range(2000)], k=60)) for _ in range(12)]
    near = " ".join(text[3].split()[:59])
    rows = [(3, text[3], "a"), (7, text[0], "a"), (7, near, "a"), (None, text[3], "a"), (None, text[1], "a"), (None, text[1], "b"), (5, text[2], "b"), (None, text[2], "a"), (8, None, "a"), (None, None, "a")]
    rows += [(7, t, "a") for t in text[4:]] + [(9, text[11], "a")] + [(7, text[5], "a")] * 5
    want = [(3, text[3]), (7, text[0]), (None, text[1]), (5, text[2]), (8, None), (None, None)] + [(7, t) for t in text[4:]]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(parts)
        got = corpus_pipeline.near_dedup(spark, docs, SF)
        assert got.columns == docs.columns and sorted((tuple(r)[:2] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_bound_arrow_batches(spark):
    def rows(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    setting = corpus_pipeline.BATCH_SETTING
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(i, f"w{i} dog", "en") for i in range(2500)], "doc_id long, text string, lang string").coalesce(1)
    try:
        for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[-1:]:
            for given, most in (("10000", 1000), ("0", 1000), ("70", 70)):
                spark.conf.set(setting, given)
                stage(spark, docs, SF)
                assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) == most
    finally:
        spark.conf.set(setting, before)
