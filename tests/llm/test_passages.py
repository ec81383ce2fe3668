import random

import pytest

from apitables.llm import decontam, linededup

from . import brute

SPACE = [" ", "\n", "  ", ", "]


def _documents():
    rng = random.Random(2)
    vocabulary = ["The", "the", "a", "é", "x1", "漢字"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 13, 14, 30])))) for i in range(20)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            text = rng.choice(items)[1].split() if rng.random() < 0.5 else rng.choices(vocabulary, k=20)
            a = rng.randrange(len(text))
            parts += text if rng.random() < 0.6 else text[a:]
        docs.append((i, "".join(w.swapcase() + rng.choice(SPACE) if w.isascii() else w + " " for w in parts)))
    return docs, items


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = _documents()
    docs += [(100, None), (101, ""), (102, "!?"), (103, (items[5][1] + " ") * 3000)]
    items += [(50, None), (51, ""), (52, items[0][1]), (0, items[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontam.contamination(df, benchmark).collect()}
    assert got == brute.contamination(docs, items)


def test_contamination_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c", "k"), (1, "a b c", "k"), (None, "a b", "l")], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(7, "b"), (None, "a")], "item_id long, text string")
    got = decontam.contamination(df, benchmark, keep=("item_id",)).collect()
    assert sorted((r["item_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in got) == [("k", 3, 1, [(1, 2)], ["7"])] * 2 + [("l", 2, 1, [(1, 2)], ["7"])]
    assert {r["n_hit"] for r in decontam.contamination(df, benchmark.limit(0)).collect()} == {0}
    assert decontam.contamination(df.limit(0), benchmark).collect() == []


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    lines = ["", " ", "\t", "a", "b", "c", "long line", "é"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.choice([0, 1, 2, 3, 6, 12])))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n\n\n\n\n"), (93, "\n".join(["same"] * 20000)), (94, "p\nq\nr\np\nq\nr")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, covered_id string").repartition(5)
    got = linededup.dedup_lines(df).collect()
    want = brute.cut_lines(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_lines"] == (0 if t is None else t.count("\n") + 1) for r in got for i, t in rows if r["doc_id"] == i)
    assert got[0].asDict().keys() == {"doc_id", "text", "id", "covered_id", "n_lines", "n_removed"}


def test_lines_of_repeated_and_nameless_rows(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "b\nc\nd")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect()), key=repr)
    # The row without an id comes first, so b, c, d go from all others; rows 1 and 1 leave each other alone.
    assert got == sorted([(1, "a"), (1, "a"), (2, ""), (None, "b\nc\nd")], key=repr)
    assert linededup.dedup_lines(df.limit(0)).collect() == []
