import random
from collections import Counter

import numpy as np
import pyarrow as pa

from apitables.llm import collocations


def brute(rows, least=2, top=2000, cover=80):
    """Plain counting of all n-grams, as the contract words it."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in __import__("re").split(r"[.,;:!?\x0A-\x0D]", text):
            w = __import__("re").findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1].split(" ")) >= 2 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        w = p.split(" ")
        cuts = [(2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(l == lang and len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= cover * a for (l, q), b in cands.items()):
            continue
        out.append((lang, p, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, text string, n string, phrase string")
    got = collocations.collocations(df, **kw).collect()
    return sorted(tuple(r) for r in got)


def test_matches_counting(spark):
    rows = [
        ("en", "New York is big. new york, NEW YORK city; the new york times", None, "x"),
        ("en", "new york city\tnew  york city!new york city", "1", None),
        (None, "ab cd ab cd ab cd", None, None),
        ("fr", None, None, None),
        ("fr", "", None, None),
        ("de", "ÄB cd ÄB cd", None, None),
        ("en", "new york city", None, None),
    ]
    assert run(spark, rows, least=2) == brute([r[:2] for r in rows], least=2)
    assert run(spark, rows, least=2, top=1) == brute([r[:2] for r in rows], least=2, top=1)


def test_ties_repeats_and_long_text(spark, monkeypatch):
    text = " ".join(["a b c d"] * 300 + ["x y"] * 50)
    rows = [("en", text, None, None)] * 2 + [("en", "a b. c d", None, None)]
    assert run(spark, rows, least=30) == brute([r[:2] for r in rows], least=30)


def test_empty_table(spark):
    assert run(spark, [], least=2) == []


def _entries(batches):
    out = Counter()
    for b in batches:
        for lang, prefix, nexts, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "prefix", "nexts", "counts"))):
            for w, c in zip(nexts, counts):
                out[lang, prefix, w] += c
    return out


def test_runs_flush_without_changing_counts(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "text": [" ".join("abcdefg") * 40 + ". z z", "q r s t"]})
    whole = _entries(collocations._stripes(iter([batch])))
    monkeypatch.setattr(collocations, "RUN", 5)
    pieces = list(collocations._stripes(iter([batch])))
    assert len(pieces) > 2 and _entries(pieces) == whole


def test_rare_parts_are_not_spread(spark, monkeypatch):
    """Stripes of longer prefixes are made of phrases whose parts are frequent, whatever shares a bit of the sieves."""
    rng = random.Random(7)
    vocabulary = [f"W{i}" for i in range(40)]
    rows = [(rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\t", ". "]).join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=60)), None, None) for _ in range(60)]
    rows += [("en", f"once{i} a b c once{i}x, \u00c4\u00df{i}\x0bz.", None, None) for i in range(300)]
    want = brute([r[:2] for r in rows], least=8)
    assert run(spark, rows, least=8) == want
    df = spark.createDataFrame(rows, "lang string, text string, n string, phrase string")
    f = {(r["lang"], *r["prefix"].split(), r["next"]): r["f"] for r in collocations.merged_stripes(df, least=8).where("next IS NOT NULL").collect()}
    assert f["en", "a", "b", "c"] == 300 and min(f.values()) >= 8
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 300, "text": [r[1] for r in rows[-300:]]})
    words = collocations._words(batch)
    one = collocations._sieve(spark.createDataFrame([(int(h),) for h in collocations._hashes(words, 1, np.flatnonzero(np.isin(words.which, words.which[1:4]))).view(np.int64)], "h long"))
    assert set(_entries(collocations._stripes(iter([batch]), [one]))) == {("en", "a", "b"), ("en", "b", "c")}
    monkeypatch.setattr(collocations, "SIEVE_LOG2", 6)
    assert run(spark, rows, least=8) == want
