import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from apitables.llm import sample_encode, token_counts
from apitables.llm.pieces import VOCABULARY, Trie, cached, pre_tokens
from apitables.llm.texts import mix

TEXTS = [None, "", "  hello  wörld\n\nabc ▁ d", "a\x00b", "漢字テスト🙂 x", "thonest the thingble", "   ", "x" * 70 + " " + "é" * 40]


@pytest.fixture(scope="module")
def vocab():
    return cached(Path(VOCABULARY).read_bytes())


def _brute(token, vocab, log_p):
    """(pieces in the likeliest segmentation, log sum over all) of one pre-token."""
    ids = {t: i for i, t in enumerate(vocab.text) if vocab.usable[i]}
    cuts = [0]
    for c in token.decode():
        cuts.append(cuts[-1] + len(c.encode()))
    best, total = {0: (0.0, 0)}, {0: 0.0}
    for e in cuts[1:]:
        ways = []
        for b in cuts:
            x = token[b:e]
            if b < e and x in ids:
                ways.append((best[b][0] + log_p[ids[x]], best[b][1] + 1, total[b] + log_p[ids[x]]))
            elif b < e and len(x.decode()) == 1:
                p = sum(log_p[vocab.byte + y] for y in x)
                ways.append((best[b][0] + p, best[b][1] + len(x), total[b] + p))
        most = max(w[0] for w in ways)
        best[e] = most, min(w[1] for w in ways if w[0] >= most - 1e-9)
        total[e] = np.logaddexp.reduce([w[2] for w in ways])
    return best[len(token)][1], total[len(token)]


def test_trie_scores_match_brute_force(vocab):
    log_p = vocab.log_zipf()
    pre = pre_tokens(pa.array(TEXTS))
    trie = Trie(pre.distinct, vocab)
    score = trie.scores(log_p, vocab.byte)
    alpha, count = trie.forward(score), trie.best(score)
    for token, node in zip(pre.distinct.to_pylist(), trie.terminal):
        n, total = _brute(token, vocab, log_p)
        assert count[node] == n and alpha[node] == pytest.approx(total)
    weight = np.arange(1.0, len(pre.distinct) + 1)
    used = trie.expected(score, alpha, weight)
    assert (used * trie.size).sum() == pytest.approx(sum(w * len(t) for w, t in zip(weight, pre.distinct.to_pylist())))


def test_token_counts(spark, vocab):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, id string")
    got = {r[0]: (r[1], r[2]) for r in token_counts.count_tokens(df).collect()}
    for i, text in enumerate([*TEXTS, TEXTS[2]]):
        pre = pre_tokens(pa.array([text]))
        tokens = [pre.distinct[int(w)].as_py() for w in pre.which]
        assert got[i] == (len(tokens), sum(_brute(t, vocab, vocab.log_zipf())[0] for t in tokens))
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_long_text_counts_as_its_parts(spark):
    part = "thonest the thingble and "
    df = spark.createDataFrame([(1, part * 40000), (2, part)], "doc_id long, text string")
    got = {r["id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert got[1] == 40000 * (got[2] - 1) + 1  # the trailing space is a token once


def test_decoding_gives_the_text_back(spark):
    rows = [(i, t, "z") for i, t in enumerate([*TEXTS, "word " * 30000, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sample_encode.decode(sample_encode.encode(df, k=3, verify=True)).collect()
    assert all(r["round_trip"] for r in got)
    reader = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for r in got:
        text = rows[r["id"]][1]
        assert all(x == text for x in r["texts"])
        assert len({tuple(x) for x in r["ids"]}) == len(r["ids"]) == len(r["log_prob"]) == len(r["log_inclusion"])
        assert len(r["ids"]) == {None: 0, "": 1, "a\x00b": 2, "漢字テスト🙂 x": 2}.get(text, 3)
        if text and "▁" not in text and "\x00" not in text:
            assert all(reader.decode(x) == text for x in r["ids"])
    assert sample_encode.encode(df.limit(0)).collect() == []


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([(1, [[], [264, 99999, -1], None, [3 + 0xC3]], "x"), (2, None, "y"), (3, [], "z")], "id long, ids array<array<int>>, texts string")
    got = {r["id"]: r["texts"] for r in sample_encode.decode(df).collect()}
    assert got == {1: ["", "a\ufffd\ufffd", None, "\ufffd"], 2: None, 3: []}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "thonest the thingble " * (i % 7)) for i in range(50)], "doc_id long, text string")
    a, b = (sorted(map(tuple, sample_encode.encode(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_samples_follow_their_probabilities(vocab):
    pre = pre_tokens(pa.array(["the inn"]))
    trie = Trie(pre.distinct, vocab)
    lattice = sample_encode.Lattice(trie, trie.scores(vocab.log_zipf() * 0.5, vocab.byte))
    n = 8000
    node, first = np.tile(trie.terminal[pre.which], n), np.arange(n + 1) * len(pre.which)
    paths, following = sample_encode.sample(lattice, node, first, mix(np.arange(n, dtype=np.uint64)), 3)
    seen, pairs, p, weighed = Counter(), Counter(), {}, defaultdict(float)
    for found, value in zip(paths, following.tolist()):
        keys = [tuple(x.edges) for x in found]
        assert len(set(keys)) == len(keys)
        assert [x.value for x in found] == sorted([x.value for x in found], reverse=True) and found[-1].value >= value
        seen[keys[0]] += 1
        pairs[keys[0], keys[1]] += 1
        for key, x in zip(keys, found):
            p[key] = math.exp(x.log_p)
            weighed[key] += math.exp(x.log_p - sample_encode.log_inclusion(x.log_p, value))
    assert sum(p.values()) == pytest.approx(1, abs=1e-3)
    for key, times in seen.most_common(4):
        assert times / n == pytest.approx(p[key], abs=0.02)
        assert weighed[key] / n == pytest.approx(p[key], abs=0.02)
    for (a, b), times in pairs.most_common(4):
        assert times / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)
