"""Phrase collocation mining by the stripes pattern, level by level.

Each prefix of up to three words keys an associative array: the words that follow it inside a piece, and how often. The
stripe of the empty prefix has the words themselves. Stripes are built over a bounded run of words in each task, then
merged elementwise across tasks. From the merged stripes come, in one structure:

- extensions: prefix plus next word, a phrase of one to four words, with its count f;
- n, the sum of the empty prefix's stripe;
- subsumption maxima: the largest f of a candidate one word longer on either side.

A phrase occurs no more often than its parts. So the stripes of longer prefixes are built only of occurrences whose parts
of one word less, the first and the last, occur `least` times. Which these are is found beforehand, for one, two and three
words in turn, by hashes: occurrences are summed by hash, and a bit set of fixed size marks the frequent ones. Phrases
that share a hash or a bit only let more through; what is merged and returned is counted by the words themselves.

Text is lower-cased in A-Z only (null: empty), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``; the language column (null: ``und``) keys everything. Repeated rows count as often as they occur; an
empty table gives no rows; columns other than the two read may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apitables.llm.texts import chained, mix, slices, utf8
from apitables.session import materialize

#: Places of one run of which the stripes, or the sums by hash, are made at a time; and bytes of text read at a time.
RUN, TEXT_BYTES = 1 << 20, 1 << 21
#: Bits of the set of frequent phrases of one length.
SIEVE_LOG2 = 26
LONGEST = 4
WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = SPACE
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

STRIPES = "lang string, prefix string, size int, nexts array<string>, counts array<bigint>"


@dataclass
class Words:
    """The words of some texts in order: each one's number in `names`, its piece and its language's number in `langs`."""

    names: pa.Array
    which: np.ndarray
    piece: np.ndarray
    langs: list[str]
    lang: np.ndarray

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of `names` and of `langs`."""
        return _digests(self.names.to_pylist()), _digests(self.langs)


def _words(part: pa.RecordBatch) -> Words:
    data, offsets = utf8(part.column("text"))
    data = LOWER[data]
    kind = KIND[data]
    inside = kind == WORD
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    shuts[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[firsts], shuts[lasts] = inside[firsts], inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    text = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(starts, offsets)))
    piece = np.cumsum(kind == BREAK)[starts] + text
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])]).dictionary_encode()
    langs = part.column("lang").dictionary_encode()
    return Words(words.dictionary, words.indices.to_numpy().astype(np.int64), piece, langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)[text])


def _digests(values: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in values), np.uint64, len(values))


def _hashes(words: Words, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n words from each place in `at` on, and their language."""
    own, lang = words.hashes
    return mix(chained([own[words.which[at + j]] for j in range(n)]) ^ lang[words.lang[at]])


def _marked(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(64 * len(sieve) - 1)
    return (sieve[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _places(words: Words, sieves: list[np.ndarray] | None) -> list[np.ndarray]:
    """Where phrases of one, two, ... words begin that lie in one piece and whose parts of one word less are marked.

    `sieves` are those of one, two, ... words; the lengths with a sieve, and one more, are given, and phrases of a length
    that has one are marked themselves. Without sieves, all phrases of all lengths.
    """
    total = len(words.which)
    found, before = [], np.ones(total, bool)
    for n in range(1, LONGEST + 1 if sieves is None else len(sieves) + 2):
        fits = np.zeros(total, bool)
        m = max(0, total - n + 1)
        fits[:m] = words.piece[:m] == words.piece[n - 1 :]
        if n > 1:
            fits[:m] &= before[:m] & before[1 : m + 1]
        at = np.flatnonzero(fits)
        if sieves is not None and n <= len(sieves):
            at = at[_marked(sieves[n - 1], _hashes(words, n, at))]
        before = np.zeros(total, bool)
        before[at] = True
        found.append(at)
    return found


def _stripe(words: Words, n: int, at: np.ndarray) -> pa.RecordBatch:
    """The stripes of the phrases of n words that begin at the places `at`."""
    size = len(words.names)
    prefix = np.unique(words.lang[at], return_inverse=True)[1]
    for j in range(n - 1):
        prefix = np.unique(prefix * size + words.which[at + j], return_inverse=True)[1]
    keys, first, counts = np.unique(prefix * size + words.which[at + n - 1], return_index=True, return_counts=True)
    of = keys // size
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    heads = at[first[cuts[:-1]]]
    names = words.names.cast(pa.string())
    spelled = [names.take(pa.array(words.which[heads + j])) for j in range(n - 1)]
    offsets = pa.array(cuts, pa.int32())
    return pa.record_batch({
        "lang": pa.array(words.langs, pa.string()).take(pa.array(words.lang[heads])),
        "prefix": pc.binary_join_element_wise(*spelled, " ") if spelled else pa.array([""] * len(heads), pa.string()),
        "size": pa.array(np.full(len(heads), n - 1), pa.int32()),
        "nexts": pa.ListArray.from_arrays(offsets, names.take(pa.array(keys % size))),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
    })


def _stripes(batches: Iterator[pa.RecordBatch], sieves: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Stripes of a task's texts in runs of RUN places: of one word with an empty list of sieves, else of two to four."""
    for part in slices(batches, "text", TEXT_BYTES):
        words = _words(part)
        for n, at in enumerate(_places(words, sieves), 1):
            if (n == 1) == (sieves == []):
                for a in range(0, len(at), RUN):
                    yield _stripe(words, n, at[a : a + RUN])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def _sieve(hashes: DataFrame) -> np.ndarray:
    """The bit set of the hashes in the column h: 2**SIEVE_LOG2 bits at any number of rows."""
    slots = hashes.select(F.expr(f"h & {(1 << SIEVE_LOG2) - 1}L").alias("slot"))
    found = slots.groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << SIEVE_LOG2 - 6, np.int64)
    sieve[found["at"].to_numpy()] = found["bits"].to_numpy()
    return sieve


def _frequent_words(words: DataFrame) -> np.ndarray:
    """The sieve of the words in the columns lang and next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            one = Words(batch.column("next").cast(pa.large_binary()), np.arange(batch.num_rows), np.zeros(0), langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64))
            yield pa.record_batch({"h": pa.array(_hashes(one, 1, np.arange(batch.num_rows)).view(np.int64))})

    return _sieve(words.select("lang", "next").mapInArrow(run, "h bigint"))


def _frequent_phrases(texts: DataFrame, sieves: list[np.ndarray], least: int) -> np.ndarray:
    """The sieve of the phrases one word longer than those of the last of `sieves`."""
    sent, n = texts.sparkSession.sparkContext.broadcast(sieves), len(sieves) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(counts, pa.int64())})

        held, pending = [], 0
        for part in slices(batches, "text", TEXT_BYTES):
            words = _words(part)
            held.append(_hashes(words, n, _places(words, sent.value)[-1]))
            pending += len(held[-1])
            if pending >= RUN:
                yield summed()
                held, pending = [], 0
        if pending:
            yield summed()

    return _sieve(texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def merged_stripes(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 1) -> DataFrame:
    """(lang, prefix, size, next, f): all words and phrases of f >= `least`, from the stripes of all texts merged elementwise.

    A stripe is exploded into its entries and summed by a hash aggregate, which merges map-side first: a prefix as
    common as a third of all words has its stripe summed in pieces over many tasks, never gathered in one. The empty
    prefix has size 0, and one more entry under next = null: n, the words of the language.
    """
    texts = _texts(docs, text, lang)
    context = docs.sparkSession.sparkContext

    def merged(stripes: DataFrame) -> DataFrame:
        entries = stripes.select("lang", "prefix", "size", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
        return entries.groupBy("lang", "prefix", "size", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("f"))

    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    single = texts.mapInArrow(lambda batches: _stripes(batches, []), STRIPES)
    single = single.select("lang", "prefix", "size", F.concat("nexts", F.array(F.lit(None).cast("string"))).alias("nexts"), F.concat("counts", F.array(total)).alias("counts"))
    words = materialize(merged(single).where((F.col("f") >= least) | F.col("next").isNull()))
    sieves = [_frequent_words(words.where(F.col("next").isNotNull()))]
    for _ in range(2, LONGEST):
        sieves.append(_frequent_phrases(texts, sieves, least))
    sent = context.broadcast(sieves)
    longer = texts.mapInArrow(lambda batches: _stripes(batches, sent.value), STRIPES)
    return words.unionByName(merged(longer).where(F.col("f") >= least))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score (all numbers long).

    Candidates are phrases of 2 to 4 words with a = f >= `least`. Each cut after k words gives l = f(first part),
    r = f(rest) and floor(2000000 * a / (l + r)), in exact decimal arithmetic; the lowest counts, ties to the smallest
    k. A candidate goes if a candidate one word longer that contains it has `cover` * a <= 100 * f; no longer
    candidate can have a larger f, since f never grows with length. Ranks: score, then a descending, then phrase in
    UTF-8 byte order. Parts of a candidate occur at least as often as it, so the words and phrases of f >= `least` are
    enough; they are written once, and all later joins read them: what is joined is bounded by the number of words over
    `least`, whatever the corpus.
    """
    frequent = materialize(merged_stripes(docs, text, lang, least))
    n = frequent.where("next IS NULL").select("lang", F.col("f").alias("n"))
    candidates = frequent.where("size > 0").select(
        "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), (F.col("size") + 1).alias("size"), F.col("f").alias("a")
    )
    parts = frequent.where("size = 0 AND next IS NOT NULL").select("lang", F.col("next").alias("part"), "f").unionByName(
        candidates.where("size <= 3").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    )
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    left = parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr("CAST(CAST(a AS DECIMAL(38, 0)) * 2000000 div (l + r) AS BIGINT)")
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    longer = candidates.where("size >= 3")
    maxima = longer.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("size") - 1), " ").alias("phrase"), "a").unionByName(
        longer.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.lit(2), F.col("size") - 1), " ").alias("phrase"), "a")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("covering"))
    kept = best.join(maxima, ["lang", "phrase"], "left").where(F.col("covering").isNull() | (100 * F.col("covering") < cover * F.col("b.a")))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("b.a").desc(), F.col("phrase").cast("binary"))
    ranked = kept.select("lang", "phrase", "b", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase",
        F.col("b.a").alias("a"), F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"),
    )
