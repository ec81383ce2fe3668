"""Benchmark decontamination as a prefix-filtered set join, verified over item-sized windows.

A window is 13 consecutive words of an item, or the whole item if it has fewer words. Seen as a set of five-word
shingles, a window is contained in a document only if each of its shingles is, so one shingle is a sufficient prefix:
the one that is rarest over all documents. Documents are joined on that shingle; its place in the window fixes where
the window must begin (positional bound), which must lie in the text (length bound); then all words are compared.

The items are indexed in blocks of bounded size, and each block's index is sent to all tasks, so a benchmark of any
size takes more blocks, not more memory. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apitables.llm.texts import chained, runs, slices, words

WINDOW = 13
SHINGLE = 5
#: UTF-8 bytes of item texts in a block; an index takes some 20 times that.
BLOCK_BYTES = 4 << 20
_FILTER = (1 << 22) - 1


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all ranges one after another, and the range that each comes from."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), which


@dataclass
class Index:
    """Distinct windows of a block of items; `shingle` holds the sorted shingles to look for."""

    words: np.ndarray  # hashes, a row of WINDOW for each window
    length: np.ndarray
    items: list[list[str]]
    sizes: list[int]
    shingle: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each shingle's windows
    window: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(_FILTER + 1, bool))

    def look_for(self, shingle: np.ndarray, window: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(shingle, kind="stable")
        self.shingle, at = np.unique(shingle[order], return_index=True)
        self.first = np.append(at, len(order))
        self.window, self.offset = window[order], offset[order]
        self.filter[:] = False
        self.filter[(self.shingle & np.uint64(_FILTER)).astype(np.int64)] = True

    def found(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Word positions where a wanted shingle begins, its number, its size; texts are not told apart."""
        for size in self.sizes:
            g = runs(h, size)
            at = np.flatnonzero(self.filter[(g & np.uint64(_FILTER)).astype(np.int64)])
            number = np.minimum(np.searchsorted(self.shingle, g[at]), len(self.shingle) - 1)
            same = self.shingle[number] == g[at]
            yield at[same], number[same], size

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of a window in the texts: text, start, window."""
        texts, starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, number, _ in self.found(h):
            entry, hit = _spread(self.first[number], self.first[number + 1])
            w = self.window[entry]
            start = at[hit] - self.offset[entry]
            text = np.searchsorted(first, at[hit], "right") - 1
            ok = (start >= first[text]) & (start + self.length[w] <= first[text + 1])
            text, start, w = text[ok], start[ok], w[ok]
            for j in range(WINDOW):
                past = self.length[w] <= j
                same = past | (h[np.minimum(start + j, len(h) - 1)] == self.words[w, j])
                text, start, w = text[same], start[same], w[same]
            texts.append(text)
            starts.append(start)
            which.append(w)
        return np.concatenate(texts), np.concatenate(starts), np.concatenate(which)


def _candidates(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of all windows: hash, window, offset."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for length in np.unique(index.length).tolist():
        those = np.flatnonzero(index.length == length)
        size = min(SHINGLE, length)
        for offset in range(length - size + 1):
            g = chained([index.words[those, offset + j] for j in range(size)])
            found.append((g, those, np.full(len(those), offset)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _windows(rows: pa.Table) -> Index:
    """Distinct windows of (item, text) rows."""
    column = rows["text"].combine_chunks()
    h, first = words(column if isinstance(column, pa.Array) else column.chunk(0))
    seen: dict[bytes, int] = {}
    kept, lengths, items = [], [], []
    for name, a, b in zip(rows["item"].to_pylist(), first.tolist(), first[1:].tolist()):
        length = min(WINDOW, b - a)
        for s in range(a, b - length + 1) if length else ():
            key = h[s : s + length].tobytes()
            if key not in seen:
                seen[key] = len(kept)
                kept.append(np.concatenate((h[s : s + length], np.zeros(WINDOW - length, np.uint64))))
                lengths.append(length)
                items.append(set())
            items[seen[key]].add(name)
    sizes = sorted({min(SHINGLE, n) for n in lengths})
    return Index(np.array(kept, np.uint64).reshape(-1, WINDOW), np.array(lengths, np.int64), [sorted(x) for x in items], sizes)


def _counted(docs: DataFrame, text: str, index: Index, shingle: np.ndarray) -> np.ndarray:
    """How often each of `shingle` (sorted) occurs over all documents."""
    index.look_for(shingle, np.zeros(len(shingle), np.int64), np.zeros(len(shingle), np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(sent.value.shingle), np.int64)
        for part in slices(batches, text):
            h, first = words(part.column(text))
            for at, number, size in sent.value.found(h):
                inside = at + size <= first[np.searchsorted(first, at, "right")]
                totals += np.bincount(number[inside], minlength=len(totals))
        hit = np.flatnonzero(totals)
        yield pa.record_batch({"number": pa.array(hit, pa.int64()), "n": pa.array(totals[hit], pa.int64())})

    found = docs.select(text).mapInArrow(count, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(shingle), np.int64)
    out[found["number"].to_numpy()] = found["n"].to_numpy()
    return out


def index_block(docs: DataFrame, text: str, rows: pa.Table) -> Index:
    """The block's windows, each under its rarest shingle."""
    index = _windows(rows)
    shingle, window, offset = _candidates(index)
    if len(shingle):
        distinct, number = np.unique(shingle, return_inverse=True)
        rarity = _counted(docs, text, index, distinct)[number]
        order = np.lexsort((offset, shingle, rarity, window))
        best = order[np.diff(window[order], prepend=-1) != 0]
        index.look_for(shingle[best], window[best], offset[best])
    return index


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each row of `docs`: words inside an occurrence of an item's window.

    Columns named in `keep` come along, in front; they must not have the names above.

    Spans are merged word ranges [start, stop); items are the distinct ids, as strings, of items with a window that
    occurs. Null and empty texts have no words and are not hit; items without id or words have no window; repeated items
    count once. Other columns are not read. An empty benchmark hits nothing.
    """
    source = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    kept = "".join(f"`kept_{name}` {docs.schema[name].dataType.simpleString()}, " for name in keep)
    state = docs.select(*[F.col(name).alias(f"kept_{name}") for name in keep], F.col(key).alias("id"), F.col(text).alias("text"))
    shape = "spans array<struct<start:int,stop:int>>, items array<string>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for block in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow() if blocks > 1 else source.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(index_block(docs, text, rows))
        last, begun = block == blocks - 1, block > 0

        def match(batches: Iterator[pa.RecordBatch], sent=sent, last=last, begun=begun) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in slices(batches, "text"):
                h, first = words(part.column("text"))
                spans: list[list] = [[] for _ in range(part.num_rows)]
                items: list[set] = [set() for _ in range(part.num_rows)]
                if begun:
                    spans = [[(x["start"], x["stop"]) for x in s] for s in part.column("spans").to_pylist()]
                    items = [set(x) for x in part.column("items").to_pylist()]
                for t, s, w in zip(*(x.tolist() for x in index.windows(h, first))):
                    spans[t].append((s - int(first[t]), s - int(first[t]) + int(index.length[w])))
                    items[t].update(index.items[w])
                spans = [_merged(x) for x in spans]
                out = {f"kept_{name}": part.column(f"kept_{name}") for name in keep} | {"id": part.column("id")}
                if last:
                    out |= {"n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())}
                else:
                    out["text"] = part.column("text").cast(pa.string())
                out["spans"] = pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], span)
                out["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.record_batch(out)

        state = state.mapInArrow(match, f"{kept}id {kind}, " + ("n_words bigint, n_hit bigint, " if last else "text string, ") + shape)
    return state.withColumnsRenamed({f"kept_{name}": name for name in keep})
