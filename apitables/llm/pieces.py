"""A fixed public SentencePiece vocabulary, and the lattice of all segmentations of many pre-tokens in one trie.

A pre-token is a run of spaces with the characters up to the next space; as no piece has a space behind another
character, every segmentation of a text is one of its pre-tokens, strung together. Like the vocabulary's own encoder,
texts get a leading space, and characters that are no piece are spelled with byte pieces.

The nodes of the trie are the distinct prefixes of the pre-tokens, numbered by length; an edge leads from a prefix to
the one that is a piece longer. So what depends on a prefix alone is computed once for all pre-tokens that share it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from apitables.llm.texts import FACTOR, STEP, powers, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The filter of piece hashes goes by their first 20 bits.
_SHIFT = np.uint64(44)
#: Bytes in a character, by its first byte; stray continuation bytes are characters of their own.
_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


def _tag(size: int) -> np.uint64:
    """Sets hashes of different lengths apart."""
    return np.uint64(int(FACTOR) * size % (1 << 64))


@dataclass
class Vocabulary:
    """Pieces as bytes with plain spaces; `text[i]` is what id i decodes to, `byte` the id of byte 0's piece."""

    text: list[bytes]
    usable: np.ndarray
    byte: int

    def __post_init__(self) -> None:
        sizes = np.array([len(x) for x in self.text])
        self.tables = {}
        self.filter = np.zeros(1 << 20, bool)
        for size in np.unique(sizes[self.usable]).tolist():
            ids = np.flatnonzero(self.usable & (sizes == size))
            data = np.frombuffer(b"".join(self.text[i] for i in ids), np.uint8).reshape(-1, size)
            up, _ = powers(size)
            hashes = ((data.astype(np.uint64) + np.uint64(1)) * up[:size]).sum(axis=1, dtype=np.uint64) * STEP + _tag(size)
            order = np.argsort(hashes)
            self.tables[size] = hashes[order], ids[order].astype(np.int32)
            self.filter[hashes >> _SHIFT] = True

    def __len__(self) -> int:
        return len(self.text)

    def log_zipf(self) -> np.ndarray:
        """log probabilities by Zipf's law on the rank that the vocabulary gives its pieces; byte pieces come last."""
        rank = np.arange(len(self), dtype=np.float64) - (self.byte + 256)
        rank[rank < 0] = len(self)
        weight = 1 / (rank + 3)
        weight[: self.byte] = 0
        with np.errstate(divide="ignore"):
            return np.log(weight / weight.sum())


def vocabulary(model: bytes) -> Vocabulary:
    """From the bytes of a SentencePiece model file with byte fallback, so that it can be sent to tasks as they are."""
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = p.get_piece_size()
    text, usable, byte = [], np.zeros(n, bool), p.piece_to_id("<0x00>")
    for i in range(n):
        if p.is_byte(i):
            text.append(bytes([i - byte]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            text.append(b"")
        else:
            text.append(p.id_to_piece(i).replace("▁", " ").encode())
            usable[i] = True
    return Vocabulary(text, usable, byte)


@lru_cache(2)
def cached(model: bytes) -> Vocabulary:
    """One vocabulary for all batches of a Python worker."""
    return vocabulary(model)


@dataclass
class PreTokens:
    """The pre-tokens of some texts: `which` is each one's number among the distinct ones, `first` each text's first."""

    distinct: pa.Array
    which: np.ndarray
    first: np.ndarray


def pre_tokens(column: pa.Array) -> PreTokens:
    data, offsets = utf8(column)
    filled = np.diff(offsets) > 0
    shift = np.cumsum(filled)
    buffer = np.full(len(data) + int(shift[-1] if len(shift) else 0), 32, np.uint8)
    sizes = np.diff(offsets)
    buffer[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    begins = np.concatenate(([0], np.cumsum(sizes + filled)))
    space = buffer == 32
    opens = space.copy()
    if len(buffer):
        opens[1:] &= ~space[:-1]
        opens[begins[:-1][filled]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts, len(buffer))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(buffer)])
    found = tokens.dictionary_encode()
    return PreTokens(found.dictionary, found.indices.to_numpy(), np.searchsorted(starts, begins))


@dataclass
class Trie:
    """Node 0 is the empty prefix; the nodes of length j are level[j] <= node < level[j + 1].

    Edges are sorted by the node they lead to: those into node v are into[v] <= edge < into[v + 1]. `piece` is an id, or
    -1 for a character spelled in `size` byte pieces. `terminal` is the node of each pre-token, `byte_at` where the
    bytes of a node's edges end in `data`.
    """

    level: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    into: np.ndarray
    terminal: np.ndarray
    data: np.ndarray
    end: np.ndarray

    def __init__(self, tokens: pa.Array, vocab: Vocabulary) -> None:
        order = pc.sort_indices(tokens).to_numpy()
        data, off = utf8(tokens.take(pa.array(order)))
        sizes = np.diff(off)
        shared = np.zeros(len(order), np.int64)
        active, j = np.arange(1, len(order)), 0
        while len(active):
            active = active[(sizes[active] > j) & (sizes[active - 1] > j)]
            active = active[data[off[active] + j] == data[off[active - 1] + j]]
            shared[active] += 1
            j += 1
        node = np.zeros(len(data), np.int64)
        alive, level, ends, count = np.arange(len(order)), [0, 1], [], 1
        for j in range(1, int(sizes.max(initial=0)) + 1):
            alive = alive[sizes[alive] >= j]
            new = shared[alive] < j
            at = off[alive] + j - 1
            node[at] = count - 1 + np.cumsum(new)
            ends.append(at[new] + 1)
            count += int(new.sum())
            level.append(count)
        self.level = np.array(level, np.int64)
        self.end = np.concatenate([np.zeros(1, np.int64), *ends]) if ends else np.zeros(1, np.int64)
        self.terminal = np.zeros(len(order), np.int64)
        self.terminal[order] = node[off[1:] - 1] if len(data) else 0
        self.data = data
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for size in sorted({*vocab.tables, 1, 2, 3, 4}):
            if size >= len(level) - 1:
                break
            nodes = np.arange(level[size], count)
            starts = self.end[nodes] - size
            piece = np.full(len(nodes), -2, np.int32)
            if size in vocab.tables:
                hashes, ids = vocab.tables[size]
                h = (total[self.end[nodes]] - total[starts]) * down[starts]
                h *= STEP
                h += _tag(size)
                maybe = np.flatnonzero(vocab.filter[h >> _SHIFT])
                number = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                piece[maybe] = np.where(hashes[number] == h[maybe], ids[number], -2)
            if size <= 4:
                piece[(piece == -2) & (_WIDTH[data[starts]] == size)] = -1
            hit = np.flatnonzero(piece > -2)
            found.append((nodes[hit], piece[hit], size))
        target = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        piece = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int32)
        size = np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found]) if found else np.zeros(0, np.int64)
        order_ = np.argsort(target, kind="stable")
        self.target, self.piece, self.size = target[order_], piece[order_], size[order_]
        depth = np.repeat(np.arange(len(level) - 1), np.diff(self.level))
        whole = depth[self.target] == self.size
        self.source = np.where(whole, 0, node[np.maximum(self.end[self.target] - self.size - 1, 0)])
        self.into = np.searchsorted(self.target, np.arange(count + 1))

    def __len__(self) -> int:
        return int(self.level[-1])

    def scores(self, log_p: np.ndarray, byte: int) -> np.ndarray:
        """log probability of each edge; `log_p` is by piece id, in its last axis."""
        out = log_p[..., np.maximum(self.piece, 0)]
        spelled = np.flatnonzero(self.piece < 0)
        if len(spelled):
            end, size = self.end[self.target[spelled]], self.size[spelled]
            total = np.zeros((*log_p.shape[:-1], len(spelled)))
            for j in range(4):
                total += np.where(j < size, log_p[..., byte + self.data[np.minimum(end - size + j, len(self.data) - 1)]], 0)
            out[..., spelled] = total
        return out

    def levels(self):
        """Of each level beyond the root: its first node, the edges into it, and the nodes that have any, with their first edge."""
        for lo, hi in zip(self.level[1:].tolist(), self.level[2:].tolist()):
            a, b = int(self.into[lo]), int(self.into[hi])
            if a < b:
                reached = np.flatnonzero(np.diff(self.into[lo : hi + 1])) + lo
                yield slice(a, b), reached, self.into[reached] - a, np.repeat(np.arange(len(reached)), self.into[reached + 1] - self.into[reached])

    def forward(self, score: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of each prefix; `score` is of the edges, in its last axis."""
        alpha = np.full((*score.shape[:-1], len(self)), -np.inf)
        alpha[..., 0] = 0
        for edges, reached, first, of in self.levels():
            value = alpha[..., self.source[edges]] + score[..., edges]
            most = np.maximum.reduceat(value, first, axis=-1)
            safe = np.where(np.isfinite(most), most, 0)
            with np.errstate(divide="ignore"):
                alpha[..., reached] = safe + np.log(np.add.reduceat(np.exp(value - safe[..., of]), first, axis=-1))
        return alpha

    def expected(self, score: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each edge is used in expectation, if pre-token i occurs weight[i] times."""
        flow = np.bincount(self.terminal, weights=weight, minlength=len(self))
        used = np.zeros(len(self.source))
        for edges, reached, _, of in reversed(list(self.levels())):
            base = np.where(np.isfinite(alpha[reached]), alpha[reached], 0)
            used[edges] = flow[reached][of] * np.exp(alpha[self.source[edges]] + score[edges] - base[of])
            flow[: reached[0]] += np.bincount(self.source[edges], weights=used[edges], minlength=reached[0])[: reached[0]]
        return used

    def best(self, score: np.ndarray) -> np.ndarray:
        """Pieces in the likeliest segmentation of each prefix; of equals, the one with the fewest."""
        value, count = np.full(len(self), -np.inf), np.zeros(len(self), np.int64)
        value[0] = 0
        cost = np.where(self.piece < 0, self.size, 1)
        for edges, reached, first, of in self.levels():
            way = value[self.source[edges]] + score[edges]
            most = np.maximum.reduceat(way, first)
            value[reached] = most
            count[reached] = np.minimum.reduceat(np.where(way == most[of], count[self.source[edges]] + cost[edges], np.iinfo(np.int64).max), first)
        return count
