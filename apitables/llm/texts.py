"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. Texts are read whole;
memory follows the slice of a batch in hand, and within a long text the block, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = 1 << 18
SLICE_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)


def _lower() -> np.ndarray:
    """Byte to lower-cased byte inside a word, 0 outside."""
    table = np.arange(256, dtype=np.uint8)
    table[[b for b in range(128) if not chr(b).isalnum()]] = 0
    table[65:91] += 32
    return table


LOWER = _lower()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        inverse = pow(int(FACTOR), -1, 1 << 64)
        for i, base in enumerate((int(FACTOR), inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and where each text starts in them; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some `size` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the number of each text's first word (one more entry at the end)."""
    low = LOWER[data]
    inside = low > 0
    opens, shuts = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        shuts[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
        opens[firsts], shuts[lasts] = inside[firsts], inside[lasts]
    starts = np.flatnonzero(opens)
    return low, starts, np.flatnonzero(shuts) + 1, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: list[int] | None = None) -> list[np.ndarray]:
    """A hash of each span; with `upto`, also of its first so many bytes (0 where it has no more than these)."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(1 + len(upto or []))]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
        base = int(starts[a])
        seg = low[base : int(ends[b - 1])].astype(np.uint64)
        up, down = powers(max(len(seg) + 1, BLOCK))
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * up[: len(seg)], out=total[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        back, zero = down[s], total[s]
        out[0][a:b] = mix((total[e] - zero) * back)
        for i, n in enumerate(upto or []):
            cut = np.minimum(s + n, e)
            out[i + 1][a:b] = np.where(s + n < e, mix((total[cut] - zero) * back + np.uint64(n)), np.uint64(0))
        a = b
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's first word."""
    low, starts, ends, first = word_spans(*utf8(column))
    return span_hashes(low, starts, ends)[0], first


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes that stand at the same place of each part, in order."""
    out = np.full(len(parts[0]), np.uint64(len(parts)))
    for part in parts:
        out = out * STEP + part
    return mix(out)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on; texts are not told apart."""
    n = max(0, len(h) - k + 1)
    return chained([h[j : j + n] for j in range(k)])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and each text's first; a shorter text has one, of all its words."""
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate(([0], np.cumsum(m)))
    out = np.zeros(at[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[text]
    full = np.flatnonzero(place <= n[text] - k)
    out[at[text[full]] + place[full]] = runs(h, k)[full]
    for short in range(1, k):
        those = np.flatnonzero(n == short)
        if len(those):
            out[at[those]] = runs(h, short)[first[those]]
    return out, at


def free(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
