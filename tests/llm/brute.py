"""Plain versions of the operators, over lists of rows."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, threshold=0.8):
    """id -> least id of its class, by plain Jaccard similarity of all pairs with a common shingle."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    by_text, by_shingle = {}, defaultdict(list)
    for i, t in rows:
        if t is not None:
            join(i, by_text.setdefault(t, i))
        for s in sets[i]:
            by_shingle[s].append(i)
    pairs = {(a, b) for found in by_shingle.values() for a in found for b in found if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            join(a, b)
    return {i: root(i) for i, _ in rows}


def cut_lines(rows, n=3):
    """id -> text without the windows of n lines that occurred before, by (id, line)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for j in range(len(lines) - n + 1):
            window = tuple(lines[j : j + n])
            if any(x.strip(" \t\r\f\v") for x in window):
                if window in seen:
                    gone.update(range(j, j + n))
                seen.add(window)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text
    return out


def contamination(docs, items, n=13):
    """id -> (words, hit words, items with a window that occurs)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows[tuple(w[i : i + size])].add(str(item))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[j : j + size]))) is not None:
                    hit.update(range(j, j + size))
                    found |= names
        out[i] = len(w), len(hit), sorted(found)
    return out
