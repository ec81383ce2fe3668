"""Plain Python scans of the base secret patterns and of random-string candidates, for the tests."""

import hashlib
import re

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ["assign", "access", "hex", "random"]


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def digest(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text, weights, threshold):
    """Base spans and random ones: runs of 16+ that overlap no base span and score at least the threshold."""
    found = base(text)
    spans = list(found)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or ""):
        if any(s < m.end() and e > m.start() for s, _, e in found):
            continue
        t = "^" + m.group()
        if sum(weights[t[i : i + 2]] for i in range(len(m.group()))) / len(m.group()) >= threshold:
            spans.append((m.start(), 3, m.end()))
    return (
        sum(k == 0 for _, k, _ in found), sum(k == 1 for _, k, _ in found), sum(k == 2 for _, k, _ in found),
        hashlib.sha256(digest(found).encode()).hexdigest(), digest(spans),
    )
