"""Secret scans with built-in functions only: three base patterns, and character Markov models for random strings.

Base kinds, each its own leftmost non-overlapping scan of a whole text (null: empty), failing matches dropped:

- ``assign``: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, the keyword in
  either case, group 2 of 6 or more characters;
- ``access``: ``AKIA[A-Z0-9]+`` of 20 or more characters;
- ``hex``: ``[0-9a-f]+`` of 24 or more characters.

For ``access`` and ``hex`` a match is a maximal run, so the length rule can sit in the pattern (``{16,}``, ``{24,}``)
without changing which runs are found; ``assign`` is scanned with ``+`` and filtered after, since a failing match
there hides a keyword inside it from the scan.

The method adds ``random`` spans: maximal runs of ``[A-Za-z0-9+/_=-]`` of 16 or more characters that overlap no base
span and whose log-likelihood ratio per character, random-string model against identifier model, is at least
`threshold`. Each model is a first-order Markov chain over those 66 characters and a start mark, with add-one
smoothing. The random model learns from the values that the base patterns find, the identifier model from words and
identifiers of 4 to 15 characters (``[A-Za-z_][A-Za-z0-9_]{3,14}`` standing alone) of the texts outside base
matches, so that no string that could be scored is learnt as ordinary; each sample is at most `sample` distinct
strings, chosen by hash, so the fitted tables (4,422 numbers each) are bounded whatever the corpus.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then kind (assign, access, hex, random).
A text's spans are found from the lengths of the pieces between matches, summed along the text by a window per row.
Each pattern runs over a text once: the pieces' lengths and matches, never the texts, are written to the shared
folder, and the random-string sample and the scores are taken from them. Repeated rows are scanned as often as they
occur; an empty table gives no rows; a null key stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apitables.session import materialize

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_]{3,14}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = "^"


def _pairs(token: Column) -> Column:
    """The character pairs of a token with the start mark before it."""
    marked = F.concat(F.lit(START), token)
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(marked, i, 2))


def _base_values(pieces: Column) -> Column:
    """The strings that the random-string model learns from: group 2 of valid assignments, access keys and hex runs."""
    valid = F.filter(pieces, lambda p: p["valid"] & (p["kind"] < 3))
    return F.transform(
        valid, lambda p: F.when(p["kind"] == 0, F.regexp_extract(p["m"], ASSIGN, 2)).otherwise(p["m"])
    )


def _plain_values(t: Column) -> Column:
    """Words and identifiers of 4 to 15 characters outside base matches."""
    return F.regexp_extract_all(F.regexp_replace(t, "|".join((ASSIGN, ACCESS, HEX)), " "), F.lit(IDENTIFIER), 0)


def _weights(random: DataFrame, plain: DataFrame, sample: int) -> Column:
    """The log-likelihood ratio of each character pair from two one-column (`s`) frames of strings."""
    counts = None
    for label, values in (("random", random), ("plain", plain)):
        strings = values.select("s", F.xxhash64("s").alias("h"))
        total = strings.agg(F.approx_count_distinct("s").alias("n")).first()["n"] or 0
        share = min(1.0, 2.0 * sample / total) if total else 1.0
        cut = min(2**63 - 1, -(2**63) + int(share * 2.0**64))
        chosen = strings.where(F.col("h") <= F.lit(cut)).distinct().orderBy("h", "s").limit(sample)
        pairs = chosen.select(F.explode(_pairs(F.col("s"))).alias("p")).groupBy("p").count().withColumn("label", F.lit(label))
        counts = pairs if counts is None else counts.unionByName(pairs)
    seen = {(r["label"], r["p"]): r["count"] for r in counts.where(F.length("p") == 2).collect()}
    keys, weights = [], []
    for a in START + ALPHABET:
        row = {label: [seen.get((label, a + b), 0) for b in ALPHABET] for label in ("random", "plain")}
        sums = {label: sum(c) + len(ALPHABET) for label, c in row.items()}
        for j, b in enumerate(ALPHABET):
            keys.append(a + b)
            weights.append(math.log((row["random"][j] + 1) / sums["random"]) - math.log((row["plain"][j] + 1) / sums["plain"]))
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit(w) for w in weights)))


def fit(docs: DataFrame, text: str = "text", sample: int = 100_000) -> Column:
    """The log-likelihood ratio of each character pair, as a map literal of 67 x 66 entries.

    Both samples are distinct strings with the smallest hashes: the share to keep is set from an approximate count
    of distinct strings, then at most `sample` are taken, so no step gathers more than about `sample` rows.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(_pieces(t, ASSIGN, 0), _pieces(t, ACCESS, 1), _pieces(t, HEX, 2))
    random = docs.select(F.explode(_base_values(base)).alias("s"))
    plain = docs.select(F.explode(_plain_values(t)).alias("s"))
    return _weights(random, plain, sample)


def _pieces(t: Column, pattern: str, kind: int) -> Column:
    """Per match of `pattern`: the length of the piece before it, the match and whether it counts; then one entry
    for the piece after the last match. The split and the matches are zipped first, so that each pattern runs over
    the text twice per row, not once per match."""
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    zipped = F.arrays_zip(F.split(t, pattern, -1).alias("p"), found.alias("m"))
    ok = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST if kind == 0 else F.lit(True)
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(z["p"]).alias("before"),
            F.coalesce(F.length(z["m"]), F.lit(0)).alias("size"),
            F.coalesce(z["m"].isNotNull() & ok(z["m"]), F.lit(False)).alias("valid"),
            z["m"].alias("m"),
        ),
    )


def _scan(t: Column) -> Column:
    """The pieces of all four patterns, base kinds first."""
    return F.concat(_pieces(t, ASSIGN, 0), _pieces(t, ACCESS, 1), _pieces(t, HEX, 2), _pieces(t, CANDIDATE, 3))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 1.5, sample: int = 100_000) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 (of the base spans joined by commas), spans (all of them)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = "__row"
    # Each pattern runs over the text once here; later steps read the written pieces, never the text again.
    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias(row), F.col(key).alias("key"), F.length(t).alias("n_chars"),
                    _scan(t).alias("pieces"))
    )
    weights = _weights(rows.select(F.explode(_base_values(F.col("pieces"))).alias("s")),
                       docs.select(F.explode(_plain_values(t)).alias("s")), sample)
    llr = lambda m: F.aggregate(_pairs(m), F.lit(0.0), lambda acc, p: acc + F.element_at(weights, p)) / F.length(m)
    flat = rows.select(row, "key", "n_chars", F.explode("pieces").alias("p")).select(row, "key", "n_chars", "p.*")
    flat = flat.withColumn("score", F.when((F.col("kind") == 3) & (F.col("size") > 0), llr(F.col("m"))))
    # Each kind's pieces and matches add up to the whole text, so a running sum over all kinds in order, less the
    # lengths of the kinds before, is the start of a match.
    along = Window.partitionBy(row).orderBy("kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flat.withColumn("start", F.sum(F.col("before") + F.col("size")).over(along) - F.col("size") - F.col("kind") * F.col("n_chars"))
    placed = placed.withColumn("end", F.col("start") + F.col("size")).withColumn("base", F.col("valid") & (F.col("kind") < 3))
    by_start = Window.partitionBy(row).orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(1, Window.unboundedFollowing))
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(nxt < F.col("end"), F.lit(False))
    marked = placed.withColumn(
        "keep", F.col("base") | ((F.col("kind") == 3) & (F.col("size") > 0) & ~overlaps & (F.col("score") >= threshold))
    )
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    grouped = marked.groupBy(row).agg(
        F.first("key").alias("key"),
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("keep"), span))).alias("a"),
    )
    return grouped.select(
        F.col("key").alias(key), "n_assign", "n_access", "n_hex",
        F.sha2(F.array_join(F.transform("b", lambda s: s["s"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("a", lambda s: s["s"]), ",").alias("spans"),
    )
