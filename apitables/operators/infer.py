"""Structural schema inference as a two-phase hash aggregate.

Every value of every record falls under a path (field steps are `"." + name`, array elements share
the step `"[]"`) and has a kind. One narrow pass lists the leaves of each record; the leaves carry
enough to count the containers above them, so documents are parsed once whatever their depth and
only (paths x kinds) rows are shuffled. All later steps work on that small relation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import with_json, with_kind
from ..session import configure, materialize
from .keyed import ENDPOINT
from .screen import REC_KEY, unwrap

# Levels that the first pass expands. Deeper containers are expanded further, by themselves; each round goes twice as deep
# as the one before, up to LAST_DEPTH levels, so that few rounds write them.
FIRST_DEPTH = 8
LAST_DEPTH = 32

# An order key is the record's place followed by up to five array positions inside the record.
# Positions beyond a field's width count as its last; this can only tie the display order.
ORDER = "decimal(38,0)"
_POSITIONS = [(10**11, 10**6 - 1), (10**7, 10**4 - 1), (10**4, 10**3 - 1), (10**2, 99), (1, 99)]
_RECORD_UNIT = 10**17

KINDS = ["null", "bool", "int", "float", "string", "date", "datetime", "array", "record"]


def _quoted(names: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}`{n}`, " for n in names)


def _leaves(df: DataFrame, keys: Sequence[str], depth: int, base: int = 0) -> DataFrame:
    """Expand the variant `record` to its leaves, `depth` levels down, without leaving the stage.

    Columns: k0.. (the keys), rec_key, issue, s1.. (one step per level), v, lead, nest, place.
    `lead` is the depth from which a leaf is the first one below its ancestors: counting a leaf
    for its ancestors at or below `lead` counts every container exactly once. Rows are never
    filtered here, as a pushed-down filter would repeat the JSON parse.

    With `base` > 0 the records are containers found `base` levels down; `prefix` is their path, or stands for it.
    """
    carried = "".join(f"k{i}, " for i in range(len(keys))) + "rec_key, issue, " + ("prefix, " if base else "")
    named = "".join(f"`{k}` AS k{i}, " for i, k in enumerate(keys)) + f"CAST(rec_key AS {REC_KEY}) AS rec_key, issue, "
    named += "prefix, record AS v, lead, nest, place" if base else "record AS v, 0 AS lead, 0 AS nest, 0L AS place"
    query = f"SELECT {named} FROM {{df}}"
    positions = " ".join(f"WHEN {i} THEN least(CAST(pos AS BIGINT), {top}L) * {unit}L"
                         for i, (unit, top) in enumerate(_POSITIONS))
    steps = ""
    for level in range(1, depth + 1):
        element = "(pos IS NOT NULL AND key IS NULL)"
        query = f"""
            SELECT {carried} {steps} IF({element}, '[]', '.' || key) AS s{level},
                   IF(pos IS NULL, v, value) AS v, IF(pos > 0, {base + level}, lead) AS lead,
                   IF({element}, nest + 1, nest) AS nest,
                   IF({element}, place + CASE nest {positions} ELSE 0L END, place) AS place
            FROM ({query}), LATERAL variant_explode_outer(v)"""
        steps += f"s{level}, "
    return df.sparkSession.sql(query, df=df)


def _steps(depth: int) -> list[str]:
    return [f"s{level}" for level in range(1, depth + 1)]


def _path(depth: int, base: int = 0) -> str:
    steps = f"filter(array({', '.join(_steps(depth))}), s -> s IS NOT NULL)"
    return f"prefix || {steps}" if base else steps


def _path_id(steps: str, base: int) -> str:
    """What stands for a path of any length: a hash over the id of the prefix and the steps below it, told apart by their lengths."""
    parts = f"array_join(transform({steps}, s -> length(s) || ':' || s), '')"
    return f"sha2({'prefix || ' if base else ''}{parts}, 256)"


def _hidden(depth: int) -> str:
    """Containers at the last level, whose content was not looked into."""
    return f"s{depth} IS NOT NULL AND kind IN ('record', 'array')"


def _counted(df: DataFrame, keys: Sequence[str], depth: int, base: int = 0) -> DataFrame:
    """(keys, path below the prefix, kind, lead) of `_opened` leaves with counts and first order key."""
    group = "".join(f"k{i}, " for i in range(len(keys))) + ("prefix, " if base else "") + ", ".join(_steps(depth))
    query = f"""
        SELECT {"".join(f"k{i} AS `{k}`, " for i, k in enumerate(keys))} {"prefix, " if base else ""}
               {_path(depth)} AS path, kind, issue, hidden, lead, n, first_ord
        FROM (SELECT {group}, kind, issue, hidden, lead, count(*) AS n, min(ord) AS first_ord
              FROM (SELECT {group}, coalesce(issue, kind) AS kind, issue IS NOT NULL AS issue, hidden, lead,
                           CAST(rec_key * CAST({_RECORD_UNIT} AS DECIMAL(18,0))
                                + CAST(place AS DECIMAL(17,0)) AS {ORDER}) AS ord
                    FROM {{leaves}})
              GROUP BY {group}, kind, issue, hidden, lead)"""
    return df.sparkSession.sql(query, leaves=df)


def _opened(df: DataFrame, keys: Sequence[str], depth: int, base: int = 0) -> DataFrame:
    """`_leaves` with their kind, whether they are hidden, and no variants but those."""
    return df.sparkSession.sql(f"SELECT * EXCEPT (v), {_hidden(depth)} AS hidden, IF({_hidden(depth)}, v, NULL) AS v FROM {{leaves}}",
                               leaves=with_kind(_leaves(df, keys, depth, base), "v", "kind"))


def _below(df: DataFrame, keys: Sequence[str], depth: int, base: int) -> DataFrame:
    """The hidden ones of `_opened` leaves, as records to expand further under the id of their path."""
    return df.sparkSession.sql(f"""
        SELECT {"".join(f"k{i} AS `{k}`, " for i, k in enumerate(keys))} rec_key, issue,
               {_path_id(f"array({', '.join(_steps(depth))})", base)} AS prefix, v AS record, lead, nest, place
        FROM {{leaves}} WHERE hidden""", leaves=df)


def _frontier(df: DataFrame, keys: Sequence[str], depth: int, base: int) -> DataFrame:
    """The hidden containers, as records to expand further under their path."""
    return df.sparkSession.sql(f"""
        SELECT {"".join(f"k{i} AS `{k}`, " for i, k in enumerate(keys))} rec_key, issue,
               {_path(depth, base)} AS prefix, v AS record, lead, nest, place
        FROM {{leaves}} WHERE {_hidden(depth)}""", leaves=with_kind(_leaves(df, keys, depth, base), "v", "kind"))


# Names a schema or profile relation uses itself.
_RESERVED = {"path", "kind", "issue", "hidden", "lead", "n", "first_ord", "len", "depth", "name", "members", "optional",
             "step_rank", "label", "prefix", "rec_key", "record", "place", "nest", "at", "fingerprint"}


def profile(df: DataFrame, keys: Sequence[str] = ENDPOINT, depth: int | None = None) -> DataFrame:
    """Path statistics of the `record` column per `keys`, ordered by `rec_key`.

    Rows with a non-NULL `issue` column stand for responses without records and are counted under
    that issue. With `depth=None` the result is written once to learn whether deeper levels exist;
    only then are the containers found that deep expanded further, by themselves. A given `depth`
    skips that job and fails, rather than losing values, when a record is deeper.
    """
    taken = _RESERVED.intersection(keys)
    if taken:
        raise ValueError(f"rename the key column `{min(taken)}`; the schema relation has a column of that name")
    configure(df.sparkSession)
    if depth is not None:
        leaves = _counted(_opened(df, keys, depth), keys, depth).withColumn(
            "kind", F.when(F.col("hidden"), F.raise_error(F.lit("a record is nested deeper than depth")))
            .otherwise(F.col("kind")))
        return _count_containers(leaves, keys)
    depth, base = FIRST_DEPTH, 0
    opened = _opened(df, keys, depth)
    rounds = [materialize(_counted(opened, keys, depth))]
    while not rounds[-1].filter("hidden").isEmpty():
        # Deep containers carry an id of their path, however long that is; the distinct paths are kept beside them.
        paths = materialize(_paths(rounds[-1], base))
        part, base, depth = materialize(_below(opened, keys, depth, base)), base + depth, min(2 * depth, LAST_DEPTH)
        # What a further round needs too is written once, as expanding it again would cost more.
        opened = materialize(_opened(part, keys, depth, base))
        rounds.append(materialize(_whole(_counted(opened, keys, depth, base), paths)))
    shown = [r.filter("NOT hidden").drop("prefix", "below") for r in rounds]
    whole = shown[0]
    for more in shown[1:]:
        whole = whole.unionByName(more)
    return _count_containers(whole, keys)


def _whole(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """Leaves counted under path ids, with their whole path; `below` is what the round found."""
    return leaves.sparkSession.sql("""
        SELECT l.* EXCEPT (path), l.path AS below, p.prefix_path || l.path AS path
        FROM {leaves} l JOIN {paths} p ON l.prefix = p.prefix""", leaves=leaves, paths=paths)


def _paths(leaves: DataFrame, base: int) -> DataFrame:
    """(prefix, prefix_path): the ids of the hidden paths of a round."""
    return leaves.sparkSession.sql(f"""
        SELECT {_path_id("below" if base else "path", base)} AS prefix, path AS prefix_path
        FROM (SELECT DISTINCT {"prefix, below, " if base else ""} path FROM {{leaves}} WHERE hidden)""", leaves=leaves)


# The ancestors of a leaf it is counted for, and itself: `len` steps of its path. The kind of an
# ancestor follows from the step below it.
_ANCESTORS = """explode(IF({issue}, array(0), sequence(least(lead, size(path)), size(path)))) AS len"""
_ANCESTOR_KIND = """CASE WHEN len = size(path) THEN kind WHEN path[len] = '[]' THEN 'array' ELSE 'record' END"""


def _count_containers(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turn leaf counts into counts of every node."""
    return leaves.sparkSession.sql(f"""
        SELECT {_quoted(keys)} slice(path, 1, len) AS path, {_ANCESTOR_KIND} AS kind, issue,
               sum(n) AS n, min(first_ord) AS first_ord
        FROM (SELECT *, {_ANCESTORS.format(issue="issue")} FROM {{leaves}})
        GROUP BY ALL""", leaves=leaves)


def path_stats(profiled: DataFrame) -> DataFrame:
    """Occurrences and first order key per (path, kind)."""
    return profiled.filter(~F.col("issue")).drop("issue")


def flatten(records: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    """One row per JSON value, at every depth: keys, rec_key, path, kind.

    A first job learns whether containers lie deeper than one pass reaches; only those are then written and expanded
    further, by themselves.
    """
    configure(records.sparkSession)
    part = records if "issue" in records.columns else records.withColumn("issue", F.lit(None).cast("string"))
    out, base = None, 0
    while True:
        deep = materialize(_frontier(part, keys, FIRST_DEPTH, base))
        leaves = with_kind(_leaves(part, keys, FIRST_DEPTH, base), "v", "kind")
        rows = records.sparkSession.sql(f"""
            SELECT {_quoted(keys)} rec_key, slice(path, 1, len) AS path, {_ANCESTOR_KIND} AS kind
            FROM (SELECT *, {_ANCESTORS.format(issue="false")}
                  FROM (SELECT {"".join(f"k{i} AS `{k}`, " for i, k in enumerate(keys))} rec_key, lead, {_path(FIRST_DEPTH, base)} AS path, kind
                        FROM {{leaves}} WHERE NOT coalesce({_hidden(FIRST_DEPTH)}, false)))""", leaves=leaves)
        out = rows if out is None else out.unionByName(rows)
        if deep.isEmpty():
            return out
        part, base = deep, base + FIRST_DEPTH


_IS_FIELD = "coalesce(try_element_at(path, -1) LIKE '.%', false)"


def unify(stats: DataFrame, keys: Sequence[str] = ENDPOINT, root_name: str = "endpoint") -> DataFrame:
    """Reduce path statistics to one row per path: the inferred schema.

    Columns: keys, path, depth, name, members (kinds in order of first appearance), optional,
    first_ord, step_rank, label. More than one member is a union. `root_name` is an SQL
    expression over the keys.

    Integers widen to floats, dates and datetimes to strings. A null field is optional rather than
    a union with null; a null element or root stays a member. Every array vouches for an
    `unknown` element, which any real element replaces.
    """
    first = lambda *kinds: f"min(IF(kind IN ({', '.join(map(repr, kinds))}), first_ord, NULL))"
    count = lambda kind: f"sum(IF(kind = '{kind}', n, 0))"
    nodes = f"""
        SELECT {_quoted(keys)} path, present, nulls, records, first_ord,
               IF(size(slots) = 0, array('unknown'), transform(array_sort(slots), s -> s.kind)) AS members
        FROM (SELECT *, filter(array(
                    named_struct('ord', number, 'kind', IF(float IS NULL, 'int', 'float')),
                    named_struct('ord', IF(string IS NULL, NULL, text), 'kind', 'string'),
                    named_struct('ord', IF(string IS NULL, date, NULL), 'kind', 'date'),
                    named_struct('ord', IF(string IS NULL, datetime, NULL), 'kind', 'datetime'),
                    named_struct('ord', IF({_IS_FIELD} AND present > nulls, NULL, null_ord), 'kind', 'null'),
                    named_struct('ord', bool, 'kind', 'bool'),
                    named_struct('ord', `array`, 'kind', 'array'),
                    named_struct('ord', record, 'kind', 'record')), s -> s.ord IS NOT NULL) AS slots
              FROM (SELECT {_quoted(keys)} path, sum(n) AS present, {count("null")} AS nulls,
                           {count("record")} AS records, min(first_ord) AS first_ord,
                           {first("int", "float")} AS number, {first("float")} AS float,
                           {first("string")} AS string, {first("date", "datetime", "string")} AS text,
                           {first("date")} AS date, {first("datetime")} AS datetime,
                           {first("null")} AS null_ord, {first("bool")} AS bool,
                           {first("array")} AS `array`, {first("record")} AS record
                    FROM (SELECT {_quoted(keys)} inline(IF(kind = 'array',
                                 array(struct(path, kind, n, first_ord),
                                       struct(path || array('[]') AS path, 'unknown' AS kind, 0L AS n, first_ord)),
                                 array(struct(path, kind, n, first_ord))))
                          FROM {{stats}})
                    GROUP BY {_quoted(keys)} path))"""
    same = "".join(f"n.`{k}` <=> p.`{k}` AND " for k in keys)
    joined = stats.sparkSession.sql(f"""
        WITH nodes AS ({nodes})
        SELECT {_quoted(keys, "n.")} n.path, size(n.path) AS depth,
               n.name, n.members, n.first_ord,
               n.field AND (n.present < p.records OR (n.nulls > 0 AND n.present > n.nulls)) AS optional,
               CAST(array_position(p.members, IF(n.field, 'record', 'array')) AS INT) AS step_rank
        FROM (SELECT *, {_IS_FIELD} AS field,
                     coalesce(substring(try_element_at(filter(path, s -> s LIKE '.%'), -1), 2), {root_name}) AS name,
                     IF(size(path) > 0, slice(path, 1, size(path) - 1), NULL) AS parent FROM nodes) n
        LEFT JOIN nodes p ON {same} n.parent = p.path""", stats=stats)
    return with_labels(joined, keys)


def with_labels(nodes: DataFrame, keys: Sequence[str] = ENDPOINT, name: str = "name") -> DataFrame:
    """Add `label`, the type in contract notation: `int`, `address`, `T[]`, `(A | B)[]`, `A | B`.

    A label depends only on the element steps directly below its path, so the nodes of one chain
    `p, p[], p[][]` meet in one group, as long as arrays are nested, and fold from the inside out.
    """
    columns = [c for c in nodes.columns if c not in (*keys, "label")]
    label = _LABEL.format(name=name)
    return nodes.sparkSession.sql(f"""
        SELECT {_quoted(keys)} {_quoted(columns, "z.chain.")} z.labels AS label
        FROM (SELECT {_quoted(keys)} explode(arrays_zip(chain, labels)) AS z
              FROM (SELECT *, aggregate(chain,
                        named_struct('inner', '', 'labels', CAST(array() AS ARRAY<STRING>)),
                        (acc, x) -> named_struct(
                            'inner', IF(size(x.members) > 1, '(' || {label} || ')', {label}),
                            'labels', acc.labels || array({label})),
                        acc -> acc.labels) AS labels
                    FROM (SELECT {_quoted(keys)}
                                 array_sort(collect_list(struct({_quoted(columns)[:-2]})),
                                            (a, b) -> size(b.path) - size(a.path)) AS chain
                          FROM {{nodes}}
                          GROUP BY {_quoted(keys)} slice(path, 1, {_ANCHOR}))))""", nodes=nodes)


# Length of a path without its trailing element steps.
_ANCHOR = "coalesce(array_max(transform(path, (s, i) -> IF(s LIKE '.%', i + 1, 0))), 0)"
_LABEL = ("array_join(transform(x.members, m -> CASE m WHEN 'array' THEN acc.inner || '[]' "
          "WHEN 'record' THEN x.`{name}` ELSE m END), ' | ')")


def optionality(stats: DataFrame, keys: Sequence[str] = ENDPOINT, root_name: str = "endpoint") -> DataFrame:
    """Which fields some record of their parent lacks or holds as null."""
    return unify(stats, keys, root_name).filter(_IS_FIELD).select(*keys, "path", "optional")


def infer_schema(responses: DataFrame, depth: int | None = None) -> DataFrame:
    """Schema of every endpoint's records, over all of its well-formed responses."""
    configure(responses.sparkSession)
    return unify(path_stats(profile(unwrap(responses), ENDPOINT, depth)))


def record_counts(profiled: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    """Records sampled per group; groups with empty record sets only have 0."""
    root = F.size("path") == 0
    return profiled.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(root & ~F.col("issue"), F.col("n"))), F.lit(0)).alias("record_count"))


def column_profile(df: DataFrame, json_col: str, keys: Sequence[str] = (), order: str | None = None,
                   depth: int | None = None) -> DataFrame:
    """`profile` of any JSON text column; texts that are not JSON are counted as issue 'json'."""
    configure(df.sparkSession)
    text = df.select(*[F.col(f"`{k}`") for k in keys],
                     (F.col(f"`{order}`") if order else F.lit(0)).cast(REC_KEY).alias("rec_key"),
                     F.col(f"`{json_col}`").alias("_text_in"))
    parsed = with_json(text, "_text_in", "record", "_valid").withColumn(
        "issue", F.when(~F.col("_valid"), "json"))
    return profile(parsed, keys, depth)


def infer_column(df: DataFrame, json_col: str, keys: Sequence[str] = (), order: str | None = None,
                 root_name: str = "record", depth: int | None = None) -> DataFrame:
    """Schema of any JSON text column per `keys`; every text is one record."""
    stats = path_stats(column_profile(df, json_col, keys, order, depth))
    return unify(stats, keys, "'" + root_name.replace("'", "\\'") + "'")
