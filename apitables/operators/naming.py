"""Registry normalisation: shared record declarations, their names and the contract text.

Input are the schema nodes of a source's tables, one endpoint per table, with `table_ord` giving
the order of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAME, PRIMITIVES
from ..session import materialize
from .diff import sums_digest, token_sums
from .infer import with_labels
from .keyed import ENDPOINT


def with_table_order(nodes: DataFrame) -> DataFrame:
    """Add `table_ord` when the caller gives none: tables then go by name."""
    return nodes if "table_ord" in nodes.columns else nodes.withColumn("table_ord", F.lit(0))


def with_tree_order(nodes: DataFrame) -> DataFrame:
    """Add `tree_ord`, which sorts a table's nodes depth first, fields in first-seen order."""
    columns = ", ".join(f"n.`{c}`" for c in nodes.columns if c != "tree_ord")
    return nodes.sparkSession.sql(f"""
        WITH steps AS (SELECT source, endpoint, path, struct(size(path) AS at, step_rank, first_ord,
                              try_element_at(path, -1) AS step) AS step FROM {{nodes}} WHERE size(path) > 0),
        keys AS (SELECT n.source, n.endpoint, n.path, array_sort(collect_list(s.step)) AS tree_ord
                 FROM (SELECT source, endpoint, path, explode(sequence(1, size(path))) AS len
                       FROM {{nodes}} WHERE size(path) > 0) n
                 JOIN steps s ON n.source <=> s.source AND n.endpoint <=> s.endpoint
                      AND slice(n.path, 1, n.len) = s.path
                 GROUP BY n.source, n.endpoint, n.path)
        SELECT {columns}, coalesce(k.tree_ord, array()) AS tree_ord
        FROM {{nodes}} n LEFT JOIN keys k
          ON n.source <=> k.source AND n.endpoint <=> k.endpoint AND n.path = k.path""", nodes=nodes)


def hoist(nodes: DataFrame) -> DataFrame:
    """Every record below a table's root, with what decides whether two share a declaration.

    `shape` covers the record's own name and everything below it, nested names included: those
    follow from the relative paths. Field order never splits a record; member order does.
    """
    return nodes.sparkSession.sql(f"""
        WITH shapes AS (
            SELECT source, endpoint, at, {sums_digest()} AS digest
            FROM (SELECT source, endpoint, at, {token_sums("token")}
                  FROM (SELECT source, endpoint, slice(path, 1, len) AS at,
                               IF(len = size(path), sha2('', 256),
                                  sha2(to_json(struct(slice(path, len + 1, size(path)) AS p, members AS m, optional AS o)), 256)) AS token
                        FROM (SELECT *, explode(sequence(0, size(path))) AS len FROM {{nodes}})
                        WHERE len = size(path) OR path[len] LIKE '.%')
                  GROUP BY source, endpoint, at))
        SELECT n.source, n.table_ord, n.endpoint, n.path, n.name, n.tree_ord, s.digest AS shape
        FROM {{nodes}} n JOIN shapes s
          ON n.source <=> s.source AND n.endpoint <=> s.endpoint AND n.path = s.at
        WHERE size(n.path) > 0 AND array_contains(n.members, 'record')""",
        nodes=with_tree_order(with_table_order(nodes)))


def dedupe_records(hoisted: DataFrame) -> DataFrame:
    """One row per declaration: the first place, in reach order, a record was reached from."""
    return hoisted.groupBy("source", "name", "shape").agg(
        F.min(F.struct("table_ord", "endpoint", "tree_ord", "path")).alias("reached"))


# The field names on the way to a record are the names of the records around it.
_SCOPE = "transform(filter(reached.path, s -> s LIKE '.%'), s -> substring(s, 2))"


def assign_names(declared: DataFrame, tables: DataFrame) -> DataFrame:
    """Add `record_name` to the declarations; `tables` holds (source, endpoint).

    A sole claimant that is not named like a table keeps its own name. Any other is qualified with
    the name of what encloses it, so its name starts at the nearest sole claimant around it, or at
    the table. Only if two names still meet are they settled one by one, in reach order.
    """
    named = declared.sparkSession.sql(f"""
        WITH tables AS (SELECT DISTINCT source, endpoint FROM {{tables}}),
        claims AS (SELECT c.source, c.name, c.n = 1 AND t.endpoint IS NULL AS alone
                   FROM (SELECT source, name, count(*) AS n FROM {{declared}} GROUP BY source, name) c
                   LEFT JOIN tables t ON c.source <=> t.source AND c.name = t.endpoint),
        scopes AS (SELECT source, name, shape, reached, posexplode({_SCOPE}) AS (at, part) FROM {{declared}})
        SELECT s.source, s.name, s.shape, s.reached,
               max(IF(c.name = s.name, c.alone, NULL)) AS alone,
               concat_ws('.', IF(max(IF(c.alone, s.at, NULL)) IS NULL, s.reached.endpoint, NULL),
                         slice({_SCOPE.replace("reached", "s.reached")}, 1 + coalesce(max(IF(c.alone, s.at, NULL)), 0), size(s.reached.path))) AS record_name
        FROM scopes s LEFT JOIN claims c ON s.source <=> c.source AND s.part = c.name
        GROUP BY s.source, s.name, s.shape, s.reached""", declared=declared, tables=tables)
    named = materialize(named)
    clashes = named.sparkSession.sql("""
        SELECT source, record_name FROM (
            SELECT source, record_name FROM {named}
            UNION ALL SELECT DISTINCT source, endpoint FROM {tables})
        GROUP BY ALL HAVING count(*) > 1""", named=named, tables=tables)
    if clashes.isEmpty():
        return named
    return _settle(named, tables)


def _settle(named: DataFrame, tables: DataFrame) -> DataFrame:
    """Resolve clashing names to the fixpoint of the sequential rule.

    Each declaration takes the first free of its own name (sole claimants), its qualified name and
    the qualified name with 2, 3, ...; names taken earlier in reach order, and those of tables, are
    not free. A pass fixes at least the earliest declaration that is still wrong.
    """
    spark = named.sparkSession
    while True:
        settled = materialize(spark.sql("""
            WITH owners AS (
                SELECT c.*, p.record_name AS enclosing
                FROM (SELECT *, slice(reached.path, 1, size(reached.path) - 1 - tail) AS outer
                      FROM (SELECT *, size(reached.path) - coalesce(array_max(transform(reached.path,
                                (s, i) -> IF(s LIKE '.%', i + 1, 0))), 0) AS tail FROM {named})) c
                LEFT JOIN {named} p ON c.source <=> p.source AND c.reached.endpoint = p.reached.endpoint
                     AND c.outer = p.reached.path),
            spoken AS (
                SELECT source, record_name AS taken, reached AS since, name, shape FROM {named}
                UNION ALL SELECT DISTINCT source, endpoint, NULL, NULL, NULL FROM {tables}),
            bare AS (
                SELECT o.source, o.name, o.shape, o.reached, o.alone, o.record_name,
                       coalesce(o.enclosing, o.reached.endpoint) || '.' || o.name AS qualified,
                       o.alone AND count(s.taken) = 0 AS free
                FROM owners o LEFT JOIN spoken s
                  ON o.source <=> s.source AND o.name = s.taken AND (s.since IS NULL OR s.since < o.reached)
                GROUP BY ALL),
            queued AS (
                SELECT *, row_number() OVER (PARTITION BY source, qualified ORDER BY reached) AS place
                FROM bare WHERE NOT free),
            numbered AS (
                SELECT source, since, name, shape, taken AS base, 1 AS number FROM spoken
                UNION ALL
                SELECT source, since, name, shape, substring(taken, 1, length(taken) - digits),
                       CAST(substring(taken, length(taken) - digits + 1) AS INT)
                FROM (SELECT *, explode(sequence(1, least(length(regexp_extract(taken, '([0-9]+)$', 1)), 9))) AS digits
                      FROM spoken WHERE taken RLIKE '[0-9]$')
                WHERE substring(taken, length(taken) - digits + 1, 1) <> '0'
                      AND CAST(substring(taken, length(taken) - digits + 1) AS INT) > 1),
            blocked AS (
                SELECT q.source, q.name, q.shape, collect_set(n.number) AS numbers
                FROM queued q JOIN numbered n ON q.source <=> n.source AND q.qualified = n.base
                LEFT ANTI JOIN queued m ON m.source <=> n.source AND m.name <=> n.name AND m.shape <=> n.shape
                     AND m.qualified = n.base
                WHERE n.since IS NULL OR n.since < q.reached
                GROUP BY ALL)
            SELECT source, name, shape, reached, alone, record_name AS was, name AS record_name
            FROM bare WHERE free
            UNION ALL
            SELECT q.source, q.name, q.shape, q.reached, q.alone, q.record_name,
                   q.qualified || IF(pick = 1, '', CAST(pick AS STRING))
            FROM (SELECT q.*, element_at(array_except(sequence(1, q.place + size(coalesce(b.numbers, array()))),
                                                      coalesce(b.numbers, array())), q.place) AS pick
                  FROM queued q LEFT JOIN blocked b
                    ON q.source <=> b.source AND q.name = b.name AND q.shape = b.shape) q
            """, named=named, tables=tables))
        named = settled.drop("was")
        if settled.filter("was <> record_name").isEmpty():
            return named


def normalise(nodes: DataFrame) -> DataFrame:
    """The registry form of a set of tables: nested records named, labels in those names.

    Adds `record_name` (what a record is called in the contract) and `declares` (whether its
    declaration is written from this place).
    """
    nodes = materialize(with_table_order(nodes))
    hoisted = materialize(hoist(nodes))
    names = assign_names(dedupe_records(hoisted), nodes)
    named = nodes.sparkSession.sql("""
        SELECT n.*, coalesce(r.record_name, n.name) AS record_name, coalesce(r.declares, false) AS declares
        FROM {nodes} n LEFT JOIN (
            SELECT h.source, h.endpoint, h.path, d.record_name,
                   d.reached.endpoint <=> h.endpoint AND d.reached.path = h.path AS declares
            FROM {hoisted} h JOIN {names} d ON h.source <=> d.source AND h.name = d.name AND h.shape = d.shape) r
          ON n.source <=> r.source AND n.endpoint <=> r.endpoint AND n.path = r.path""",
        nodes=nodes, hoisted=hoisted, names=names)
    return with_labels(named, ENDPOINT, "record_name")


def unqualify(registry: DataFrame) -> DataFrame:
    """Recorded tables as inference would have named them: names follow from position again."""
    return with_labels(registry.drop("record_name", "declares"), ENDPOINT, "name")


def registry_violations(nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, endpoint, problem) for tables a contract cannot represent.

    With `sources` given, those without any table are reported too.
    """
    primitives = ", ".join(f"'{p}'" for p in PRIMITIVES)
    rule = r"(names must match [A-Za-z_][A-Za-z0-9_.-]*)"
    bad = lambda what, name: f"concat('{what} `', {name}, '` cannot be represented {rule}')"
    found = nodes.sparkSession.sql(f"""
        WITH named AS (SELECT *, substring(try_element_at(path, -1), 2) AS field,
                              coalesce(try_element_at(path, -1) LIKE '.%', false) AS is_field FROM {{nodes}})
        SELECT source, endpoint, 'the top-level type must be a record' AS problem
        FROM named WHERE size(path) = 0 AND members <> array('record')
        UNION ALL
        SELECT source, endpoint, concat('duplicate table name `', endpoint, '`')
        FROM named WHERE size(path) = 0 GROUP BY source, endpoint HAVING count(*) > 1
        UNION ALL
        SELECT source, endpoint, {bad("table name", "endpoint")}
        FROM named WHERE size(path) = 0 AND NOT endpoint RLIKE '\\\\A{NAME}\\\\z'
        UNION ALL
        SELECT source, endpoint, {bad("field name", "field")}
        FROM named WHERE is_field AND NOT field RLIKE '\\\\A{NAME}\\\\z'
        UNION ALL
        SELECT source, endpoint, concat('record name `', name, '` collides with a primitive type name')
        FROM named WHERE size(path) > 0 AND array_contains(members, 'record') AND name IN ({primitives})
        """, nodes=nodes)
    if sources is None:
        return found
    empty = sources.select("source").distinct().join(nodes.select("source").distinct(), "source", "left_anti")
    return found.unionByName(empty.select(
        "source", F.lit(None).cast("string").alias("endpoint"),
        F.lit("at least one table is required").alias("problem")))


def contract_lines(registry: DataFrame) -> DataFrame:
    """The contract, one row per line: source, decl (its place and name), line_ord, text.

    Tables come in their order, then the shared records in reach order.
    """
    nodes = materialize(with_tree_order(registry))
    return nodes.sparkSession.sql("""
        WITH decls AS (
            SELECT source, endpoint, path, struct(size(path) > 0 AS nested, table_ord, endpoint, tree_ord) AS decl,
                   IF(size(path) = 0, 'table ' || endpoint, 'record ' || record_name) AS head
            FROM {nodes} WHERE size(path) = 0 OR declares),
        fields AS (
            SELECT source, endpoint, slice(path, 1, size(path) - 1) AS holder, first_ord,
                   substring(try_element_at(path, -1), 2) AS field, label, optional
            FROM {nodes} WHERE coalesce(try_element_at(path, -1) LIKE '.%', false))
        SELECT source, decl, struct(0 AS part, CAST(0 AS DECIMAL(38,0)) AS ord, '' AS field) AS line_ord, head || ' {{' AS text FROM decls
        UNION ALL
        SELECT d.source, d.decl, struct(1, f.first_ord, f.field), '  ' || f.field || ': ' || f.label || IF(f.optional, '?', '')
        FROM decls d JOIN fields f ON d.source <=> f.source AND d.endpoint <=> f.endpoint AND d.path = f.holder
        UNION ALL
        SELECT source, decl, struct(2, CAST(0 AS DECIMAL(38,0)), ''), '}}' FROM decls""", nodes=nodes)


def render_contract(registry: DataFrame) -> DataFrame:
    """(source, text): the whole contract of each source, which by its nature is one value."""
    lines = contract_lines(registry)
    return lines.sparkSession.sql("""
        SELECT source, array_join(transform(array_sort(collect_list(struct(decl, text))), d -> d.text), '\n') AS text
        FROM (SELECT source, decl, array_join(transform(array_sort(collect_list(struct(line_ord, text))),
                                                        l -> l.text || '\n'), '') AS text
              FROM {lines} GROUP BY source, decl)
        GROUP BY source""", lines=lines)
