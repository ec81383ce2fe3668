"""An endpoint's records as a table under their inferred schema."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _children(nodes: dict[tuple, object], path: tuple) -> list[tuple]:
    below = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path and p[-1].startswith(".")]
    return sorted(below, key=lambda p: (nodes[p].first_ord, p[-1]))


class Traits(NamedTuple):
    """What the kinds of a schema leave open: paths with integers beyond 63 bits, and datetimes that have offsets."""

    wide: frozenset[tuple]
    zoned: frozenset[tuple]


def spark_type(nodes: dict[tuple, object], traits: Traits, path: tuple = ()) -> T.DataType:
    """Spark type of the schema node at `path`; unions and unknowns stay VARIANT."""
    members = nodes[path].members
    if len(members) > 1:
        return T.VariantType()
    simple = {"string": T.StringType(), "int": T.DecimalType(20, 0) if path in traits.wide else T.LongType(), "float": T.DoubleType(),
              "bool": T.BooleanType(), "date": T.DateType(), "null": T.StringType(),
              "datetime": T.TimestampType() if path in traits.zoned else T.TimestampNTZType()}
    if members[0] in simple:
        return simple[members[0]]
    if members[0] == "array":
        return T.ArrayType(spark_type(nodes, traits, (*path, "[]")))
    if members[0] == "record" and _children(nodes, path):
        return T.StructType([T.StructField(p[-1][1:], spark_type(nodes, traits, p), nodes[p].optional)
                             for p in _children(nodes, path)])
    return T.VariantType()


_OFFSET = r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)\z"


def _value(value: Column, kind: T.DataType) -> Column:
    """A variant as `kind`; what cannot be cast is NULL by itself, not with all around it."""
    if isinstance(kind, T.StructType):
        inner = [_value(_get(value, f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _value(x, kind.elementType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.upper(F.try_variant_get(value, "$", "string"))
        if isinstance(kind, T.TimestampNTZType):
            return text.try_cast("timestamp_ntz")
        # Offsets may come as +HHMM, which the cast does not read; without one the time is UTC, whatever the session's zone.
        read = F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
        return F.when(text.rlike(_OFFSET), read).otherwise(F.concat(read, F.lit("Z"))).try_cast("timestamp")
    return F.try_variant_get(value, "$", kind.simpleString())


def _get(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{quoted}"]', "variant")


def _plan(nodes: DataFrame) -> dict[tuple, object]:
    # A table's columns are part of its plan, so the schema of the one endpoint comes to the driver.
    rows = nodes.select("source", "endpoint", "path", "members", "optional", "first_ord").collect()
    if len({(r.source, r.endpoint) for r in rows}) != 1:
        raise ValueError("the schema nodes of exactly one endpoint are needed")
    found = {tuple(r.path): r for r in rows}
    if found[()].members != ["record"]:
        raise ValueError("the endpoint's records have no single record type")
    return found


def _tally(value: Column, steps: tuple, test: Callable[[Column], Column]) -> Column:
    """How many values at the end of `steps` pass the test; array elements are counted each."""
    if not steps:
        return F.coalesce(test(value).cast("long"), F.lit(0).cast("long"))
    if steps[0] != "[]":
        return _tally(_get(value, steps[0][1:]), steps[1:], test)
    elements = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.aggregate(elements, F.lit(0).cast("long"), lambda n, x: n + _tally(x, steps[1:], test))


def _tallies(records: DataFrame, tests: dict[tuple, Callable[[Column], Column]]) -> dict[tuple, int]:
    """The tests' counts over all records, by (path, ...) key; one aggregate for all."""
    columns = [F.sum(_tally(F.col("record"), key[0], test)).alias(f"n{i}") for i, (key, test) in enumerate(tests.items())]
    row = records.agg(*columns).first() if columns else []
    return {key: n or 0 for key, n in zip(tests, row)}


def traits_of(records: DataFrame, nodes: DataFrame) -> Traits:
    """Look once at the integers and datetimes of one endpoint's records."""
    return _traits(records, _plan(nodes))


def _traits(records: DataFrame, found: dict[tuple, object]) -> Traits:
    only = {p: r.members[0] for p, r in found.items() if len(r.members) == 1}
    big = lambda v: F.try_variant_get(v, "$", "decimal(38,0)") > F.lit(2**63 - 1)
    offset = lambda v: F.upper(F.try_variant_get(v, "$", "string")).rlike(_OFFSET)
    tests = {(p, kind): big if kind == "int" else offset for p, kind in only.items() if kind in ("int", "datetime")}
    counts = _tallies(records, tests)
    return Traits(*[frozenset(p for (p, kind), n in counts.items() if kind == which and n) for which in ("int", "datetime")])


def load_table(records: DataFrame, nodes: DataFrame, traits: Traits | None = None) -> DataFrame:
    """The records of one endpoint as columns; a value its type cannot hold becomes NULL.

    `nodes` holds the schema of that endpoint only. Integers are BIGINT, or DECIMAL(20,0) where some do not fit; datetimes
    TIMESTAMP_NTZ, or TIMESTAMP where some have an offset. Unless `traits` are given, a first job looks for these.
    """
    found = _plan(nodes)
    traits = _traits(records, found) if traits is None else traits
    return records.select(*[
        _value(_get(F.col("record"), p[-1][1:]), spark_type(found, traits, p)).alias(p[-1][1:]) for p in _children(found, ())])


def load_report(records: DataFrame, nodes: DataFrame, traits: Traits | None = None) -> DataFrame:
    """Per leaf (`column` is its path): how many values were present and not null, and how many the load lost.

    Leaves are the scalar fields and elements at every depth; what is loaded as VARIANT is one leaf and loses nothing.
    """
    found = _plan(nodes)
    traits = _traits(records, found) if traits is None else traits
    present = lambda v: v.isNotNull() & ~F.is_variant_null(v)
    kinds = {p: spark_type(found, traits, p) for p in found if p}
    whole = [p for p, kind in kinds.items() if isinstance(kind, T.VariantType)]
    leaves = [p for p, kind in kinds.items() if not isinstance(kind, (T.StructType, T.ArrayType)) and not any(p[: len(w)] == w and p != w for w in whole)]
    columns = []
    for p in leaves:
        lost = lambda v, kind=kinds[p]: present(v) & _value(v, kind).isNull()
        columns += [F.coalesce(F.sum(_tally(F.col("record"), p, test)), F.lit(0).cast("long")) for test in (present, lost)]
    if not leaves:
        return records.sparkSession.createDataFrame([], "column string, present long, lost long")
    wide = records.agg(*[c.alias(f"n{i}") for i, c in enumerate(columns)])
    texts = path_texts(leaves)
    rows = F.array(*[F.struct(F.lit(texts[i]).alias("column"), F.col(f"n{2 * i}").alias("present"), F.col(f"n{2 * i + 1}").alias("lost"))
                     for i in range(len(leaves))])
    return wide.select(F.inline(rows))


def path_texts(leaves: list[tuple]) -> list[str]:
    return ["".join(step if step == "[]" else ("." if i else "") + step[1:] for i, step in enumerate(p)) for p in leaves]


def load_source(records: DataFrame, nodes: DataFrame, source: str, prefix: str = "") -> dict[str, DataFrame]:
    """All tables of a source under their prefixed endpoint names; endpoints without a record type are left out.

    A table's columns are part of its plan, so this goes through the source's endpoints, which are configuration.
    """
    of = nodes.filter(F.col("source") == source)
    roots = of.filter((F.size("path") == 0) & (F.col("members") == F.array(F.lit("record")))).select("endpoint").distinct()
    names = sorted(r.endpoint for r in roots.toLocalIterator())
    mine = records.filter(F.col("source") == source)
    return {prefix + n: load_table(mine.filter(F.col("endpoint") == n), of.filter(F.col("endpoint") == n)) for n in names}
