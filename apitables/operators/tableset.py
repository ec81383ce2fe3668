"""Named tables and the pure steps that reshape them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSet:
    """An immutable set of named tables with declared relations.

    Every step returns a new set and leaves this one as it was; `pipe` chains steps.
    """

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    relations: tuple[tuple[str, str, str, str], ...] = ()

    @staticmethod
    def empty() -> TableSet:
        return TableSet()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def _set(self, drop: Sequence[str] = (), **new: DataFrame) -> TableSet:
        kept = {n: t for n, t in self.tables.items() if n not in drop}
        taken = [n for n in new if n in kept]
        if taken:
            raise ValueError(f"table `{taken[0]}` already exists")
        relations = tuple(r for r in self.relations if r[0] not in drop and r[2] not in drop)
        return TableSet({**kept, **new}, relations)

    def with_(self, tables: Mapping[str, DataFrame] | TableSet) -> TableSet:
        """Add tables; a name already in the set is refused."""
        more = tables.tables if isinstance(tables, TableSet) else tables
        return self._set(**dict(more))

    def pipe(self, *steps: Callable[[TableSet], TableSet]) -> TableSet:
        out = self
        for step in steps:
            out = step(out)
        return out

    def join(self, left: str, right: str, out: str, left_prefix: str = "", right_prefix: str = "") -> TableSet:
        """Equi-join `table.column` with `table.column` into `out`, in place of both tables."""
        (lt, lc), (rt, rc) = _column(left), _column(right)
        a, b = _prefixed(self[lt], left_prefix), _prefixed(self[rt], right_prefix)
        shared = set(a.columns) & set(b.columns)
        if shared:
            raise ValueError(f"both tables have a column `{min(shared)}`; give a prefix")
        joined = a.join(b, a[left_prefix + lc] == b[right_prefix + rc], "inner")
        return self._set(drop=(lt, rt), **{out: joined})

    def relate(self, child: str, parent: str) -> TableSet:
        """Declare that the values of one column appear in another; tables stay as they are."""
        (ct, cc), (pt, pc) = _column(child), _column(parent)
        for table, column in ((ct, cc), (pt, pc)):
            if column not in self[table].columns:
                raise ValueError(f"table `{table}` has no column `{column}`")
        return replace(self, relations=(*self.relations, (ct, cc, pt, pc)))

    def orphan_rows(self, child: str, parent: str) -> DataFrame:
        """Rows of a declared relation's child table whose value no parent row has."""
        (ct, cc), (pt, pc) = _column(child), _column(parent)
        if (ct, cc, pt, pc) not in self.relations:
            raise ValueError(f"`{child}` is not related to `{parent}`")
        known = self[pt].select(F.col(pc).alias("_known"))
        rows = self[ct].filter(F.col(cc).isNotNull())
        return rows.join(known, rows[cc] == known["_known"], "left_anti")

    def extend(self, table: str, name: str, value: Column) -> TableSet:
        """Add a column computed from the row."""
        return replace(self, tables={**self.tables, table: self[table].withColumn(name, value)})

    def split(self, table: str, by: Mapping[str, Column]) -> TableSet:
        """Replace a table by one table per predicate, each row going to the first that holds.

        A row for which none holds would be lost, so it goes to `<table>_rest`.
        """
        rows = self[table]
        parts, earlier = {}, F.lit(False)
        for name, holds in by.items():
            holds = F.coalesce(holds, F.lit(False))
            parts[name] = rows.filter(holds & ~earlier)
            earlier = earlier | holds
        parts[f"{table}_rest"] = rows.filter(~earlier)
        return self._set(drop=(table,), **parts)

    def merge(self, tables: Sequence[str], out: str) -> TableSet:
        """Stack tables into one; columns some of them lack are NULL there."""
        merged = self[tables[0]]
        for name in tables[1:]:
            merged = merged.unionByName(self[name], allowMissingColumns=True)
        return self._set(drop=tuple(tables), **{out: merged})


def load(source: Mapping[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """All tables of a source, their names prefixed."""
    return {prefix + name: table for name, table in source.items()}


def _column(reference: str) -> tuple[str, str]:
    table, column = reference.split(".", 1)
    return table, column


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])
