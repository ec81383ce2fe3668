"""Field-level drift between a recorded and a fresh schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_text
from ..session import materialize
from .keyed import ENDPOINT, join_keyed

# A multiset of SHA-256 tokens is hashed by adding the tokens' parts: sums do not depend on order
# and combine before the shuffle, so no node's descendants ever meet in one place.
_PARTS = [1, 15, 29, 43]


def token_sums(token: str) -> str:
    return ", ".join(
        f"sum(CAST(conv(substring({token}, {at}, 14), 16, 10) AS DECIMAL(18,0))) AS t{i}"
        for i, at in enumerate(_PARTS))


def sums_digest() -> str:
    return "sha2(concat_ws(':', " + ", ".join(f"t{i}" for i in range(len(_PARTS))) + "), 256)"


def with_fingerprint(nodes: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    """Add `fingerprint`: equal exactly for structurally equal types.

    Record names, field order and the order of union members do not count; the optionality of
    fields inside the type does. A type is the set of (relative path, members, optional) below it,
    so every node adds its token to each of its ancestors.
    """
    columns = [c for c in nodes.columns if c not in (*keys, "fingerprint")]
    own = ", ".join(f"`{c}`" for c in columns)
    group = "".join(f"`{k}`, " for k in keys)
    return nodes.sparkSession.sql(f"""
        SELECT {group} own.*, {sums_digest()} AS fingerprint
        FROM (SELECT {group} any_value(own, true) AS own, {token_sums("token")}
              FROM (SELECT {group} slice(path, 1, len) AS at, IF(len = size(path), struct({own}), NULL) AS own,
                           sha2(to_json(struct(slice(path, len + 1, size(path)) AS p, array_sort(members) AS m,
                                               optional AND len < size(path) AS o)), 256) AS token
                    FROM (SELECT *, explode(sequence(0, size(path))) AS len FROM {{nodes}}))
              GROUP BY {group} at)""", nodes=nodes)


def _container(members: Column) -> Column:
    return F.when(F.size(members) == 1, members[0]).isin("record", "array")


def diff_schemas(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    """The changes that turn `stored` into `fresh`, per group present on both sides.

    Columns: keys, op (`+`, `-`, `~`), path_text, from_label, to_label, line, change_ord. Only the
    topmost difference is reported: nested ones count while every type above is a record on both
    sides or an array on both sides. Sorting by `change_ord` walks the stored fields in their
    order, followed at each record by its added fields.
    """
    sides = []
    for df, tag in ((stored, "s"), (fresh, "f")):
        full = with_fingerprint(df, keys)
        sides.append(full.select(*keys, "path", F.struct(
            "members", "optional", "label", "first_ord", "step_rank", "fingerprint").alias(tag)))
    both = join_keyed(sides[0], sides[1], [*keys, "path"], "full")
    paired = F.col("s").isNotNull() & F.col("f").isNotNull()
    field = F.when(F.size("path") > 0, F.try_element_at("path", F.lit(-1)).startswith(".")).otherwise(False)
    through = F.coalesce(paired & (F.col("s.members") == F.col("f.members")) & _container(F.col("s.members")), F.lit(False))
    same = F.col("s.fingerprint") == F.col("f.fingerprint")
    same_need = F.col("s.optional") == F.col("f.optional")
    op = (
        F.when(paired, F.when(F.when(through, ~same_need).otherwise(~same | ~same_need), "~"))
        .when(field & F.col("f").isNull(), "-")
        .when(field & F.col("s").isNull(), "+")
    )
    # Read twice below, for the changes and for what leads to them.
    marked = materialize(both.withColumn("through", through).withColumn("op", op))
    label = lambda side: F.concat(F.col(f"{side}.label"), F.when(F.col(f"{side}.optional"), "?").otherwise(""))
    own = F.coalesce(F.col("s"), F.col("f"))
    step = lambda at, side, row, path: F.struct(
        at.alias("at"), side.alias("side"), row["step_rank"].alias("rank"), row["first_ord"].alias("ord"),
        F.try_element_at(path, F.lit(-1)).alias("step"))
    found = marked.filter(F.col("op").isNotNull()).select(
        *keys, "path", "op",
        F.when(F.col("op") != "+", label("s")).alias("from_label"),
        F.when(F.col("op") != "-", label("f")).alias("to_label"),
        F.array(step(F.size("path"), F.when(F.col("op") == "+", 1).otherwise(0), own, F.col("path"))).alias("last"))
    # Every proper prefix of a change must lead through; on the way, note where it stands.
    prefixes = found.withColumn("_len", F.explode(F.when(F.size("path") > 0, F.sequence(F.lit(0), F.size("path") - 1))
                                                  .otherwise(F.array(F.lit(-1)))))
    prefixes = prefixes.withColumn("at", F.when(F.col("_len") >= 0, F.slice("path", F.lit(1), F.greatest(F.col("_len"), F.lit(0)))))
    above = marked.filter("through").select(
        *keys, F.col("path").alias("at"), step(F.size("path"), F.lit(0), F.col("s"), F.col("path")).alias("step"))
    walked = join_keyed(prefixes, above, [*keys, "at"], "left")
    kept = (
        walked.groupBy(*keys, "path", "op", "from_label", "to_label", "last")
        .agg(F.array_sort(F.collect_list("step")).alias("_steps"))
        .filter(F.size("_steps") == F.size("path"))
    )
    text = F.when(F.size("path") == 0, "response").otherwise(path_text(F.col("path")))
    return kept.select(
        *keys, "op", text.alias("path_text"), "from_label", "to_label",
        render_change(F.col("op"), text, F.col("from_label"), F.col("to_label")).alias("line"),
        F.concat("_steps", "last").alias("change_ord"))


def render_change(op: Column, path: Column, from_label: Column, to_label: Column) -> Column:
    """`+ path: T`, `- path: T` or `~ path: T -> T`."""
    return F.concat(op, F.lit(" "), path, F.lit(": "), F.concat_ws(" -> ", from_label, to_label))


def ordered_changes(changes: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    return changes.orderBy(*keys, "change_ord")
