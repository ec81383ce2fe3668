"""Ordered row rules with one report per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import identifier_violation, path_violation


def first_violation(df: DataFrame, group: Sequence[str], order: str, rules: Sequence[Column],
                    unique: str | None = None, duplicate: str = "duplicate", subject: str | None = None) -> DataFrame:
    """The first row of each group that breaks a rule: group, order, subject and `problem`.

    Each rule gives a message or NULL; a row's first message counts. A repeated `unique` value is
    one more rule, checked last, broken by every row but the value's first. Only the two earliest
    rows of a value matter, so repeated values shrink before the shuffle.
    """
    named = subject or unique or order
    columns = dict.fromkeys([*group, order, named])
    broken = df.select(*columns, F.coalesce(*rules).alias("problem")).filter(F.col("problem").isNotNull())
    if unique is not None:
        place = F.row_number().over(Window.partitionBy(*group, unique).orderBy(order))
        seconds = df.select(*dict.fromkeys([*columns, unique])).withColumn("_place", place).filter("_place <= 2")
        repeats = seconds.filter("_place = 2").select(*columns, F.lit(duplicate).alias("problem"))
        broken = broken.withColumn("_rank", F.lit(0)).unionByName(repeats.withColumn("_rank", F.lit(1)))
    else:
        broken = broken.withColumn("_rank", F.lit(0))
    first = broken.groupBy(*group).agg(
        F.min(F.struct(F.col(order).alias("_o"), "_rank", F.col(named).alias("_s"), "problem")).alias("_first"))
    out = [*group, F.col("_first._o").alias(order)]
    if named not in (*group, order):
        out.append(F.col("_first._s").alias(named))
    return first.select(*out, F.col("_first.problem").alias("problem"))


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """The first bad endpoint of each source: its name, its path, or a name used before."""
    name, path = F.col("endpoint"), F.col("path")
    return first_violation(
        catalog, ["source"], "ordinal",
        [F.concat(F.lit("endpoint name "), identifier_violation(name)),
         F.concat(F.lit("path `"), path, F.lit("` "), path_violation(path))],
        unique="endpoint", duplicate="duplicate endpoint name")
