"""Joins on grouping keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINT = ("source", "endpoint")


def join_keyed(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on `on`, treating NULL keys as equal; the right side's copies of `on` are dropped.

    For a full outer join the key columns hold whichever side is present.
    """
    if not on:
        raise ValueError("a join needs at least one key")
    renamed = right.select(
        *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(on)],
        *[F.col(f"`{c}`") for c in right.columns if c not in on],
    )
    match: Column = reduce(
        lambda a, b: a & b,
        [left[f"`{c}`"].eqNullSafe(renamed[f"_r{i}"]) for i, c in enumerate(on)],
    )
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        for i, c in enumerate(on):
            joined = joined.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.col(f"_r{i}")))
    return joined.drop(*[f"_r{i}" for i in range(len(on))])
