"""Sum types over rows and values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import value_kind

# Kinds that make up each primitive type.
CONFORMING = {
    "number": ["int", "float"],
    "string": ["string", "date", "datetime"],
    "bool": ["bool"],
    "datetime": ["datetime", "date"],
}


def variant_tag(variants: Mapping[str, Sequence[str]]) -> Column:
    """Name of the variant whose fields are exactly those a row carries; NULL if there is none."""
    every = sorted({f for fields in variants.values() for f in fields})
    tag = None
    for name, fields in variants.items():
        held = F.lit(True)
        for f in every:
            held = held & (F.col(f).isNotNull() if f in fields else F.col(f).isNull())
        tag = F.when(held, name) if tag is None else tag.when(held, name)
    return tag


def tag_variant(df: DataFrame, variants: Mapping[str, Sequence[str]], out: str = "tag") -> DataFrame:
    """Replace the variants' fields by `out` and one struct per variant, NULL but for the row's own."""
    every = {f for fields in variants.values() for f in fields}
    tagged = df.withColumn(out, variant_tag(variants))
    return tagged.select(
        *[c for c in df.columns if c not in every], out,
        *[F.when(F.col(out) == name, F.struct(*fields)).alias(name) for name, fields in variants.items()])


def parse_enum(text: Column, mapping: Mapping[str, str]) -> Column:
    """Variant named by a string; NULL when no variant is backed by it."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), text)


def enum_report(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """How often each string that backs no variant occurs."""
    unknown = F.col(column).isNull() | ~F.col(column).isin(*mapping)
    return df.filter(unknown).groupBy(column).agg(F.count("*").alias("n"))


def conforms(value: Column, types: Sequence[str]) -> Column:
    """Whether a variant is of one of the listed primitive types."""
    kinds = [k for t in types for k in CONFORMING[t]]
    return F.coalesce(value_kind(value).isin(*kinds), F.lit(False))
