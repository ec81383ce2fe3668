"""JSON validity and value kinds over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_iso_date, is_iso_datetime


# Three closing brackets in a row, the only way a body can end the wrapping of `with_json` early.
_CLOSES_WRAPPING = r"\][ \t\r\n]*\][ \t\r\n]*\]"

# Types that a variant converts to exactly if it is an object or an array, whatever these hold. Their content is not
# walked: a conversion to `variant` rebuilds a value down to its last level.
_OBJECT, _ARRAY = "struct<_:boolean>", "array<boolean>"


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("[[["), text, F.lit(",0]]]")))


def _one_value(wrapped: Column, text: Column) -> Column:
    absent = lambda path: F.try_variant_get(wrapped, path, "variant").isNull()
    closes = F.contains(text, F.lit("]")) & text.rlike(_CLOSES_WRAPPING)
    again = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(
        ~absent("$[0][0][1]") & absent("$[0][0][2]") & absent("$[0][1]") & absent("$[1]") & (~closes | again),
        F.lit(False))


def with_json(df: DataFrame, body: str, out: str, valid: str) -> DataFrame:
    """Add `valid`, whether `body` is exactly one JSON value, and `out`, that value or NULL.

    `try_parse_json` ignores text after the first value, so the body is parsed inside brackets and
    before a closing 0: further values or brackets then move elements to other places, and only a
    body with three closing brackets in a row can end the wrapping early and needs a second,
    differently wrapped parse. Each step has its own projection so that the optimizer evaluates it
    once per row.
    """
    listed = df.withColumn(out, _wrapped(F.col(body)))
    checked = listed.withColumn(valid, _one_value(F.col(out), F.col(body)))
    return checked.withColumn(out, F.when(F.col(valid), F.try_variant_get(out, "$[0][0][0]", "variant")))


def is_strict_json(text: Column) -> Column:
    """Whether `text` is exactly one JSON value, as one boolean expression."""
    checks = F.transform(F.array(_wrapped(text)), lambda wrapped: _one_value(wrapped, text))
    return F.element_at(checks, 1)


def is_array(value: Column) -> Column:
    """Whether a variant is an array, without walking the elements of a filled one."""
    return F.coalesce(
        F.try_variant_get(value, "$[0]", "variant").isNotNull()
        | (F.size(F.try_variant_get(value, "$", _ARRAY)) == 0),
        F.lit(False),
    )


def _kind(shape: Column, text: Column, wide: Column) -> Column:
    above_long = (wide > F.lit(2**63 - 1)) & (wide < F.lit(str(2**64)).cast("decimal(38,0)"))
    return (
        F.when(shape == "STRING",
               F.when(F.substring(text, 5, 1) != "-", "string")
               .when(is_iso_date(text), "date")
               .when(is_iso_datetime(text), "datetime")
               .otherwise("string"))
        .when(shape == "BIGINT", "int")
        .when(shape.startswith("OBJECT"), "record")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "VOID", "null")
        .when(shape.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & above_long, "int")
        .when(shape.isNotNull(), "float")
    )


def _shape(value: Column) -> Column:
    """`schema_of_variant`, except that a container's content is not walked: its schema is OBJECT or ARRAY."""
    return (
        F.when(F.try_variant_get(value, "$", _OBJECT).isNotNull(), "OBJECT")
        .when(F.try_variant_get(value, "$", _ARRAY).isNotNull(), "ARRAY")
        .otherwise(F.schema_of_variant(value))
    )


def value_kind(value: Column) -> Column:
    """One of null, bool, int, float, string, date, datetime, array, record.

    A JSON integer outside 64 signed bits arrives as DECIMAL(19|20,0); up to 2^64-1 it is still
    an integer, beyond that a float. Everything written with a point or exponent is a float.
    """
    return _kind(
        _shape(value),
        F.try_variant_get(value, "$", "string"),
        F.try_variant_get(value, "$", "decimal(38,0)"),
    )


def with_kind(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add `out`, the `value_kind` of `value`, reading shape and text once per row."""
    return (
        df.withColumn("_shape", _shape(F.col(value)))
        .withColumn("_text", F.when(F.col("_shape") == "STRING", F.try_variant_get(value, "$", "string")))
        .withColumn(out, _kind(F.col("_shape"), F.col("_text"),
                               F.try_variant_get(value, "$", "decimal(38,0)")))
        .drop("_shape", "_text")
    )
