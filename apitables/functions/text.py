"""Scalar predicates and text helpers, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes of dates, times, offsets and names.
DATE = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
TIME = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"
OFFSET = r"[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?"
NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"

# Names a record may not take, in the order of the type list.
PRIMITIVES = ["string", "int", "float", "bool", "null", "date", "datetime", "unknown"]

# Fixed value: characters of an error body kept in messages.
SNIPPET_CHARS = 256

# White space as Unicode defines it, which is what makes a body "blank".
_BLANK = "(?U)\\A\\s*\\z"


def is_iso_date(text: Column) -> Column:
    """`YYYY-MM-DD` with month 1-12 and day 1-31; a shape test, not a calendar."""
    return text.rlike(rf"\A{DATE}\z")


def is_iso_datetime(text: Column) -> Column:
    """A date, `T`, `HH:MM:SS`, optional fraction, optional `Z` or offset."""
    return text.rlike(rf"\A{DATE}[Tt]{TIME}([Zz]|{OFFSET})?\z")


def is_tz_offset(text: Column) -> Column:
    """`±HH`, `±HHMM` or `±HH:MM`."""
    return text.rlike(rf"\A{OFFSET}\z")


def is_name(text: Column) -> Column:
    """Whether `text` can stand as a table, record or field name in a contract."""
    return text.rlike(rf"\A{NAME}\z")


def has_scheme(text: Column) -> Column:
    """Whether `text` starts like an absolute URL (`https:`, `file:`)."""
    return text.rlike(rf"\A{SCHEME}")


def error_snippet(body: Column) -> Column:
    """The start of an error body, short enough for a message."""
    return (
        F.when(body.rlike(_BLANK), F.lit("(empty body)"))
        .when(F.char_length(body) > SNIPPET_CHARS,
              F.concat(F.substring(body, 1, SNIPPET_CHARS), F.lit("…")))
        .otherwise(body)
    )


def path_text(path: Column) -> Column:
    """Display form of a path: `address.city`, `items[].sku`; the root is empty."""
    return F.regexp_replace(F.array_join(path, ""), r"\A\.", "")
