"""URL and endpoint-name rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_scheme

# Ports implied by a scheme.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def identifier_violation(name: Column) -> Column:
    """Why `name` is not a valid endpoint name; NULL if it is."""
    return (
        F.when(name == "", "must not be empty")
        .when(~name.rlike(r"\A[a-z0-9_]+\z"), "may only contain lowercase letters, digits, and underscores")
    )


def path_violation(path: Column) -> Column:
    """Why `path` could leave the base URL it is joined to; NULL if it cannot."""
    part = F.regexp_extract(path, r"(?s)\A([^?#]*)", 1)
    return (
        F.when(F.contains(path, F.lit("\\")), "must not contain backslashes")
        .when(part.startswith("//"), "must not start with `//`, which replaces the host")
        .when(has_scheme(path), "must be a path relative to the base URL, not an absolute URL")
        .when(F.array_contains(F.split(part, "/"), ".."), "must not contain `..` segments")
    )


def join_url(base: Column, path: Column) -> Column:
    """`base` and `path` with exactly one slash between them; an empty path is the base itself."""
    relative = F.regexp_replace(path, r"\A/+", "")
    stem = F.regexp_replace(base, r"(?s)[?#].*\z", "")
    slash = F.when(stem.endswith("/"), stem).otherwise(F.concat(stem, F.lit("/")))
    return F.when(relative == "", base).otherwise(F.concat(slash, relative))


# Schemes whose URLs have a host and read a backslash as a slash; spellings of dot segments.
SPECIAL = ("http", "https", "ws", "wss", "ftp")
SINGLE_DOT = (".", "%2e")
DOUBLE_DOT = ("..", ".%2e", "%2e.", "%2e%2e")
# What every dot segment begins with, after its slash; a path without it has none.
_MAYBE_DOTS = r"/(?:\.|%2[eE])"
# Host, in brackets or not, and port.
_HOST_PORT = r"(?s)\A(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?\z"
# Characters a host may not hold once percent-decoded.
_FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(path: Column) -> Column:
    """A path with its dot segments resolved, as a URL parser does: `.` goes, `..` takes the segment before it with it;
    either at the end leaves the path ending in a slash."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    marked = F.transform(segments, lambda seg, i: F.struct(seg.alias("s"), (i == F.size(segments) - 1).alias("last")))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        word = F.lower(x["s"])
        shorter = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(word.isin(*DOUBLE_DOT), F.when(x["last"], F.concat(shorter, F.array(F.lit("")))).otherwise(shorter))
            .when(word.isin(*SINGLE_DOT), F.when(x["last"], F.concat(acc, F.array(F.lit("")))).otherwise(acc))
            .otherwise(F.concat(acc, F.array(x["s"])))
        )

    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(marked, empty, step), "/"))
    return F.when(path.rlike(_MAYBE_DOTS), folded).otherwise(path)


def normalise(url: Column) -> Column:
    """struct(scheme, host, port, path) of a URL read as a browser reads it; NULL where it has no valid host.

    Leading and trailing controls and spaces go, and tabs and line breaks anywhere. In special schemes a backslash
    before the query is a slash and any number of slashes may follow the colon. The host is what follows the last `@`
    of the authority, percent-decoded and lower-cased; a port is read as a number, and a scheme's own port counts as
    none. Dot segments of the path are resolved, also percent-encoded ones.
    """
    u = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")

    def split(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
        head = F.regexp_extract(u, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*:([^?#]*)", 1)
        return _let(F.struct(scheme.alias("scheme"), scheme.isin(*SPECIAL).alias("special"), head.alias("head")), slashed)

    def slashed(x: Column) -> Column:
        head = F.when(x["special"], F.translate(x["head"], "\\", "/")).otherwise(x["head"])
        after = F.when(x["special"], F.regexp_replace(head, r"\A/*", "")).otherwise(F.regexp_extract(head, r"(?s)\A//(.*)", 1))
        has_authority = x["special"] | head.startswith("//")
        return _let(F.struct(x["scheme"].alias("scheme"), has_authority.alias("has_authority"), after.alias("after")), located)

    def located(x: Column) -> Column:
        authority = F.regexp_extract(x["after"], r"(?s)\A([^/]*)", 1)
        path = F.regexp_extract(x["after"], r"(?s)\A[^/]*(.*)", 1)
        hostport = F.regexp_extract(authority, r"(?s)\A(?:.*@)?(.*)\z", 1)
        return _let(F.struct(x["scheme"].alias("scheme"), x["has_authority"].alias("has_authority"),
                             hostport.alias("hostport"), path.alias("path")), hosted)

    def hosted(x: Column) -> Column:
        host = F.lower(F.try_url_decode(F.replace(F.regexp_extract(x["hostport"], _HOST_PORT, 1), F.lit("+"), F.lit("%2B"))))
        implied = F.lit(None).cast("int")
        for name, number in DEFAULT_PORTS.items():
            implied = F.when(x["scheme"] == name, F.lit(int(number))).otherwise(implied)
        port = _let(F.regexp_extract(x["hostport"], _HOST_PORT, 2), lambda text: F.when(text == "", implied).otherwise(
            text.cast("decimal(38,0)")).cast("decimal(38,0)"))
        port = _let(port, lambda number: F.when(number == implied, F.lit(None)).otherwise(number))
        fits = x["has_authority"] & x["hostport"].rlike(_HOST_PORT)
        return _let(F.struct(x["scheme"].alias("scheme"), fits.alias("fits"), host.alias("host"), port.alias("port"), x["path"].alias("path")), judged)

    def judged(x: Column) -> Column:
        host, port, path = x["host"], x["port"], x["path"]
        valid = (
            x["fits"] & host.isNotNull() & (host != "")
            & (host.startswith("[") | ~host.rlike(_FORBIDDEN_HOST)) & F.coalesce(port <= 65535, F.lit(True))
        )
        return F.when(valid, F.struct(
            x["scheme"].alias("scheme"), host.alias("host"), port.alias("port"),
            _let(F.when(path == "", F.lit("/")).otherwise(path), _fold).alias("path"),
        ))

    return _let(u, split)


def in_scope(url: Column, base: Column) -> Column:
    """Whether `url`, once normalised, keeps the scheme, host and port of `base` and stays below its path.

    A URL equal to the base is in scope; one that does not parse is not.
    """
    def keeps(u: Column, b: Column) -> Column:
        same = (u["scheme"] == b["scheme"]) & (u["host"] == b["host"]) & u["port"].eqNullSafe(b["port"])
        return same & u["path"].startswith(F.when(b["path"].endswith("/"), b["path"]).otherwise(F.concat(b["path"], F.lit("/"))))

    below = _let(F.struct(normalise(url).alias("u"), normalise(base).alias("b")), lambda x: keeps(x["u"], x["b"]))
    return F.coalesce((url == base) | below, F.lit(False))
