"""Line dedup: overlapping three-line windows, of which only the first occurrence in the whole table stays.

Each text is split at line feeds; every three consecutive lines not all blank are
hashed (128 bits). A window that occurs again later, by (id, line), covers its three lines there; covered positions
are merged and those lines go. Counting is a sum with map-side combine, so a window that is in a third of all
documents is no hot key; only windows that repeat are joined back, by a join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apitables.llm.texts import free, slices
from apitables.session import materialize

LINES = 3
#: A line of these alone is blank; three blank lines are no window.
BLANK = " \t\r\f\v"


def windows(df: DataFrame, key: str, text: str, lines: int = LINES) -> DataFrame:
    """(id, row, h1, h2, line, again): each window, the hash of its text, whether it stands further up in that text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            digests, line, again, counts = [], [], [], []
            for value in part.column("text").to_pylist():
                parts = (value or "").split("\n")
                before, n = set(), 0
                own = [(xxhash.xxh3_128_digest(x), bool(x.strip(BLANK))) for x in parts] if len(parts) >= lines else []
                for i in range(len(own) - lines + 1):
                    window = own[i : i + lines]
                    if any(filled for _, filled in window):
                        digest = xxhash.xxh3_128_digest(b"".join(x for x, _ in window))
                        digests.append(digest)
                        line.append(i)
                        again.append(digest in before)
                        before.add(digest)
                        n += 1
                counts.append(n)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(part.num_rows), counts))
            yield pa.record_batch({"id": part.column("id").take(of), "row": part.column("row").take(of), "h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]), "line": pa.array(line, pa.int32()), "again": pa.array(again, pa.bool_())})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    return rows.mapInArrow(cut, f"id {kind}, row bigint, h1 bigint, h2 bigint, line int, again boolean")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """All rows and columns of `df` with repeated windows taken out of `text`, and n_lines, n_removed (longs).

    A text of fewer lines than a window stays as it is. If all lines of a text go, it is empty; a null text stays null
    with no lines. Rows that share an id count as one place, so none of them makes the other a later occurrence; rows
    with a null id come before all others. `n_lines` and `n_removed` replace columns of that name.
    """
    found = materialize(windows(df, key, text, lines))
    totals = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("home"), F.max(F.col("id").isNull()).alias("homeless"))
    repeated = totals.where("n > 1").select("h1", "h2", "home", "homeless")
    later = F.col("again") | (F.col("id").isNotNull() & (F.col("homeless") | (F.col("id") > F.col("home"))))
    rest = df.drop("n_lines", "n_removed")
    of, row, at = free(rest, "covered_id"), free(rest, "covered_row"), free(rest, "covered_lines")
    covered = found.join(repeated, ["h1", "h2"]).where(later).groupBy(F.col("id").alias(of), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("line")).alias(at))
    joined = rest.join(covered, F.col(key).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(row)), "left").drop(of, row)
    schema = rest.schema.add("n_lines", "long").add("n_removed", "long")
    column = schema.fieldNames().index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts, n_lines, n_removed = [], [], []
            for value, starts in zip(part.column(text).to_pylist(), part.column(at).to_pylist()):
                parts = [] if value is None else value.split("\n")
                gone = {i + j for i in starts or () for j in range(lines)}
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else value)
                n_lines.append(len(parts))
                n_removed.append(len(gone))
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns[column] = pa.array(texts, pa.string())
            names = [*part.schema.names[:-1], "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    return joined.mapInArrow(keep, schema)
