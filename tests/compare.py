"""Run registered queries next to their oracles: python -m tests.compare <sf_dir> [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else how they differ."""
    df = queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.sql(oracle_sql()[name])
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got == want:
        return None
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows != {len(want)}; extra {extra}; missing {missing}"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        started = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name)
        except Exception as error:  # keep going: one report per query
            outcome = f"{type(error).__name__}: {str(error)[:300]}"
        print(f"{name:28} {time.time() - started:6.1f}s {'ok' if outcome is None else 'DIFFERS ' + outcome[:600]}", flush=True)


if __name__ == "__main__":
    main()
