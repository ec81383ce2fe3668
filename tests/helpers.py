"""Small builders shared by the tests."""

import json

from pyspark.sql import functions as F

from apitables.functions.text import path_text
from apitables.operators.infer import infer_schema

RESPONSES = ("source string, endpoint string, response_ord long, status int, content_type string, "
             "body string, elapsed_ms long")


def responses(spark, *rows):
    """Rows of (endpoint, body) or dicts overriding the defaults of a good response."""
    full = []
    for row in rows:
        if not isinstance(row, dict):
            row = {"endpoint": row[0], "body": row[1]}
        r = {"source": "shop", "response_ord": 0, "status": 200, "content_type": "application/json",
             "elapsed_ms": 5, **row}
        body = r["body"] if isinstance(r["body"], str) else json.dumps(r["body"])
        full.append((r["source"], r["endpoint"], r["response_ord"], r["status"], r["content_type"],
                     body, r["elapsed_ms"]))
    return spark.createDataFrame(full, RESPONSES)


def schema_of(spark, records, endpoint="t"):
    """The inferred schema as {path text: label with ? when optional}."""
    return as_labels(infer_schema(responses(spark, (endpoint, records))))


def as_labels(nodes):
    rows = nodes.select(path_text(F.col("path")).alias("p"), "label", "optional").collect()
    return {r.p: r.label + ("?" if r.optional else "") for r in rows}
