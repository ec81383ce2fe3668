"""Responses of REST endpoints, requested where the catalog's rows lie.

The catalog is dealt over tasks of a bounded number of rows; each task asks for its endpoints one after another. Only
the names of environment variables travel with the plan; the secrets behind them are read where the request is made.
A request that cannot be made or gets no answer is a response without a status, whose body says why, so one failure
does not stop the others.
"""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import in_scope, join_url, path_violation
from .landed import RESPONSES

# (url, headers, timeout) -> (status, content type, body)
Transport = Callable[[str, dict[str, str], float], tuple[int, str | None, str]]

_ANSWER = pa.schema([
    ("source", pa.string()), ("endpoint", pa.string()), ("response_ord", pa.int64()), ("status", pa.int32()),
    ("content_type", pa.string()), ("body", pa.string()), ("elapsed_ms", pa.int64())])


class _Stay(HTTPRedirectHandler):
    """A redirect is an answer like any other: its target must not see the request's headers."""

    def redirect_request(self, *_):
        return None


def urllib_transport(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str | None, str]:
    """(status, content type, body) of a GET."""
    try:
        with build_opener(_Stay).open(Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.headers.get("Content-Type"), answer.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, error.headers.get("Content-Type"), error.read().decode("utf-8", "replace")


def auth_headers(auth_type: str, header_name: str, env_var: str) -> dict[str, str]:
    if auth_type in ("", "none"):
        return {}
    secret = os.environ.get(env_var)
    if secret is None:
        raise ValueError(f"environment variable `{env_var}` is not set")
    if auth_type == "api_key":
        return {header_name: secret}
    if auth_type == "bearer":
        return {"Authorization": f"Bearer {secret}"}
    raise ValueError(f"unknown auth type `{auth_type}`")


def fetch(catalog: DataFrame, transport: Transport = urllib_transport, timeout: float = 30, per_task: int = 64) -> DataFrame:
    """The responses of the catalog's endpoints, `per_task` requests to a task.

    An endpoint whose URL would leave its base is not asked.
    """
    url = join_url(F.col("base_url"), F.col("path"))
    refused = F.coalesce(path_violation(F.col("path")), F.when(~in_scope(url, F.col("base_url")), "leaves the base URL"))
    header = F.col("header_name") if "header_name" in catalog.columns else F.lit(None).cast("string")
    rows = catalog.select(
        "source", "endpoint", url.alias("url"), refused.alias("refused"), F.coalesce("auth_type", F.lit("none")).alias("auth_type"),
        F.coalesce(F.try_element_at("env_vars", F.lit(1)), F.lit("")).alias("env_var"), F.coalesce(header, F.lit("X-Api-Key")).alias("header_name"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for row in batch.to_pylist():
                started = time.monotonic()
                try:
                    if row["refused"]:
                        raise ValueError(f"path {row['refused']}")
                    headers = auth_headers(row["auth_type"], row["header_name"], row["env_var"])
                    status, content_type, body = transport(row["url"], headers, timeout)
                except Exception as error:  # whatever went wrong is this endpoint's answer
                    status, content_type, body = None, None, str(error)
                elapsed = int((time.monotonic() - started) * 1000)
                answers.append({"source": row["source"], "endpoint": row["endpoint"], "response_ord": 0, "status": status,
                                "content_type": content_type, "body": body, "elapsed_ms": elapsed})
            yield pa.RecordBatch.from_pylist(answers, _ANSWER)

    tasks = max(1, math.ceil(rows.count() / per_task))
    return rows.repartition(tasks).mapInArrow(ask, RESPONSES)
