"""Response screening: status, JSON validity, envelopes and record sets.

A responses relation has source, endpoint, status, content_type and body. An endpoint may answer
in many pages; `response_ord` (a long, default 0) orders them. Pages beyond 10^12 and below 0 are read like
all others, but count as equally late (or early) where a first appearance is looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import is_array, with_json
from ..functions.text import error_snippet
from .keyed import ENDPOINT

# Fixed value, used wherever a response has no single record type to learn from.
NOT_RECORDS = "response does not describe records (cannot infer a table schema)"

# Position of a record among all records of its endpoint: 12 digits of page, 9 of place in it.
REC_KEY = "decimal(21,0)"
_PAGE = 10**9


def is_success(status: Column) -> Column:
    """2xx. Written so that a filter on it, or on its negation, reaches the scan."""
    return status.isNotNull() & status.between(200, 299)


# Fixed text, up to the words for a status that nobody recorded.
def status_message(url: Column, status: Column, body: Column) -> Column:
    """Never NULL, so that a failed response is always told."""
    return F.concat(
        F.lit("request to `"), F.coalesce(url, F.lit("unknown")), F.lit("` failed with status "),
        F.coalesce(status.cast("string"), F.lit("unknown")), F.lit(": "), error_snippet(F.coalesce(body, F.lit(""))),
    )


def with_page(responses: DataFrame) -> DataFrame:
    if "response_ord" in responses.columns:
        return responses
    return responses.withColumn("response_ord", F.lit(0).cast("long"))


def screen_status(responses: DataFrame, url: Column | None = None) -> DataFrame:
    """Add `ok` and, for everything but 2xx, `message`."""
    where = url if url is not None else (
        F.col("url") if "url" in responses.columns else F.col("endpoint"))
    ok = is_success(F.col("status"))
    return responses.withColumn("ok", ok).withColumn(
        "message", F.when(~ok, status_message(where, F.col("status"), F.col("body")))
    )


def detect_envelope(df: DataFrame, value: str = "v") -> DataFrame:
    """Add `envelope` and `record_set` for the parsed body in `value`.

    A top-level array is the record set. An object with exactly one array field is an envelope
    and that field is the record set. For anything else both are NULL: the body is one record.
    """
    # Fields that are no arrays become NULL here, without a look at what they hold.
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,array<boolean>>"))
    arrays = df.withColumn("_arrays", F.filter(fields, lambda e: e["value"].isNotNull()))
    only = F.when(F.size("_arrays") == 1, F.col("_arrays")[0])
    return (
        arrays.withColumn("envelope", only["key"])
        .withColumn("record_set", F.when(F.col("_arrays").isNotNull(), F.when(
            F.size("_arrays") == 1, F.element_at(F.try_variant_get(value, "$", "map<string,variant>"), only["key"])))
                    .when(is_array(F.col(value)), F.col(value)))
        .drop("_arrays")
    )


def unwrap(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record, plus one row without a record per response that has none.

    Columns: source, endpoint, response_ord, `keep`, envelope, rec_key, record and `issue`
    (NULL, 'status', 'empty' or 'json <status> <content type>'). Everything stays in the scan's own stage.
    """
    spark = responses.sparkSession
    kept = "".join(f"`{c}`, " for c in keep)
    bodies = spark.sql(f"""
        SELECT source, endpoint, response_ord, {kept} good,
               concat_ws(' ', 'json', CAST(status AS STRING), coalesce(content_type, 'unknown')) AS answer,
               IF(good, body, NULL) AS body
        FROM (SELECT *, status IS NOT NULL AND status BETWEEN 200 AND 299 AS good FROM {{pages}})""",
        pages=with_page(responses))
    parsed = detect_envelope(with_json(bodies, "body", "v", "valid"), "v")
    return spark.sql(f"""
        SELECT source, endpoint, response_ord, {kept} envelope,
               CAST(CAST(greatest(0L, least(coalesce(response_ord, 0L), 999999999999L)) AS DECIMAL(12,0)) * CAST({_PAGE} AS DECIMAL(10,0))
                    + CAST(coalesce(pos, 0) AS DECIMAL(9,0)) AS {REC_KEY}) AS rec_key,
               CAST(coalesce(pos, 0) AS BIGINT) AS rec_ord,
               IF(record_set IS NULL, v, value) AS record,
               CASE WHEN NOT good THEN 'status' WHEN NOT valid THEN answer
                    WHEN record_set IS NOT NULL AND pos IS NULL THEN 'empty' END AS issue
        FROM {{parsed}}, LATERAL variant_explode_outer(record_set)""", parsed=parsed)


def record_sets(responses: DataFrame) -> DataFrame:
    """Per well-formed response: the name of its record set, the envelope and the record count.

    A record set is named after its envelope field, otherwise after the endpoint.
    """
    pages = with_page(responses).select(
        *ENDPOINT, "response_ord", F.when(is_success(F.col("status")), F.col("body")).alias("_body"))
    found = detect_envelope(with_json(pages, "_body", "_v", "_valid"), "_v").filter("_valid")
    elements = F.size(F.try_variant_get("record_set", "$", "array<variant>"))
    return found.select(
        *ENDPOINT, "response_ord", F.coalesce("envelope", "endpoint").alias("name"), "envelope",
        F.when(F.col("record_set").isNull(), 1).otherwise(elements).cast("long").alias("record_count"))


def explode_records(responses: DataFrame) -> DataFrame:
    """The records of every well-formed response: source, endpoint, envelope, rec_key, record."""
    rows = unwrap(responses)
    return rows.filter(F.col("issue").isNull()).drop("issue")
