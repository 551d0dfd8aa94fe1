"""Registered queries of the core operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.audit_values import blank_to_null, status, with_unix_time
from lodesift.operators.history import version_history
from lodesift.sources.har import har_lists, har_table, parse_har
from lodesift.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each header object of the captures' requests and responses."""
    lists = ["request.headers", "response.headers"]
    rows = har_lists(parse_har(table(spark, folder, "har_captures").select("capture_id", "har"), only=lists), ["capture_id"], lists)
    return rows.select("capture_id", "entry_index", F.substring_index("list", ".", 1).alias("direction"), F.col("item_index").alias("header_index"))


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each entry of the captures, with what its messages say of themselves."""
    parsed = parse_har(table(spark, folder, "har_captures").select("capture_id", "har"))
    return har_table(parsed, ["capture_id"], "entries").select("capture_id", "entry_index", "pageref", F.col("request_method").alias("method"), F.col("request_url").alias("url"), F.col("response_status").alias("status"))


def status_versions(df: DataFrame) -> DataFrame:
    """Versions of status and note in a table such as status_history."""
    rows = with_unix_time(df, "history_timestamp", "at").select(
        F.upper(blank_to_null(F.col("finding_id"))).alias("finding_id"),
        status(F.col("status")).alias("status"),
        blank_to_null(F.col("note")).alias("note"),
        "at",
        "update_id",
    )
    return version_history(rows, "finding_id", "at", "update_id", ["status", "note"], needed=["status"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of the findings' status and note, each with its period."""
    return status_versions(table(spark, folder, "status_history")).select("finding_id", "status", "valid_from", "valid_to")


_HAR = """
WITH docs AS (SELECT capture_id, trim(har, chr(65279) || ' ' || chr(10) || chr(13) || chr(9)) AS h FROM har_captures),
good AS (SELECT capture_id, CAST(h AS JSON) AS h FROM docs WHERE json_valid(h)),
lists AS (SELECT capture_id, CASE json_type(h, '$.log.entries') WHEN 'ARRAY' THEN json_extract(h, '$.log.entries[*]') WHEN 'OBJECT' THEN [json_extract(h, '$.log.entries')] END AS es FROM good),
entries AS (SELECT capture_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS entry_index FROM lists)
"""
P5_FOUND_SQL = _HAR + """,
sides AS (SELECT capture_id, entry_index, 'request' AS direction, json_extract(e, '$.request.headers') AS hs FROM entries
UNION ALL SELECT capture_id, entry_index, 'response', json_extract(e, '$.response.headers') FROM entries),
texts AS (SELECT * REPLACE (CASE WHEN json_type(hs) = 'VARCHAR' AND json_valid(hs ->> '$') THEN CAST(hs ->> '$' AS JSON) ELSE hs END AS hs) FROM sides),
items AS (SELECT capture_id, entry_index, direction, CASE json_type(hs) WHEN 'ARRAY' THEN json_extract(hs, '$[*]') WHEN 'OBJECT' THEN [hs] END AS hs FROM texts),
headers AS (SELECT capture_id, entry_index, direction, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS header_index FROM items)
SELECT capture_id, CAST(entry_index AS INTEGER) AS entry_index, direction, CAST(header_index AS INTEGER) AS header_index FROM headers WHERE json_type(h) = 'OBJECT'
"""
P5_ENTRIES_SQL = _HAR + """
SELECT capture_id, CAST(entry_index AS INTEGER) AS entry_index, e ->> '$.pageref' AS pageref, e ->> '$.request.method' AS method, e ->> '$.request.url' AS url, e ->> '$.response.status' AS status
FROM entries WHERE json_type(e) = 'OBJECT'
"""
TIMES_SQL = r"""
WITH t AS (SELECT update_id, upper(trim(finding_id, ' ' || chr(9) || chr(10) || chr(13))) AS finding_id, regexp_replace(lower(trim(status, ' ' || chr(9) || chr(10) || chr(13))), '[\s_-]+', '_', 'g') AS status, nullif(trim(note, ' ' || chr(9) || chr(10) || chr(13)), '') AS note, trim(history_timestamp) AS h FROM status_history),
n AS (SELECT *, CASE WHEN regexp_matches(h, '^\d{8}T\d{6}Z$') THEN strptime(h, '%Y%m%dT%H%M%SZ') END AS compact,
regexp_extract(h, '^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)', ['d', 'c']) AS p, regexp_extract(h, '([+-])(\d\d):?(\d\d)$', ['s', 'h', 'm']) AS o FROM t),
u AS (SELECT finding_id, status, note, update_id, CASE WHEN regexp_matches(h, '^\d+$') THEN CAST(h AS BIGINT) WHEN compact IS NOT NULL THEN CAST(epoch(compact) AS BIGINT)
ELSE CAST(epoch(try_cast(p.d || ' ' || p.c AS TIMESTAMP)) AS BIGINT) - CASE WHEN length(h) > 19 AND o.s <> '' THEN (CASE o.s WHEN '-' THEN -1 ELSE 1 END) * (try_cast(o.h AS BIGINT) * 3600 + try_cast(o.m AS BIGINT) * 60) ELSE 0 END END AS ts FROM n)
"""
P6_FOUND_SQL = TIMES_SQL + r""",
k AS (SELECT * FROM u WHERE ts IS NOT NULL AND finding_id <> '' AND status IN ('open', 'fixed', 'partially_fixed', 'accepted_risk', 'not_reproducible')
QUALIFY row_number() OVER (PARTITION BY finding_id, ts ORDER BY update_id DESC, status DESC, note DESC NULLS LAST) = 1),
c AS (SELECT *, lag(status) OVER w AS ps, lag(note) OVER w AS pn, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY finding_id ORDER BY ts)),
v AS (SELECT * FROM c WHERE i = 1 OR ps IS DISTINCT FROM status OR pn IS DISTINCT FROM note)
SELECT finding_id, status, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY finding_id ORDER BY ts), -1) AS valid_to FROM v
"""

QUERIES = {"p5_found": p5_found, "p5_entries": p5_entries, "p6_found": p6_found}
SQL = {"p5_found": P5_FOUND_SQL, "p5_entries": P5_ENTRIES_SQL, "p6_found": P6_FOUND_SQL}
