"""Call tables derived from the star-schema test tables.

Each table is a list of (name, expression[, DuckDB expression]) over a source,
so that a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2002-01-01 00:00:00"

_CALLS = [
    ("id", "o_orderkey"),
    ("filename", "concat('call-', CAST(o_orderkey AS STRING), '-', lower(o_orderpriority), '.mp3')"),
    ("relative_path", "concat('inbox/', CAST(o_orderkey % 100 AS STRING), '/', CAST(o_orderkey AS STRING), '.mp3')"),
    ("absolute_path", "concat('/calls/inbox/', CAST(o_orderkey % 100 AS STRING), '/', CAST(o_orderkey AS STRING), '.mp3')"),
    ("direction", "CASE o_orderstatus WHEN 'O' THEN 'inbound' WHEN 'F' THEN 'outbound' ELSE 'internal' END"),
    ("remote_number", "concat('09', CAST(o_custkey AS STRING))"),
    ("call_id", "concat('C', CAST(o_orderkey AS STRING))"),
    ("recorded_at", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END"),
    ("duration_seconds", "CAST(o_orderkey * 37 % 4000 AS DOUBLE) / 10"),
    ("content_sha256", "CAST(o_custkey % 2 AS STRING)"),
]
#: Calls as a scan finds them, with all that their headers say.
_RECORDINGS = [
    *_CALLS,
    ("agent_extension", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('2', CAST(o_custkey % 10 AS STRING), '_', CAST(o_orderkey % 3 AS STRING)) END"),
    ("size_bytes", "o_orderkey * 1000"),
    ("codec", "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 'mp3' END"),
    ("bitrate", "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 64000 + o_orderkey % 2 * 64000 END"),
    ("sample_rate", "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 8000 END"),
    ("channels", "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END"),
    ("metadata_error", "CASE WHEN o_orderkey % 14 = 0 THEN 'Unreadable: no run of MPEG frames' END"),
]
_JOBS = [
    ("id", "o_orderkey"),
    ("audio_file_id", "o_orderkey"),
    ("stage", "'transcribe'"),
    ("status", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'running' WHEN '3' THEN 'completed' WHEN '4' THEN 'failed' ELSE 'skipped' END"),
    ("priority", "CAST(CASE WHEN o_orderkey % 17 = 0 THEN 1000 ELSE 0 END AS BIGINT)"),
    ("attempts", "CAST(o_orderkey % 4 AS BIGINT)"),
    ("max_attempts", "CAST(3 AS BIGINT)"),
    ("claimed_by", "CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'w1' END"),
    ("claimed_at", "CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN o_orderdate END"),
    ("lease_expires_at", "CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN o_orderdate END"),
    ("last_error", "CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN concat('error ', CAST(o_custkey AS STRING)) END"),
    ("updated_at", "o_orderdate"),
]
_RUNS = [
    ("id", "o_orderkey * 10 + n"),
    ("audio_file_id", "o_orderkey"),
    ("stage", "'transcribe'"),
    ("status", "CASE WHEN n <= o_orderkey % 4 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'completed' END"),
    ("attempt", "CAST(n AS BIGINT)"),
    ("error", "CASE WHEN n <= o_orderkey % 4 THEN concat('error ', CAST(n AS STRING)) END"),
    ("started_at", "o_orderdate + make_dt_interval(0, 0, n, 0)", "o_orderdate + to_minutes(n)"),
    ("finished_at", "CASE WHEN n > o_orderkey % 4 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + make_dt_interval(0, 0, n, o_custkey * n % 900) END", "CASE WHEN n > o_orderkey % 4 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + to_minutes(n) + to_seconds(o_custkey * n % 900) END"),
]
_TRANSCRIPTS = [
    ("id", "o_orderkey * 10 + n"),
    ("audio_file_id", "o_orderkey"),
    ("version", "CAST(n AS BIGINT)"),
    ("content", "concat('text ', CAST(o_custkey * n % 5 AS STRING))"),
    ("source", "CASE WHEN n = 3 THEN 'human' ELSE 'machine' END"),
    ("audio_content_hash", "CAST((o_custkey + n) % 2 AS STRING)"),
    ("content_hash", "sha2(concat('text ', CAST(o_custkey * n % 5 AS STRING)), 256)", "sha256(concat('text ', CAST(o_custkey * n % 5 AS STRING)))"),
    ("is_current", "n = 1 + o_orderkey % 3"),
    ("unclear_count", "CAST(o_custkey % 4 AS BIGINT)"),
    ("created_at", "o_orderdate + make_dt_interval(n, 0, 0, 0)", "o_orderdate + to_days(n)"),
]
_REVIEWS = [
    ("transcript_id", "o_orderkey * 10 + n"),
    ("status", "CASE o_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'in_review' ELSE 'needs_review' END"),
]
_SEGMENTS = [
    ("call_id", "conv_id"),
    ("index", "turn"),
    ("id", "concat('s', CAST(turn AS STRING))"),
    ("start", "CAST(turn * 6 AS DOUBLE)"),
    ("end", "CAST(turn * 6 AS DOUBLE) + least(CAST(8 AS DOUBLE), CAST(length(text) AS DOUBLE) / CAST(15 AS DOUBLE))"),
    ("text", "text"),
    ("speaker", "role"),
    ("confidence_tier", "CASE WHEN turn % 3 = 0 THEN 'unresolved' ELSE 'high' END"),
    ("uncertain", "turn % 4 = 1"),
]
_INTERVALS = [
    ("id", "CAST(event_id AS STRING)"),
    ("call_id", "user_id"),
    ("start", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000", "CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000"),
    ("end", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000 + value * 200", "CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000 + value * 200"),
    ("speaker_id", "event_type"),
]
TABLES: dict[str, tuple[list, str, str | None, str | None]] = {
    # columns, source, repetitions n = 1..k, filter
    "audio_files": (_CALLS, "orders", None, None),
    "recordings": (_RECORDINGS, "orders", None, None),
    "jobs": (_JOBS, "orders", None, None),
    "processing_runs": (_RUNS, "orders", "1 + o_orderkey % 4", None),
    "transcripts": (_TRANSCRIPTS, "orders", "1 + o_orderkey % 3", None),
    "transcript_reviews": (_REVIEWS, "orders", "1 + o_orderkey % 3", "(o_orderkey + n) % 4 <> 0"),
    "segments": (_SEGMENTS, "conversations", None, None),
    "intervals": (_INTERVALS, "events", None, None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, source, times, where = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if times:
        df = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.expr(f"CAST({times} AS INT)"))))
    if where:
        df = df.where(where)
    return df.selectExpr(*(f"{c[1]} AS `{c[0]}`" for c in columns))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in ("audio_files", "jobs", "processing_runs", "transcripts", "transcript_reviews")}


def cte(*names: str) -> str:
    """WITH clause of the named tables for DuckDB."""
    parts = []
    for name in names:
        columns, source, times, where = TABLES[name]
        src = f"(SELECT *, unnest(range(1, 1 + {times})) AS n FROM {source})" if times else source
        parts.append(f"{name} AS (SELECT {', '.join(f'{c[-1]} AS "{c[0]}"' for c in columns)} FROM {src}{f' WHERE {where}' if where else ''})")
    return "WITH RECURSIVE " + ",\n".join(parts)
