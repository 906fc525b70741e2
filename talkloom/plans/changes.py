"""Registered state changes: tables after runs, imports, reviews and corrections, as rows (name, key, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.operators import revisions, store
from talkloom.plans.queries import _now, query
from talkloom.plans.standins import cte, table, tables
from talkloom.sources.calls import apply_scan

_STORE = ("audio_files", "jobs", "processing_runs", "transcripts", "transcript_reviews")


def _rows(name: str, df: DataFrame, key, *values) -> DataFrame:
    text = [v.cast("string") for v in (F.col(v) if isinstance(v, str) else v for v in values)] + [F.lit(None).cast("string")] * (3 - len(values))
    return df.select(F.lit(name).alias("name"), key.cast("string").alias("key"), *(v.alias(n) for v, n in zip(text, "abc", strict=True)))


def _version_key():
    return F.concat_ws(":", F.col("audio_file_id").cast("string"), F.col("version").cast("string"))


def _state(t: dict[str, DataFrame], *reviewed: str) -> DataFrame:
    """Jobs, runs, versions and reviews of the tables in one."""
    versions = t["transcripts"].select(F.col("id").alias("transcript_id"), "audio_file_id", "version")
    out = _rows("job", t["jobs"], F.col("id"), "status", "last_error", "claimed_by")
    out = out.unionByName(_rows("run", t["processing_runs"], F.col("id"), "status", "error", "finished_at"))
    out = out.unionByName(_rows("version", t["transcripts"], _version_key(), "content", "is_current", "source"))
    return out.unionByName(_rows("review", t["transcript_reviews"].join(versions, "transcript_id"), _version_key(), "status", *reviewed))


def _versions_sql(incoming: str) -> str:
    """CTEs n (new versions) and after (all of them) for the rows (audio_file_id, content, forced, source) of a table."""
    return f"""
 n AS (SELECT i.audio_file_id, i.content, i.source, (SELECT max(version) FROM transcripts t WHERE t.audio_file_id = i.audio_file_id) + 1 AS version
   FROM {incoming} i LEFT JOIN transcripts c ON c.audio_file_id = i.audio_file_id AND c.is_current WHERE c.content IS DISTINCT FROM i.content OR i.forced),
 after AS (SELECT audio_file_id, version, content, is_current AND audio_file_id NOT IN (SELECT audio_file_id FROM n) AS is_current, source FROM transcripts
   UNION ALL SELECT audio_file_id, version, content, true, source FROM n)"""


_AFTER = "SELECT 'version' AS name, audio_file_id || ':' || version AS key, content AS a, CAST(is_current AS VARCHAR) AS b, source AS c FROM after"
_OLD_REVIEWS = "SELECT 'review' AS name, t.audio_file_id || ':' || t.version AS key, v.status AS a FROM transcript_reviews v JOIN transcripts t ON t.id = v.transcript_id"
_LAST_RUN = "id * 10 + 1 + id % 4"


def _latest_run():
    return F.col("id") * 10 + 1 + F.col("id") % 4


@query(f"{cte('jobs', 'processing_runs')} SELECT audio_file_id, status, attempt, started_at, finished_at FROM processing_runs UNION ALL SELECT audio_file_id, 'running', attempts, TIMESTAMP '2002-01-01 00:00:00', NULL FROM jobs WHERE status = 'running'")
def start_runs(spark, d):
    t = tables(spark, d)
    out = revisions.start_runs(t, t["jobs"].where("status = 'running'").select(F.col("id").alias("job_id")), _now())
    return out["processing_runs"].select("audio_file_id", "status", "attempt", "started_at", "finished_at")


@query(
    f"""{cte(*_STORE)}, r AS (SELECT id, audio_file_id, {_LAST_RUN} AS run_id, 'text ' || id % 5 AS content, 'machine' AS source, id % 2 = 0 AS forced FROM jobs WHERE status = 'running' AND id % 7 <> 0),{_versions_sql("r")}
 SELECT 'job' AS name, CAST(id AS VARCHAR) AS key, CASE WHEN id IN (SELECT id FROM r) THEN 'completed' ELSE status END AS a, CASE WHEN id NOT IN (SELECT id FROM r) THEN last_error END AS b, CASE WHEN id NOT IN (SELECT id FROM r) THEN claimed_by END AS c FROM jobs
 UNION ALL SELECT 'run', CAST(id AS VARCHAR), CASE WHEN id IN (SELECT run_id FROM r) THEN 'completed' ELSE status END, error, CAST(CASE WHEN id IN (SELECT run_id FROM r) THEN TIMESTAMP '2002-01-01 00:00:00' ELSE finished_at END AS VARCHAR) FROM processing_runs
 UNION ALL {_AFTER}
 UNION ALL SELECT *, NULL, NULL FROM ({_OLD_REVIEWS} WHERE NOT (t.is_current AND t.audio_file_id IN (SELECT audio_file_id FROM r) AND t.audio_file_id NOT IN (SELECT audio_file_id FROM n)))
 UNION ALL SELECT 'review', r.audio_file_id || ':' || a.version, 'needs_review', NULL, NULL FROM r JOIN after a ON a.audio_file_id = r.audio_file_id AND a.is_current"""
)
def complete_runs(spark, d):
    """All tables after the running jobs' results came in, some of them incomplete."""
    t = tables(spark, d)
    results = t["jobs"].where("status = 'running'").select(
        F.col("id").alias("job_id"), _latest_run().alias("run_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("content"), F.lit("machine").alias("source"), F.lit("fa").alias("language"),
        F.lit("x.md").alias("markdown_path"), F.lit(None).cast("string").alias("thread_id"), F.when(F.col("id") % 2 == 0, "{}").alias("quality"), (F.col("id") % 7 != 0).alias("complete"),
    )
    return _state(revisions.complete_runs(t, results, _now())[0])


@query(
    f"""{cte(*_STORE)}, r AS (SELECT id, {_LAST_RUN} AS run_id FROM jobs WHERE status = 'running')
 SELECT 'job' AS name, CAST(id AS VARCHAR) AS key, CASE WHEN status <> 'running' THEN status WHEN id % 3 <> 0 AND attempts < max_attempts THEN 'pending' ELSE 'failed' END AS a, CASE WHEN status = 'running' THEN 'boom' ELSE last_error END AS b, CASE WHEN status <> 'running' THEN claimed_by END AS c FROM jobs
 UNION ALL SELECT 'run', CAST(id AS VARCHAR), CASE WHEN id IN (SELECT run_id FROM r) THEN 'failed' ELSE status END, CASE WHEN id IN (SELECT run_id FROM r) THEN 'boom' ELSE error END, CAST(CASE WHEN id IN (SELECT run_id FROM r) THEN TIMESTAMP '2002-01-01 00:00:00' ELSE finished_at END AS VARCHAR) FROM processing_runs
 UNION ALL SELECT 'version', audio_file_id || ':' || version, content, CAST(is_current AS VARCHAR), source FROM transcripts UNION ALL SELECT *, NULL, NULL FROM ({_OLD_REVIEWS})"""
)
def fail_runs(spark, d):
    t = tables(spark, d)
    failures = t["jobs"].where("status = 'running'").select(F.col("id").alias("job_id"), _latest_run().alias("run_id"), F.lit("boom").alias("error"), (F.col("id") % 3 != 0).alias("retryable"))
    return _state(revisions.fail_runs(t, failures, _now()))


@query(
    f"""{cte(*_STORE)}, r AS (SELECT id, audio_file_id, 'text ' || id % 4 AS content, 'existing_markdown' AS source, false AS forced FROM jobs WHERE status NOT IN ('running', 'skipped') AND id % 2 = 0 AND id % 5 <> 0),{_versions_sql("r")}
 SELECT 'job' AS name, CAST(id AS VARCHAR) AS key, CASE WHEN id IN (SELECT id FROM r) THEN 'completed' ELSE status END AS a, CASE WHEN id NOT IN (SELECT id FROM r) THEN last_error END AS b, claimed_by AS c FROM jobs
 UNION ALL {_AFTER} UNION ALL SELECT 'imported', NULL, CAST(count(*) AS VARCHAR), NULL, NULL FROM n"""
)
def import_markdown(spark, d):
    t = tables(spark, d)
    documents = t["audio_files"].where("id % 2 = 0").select(F.col("id").alias("audio_file_id"), F.when(F.col("id") % 5 == 0, " \n ").otherwise(F.concat(F.lit("text "), F.col("id") % 4)).alias("content"))
    out, count = revisions.import_markdown(t, documents, _now())
    rows = _rows("job", out["jobs"], F.col("id"), "status", "last_error", "claimed_by").unionByName(_rows("version", out["transcripts"], _version_key(), "content", "is_current", "source"))
    return rows.unionByName(_rows("imported", count, F.lit(None), "imported"))


def _review_requests(t: dict[str, DataFrame]) -> DataFrame:
    current = t["transcripts"].where("is_current").select("audio_file_id", F.col("id").alias("transcript_id"))
    k = F.col("audio_file_id")
    return current.where(k % 3 == 0).select(
        "audio_file_id", F.when(k % 9 == 0, F.col("transcript_id") - 1).otherwise(F.col("transcript_id")).alias("base_transcript_id"), F.when(k % 2 == 0, "approved").when(k % 11 == 0, "needs_review").otherwise("in_review").alias("status"),
        F.when(k % 5 == 0, " ").otherwise("r").alias("reviewer"), F.when(k % 12 == 0, "seen").alias("notes"), F.when(k % 4 == 0, f"so {C.MARKER}").when(k % 7 == 0, " ").otherwise("reviewed").alias("content"),
    )


_SAVE_REVIEWS = f"""{cte(*_STORE)},
 q AS (SELECT c.audio_file_id, c.id, c.audio_content_hash, a.content_sha256, j.status AS job, c.audio_file_id AS k, CASE WHEN c.audio_file_id % 4 = 0 THEN 'so {C.MARKER}' WHEN c.audio_file_id % 7 = 0 THEN ' ' ELSE 'reviewed' END AS content
   FROM transcripts c JOIN audio_files a ON a.id = c.audio_file_id JOIN jobs j ON j.audio_file_id = c.audio_file_id WHERE c.is_current AND c.audio_file_id % 3 = 0),
 e AS (SELECT *, CASE WHEN k % 2 <> 0 AND k % 11 = 0 THEN 'invalid status' WHEN k % 5 = 0 THEN 'no reviewer' WHEN job IN ('running', 'skipped') THEN 'call in progress or skipped' WHEN k % 9 = 0 THEN 'stale base version'
   WHEN audio_content_hash <> content_sha256 THEN 'audio changed' WHEN content = ' ' THEN 'no text' WHEN k % 4 = 0 AND k % 12 <> 0 THEN 'notes required' END AS error FROM q),
 r AS (SELECT audio_file_id, content, 'human_review' AS source, true AS forced FROM e WHERE error IS NULL),{_versions_sql("r")}
"""


@query(
    f"""{_SAVE_REVIEWS} {_AFTER} UNION ALL SELECT *, NULL, NULL FROM ({_OLD_REVIEWS})
 UNION ALL SELECT 'review', n.audio_file_id || ':' || n.version, CASE WHEN n.audio_file_id % 2 = 0 THEN 'approved' ELSE 'in_review' END, 'r', CAST(e.id AS VARCHAR) FROM n JOIN e USING (audio_file_id)
 UNION ALL SELECT 'refused', CAST(audio_file_id AS VARCHAR), error, NULL, NULL FROM e WHERE error IS NOT NULL"""
)
def save_reviews(spark, d):
    """Versions, reviews and refusals after reviews of every third call, which have no segments."""
    t = tables(spark, d)
    t["transcript_reviews"] = t["transcript_reviews"].withColumn("reviewer", F.lit(None).cast("string")).withColumn("base_transcript_id", F.lit(None).cast("long"))
    none = spark.createDataFrame([], "audio_file_id long, id string, start double, end double, text string, speaker string, uncertain boolean")
    out, refused = revisions.save_reviews(t, _review_requests(t), none, none.select("audio_file_id", "id"), _now())
    versions = out["transcripts"].select(F.col("id").alias("transcript_id"), "audio_file_id", "version")
    rows = _rows("version", out["transcripts"], _version_key(), "content", "is_current", "source").unionByName(_rows("review", out["transcript_reviews"].join(versions, "transcript_id"), _version_key(), "status", "reviewer", "base_transcript_id"))
    return rows.unionByName(_rows("refused", refused, F.col("audio_file_id"), "error"))


@query(
    f"""{cte(*_STORE, "segments")},
 q AS (SELECT s.call_id AS audio_file_id, s.start, s.text, c.id, j.status AS job, c.audio_content_hash <> a.content_sha256 AS moved, CASE WHEN s.call_id % 4 = 0 THEN 'picked ' || s.call_id WHEN s.call_id % 7 = 0 THEN trim(s.text) ELSE 'fixed ' || s.call_id END AS corrected
   FROM segments s LEFT JOIN transcripts c ON c.audio_file_id = s.call_id AND c.is_current LEFT JOIN audio_files a ON a.id = s.call_id LEFT JOIN jobs j ON j.audio_file_id = s.call_id WHERE s."index" = 0),
 e AS (SELECT *, CASE WHEN audio_file_id % 6 = 5 THEN 'no reviewer' WHEN id IS NULL THEN 'unknown call' WHEN job IN ('running', 'skipped') THEN 'call in progress or skipped' WHEN moved THEN 'audio changed' WHEN corrected = trim(text) THEN 'no change' END AS error FROM q)
 SELECT 'refused' AS name, CAST(audio_file_id AS VARCHAR) AS key, error AS a, NULL AS b, NULL AS c FROM e WHERE error IS NOT NULL
 UNION ALL SELECT 'example', CAST(audio_file_id AS VARCHAR), corrected, CASE WHEN audio_file_id % 4 = 0 THEN 'candidate' ELSE 'custom' END, CAST(id AS VARCHAR) FROM e WHERE error IS NULL
 UNION ALL SELECT 'segment', s.call_id || ':' || s.id, CASE WHEN s."index" = 0 THEN corrected ELSE s.text END, CASE WHEN s."index" = 0 THEN 'human_corrected' ELSE s.confidence_tier END, CAST(CASE WHEN s."index" = 0 THEN false ELSE s.uncertain END AS VARCHAR)
   FROM segments s JOIN e ON e.audio_file_id = s.call_id WHERE error IS NULL"""
)
def save_corrections(spark, d):
    """Refusals, examples and new segments after a correction of each call's first segment."""
    t = tables(spark, d)
    t["transcript_reviews"] = t["transcript_reviews"].withColumn("base_transcript_id", F.lit(None).cast("long"))
    t["review_corrections"] = spark.createDataFrame([], "id long, audio_file_id long, source_transcript_id long, result_transcript_id long, segment_id string, original_text string, corrected_text string, selection_source string, candidate_id string, reviewer string")
    k = F.col("call_id")
    candidates = F.array(F.struct(F.lit("c1").alias("id"), F.concat(F.lit("picked "), k).alias("text")))
    s = table(spark, d, "segments").withColumns({"flags": F.array().cast("array<string>"), "reason": F.lit(None).cast("string"), "candidates": candidates})
    current = t["transcripts"].where("is_current").select(F.col("audio_file_id").alias("call_id"), F.col("id").alias("base_transcript_id"))
    asked = s.where("index = 0").join(current, "call_id", "left").select(
        k.alias("audio_file_id"), "base_transcript_id", F.col("id").alias("segment_id"), F.when(k % 6 != 5, "r").alias("reviewer"), F.when(k % 4 == 0, "c1").alias("candidate_id"),
        F.when(k % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("fixed "), k)).alias("custom_text"),
    )
    out, rows, refused = revisions.save_corrections(t, asked, s.withColumnRenamed("call_id", "audio_file_id"), _now())
    done = _rows("refused", refused, F.col("audio_file_id"), "error").unionByName(_rows("example", out["review_corrections"], F.col("audio_file_id"), "corrected_text", "selection_source", "source_transcript_id"))
    return done.unionByName(_rows("segment", rows, F.concat_ws(":", F.col("audio_file_id").cast("string"), "id"), "text", "confidence_tier", "uncertain"))


def _scanned(spark, d):
    calls = table(spark, d, "audio_files").withColumn("discovered_at", _now()).withColumn("updated_at", _now())
    seen = calls.where("id % 2 = 0").withColumn("content_sha256", F.when(F.col("id") % 6 == 0, "new").otherwise(F.col("content_sha256"))).withColumn("duration_seconds", F.when(F.col("id") % 9 == 0, 0.1).otherwise(F.col("duration_seconds"))).drop("id", "discovered_at", "updated_at")
    return store.upsert_calls(calls, table(spark, d, "jobs").withColumn("created_at", _now()), table(spark, d, "transcripts"), seen, _now())


@query(f"{cte('audio_files')} SELECT id, absolute_path, CASE WHEN id % 6 = 0 THEN 'new' ELSE content_sha256 END AS content_sha256, CASE WHEN id % 18 = 0 THEN 0.1 ELSE duration_seconds END AS duration_seconds FROM audio_files")
def scan_calls(spark, d):
    """The calls after a scan that changed some and shortened some."""
    return _scanned(spark, d)[0].select("id", "absolute_path", "content_sha256", "duration_seconds")


@query(f"{cte('transcripts')} SELECT id, audio_file_id, is_current AND audio_file_id % 6 <> 0 AS is_current FROM transcripts")
def scan_transcripts(spark, d):
    """The versions after the same scan: those of changed calls are retired."""
    return _scanned(spark, d)[2].select("id", "audio_file_id", "is_current")


_SCAN = f"""{cte("audio_files", "jobs", "transcripts")},
 s AS (SELECT id, absolute_path AS path, true AS known, id % 6 = 0 AS changed, CASE WHEN id % 9 = 0 THEN 0.1 ELSE duration_seconds END < 0.5 AS short, id % 15 = 0 AS collision, id % 14 = 0 AS bad FROM audio_files WHERE id % 2 = 0
   UNION ALL SELECT id, '/calls/new/' || id || '.mp3', false, true, id % 30 = 0, false, false FROM audio_files WHERE id % 10 = 0),
 j AS (SELECT a.absolute_path AS path, a.id, CASE WHEN s.path IS NULL OR s.collision OR j.status = 'running' THEN j.status WHEN s.short THEN 'skipped' WHEN s.changed OR j.status = 'skipped' THEN 'pending' ELSE j.status END AS status
     FROM audio_files a JOIN jobs j ON j.audio_file_id = a.id LEFT JOIN s ON s.path = a.absolute_path
   UNION ALL SELECT path, NULL, CASE WHEN short THEN 'skipped' ELSE 'pending' END FROM s WHERE NOT known),
 i AS (SELECT s.path, j.id, 'text ' || s.id % 5 AS content FROM s JOIN j USING (path) WHERE s.id % 4 = 0 AND s.id % 16 <> 0 AND NOT s.collision AND NOT s.short AND NOT (s.known AND s.changed) AND j.status NOT IN ('running', 'skipped')),
 t AS (SELECT a.absolute_path AS path, t.version, t.content, t.is_current AND NOT coalesce(s.changed AND NOT s.collision, false) AS is_current, t.source FROM transcripts t JOIN audio_files a ON a.id = t.audio_file_id LEFT JOIN s ON s.path = a.absolute_path),
 n AS (SELECT i.path, i.content, coalesce((SELECT max(version) FROM t WHERE t.path = i.path), 0) + 1 AS version FROM i LEFT JOIN t c ON c.path = i.path AND c.is_current WHERE c.content IS DISTINCT FROM i.content)
"""


@query(
    f"""{_SCAN} SELECT 'job' AS name, path AS key, CASE WHEN path IN (SELECT path FROM i) THEN 'completed' ELSE status END AS a, NULL AS b, NULL AS c FROM j
 UNION ALL SELECT 'version', path || ':' || version, content, CAST(is_current AND path NOT IN (SELECT path FROM n) AS VARCHAR), source FROM t
 UNION ALL SELECT 'version', path || ':' || version, content, 'true', 'existing_markdown' FROM n
 UNION ALL SELECT unnest(['discovered', 'changed', 'metadata_errors', 'skipped', 'collisions', 'imported_markdown']), NULL,
   CAST(unnest([count(*), count(*) FILTER (changed AND NOT collision), count(*) FILTER (collision OR bad), count(*) FILTER (collision OR short), count(*) FILTER (collision), (SELECT count(*) FROM n)]) AS VARCHAR), NULL, NULL FROM s"""
)
def scan_into(spark, d):
    """Jobs and versions after a scan with new, changed, short, colliding and unreadable recordings and documents beside them, and its counters."""
    t = tables(spark, d)
    t = t | {"audio_files": t["audio_files"].withColumn("discovered_at", _now()).withColumn("updated_at", _now()), "jobs": t["jobs"].withColumn("created_at", _now())}
    k = F.col("id")
    known = t["audio_files"].where("id % 2 = 0").drop("discovered_at", "updated_at").withColumns({
        "content_sha256": F.when(k % 6 == 0, "new").otherwise(F.col("content_sha256")), "duration_seconds": F.when(k % 9 == 0, 0.1).otherwise(F.col("duration_seconds")),
        "collision": k % 15 == 0, "metadata_error": F.when(k % 14 == 0, "unreadable"),
    })
    new = t["audio_files"].where("id % 10 = 0").drop("discovered_at", "updated_at").withColumns({
        "absolute_path": F.concat(F.lit("/calls/new/"), k, F.lit(".mp3")), "content_sha256": F.lit("n"), "duration_seconds": F.when(k % 30 == 0, 0.2).otherwise(9.0),
        "collision": F.lit(False), "metadata_error": F.lit(None).cast("string"),
    })
    scanned = known.unionByName(new)
    documents = scanned.where("id % 4 = 0").select("absolute_path", F.when(k % 16 == 0, " \n").otherwise(F.concat(F.lit("text "), k % 5)).alias("content"))
    out, counters = apply_scan(t, scanned.drop("id"), documents, _now())
    path = out["audio_files"].select(F.col("id").alias("audio_file_id"), F.col("absolute_path").alias("path"))
    rows = _rows("job", out["jobs"].join(path, "audio_file_id"), F.col("path"), "status")
    rows = rows.unionByName(_rows("version", out["transcripts"].join(path, "audio_file_id"), F.concat_ws(":", "path", F.col("version").cast("string")), "content", "is_current", "source"))
    names = counters.columns
    each = counters.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("a")) for n in names))).alias("x")).select("x.name", "x.a")
    return rows.unionByName(each.select("name", F.lit(None).cast("string").alias("key"), "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")))
