"""Read models over the stored tables.

Latest runs and total seconds are one aggregate over the runs, joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T

STAGE = "transcribe"


def clamp(value, default: int, most: int, zero_is_default: bool = False) -> int:
    """An API number: what isn't an integer is the default; then clamped to 0..most."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    if zero_is_default and not n:
        n = default
    return max(0, min(n, most))


def run_totals(runs: DataFrame, now: Column) -> DataFrame:
    """Per call: latest run id and the seconds of all runs, open ones up to now."""
    seconds = (F.unix_micros(F.coalesce("finished_at", now).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.where(F.col("stage") == STAGE).groupBy(F.col("audio_file_id").alias("_ra")).agg(F.max("id").alias("latest_run_id"), F.sum(seconds).alias("_sec"))


def _base(calls: DataFrame, jobs: DataFrame, transcripts: DataFrame, reviews: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    j = jobs.where(F.col("stage") == STAGE).select(F.col("audio_file_id").alias("_ja"), F.col("status").alias("job_status"), F.col("priority").alias("job_priority"), "attempts", "max_attempts", "last_error")
    t = transcripts.where("is_current").select(F.col("audio_file_id").alias("_ta"), F.col("id").alias("transcript_id"), F.col("version").alias("transcript_version"), F.col("source").alias("transcript_source"), "unclear_count", F.col("created_at").alias("transcript_created_at"))
    r = reviews.select(F.col("transcript_id").alias("_rt"), F.col("status").alias("_review"))
    x = calls.join(j, F.col("id") == F.col("_ja"), "left")
    # a transcript counts while its call's job is not skipped; a call without a job keeps it
    x = x.join(t, (F.col("id") == F.col("_ta")) & (F.col("job_status").isNull() | (F.col("job_status") != "skipped")), "left")
    x = x.join(r, F.col("transcript_id") == F.col("_rt"), "left").join(run_totals(runs, now), F.col("id") == F.col("_ra"), "left")
    return x.withColumn("review_status", F.coalesce("_review", F.lit("needs_review"))).withColumn("processing_total_seconds", F.coalesce("_sec", F.lit(0.0)))


LIST_COLUMNS = ["id", "filename", "direction", "remote_number", "recorded_at", "duration_seconds", "job_status", "job_priority", "attempts", "max_attempts", "latest_run_id", "processing_total_seconds", "transcript_id", "transcript_version", "transcript_source", "unclear_count", "review_status"]
#: What a list shows besides, where the table has it.
FILE_COLUMNS = ["relative_path", "agent_extension", "size_bytes", "codec", "bitrate", "sample_rate", "channels", "metadata_error", "last_error", "transcript_created_at"]


def list_calls(tables: dict[str, DataFrame], now: Column, *, search: str = "", direction: str = "", status: str = "", transcript: str = "", review: str = "", searched: tuple[str, ...] = ("filename", "relative_path", "remote_number", "agent_extension"), full: bool = False) -> DataFrame:
    """All matching calls; unknown filter values are ignored.  ``page`` orders and cuts.  With ``full`` also FILE_COLUMNS."""
    x = _base(tables["audio_files"], tables["jobs"], tables["transcripts"], tables["transcript_reviews"], tables["processing_runs"], now)
    keep: list[Column] = []
    if search.strip():
        keep.append(T.matches_any(search.strip(), [c for c in searched if c in x.columns]))
    if direction in C.DIRECTIONS:
        keep.append(F.col("direction") == direction)
    if status in C.JOB_STATUSES:
        keep.append(F.col("job_status") == status)
    if transcript in ("yes", "no"):
        keep.append(F.col("transcript_id").isNotNull() if transcript == "yes" else F.col("transcript_id").isNull())
    if review in C.REVIEW_STATUSES:
        keep.append(F.col("transcript_id").isNotNull() & (F.col("review_status") == review) & (F.col("job_status") != "skipped"))
    for c in keep:
        x = x.where(c)
    return x.select(*(c for c in [*LIST_COLUMNS, *(FILE_COLUMNS if full else [])] if c in x.columns))


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, unknown times last."""
    out = df.orderBy(F.desc_nulls_last("recorded_at"), F.desc("id"))
    return (out.offset(offset) if offset else out).limit(limit)


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, each row with the number of all matching calls (``total``); a page behind the last one is empty."""
    return page(df, limit, offset).join(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def audio_paths(tables: dict[str, DataFrame], requested: DataFrame) -> DataFrame:
    """(id, absolute_path) of the requested calls (id); null for unknown ones."""
    return requested.select("id").distinct().join(tables["audio_files"].select("id", "absolute_path"), "id", "left")


def review_details(tables: dict[str, DataFrame]) -> DataFrame:
    """Per call: transcript_id, status, reviewer, notes, data_json and markdown_synced of the current version's review, and all versions, newest first."""
    r = tables["transcript_reviews"]
    known = lambda c, kind: (F.col(c) if c in r.columns else F.lit(None)).cast(kind).alias(c)
    r = r.select(F.col("transcript_id").alias("_t"), "status", known("reviewer", "string"), known("notes", "string"), known("data_json", "string"), known("markdown_synced", "boolean"))
    x = tables["transcripts"].join(r, F.col("id") == F.col("_t"), "left")
    one = F.struct("version", "id", "source", "content", "created_at", "status", "reviewer", "notes")
    now = F.max(F.when(F.col("is_current"), F.struct("version", "id", "status", "reviewer", "notes", "data_json", "markdown_synced"))).alias("now")
    x = x.groupBy("audio_file_id").agg(now, F.sort_array(F.collect_list(one), asc=False).alias("versions"))
    x = tables["audio_files"].select(F.col("id").alias("audio_file_id")).join(x, "audio_file_id", "left")
    has, text = F.col("now").isNotNull(), lambda c, default: F.coalesce(F.col(f"now.{c}"), F.lit(default)).alias(c)
    said = lambda c: F.when(has, F.col(f"now.{c}")).otherwise("").alias(c)
    return x.select("audio_file_id", F.col("now.id").alias("transcript_id"), text("status", "needs_review"), said("reviewer"), said("notes"), text("data_json", "{}"), text("markdown_synced", False), F.coalesce("versions", F.array().cast(x.schema["versions"].dataType)).alias("versions"))


def call_detail(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """Every call with its job, current transcript and latest run."""
    x = _base(tables["audio_files"], tables["jobs"], tables["transcripts"], tables["transcript_reviews"], tables["processing_runs"], now)
    r = tables["processing_runs"].select(F.col("id").alias("_rid"), F.col("status").alias("latest_run_status"), F.col("attempt").alias("latest_run_attempt"))
    x = x.join(r, F.col("latest_run_id") == F.col("_rid"), "left")
    return x.select(*(c for c in LIST_COLUMNS if c in x.columns), "latest_run_status", "latest_run_attempt")


def processing_snapshot(tables: dict[str, DataFrame], now: Column, error_limit: int = 800) -> DataFrame:
    """Public progress state of each job, without paths, errors cut."""
    j = tables["jobs"].where(F.col("stage") == STAGE).select(F.col("audio_file_id").alias("audio_id"), F.col("status").alias("job_status"), F.col("priority").alias("job_priority"), "attempts", F.substring("last_error", 1, error_limit).alias("last_error"))
    r = tables["processing_runs"].select(F.col("id").alias("_rid"), F.col("status").alias("run_status"), F.col("attempt").alias("run_attempt"), F.substring("error", 1, error_limit).alias("run_error"))
    x = j.join(tables["audio_files"].select(F.col("id").alias("audio_id"), "filename"), "audio_id").join(run_totals(tables["processing_runs"], now), F.col("audio_id") == F.col("_ra"), "left").join(r, F.col("latest_run_id") == F.col("_rid"), "left")
    return x.select("audio_id", "filename", "job_status", "job_priority", "attempts", "last_error", F.col("latest_run_id").alias("run_id"), "run_status", "run_attempt", "run_error", F.coalesce("_sec", F.lit(0.0)).alias("processing_total_seconds"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): calls, calls not skipped, jobs by present status of all stages, transcripts and current ones of calls not skipped."""
    calls, jobs, transcripts = tables["audio_files"], tables["jobs"], tables["transcripts"]
    skipped = jobs.where((F.col("stage") == STAGE) & (F.col("status") == "skipped")).select(F.col("audio_file_id").alias("_a"))
    live = transcripts.join(jobs.where(F.col("stage") == STAGE).select(F.col("audio_file_id").alias("_a"), "status"), F.col("audio_file_id") == F.col("_a")).where("status <> 'skipped'")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = one(calls, "total_audio_files").unionByName(one(calls.join(skipped, F.col("id") == F.col("_a"), "left_anti"), "audio_files"))
    out = out.unionByName(jobs.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")))
    sums = live.agg(F.count("*").alias("t"), F.count_if("is_current").alias("c"))
    return out.unionByName(sums.select(F.lit("transcripts").alias("name"), F.col("t").alias("n"))).unionByName(sums.select(F.lit("current_transcripts").alias("name"), F.col("c").alias("n")))


def recent_transcripts(tables: dict[str, DataFrame], limit: int = 20) -> DataFrame:
    live = tables["jobs"].where((F.col("stage") == STAGE) & (F.col("status") != "skipped")).select(F.col("audio_file_id").alias("_a"))
    x = tables["transcripts"].join(live, F.col("audio_file_id") == F.col("_a"), "left_semi").join(tables["audio_files"].select(F.col("id").alias("_c"), "filename"), F.col("audio_file_id") == F.col("_c"))
    return x.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("filename", "version", "source", "created_at")


def review_versions(tables: dict[str, DataFrame]) -> DataFrame:
    """Per call: the current version with its review and all versions, newest first."""
    t = tables["transcripts"]
    listed = t.groupBy("audio_file_id").agg(F.sort_array(F.collect_list(F.struct("version", "id", "source")), asc=False).alias("versions"))
    r = tables["transcript_reviews"].select(F.col("transcript_id").alias("_t"), "status")
    x = t.where("is_current").select("audio_file_id", F.col("id").alias("transcript_id")).join(r, F.col("transcript_id") == F.col("_t"), "left").join(listed, "audio_file_id")
    return x.select("audio_file_id", "transcript_id", F.coalesce("status", F.lit("needs_review")).alias("status"), F.transform("versions", lambda v: v["version"]).alias("versions"))


def unresolved(text: str = "text", tier: str = "confidence_tier", flags: str = "flags") -> Column:
    """Does a segment wait for a human?"""
    return T.has_marker(text) | F.coalesce(F.col(tier) == "unresolved", F.lit(False)) | F.coalesce(F.array_contains(flags, "unclear"), F.lit(False))


def review_queue(segments: DataFrame, tables: dict[str, DataFrame], call: str = "call_id", full: bool = False) -> DataFrame:
    """Unresolved segments of current, unapproved transcripts, with the texts before and after.

    segments: (call, index, id, start, end, speaker, text, flags, confidence_tier), and if known reason, notes and
    candidates (``review.suggestions`` by segment).  With ``full`` also these, and the call's names and duration.
    """
    w = Window.partitionBy(call).orderBy("index")
    s = segments.withColumn("context_before", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("context_after", F.coalesce(F.lead("text").over(w), F.lit(""))).where(unresolved())
    j = tables["jobs"].where((F.col("stage") == STAGE) & ~F.col("status").isin("running", "skipped")).select(F.col("audio_file_id").alias("_a"))
    t = tables["transcripts"].where("is_current").join(j, F.col("audio_file_id") == F.col("_a"), "left_semi").select(F.col("audio_file_id").alias("_ta"), F.col("id").alias("transcript_id"), F.col("version").alias("transcript_version"))
    r = tables["transcript_reviews"].select(F.col("transcript_id").alias("_t"), F.col("status").alias("_s"))
    x = s.join(t, F.col(call) == F.col("_ta")).join(r, F.col("transcript_id") == F.col("_t"), "left").withColumn("review_status", F.coalesce("_s", F.lit("needs_review"))).where("review_status <> 'approved'")
    key = F.concat_ws(":", F.col(call).cast("string"), F.col("transcript_id").cast("string"), F.col("id"))
    more = []
    if full:
        named = tables["audio_files"].select(F.col("id").alias("_ca"), "filename", "relative_path", "duration_seconds")
        x = x.join(named, F.col(call) == F.col("_ca"))
        text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in x.columns else F.lit("")
        more = ["filename", "relative_path", "duration_seconds", F.when(text("reason") == "", "unclear").otherwise(text("reason")).alias("reason"), text("notes").alias("notes"), *(c for c in ("candidates",) if c in x.columns)]
    return x.select(key.alias("key"), F.col(call).alias("audio_id"), "transcript_id", "transcript_version", "review_status", F.col("id").alias("segment_id"), "start", "end", "speaker", "text", "context_before", "context_after", *more)


def correction_examples(corrections: DataFrame, calls: DataFrame, limit: int = 500) -> DataFrame:
    return corrections.join(calls.select(F.col("id").alias("_c"), "filename"), F.col("audio_file_id") == F.col("_c")).drop("_c").orderBy(F.desc("id")).limit(limit)
