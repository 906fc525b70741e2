"""Runs, imports, reviews and corrections as pure functions over the tables.

``tables`` holds audio_files, jobs, processing_runs, transcripts, transcript_reviews and, where a function says so,
run_evidence and review_corrections.  A function returns the tables it changed beside the others; columns that a
table doesn't have are left out.  Requests that are refused come back with a reason and change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.operators.evidence import markdown
from talkloom.operators.listing import unresolved
from talkloom.operators.store import STAGE, _free, add_versions, changed, next_ids

Tables = dict[str, DataFrame]


def _versions(tables: Tables, incoming: DataFrame, now: Column) -> DataFrame:
    """Transcripts with the new versions of ``incoming`` (audio_file_id, content, ...), made for the audio as it is."""
    audio = tables["audio_files"].select(F.col("id").alias("audio_file_id"), F.col("content_sha256").alias("audio_content_hash"))
    return add_versions(tables["transcripts"], incoming.join(audio, "audio_file_id"), now)


def _current(transcripts: DataFrame) -> DataFrame:
    return transcripts.where("is_current").select("audio_file_id", F.col("id").alias("transcript_id"))


def _added(df: DataFrame, rows: DataFrame) -> DataFrame:
    rows = rows.select(*(c for c in rows.columns if c in df.columns))
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def _replaced(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return _added(df.join(rows.select(key), key, "left_anti").select(*df.columns), rows)


def start_runs(tables: Tables, claimed: DataFrame, now: Column) -> Tables:
    """One running run for each claimed job; claimed: (job_id, further run columns such as log_path)."""
    j = tables["jobs"].select(F.col("id").alias("job_id"), "audio_file_id", "stage", F.col("claimed_by").alias("worker_id"), F.col("attempts").alias("attempt"))
    x = claimed.join(j, "job_id").withColumn("status", F.lit("running")).withColumn("started_at", now)
    return tables | {"processing_runs": _added(tables["processing_runs"], next_ids(x, tables["processing_runs"], ["job_id"]))}


def _with_evidence(tables: Tables, results: DataFrame) -> Tables:
    if "run_evidence" not in tables or "evidence" not in results.columns:
        return {}
    rows = results.where("evidence is not null").select(F.col("run_id").alias("processing_run_id"), "directory", F.col("evidence").alias("evidence_json"))
    return {"run_evidence": _replaced(tables["run_evidence"], rows, "processing_run_id")}


def complete_runs(tables: Tables, results: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Publishes finished runs.  results: (job_id, run_id, content, source, language, markdown_path, thread_id, quality JSON, complete).

    A result whose review or speakers are incomplete is refused.  With ``quality`` the version is new even if its text is
    not.  The review of the version starts again.
    """
    refused = results.where(~F.coalesce("complete", F.lit(True))).select("job_id", "run_id", F.lit("incomplete review").alias("error"))
    good = results.where(F.coalesce("complete", F.lit(True))).join(tables["jobs"].select(F.col("id").alias("job_id"), "audio_file_id"), "job_id")
    incoming = good.select("audio_file_id", "content", "source", "language", "markdown_path", F.col("run_id").alias("processing_run_id"), F.col("quality").isNotNull().alias("forced"))
    transcripts = _versions(tables, incoming, now)
    reviews = good.join(_current(transcripts), "audio_file_id").select("transcript_id", F.lit("needs_review").alias("status"), F.coalesce("quality", F.lit("{}")).alias("data_json"), F.lit(True).alias("markdown_synced"), now.alias("created_at"))
    done = good.select(F.col("job_id").alias("_j"), F.col("run_id").alias("_r"), "thread_id")
    runs = tables["processing_runs"].join(done, F.col("id") == F.col("_r"), "left")
    jobs = tables["jobs"].join(done.select("_j"), F.col("id") == F.col("_j"), "left")
    return tables | _with_evidence(tables, good) | {
        "transcripts": transcripts,
        "transcript_reviews": _replaced(tables["transcript_reviews"], reviews, "transcript_id"),
        "processing_runs": changed(runs, F.col("_r").isNotNull(), {"status": F.lit("completed"), "thread_id": F.col("thread_id"), "finished_at": now}, tables["processing_runs"].columns),
        "jobs": changed(jobs, F.col("_j").isNotNull(), {"status": F.lit("completed"), "last_error": F.lit(None), **_free(), "updated_at": now}, tables["jobs"].columns),
    }, refused


def fail_runs(tables: Tables, failures: DataFrame, now: Column) -> Tables:
    """Failed runs (job_id, run_id, error, retryable); the job waits again while it may be tried and has attempts left."""
    f = failures.select(F.col("job_id").alias("_j"), F.col("run_id").alias("_r"), F.col("error").alias("_error"), F.coalesce("retryable", F.lit(True)).alias("_again"))
    runs = tables["processing_runs"].join(f, F.col("id") == F.col("_r"), "left")
    jobs = tables["jobs"].join(f, F.col("id") == F.col("_j"), "left")
    status = F.when(F.col("_again") & (F.col("attempts") < F.col("max_attempts")), "pending").otherwise("failed")
    return tables | _with_evidence(tables, failures) | {
        "processing_runs": changed(runs, F.col("_r").isNotNull(), {"status": F.lit("failed"), "error": F.col("_error"), "finished_at": now}, tables["processing_runs"].columns),
        "jobs": changed(jobs, F.col("_j").isNotNull(), {"status": status, "last_error": F.col("_error"), **_free(), "updated_at": now}, tables["jobs"].columns),
    }


def import_markdown(tables: Tables, documents: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Documents found beside recordings (audio_file_id, content) become versions; the job is completed.

    Blank ones, and those of skipped or running calls, are left.  Also returns (imported), the count of new versions.
    """
    busy = tables["jobs"].where((F.col("stage") == STAGE) & F.col("status").isin("skipped", "running")).select("audio_file_id")
    good = documents.where(T.collapse("content") != "").join(busy, "audio_file_id", "left_anti")
    transcripts = _versions(tables, good.withColumn("source", F.lit("existing_markdown")).withColumn("forced", F.lit(False)), now)
    x = tables["jobs"].join(good.select(F.col("audio_file_id").alias("_a")), (F.col("audio_file_id") == F.col("_a")) & (F.col("stage") == STAGE), "left")
    jobs = changed(x, F.col("_a").isNotNull(), {"status": F.lit("completed"), "last_error": F.lit(None), "updated_at": now}, tables["jobs"].columns)
    fresh = transcripts.join(tables["transcripts"].select("id"), "id", "left_anti").agg(F.count("*").alias("imported"))
    return tables | {"transcripts": transcripts, "jobs": jobs}, fresh


def _asked(requests: DataFrame, tables: Tables) -> DataFrame:
    """Requests with the state of their call: _status, _current, _made_for, _audio, duration_seconds, _known."""
    a = tables["audio_files"].select(F.col("id").alias("audio_file_id"), "duration_seconds", F.col("content_sha256").alias("_audio"), F.lit(True).alias("_known"))
    j = tables["jobs"].where(F.col("stage") == STAGE).select("audio_file_id", F.col("status").alias("_status"))
    t = tables["transcripts"].where("is_current").select("audio_file_id", F.col("id").alias("_current"), F.col("audio_content_hash").alias("_made_for"))
    return requests.join(a, "audio_file_id", "left").join(j, "audio_file_id", "left").join(t, "audio_file_id", "left")


def _blank(c: str) -> Column:
    return T.collapse(F.coalesce(c, F.lit(""))) == ""


def _state_error(error: Column) -> Column:
    """Reasons that lie in the call, after those in ``error``."""
    return (
        error.when(F.col("_known").isNull(), "unknown call")
        .when(F.coalesce(F.col("_status").isin("running", "skipped"), F.lit(False)), "call in progress or skipped")
        .when(~F.col("_current").eqNullSafe(F.col("base_transcript_id")) | F.col("_current").isNull(), "stale base version")
        .when(~F.col("_made_for").eqNullSafe(F.col("_audio")), "audio changed")
    )


def check_reviews(requests: DataFrame, tables: Tables, segments: DataFrame, previous: DataFrame) -> DataFrame:
    """Requests with the reason to refuse each, null if none.

    requests: (audio_file_id, base_transcript_id, status, reviewer, notes, content); segments: the reviewed ones
    (audio_file_id, id, start, end, text, speaker, uncertain); previous: (audio_file_id, id) of the current versions.
    """
    x = _asked(requests, tables)
    s = segments.join(x.select("audio_file_id", "duration_seconds").distinct(), "audio_file_id")
    inside = T.finite(F.col("start")) & T.finite(F.col("end")) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.coalesce("duration_seconds", F.lit(0.0)) + 0.1)
    of = s.groupBy("audio_file_id").agg(
        F.count("*").alias("_n"),
        (F.count("id") != F.count_distinct("id")).alias("_dup"),
        F.max(~F.coalesce(inside, F.lit(False))).alias("_range"),
        F.max(_blank("text") | (F.length("text") > 20_000)).alias("_text"),
        F.max(_blank("speaker") | (F.length("speaker") > 200)).alias("_speaker"),
        F.max(F.coalesce("uncertain", F.lit(False)) | T.has_marker("text")).alias("_open"),
    )
    gone = previous.join(segments, ["audio_file_id", "id"], "left_anti").groupBy("audio_file_id").agg(F.lit(True).alias("_gone"))
    had = previous.select("audio_file_id").distinct().withColumn("_had", F.lit(True))
    x = x.join(of, "audio_file_id", "left").join(gone, "audio_file_id", "left").join(had, "audio_file_id", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    timed = F.col("_n").isNotNull()
    unexplained = (F.col("status") == "approved") & _blank("notes")
    first = (
        F.when(~F.coalesce(F.col("status").isin("in_review", "approved"), F.lit(False)), "invalid status")
        .when(_blank("reviewer") | (F.length("reviewer") > 200), "no reviewer")
        .when(F.length(F.coalesce("notes", F.lit(""))) > 10_000, "invalid notes")
    )
    error = (
        _state_error(first)
        .when(F.coalesce(F.col("_n") > 10_000, F.lit(False)), "too many segments")
        .when(is_("_range"), "segment out of range")
        .when(is_("_text"), "segment without text")
        .when(is_("_speaker"), "segment without speaker")
        .when(is_("_dup"), "duplicate segment id")
        .when(~timed & is_("_had"), "segments required")
        .when(~timed & _blank("content"), "no text")
        .when(unexplained & timed & (is_("_gone") | is_("_open")), "notes required")
        .when(unexplained & ~timed & T.has_marker("content"), "notes required")
    )
    return x.select(*requests.columns, error.alias("error"))


def _one_each(checked: DataFrame, order: list[str]) -> DataFrame:
    """Of several accepted requests on one call the first is taken; the others then have a stale base."""
    w = Window.partitionBy("audio_file_id", F.col("error").isNull()).orderBy(*order)
    late = F.col("error").isNull() & (F.row_number().over(w) > 1)
    return checked.withColumn("error", F.when(late, "stale base version").otherwise(F.col("error")))


def _revised(tables: Tables, revisions: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Tables with a forced human version and its review each; revisions: (audio_file_id, content, status, reviewer, notes, data_json, base_transcript_id)."""
    incoming = revisions.select("audio_file_id", "content", F.lit("human_review").alias("source"), F.lit(True).alias("forced"))
    transcripts = _versions(tables, incoming, now)
    made = revisions.join(_current(transcripts), "audio_file_id")
    reviews = made.select("transcript_id", "status", F.trim("reviewer").alias("reviewer"), "notes", "data_json", "base_transcript_id", now.alias("created_at"))
    return tables | {"transcripts": transcripts, "transcript_reviews": _added(tables["transcript_reviews"], reviews)}, made


def _data(rows: DataFrame) -> DataFrame:
    """(audio_file_id, data_json) with the segments in time order."""
    one = F.struct("start", "end", "id", "text", "speaker", "uncertain", "flags")
    return rows.groupBy("audio_file_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("segments"))).alias("data_json"))


def save_reviews(tables: Tables, requests: DataFrame, segments: DataFrame, previous: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Applies the reviews that ``check_reviews`` accepts; returns the tables and the refused requests with their reasons.

    A review of segments is rendered anew; one without segments has its own content.
    """
    checked = _one_each(check_reviews(requests, tables, segments, previous), ["status", "reviewer", "notes", "content"])
    good = checked.where("error is null").drop("error")
    rows = segments.join(good.select("audio_file_id"), "audio_file_id", "left_semi").withColumn("text", F.trim("text")).withColumn("speaker", F.trim("speaker")).withColumn("flags", T.text_flags("text"))
    names = tables["audio_files"].select(F.col("id").alias("audio_file_id"), "filename")
    heads = good.join(names, "audio_file_id").select("audio_file_id", "filename", (F.col("status") == "approved").alias("human_reviewed"))
    timed = rows.select("audio_file_id").distinct()
    shown = markdown(rows, heads.join(timed, "audio_file_id", "left_semi"), "audio_file_id").withColumnRenamed("content", "_shown")
    revisions = good.join(shown, "audio_file_id", "left").join(_data(rows), "audio_file_id", "left")
    revisions = revisions.withColumn("content", F.coalesce("_shown", "content")).withColumn("data_json", F.coalesce("data_json", F.lit("{}")))
    out, _ = _revised(tables, revisions, now)
    return out, checked.where("error is not null")


def check_corrections(requests: DataFrame, tables: Tables, segments: DataFrame) -> DataFrame:
    """Corrections with the text they set, its source and the reason to refuse each, null if none.

    requests: (audio_file_id, base_transcript_id, segment_id, reviewer, candidate_id, custom_text); segments: those of the
    current versions (audio_file_id, id, text, flags, confidence_tier, candidates array of (id, text)).
    """
    s = segments.withColumn("_open", unresolved()).groupBy("audio_file_id", F.col("id").alias("segment_id")).agg(F.count("*").alias("_n"), F.first("text").alias("original_text"), F.first("candidates").alias("candidates"), F.max("_open").alias("_open"))
    x = _asked(requests, tables).join(s, ["audio_file_id", "segment_id"], "left")
    picked = F.col("candidate_id").isNotNull()
    chosen = F.get(F.filter("candidates", lambda c: c["id"] == F.col("candidate_id")), F.lit(0))["text"]
    x = x.withColumn("corrected_text", F.when(picked, chosen).otherwise(T.collapse("custom_text"))).withColumn("selection_source", F.when(picked, "candidate").otherwise("custom"))
    before = F.trim(F.coalesce("original_text", F.lit("")))
    # white space that only the collapse of a custom text takes away is no correction
    unaltered = ~picked & (F.trim("custom_text") == before)
    error = (
        _state_error(F.when(_blank("reviewer") | (F.length("reviewer") > 200), "no reviewer"))
        .when(F.coalesce("_n", F.lit(0)) != 1, "unknown segment")
        .when(~F.coalesce("_open", F.lit(False)), "segment is resolved")
        .when(_blank("corrected_text") | (F.length("corrected_text") > 20_000), "no text")
        .when(T.has_marker("corrected_text"), "still unresolved")
        .when((F.col("corrected_text") == before) | unaltered, "no change")
    )
    return x.select(*requests.columns, "original_text", "corrected_text", "selection_source", error.alias("error"))


def save_corrections(tables: Tables, requests: DataFrame, segments: DataFrame, now: Column) -> tuple[Tables, DataFrame, DataFrame]:
    """Applies accepted corrections, one a call; returns the tables, the segments of the new versions and the refused requests.

    segments: (audio_file_id, index, id, start, end, text, speaker, uncertain, flags, confidence_tier, reason, candidates).
    ``tables`` also holds review_corrections.
    """
    checked = _one_each(check_corrections(requests, tables, segments), ["segment_id", "corrected_text"])
    good = checked.where("error is null")
    mine = segments.join(good.select("audio_file_id", "segment_id", "corrected_text"), "audio_file_id")
    hit = F.col("id") == F.col("segment_id")
    fixed = {
        "text": F.col("corrected_text"),
        "uncertain": F.lit(False),
        "flags": T.text_flags("corrected_text", flags=F.array_remove(F.coalesce("flags", F.array().cast("array<string>")), "unclear")),
        "confidence_tier": F.lit("human_corrected"),
        "reason": F.lit("human_review_correction"),
    }
    rows = changed(mine, hit, fixed, segments.columns)
    names = tables["audio_files"].select(F.col("id").alias("audio_file_id"), "filename")
    heads = good.join(names, "audio_file_id").select("audio_file_id", "filename", F.lit(False).alias("human_reviewed"))
    revisions = good.join(markdown(rows, heads, "audio_file_id"), "audio_file_id").join(_data(rows), "audio_file_id").withColumn("status", F.lit("in_review")).withColumn("notes", F.lit(C.CORRECTION_NOTE))
    out, made = _revised(tables, revisions, now)
    place = segments.select("audio_file_id", F.col("id").alias("segment_id"), F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.to_json("candidates").alias("candidates_json"))
    examples = made.join(place, ["audio_file_id", "segment_id"]).withColumn("source_transcript_id", F.col("base_transcript_id")).withColumn("result_transcript_id", F.col("transcript_id")).withColumn("reviewer", F.trim("reviewer")).withColumn("created_at", now)
    corrections = _added(tables["review_corrections"], next_ids(examples, tables["review_corrections"], ["audio_file_id", "segment_id"]))
    return out | {"review_corrections": corrections}, rows, checked.where("error is not null")
