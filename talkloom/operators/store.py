"""State changes as pure functions: old snapshot and input in, new snapshot out.

Tables are Parquet snapshots with one writer; ``publish_snapshot`` in the sinks
writes the new one beside the old.  Every function is a join or a window keyed
by call, never a loop over calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.sources.scratch import kept

STAGE = "transcribe"


def is_short(duration: Column) -> Column:
    """Below half a second; an unknown duration isn't."""
    return F.coalesce(duration < C.SHORTEST_CALL, F.lit(False))


NUMBERED = 4096


def next_ids(df: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Ids above the largest existing one, without gaps, by NUMBERED hash classes of ``order`` and by ``order`` within each.

    Only the classes' counts meet in one task; the rows of a class are numbered where they are.  The rows are written in
    between, so that what they come from is computed once, and plans stay small.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    x = kept(df.withColumn("_class", F.pmod(F.xxhash64(*order), F.lit(NUMBERED))))
    below = F.sum("_n").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1))
    starts = x.groupBy("_class").agg(F.count("*").alias("_n")).select("_class", F.coalesce(below, F.lit(0)).alias("_below"))
    starts = starts.join(F.broadcast(top))  # one row
    numbered = x.withColumn("_row", F.row_number().over(Window.partitionBy("_class").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_class").withColumn("id", F.col("_top") + F.col("_below") + F.col("_row")).drop("_top", "_class", "_below", "_row")  # at most NUMBERED rows


def upsert_calls(calls: DataFrame, jobs: DataFrame, transcripts: DataFrame, scanned: DataFrame, now: Column, max_attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applies a scan.  calls and scanned are keyed by absolute_path; returns new (calls, jobs, transcripts).

    A new call gets a job, pending or skipped if short.  Changed content retires the call's transcripts and
    resets its job; unchanged content only moves the job between skipped and pending.  Running jobs stay.
    """
    fields = [c for c in scanned.columns if c != "absolute_path"]
    old = calls.select("absolute_path", "id", "discovered_at", F.col("content_sha256").alias("_hash"))
    seen = scanned.join(old, "absolute_path", "left")
    known = seen.where("id is not null")
    fresh = next_ids(seen.where("id is null").drop("id"), calls, ["absolute_path"])
    cols = ["id", "absolute_path", *fields, F.coalesce("discovered_at", now).alias("discovered_at"), now.alias("updated_at")]
    gone = calls.join(scanned.select("absolute_path"), "absolute_path", "left_anti")
    touched = known.select(*cols).unionByName(fresh.select(*cols))
    new_calls = gone.unionByName(touched, allowMissingColumns=True).select(*calls.columns)

    change = known.select(F.col("id").alias("_a"), (~F.col("_hash").eqNullSafe(F.col("content_sha256"))).alias("_changed"), is_short(F.col("duration_seconds")).alias("_short"))
    j = jobs.join(change, (F.col("audio_file_id") == F.col("_a")) & (F.col("stage") == STAGE), "left")
    free = F.col("_a").isNotNull() & (F.col("status") != "running")
    reset = free & F.col("_changed")
    skip = free & ~F.col("_changed") & F.col("_short")
    wake = free & ~F.col("_changed") & ~F.col("_short") & (F.col("status") == "skipped")
    any_ = reset | skip | wake
    target = F.when(F.col("_short"), "skipped").otherwise("pending")
    changed = {
        "status": F.when(any_, target).otherwise(F.col("status")),
        "priority": F.when(reset | skip, 0).otherwise(F.col("priority")),
        "attempts": F.when(reset | wake, 0).otherwise(F.col("attempts")),
        "claimed_by": F.when(reset | skip, F.lit(None)).otherwise(F.col("claimed_by")),
        "claimed_at": F.when(reset | skip, F.lit(None)).otherwise(F.col("claimed_at")),
        "lease_expires_at": F.when(reset | skip, F.lit(None)).otherwise(F.col("lease_expires_at")),
        "last_error": F.when(reset | skip, F.lit(None)).otherwise(F.col("last_error")),
        "updated_at": F.when(any_, now).otherwise(F.col("updated_at")),
    }
    changed_jobs = j.select(*(F.coalesce(changed[c], F.col(c)).alias(c) if c == "status" else changed.get(c, F.col(c)).alias(c) for c in jobs.columns))
    lone = touched.select(F.col("id").alias("audio_file_id"), "duration_seconds").join(jobs.where(F.col("stage") == STAGE).select("audio_file_id"), "audio_file_id", "left_anti")
    added = next_ids(lone, jobs, ["audio_file_id"]).select("id", "audio_file_id", F.lit(STAGE).alias("stage"), F.when(is_short(F.col("duration_seconds")), "skipped").otherwise("pending").alias("status"), F.lit(0).cast("long").alias("priority"), F.lit(0).cast("long").alias("attempts"), F.lit(max_attempts).cast("long").alias("max_attempts"), now.alias("created_at"), now.alias("updated_at"))
    new_jobs = changed_jobs.unionByName(added, allowMissingColumns=True).select(*jobs.columns)

    t = transcripts.join(change.where("_changed").select("_a"), F.col("audio_file_id") == F.col("_a"), "left")
    new_transcripts = t.withColumn("is_current", F.col("is_current") & F.col("_a").isNull()).select(*transcripts.columns)
    return new_calls, new_jobs, new_transcripts


def add_versions(transcripts: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Appends one new version per call of ``incoming`` (audio_file_id, content, source, audio_content_hash, forced, ...).

    Content equal to the current version's adds nothing unless forced.
    """
    current = transcripts.where("is_current").select("audio_file_id", F.col("content_hash").alias("_hash"))
    last = transcripts.groupBy("audio_file_id").agg(F.max("version").alias("_v"))
    x = incoming.withColumn("content_hash", F.sha2("content", 256)).join(current, "audio_file_id", "left").join(last, "audio_file_id", "left")
    x = x.where(~F.col("_hash").eqNullSafe(F.col("content_hash")) | F.coalesce("forced", F.lit(False)))
    x = next_ids(x, transcripts, ["audio_file_id"]).withColumn("version", F.coalesce("_v", F.lit(0)) + 1).withColumn("is_current", F.lit(True)).withColumn("created_at", now).withColumn("unclear_count", T.marker_count("content").cast("long"))
    x = x.drop("_hash", "_v", "forced")
    replaced = transcripts.join(x.select(F.col("audio_file_id").alias("_a")), F.col("audio_file_id") == F.col("_a"), "left")
    old = replaced.withColumn("is_current", F.col("is_current") & F.col("_a").isNull()).select(*transcripts.columns)
    return old.unionByName(x, allowMissingColumns=True).select(*transcripts.columns)


def _free() -> dict[str, Column]:
    """A job that nobody works on."""
    return {"claimed_by": F.lit(None), "claimed_at": F.lit(None), "lease_expires_at": F.lit(None)}


def changed(df: DataFrame, hit: Column, new: dict[str, Column], columns: list[str]) -> DataFrame:
    """``columns`` of a table with new values in the rows that are hit."""
    return df.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns))


def expire_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has passed are pending again."""
    gone = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.lit(False))
    new = {"status": F.lit("pending"), "claimed_by": F.lit(None), "claimed_at": F.lit(None), "lease_expires_at": F.lit(None), "last_error": F.lit("Previous worker lease expired"), "updated_at": now}
    return changed(jobs, gone, new, jobs.columns)


def claim(jobs: DataFrame, calls: DataFrame, limit: int, worker: str, now: Column, lease_seconds: int = 7200, audio_id: int | None = None) -> DataFrame:
    """New jobs table with up to ``limit`` pending jobs running for a worker, by priority and id."""
    open_ = expire_leases(jobs, now)
    long_enough = calls.where(~is_short(F.col("duration_seconds"))).select(F.col("id").alias("audio_file_id"))
    ready = open_.where((F.col("stage") == STAGE) & (F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts")))
    if audio_id is not None:
        ready = ready.where(F.col("audio_file_id") == audio_id)
    chosen = ready.join(long_enough, "audio_file_id", "left_semi").orderBy(F.desc("priority"), "id").limit(limit).select(F.col("id").alias("_id"))
    x = open_.join(F.broadcast(chosen), F.col("id") == F.col("_id"), "left")  # at most ``limit`` rows
    mine = F.col("_id").isNotNull()
    new = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimed_by": F.lit(worker), "claimed_at": now, "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds)), "last_error": F.lit(None), "updated_at": now}
    return changed(x, mine, new, jobs.columns)


def queue(jobs: DataFrame, calls: DataFrame, requested: DataFrame, now: Column) -> DataFrame:
    """User requests (audio_file_id): pending with priority 1000 and no attempts, unless running or too short."""
    able = calls.where(~is_short(F.col("duration_seconds"))).select(F.col("id").alias("_a")).join(requested.select(F.col("audio_file_id").alias("_a")).distinct(), "_a", "left_semi")
    x = jobs.join(able, (F.col("audio_file_id") == F.col("_a")) & (F.col("stage") == STAGE), "left")
    hit = F.col("_a").isNotNull() & (F.col("status") != "running")
    new = {"status": F.lit("pending"), "priority": F.lit(1000).cast("long"), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None), **_free(), "updated_at": now}
    return changed(x, hit, new, jobs.columns)


def finish(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Applies outcomes (audio_file_id, ok, error, retryable) to running jobs."""
    o = outcomes.select(F.col("audio_file_id").alias("_a"), "ok", "error", F.coalesce("retryable", F.lit(True)).alias("_again"))
    x = jobs.join(o, (F.col("audio_file_id") == F.col("_a")) & (F.col("stage") == STAGE) & (F.col("status") == "running"), "left")
    hit = F.col("_a").isNotNull()
    status = F.when(F.col("ok"), "completed").when(F.col("_again") & (F.col("attempts") < F.col("max_attempts")), "pending").otherwise("failed")
    new = {"status": status, "last_error": F.when(F.col("ok"), F.lit(None)).otherwise(F.col("error")), "claimed_by": F.lit(None), "claimed_at": F.lit(None), "lease_expires_at": F.lit(None), "updated_at": now}
    return changed(x, hit, new, jobs.columns)


def retry_failed(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed jobs of any stage are pending with no attempts."""
    hit = F.col("status") == "failed"
    new = {"status": F.lit("pending"), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None), **_free(), "updated_at": now}
    return changed(jobs, hit, new, jobs.columns)


def under(path: Column, target: str) -> Column:
    """Is a path the target or below it?"""
    return (path == target) | F.startswith(path, F.lit(target.rstrip("/") + "/"))


def reset(tables: dict[str, DataFrame], target: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes calls (all, or under a path) from every table; with a one-row audit (matched, running).

    If one of the calls has a running job, nothing is deleted.
    """
    calls, jobs = tables["audio_files"], tables["jobs"]
    doomed = calls.where(under(F.col("absolute_path"), target)) if target else calls
    doomed = doomed.select(F.col("id").alias("_a"))
    running = jobs.where("status = 'running'").join(doomed, F.col("audio_file_id") == F.col("_a"), "left_semi")
    audit = doomed.agg(F.count("*").alias("matched")).join(F.broadcast(running.agg(F.count("*").alias("running"))))  # one row
    gone = doomed.join(F.broadcast(audit.where("running = 0").select(F.lit(1).alias("_go"))))
    lost_transcripts = tables["transcripts"].join(gone, F.col("audio_file_id") == F.col("_a"), "left_semi").select(F.col("id").alias("_t"))
    lost_runs = tables["processing_runs"].join(gone, F.col("audio_file_id") == F.col("_a"), "left_semi").select(F.col("id").alias("_r"))
    key = {"audio_files": ("id", gone, "_a"), "transcript_reviews": ("transcript_id", lost_transcripts, "_t"), "run_evidence": ("processing_run_id", lost_runs, "_r")}
    out = {}
    for name, df in tables.items():
        column, lost, other = key.get(name, ("audio_file_id", gone, "_a"))
        out[name] = df.join(lost, F.col(column) == F.col(other), "left_anti")
    return out, audit
