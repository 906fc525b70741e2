"""Recovery of speech that no pass has text for.

Gaps are rows of a timeline; decoding happens outside and its results are rows
of retries, tried rung by rung (window, then decoder) for each group of gaps.
The first rung that gives text to a gap of its group is the one whose texts are
attached to the timeline's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.operators import evaluation, evidence, intervals
from talkloom.sources.scratch import kept

RECOVERED = "coverage_recovered"
#: Flags of rows that a selective retry may mend.
REPAIRABLE = ("repetition", "compression", "pass_disagreement", "speech_gap", "low_logprob", "invalid_asr_metrics", "decoder_truncated")


def gap_candidates(rows: DataFrame, speech: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without usable text that hold speech, with ``position`` from 0 by (start, end, id) in their call.

    rows: (keys, id, start, end, text, alternative, flags, retry_text: null if unusable); speech: (keys, start, end).
    A call of which no speech is known has speech everywhere.
    """
    poor = rows.where(evidence.unusable(F.col("text"), F.col("alternative"), F.col("flags"), F.col("retry_text")))
    heard = intervals.overlap_join(poor.select(*keys, "id", "start", "end"), speech.select(*keys, "start", "end"), keys).select(*keys, "id").distinct()
    known = speech.select(*keys).distinct()
    spoken = poor.join(heard, [*keys, "id"], "left_semi").unionByName(poor.join(known, keys, "left_anti"))
    return spoken.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "id")) - 1)


def plans(gaps: DataFrame, durations: DataFrame, keys: list[str], **limits) -> DataFrame:
    """Groups of gaps to decode together: (keys, plan from 0, gap_start, gap_end, ids, start, end, duration)."""
    grouped = intervals.retry_groups(gaps.select(*keys, "id", "start", "end").join(durations.select(*keys, "duration").where("duration > 0"), keys), keys, "duration", **limits)
    return grouped.withColumn("plan", F.row_number().over(Window.partitionBy(*keys).orderBy("gap_start", "gap_end")) - 1)


def recovered(plans: DataFrame, gaps: DataFrame, retries: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of the first rung of each plan that gives any: (keys, plan, attempt, provider, variant, id, text, segments).

    plans: (keys, plan, ids); gaps: (keys, id, start, end); retries: (keys, plan, attempt, provider, variant, status, index,
    s_start, s_end, text, avg_logprob, no_speech_prob, compression_ratio, words, prompt).  Rungs are tried by attempt, then
    by provider (its place in the cascade); of the variants of a rung that were decoded, the one with the fewest defects
    counts, of equal ones that with the smallest name.
    """
    rung = [*keys, "plan", "attempt", "provider"]
    done = retries.where(~F.coalesce(F.col("status").isin("unsupported", "failed"), F.lit(False)))
    texts = done.groupBy(*rung, "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("text"), F.first("prompt").alias("prompt"))
    as_segments = done.select(*rung, "variant", "index", F.col("s_start").alias("start"), F.col("s_end").alias("end"), "text", "avg_logprob", "no_speech_prob", "compression_ratio")
    best = kept(evaluation.choose_candidate(evaluation.candidate_defects(as_segments, texts, [*rung, "variant"]), rung, "variant"))
    chosen = done.join(best, [*rung, "variant"], "left_semi")
    wanted = plans.select(*keys, "plan", F.explode("ids").alias("id")).join(gaps.select(*keys, "id", "start", "end"), [*keys, "id"])
    heard = kept(evidence.retry_for_gaps(chosen, wanted.join(best.drop("variant"), [*keys, "plan"]).select(*rung, "start", "end").distinct(), rung))
    first = heard.groupBy(*keys, "plan").agg(F.min(F.struct("attempt", "provider")).alias("r")).select(*keys, "plan", "r.attempt", "r.provider")
    texts = heard.join(first, rung).join(best, rung).join(wanted, [*keys, "plan", "start", "end"])
    return texts.select(*rung, "variant", "id", "text", "segments")


def attach(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Timeline rows with the recovered texts (keys, id, text, segments): retry_text, retry_segments, and a flag."""
    t = texts.select(*keys, "id", F.col("text").alias("_t"), F.col("segments").alias("_s"))
    x = rows.join(t, [*keys, "id"], "left")
    found = F.col("_t").isNotNull()
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit(RECOVERED)))))
    changed = {"retry_text": F.when(found, F.col("_t")).otherwise(F.col("retry_text")), "flags": F.when(found, flags).otherwise(F.col("flags"))}
    segments = F.when(found, F.col("_s"))
    if "retry_segments" in rows.columns:
        segments = F.when(found, F.col("_s")).otherwise(F.col("retry_segments"))
    return x.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "retry_segments"), segments.alias("retry_segments"))


def summary(plans: DataFrame, texts: DataFrame, remaining: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per call: requested_windows, recovered_windows, recovered_segments, remaining_segments."""
    asked = plans.groupBy(*keys).agg(F.count("*").alias("requested_windows"))
    got = texts.groupBy(*keys).agg(F.count_distinct("plan").alias("recovered_windows"), F.count("*").alias("recovered_segments"))
    left = remaining.groupBy(*keys).agg(F.count("*").alias("remaining_segments"))
    x = calls.select(*keys).join(asked, keys, "left").join(got, keys, "left").join(left, keys, "left")
    return x.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requested_windows", "recovered_windows", "recovered_segments", "remaining_segments")))


def repairs(rows: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The rows of each call to retry one by one within its budget: ``place`` from 1 to ``most``, worst first, then by time; and the window (r_start, r_end).

    rows: (keys, id, start, end, flags, retry_text, duration).
    """
    x = rows.where(T.has_any(F.col("flags"), REPAIRABLE) & F.col("retry_text").isNull())
    x = x.withColumn("priority", T.retry_priority(F.col("flags")))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "start", "id"))).where(F.col("place") <= most)
    return x.select(*keys, "id", "priority", "place", F.greatest(F.lit(0.0), F.col("start") - 2).alias("r_start"), F.least(F.col("duration"), F.col("end") + 2).alias("r_end"))


def review_input(rows: DataFrame, calls: DataFrame, call: str = "call_id") -> DataFrame:
    """What a reviewer of a call is given: (call, duration_seconds, segments) with the fixed fields of each row and its usable retry, by time.

    rows may lack any of the fields; they are null then.
    """
    fields = ("id", "start", "end", "text", "alternative", "flags", "speaker", "consensus_text", "confidence_tier", "uncertainty_spans", "candidate_sources", "reason", "entity_resolutions", "entity_candidates", "retry_text")
    one = F.struct(*((F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in fields))
    listed = rows.groupBy(call).agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("id").alias("_i"), F.to_json(one).alias("_j")))).alias("_r"))
    x = calls.select(call, F.col("duration").alias("duration_seconds")).join(listed, call, "left")
    return x.select(call, "duration_seconds", F.coalesce(F.transform("_r", lambda s: s["_j"]), F.array().cast("array<string>")).alias("segments"))


def speaker_counters(rows: DataFrame, call: str = "call_id") -> DataFrame:
    """Per call: total rows, rows with a known speaker, rows that words refined, rows of mixed speakers."""
    known = ~F.coalesce(F.trim("speaker"), F.lit("")).isin(*C.UNKNOWN_LABELS)
    flagged = lambda f: T.has_any(F.col("flags"), (f,))
    return rows.groupBy(call).agg(F.count("*").alias("total"), F.count_if(known).alias("assigned"), F.count_if(flagged("word_aligned")).alias("refined"), F.count_if(flagged("mixed_speakers")).alias("mixed"))

