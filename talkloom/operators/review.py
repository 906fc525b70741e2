"""Suggestions for unresolved segments, and checks of review responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T


def safe_text(text: Column) -> Column:
    """The text on one line if it may be suggested, else null."""
    t = T.collapse(text)
    ok = (t != "") & (F.length(t) <= 20_000) & ~T.has_marker(t) & ~T.has_any(T.text_flags(t), C.REJECTED_SUGGESTION)
    return F.when(ok, t)


def suggestions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Full-segment suggestions of each row: (keys, position, candidate_id, source, source_label, text).

    rows: (keys, text, raw_text, consensus_text, alternative, retry_text, fragments array<string>,
    entities array<string>, flags).  A fragment fills the marker if there is exactly one.
    """
    pair = lambda source, text, fragment: F.struct(F.lit(source).alias("source"), text.alias("text"), F.lit(fragment).alias("fragment"))
    kind = "array<struct<source:string,text:string,fragment:boolean>>"
    leaked = T.has_any(F.col("flags"), ("alternative_prompt_leakage",))
    listed = F.concat(
        F.array(pair("raw", F.col("raw_text"), False), pair("consensus", F.col("consensus_text"), False), pair("alternative", F.when(~leaked, F.col("alternative")), False), pair("retry", F.col("retry_text"), False)),
        F.coalesce(F.transform("fragments", lambda x: pair("uncertainty", x, True)), F.array().cast(kind)),
        F.coalesce(F.transform("entities", lambda x: pair("entity", x, True)), F.array().cast(kind)),
    )
    current = F.trim(F.coalesce("text", F.lit("")))
    x = rows.select(*keys, current.alias("_cur"), F.posexplode(listed).alias("_pos", "_s")).select(*keys, "_cur", "_pos", "_s.*")
    plain = safe_text(F.col("text"))
    filled = F.when(T.marker_count("_cur") == 1, safe_text(F.replace("_cur", F.lit(C.MARKER), plain)))
    x = x.withColumn("text", F.when(F.col("fragment"), filled).otherwise(plain)).where("text is not null").withColumn("_key", T.normalize("text")).where((F.col("_key") != "") & (F.col("_key") != T.normalize("_cur")))
    best = x.groupBy(*keys, "_key").agg(F.min(F.struct("_pos", "source", "text")).alias("m")).select(*keys, "m.*")
    digest = F.substring(F.sha2(F.concat("source", F.char(F.lit(0)), "text"), 256), 1, 16)
    label = F.element_at(F.create_map(*(F.lit(v) for p in C.SUGGESTION_LABELS.items() for v in p)), F.col("source"))
    return best.select(*keys, F.col("_pos").alias("position"), F.concat_ws("-", "source", digest).alias("candidate_id"), "source", label.alias("source_label"), "text")


def review_errors(response: DataFrame, evidence: DataFrame, call: str = "call_id") -> DataFrame:
    """Reasons to reject a review response: (call, id, error).  response: (call, id, text, speaker, uncertain, notes)."""
    known = evidence.select(F.col(call).alias("_c"), F.col("id").alias("_i"))
    both = response.select(call, "id").withColumn("_in", F.lit(True)).join(known, (F.col(call) == F.col("_c")) & (F.col("id") == F.col("_i")), "full_outer")
    unmatched = both.where("_c is null").select(call, "id", F.lit("unknown segment").alias("error")).unionByName(both.where("_in is null").select(F.col("_c").alias(call), F.col("_i").alias("id"), F.lit("omitted segment").alias("error")))
    twice = response.groupBy(call, "id").count().where("count > 1").select(call, "id", F.lit("duplicate segment").alias("error"))
    text = F.trim(F.coalesce("text", F.lit("")))
    error = (
        F.when(text.isin("", "...", "…"), "empty text")
        .when(F.col("uncertain").isNull(), "uncertainty not marked")
        .when(F.trim(F.coalesce("speaker", F.lit(""))) == "", "no speaker")
        .when(F.col("notes").isNull(), "no notes")
        .when(T.repeats(text, 8), "repetition loop")
    )
    form = response.select(call, "id", error.alias("error")).where("error is not null")
    return unmatched.unionByName(twice).unionByName(form)


def apply_review(response: DataFrame, evidence: DataFrame, call: str = "call_id") -> DataFrame:
    """Evidence rows with the reviewed wording; numbers that no hypothesis has are masked, and flags, tier and spans follow.

    evidence: (call, id, start, end, text, alternative, retry_text, flags, confidence_tier); times stay the evidence's.
    """
    r = response.select(F.col(call).alias("_c"), F.col("id").alias("_i"), F.col("text").alias("_t"), "speaker", F.col("uncertain").alias("_u"), "notes")
    x = evidence.join(r, (F.col(call) == F.col("_c")) & (F.col("id") == F.col("_i"))).withColumnRenamed("text", "raw_text")
    sources = T.numbers(F.concat_ws(" ", "raw_text", "alternative", "retry_text"))
    unsupported = F.array_except(T.numbers("_t"), sources)
    # digit runs alternate with the text between them; masked ones are replaced in place
    between, runs = F.split("_t", r"\p{Nd}+", -1), F.regexp_extract_all("_t", F.lit(r"\p{Nd}+"), F.lit(0))
    masked = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(runs), F.lit(1))),
        F.get(between, F.lit(0)),
        lambda acc, i: F.concat(acc, F.coalesce(F.when(F.array_contains("_bad", T.normalize(F.get(F.col("_runs"), i - 1))), F.lit(C.MARKER)).otherwise(F.get(F.col("_runs"), i - 1)), F.lit("")), F.coalesce(F.get(F.col("_between"), i), F.lit(""))),
    )
    x = x.withColumn("_bad", unsupported).withColumn("_runs", runs).withColumn("_between", between)
    x = x.withColumn("text", F.when(F.size("_bad") > 0, masked).otherwise(F.col("_t")))
    flags = F.array_distinct(F.concat("flags", T.text_flags("_t")))
    broken = T.has_any(flags, ("invalid_asr_metrics", "decoder_truncated"))
    uncertain = F.col("_u") | broken | (F.size("_bad") > 0)
    extra = F.filter(F.array(F.when(F.size("_bad") > 0, F.lit("unsupported_number")), F.when(F.col("_u") & ~T.has_marker("text"), F.lit("uncertain_wording")), F.when(T.similarity(T.normalize("raw_text"), T.normalize("text")) < 0.25, F.lit("large_revision"))), lambda f: f.isNotNull())
    x = x.withColumn("uncertain", uncertain).withColumn("flags", F.array_sort(F.array_distinct(F.concat(flags, extra)))).withColumn("spans", T.marker_spans("text"))
    tier = F.when(F.size("spans") > 0, "unresolved").when(F.col("uncertain"), "low").otherwise(F.coalesce("confidence_tier", F.lit("medium")))
    return x.withColumn("confidence_tier", tier).drop("_c", "_i", "_t", "_u", "_bad", "_runs", "_between")
