"""Frozen references: what a person approved, what a machine had before, and their scores, under one content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.operators import evaluation, intervals, speakers  # noqa: F401
from talkloom.sources.sinks import finite_rows

SPLITS = ("development", "holdout")
_TEXT = "struct<transcript_id:long,version:long,content:string,text:string>"
SCHEMA = f"schema_version int, split string, audio_id long, audio_sha256 string, duration_seconds double, direction string, reference {_TEXT}, baseline {_TEXT}, score struct<word_errors:long,reference_words:long,character_errors:long,reference_characters:long,matched_numbers:long,reference_numbers:long,hypothesis_numbers:long>, unresolved_token_rate double, content_hash string"


class Tampered(ValueError):
    pass


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the JSON of a row's columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def assemble(calls: DataFrame, transcripts: DataFrame, reviews: DataFrame, split: Column) -> tuple[DataFrame, DataFrame]:
    """(references, refused): a nested row for each call whose current version is approved, and (audio_id, reason) for the others.

    calls: (id, content_sha256, duration_seconds, direction); transcripts: (id, audio_file_id, version, content, source,
    audio_content_hash, is_current); reviews: (transcript_id, status).  The baseline is the last machine version before
    the approved one of the same sound.  ``split`` is an expression over the call's columns.
    """
    current = transcripts.where("is_current").join(reviews.select(F.col("transcript_id").alias("id"), "status"), "id", "left")
    current = current.select(F.col("audio_file_id").alias("audio_id"), "id", "version", "content", "audio_content_hash", "status")
    x = calls.select(F.col("id").alias("audio_id"), "content_sha256", "duration_seconds", "direction", split.alias("split")).join(current, "audio_id", "left")
    versions = transcripts.select("id", F.col("audio_file_id").alias("audio_id"), "version", "source", F.col("audio_content_hash").alias("audio_hash"))
    approved = x.where("status = 'approved'").select(F.col("id").alias("transcript_id"))
    base = evaluation.baselines(versions, approved).where("baseline_id IS NOT NULL").select("audio_id", "baseline_id")
    base = base.join(transcripts.select(F.col("id").alias("baseline_id"), F.col("version").alias("b_version"), F.col("content").alias("b_content")), "baseline_id")
    x = x.join(base, "audio_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("status") == "approved", F.lit(False)), "the current version is not approved")
        .when(F.col("baseline_id").isNull(), "no matching machine baseline")
        .when(~F.col("content_sha256").eqNullSafe(F.col("audio_content_hash")), "the audio has changed since the review")
        .when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "the split must be development or holdout")
    )
    x = x.withColumn("reason", reason)
    good = x.where("reason IS NULL")
    spoken = lambda c: T.transcript_text(F.col(c), F.lit(None).cast("array<string>"))
    text = lambda i, v, c: F.struct(F.col(i).alias("transcript_id"), F.col(v).alias("version"), F.col(c).alias("content"), spoken(c).alias("text")).cast(_TEXT)
    good = good.withColumns({"reference": text("id", "version", "content"), "baseline": text("baseline_id", "b_version", "b_content")})
    scored = T.score(F.col("reference.text"), F.col("baseline.text"))
    kind = SCHEMA.split("score ")[1].split(">")[0] + ">"
    names = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]
    markers = T.marker_count(F.col("baseline.text")) / F.greatest(F.lit(1), F.size(T.words("baseline.text")))
    good = good.withColumn("_s", scored).withColumns({"score": F.struct(*(F.col(f"_s.{n}").cast("long").alias(n) for n in names)), "unresolved_token_rate": markers.cast("double")})
    out = good.select(F.lit(1).alias("schema_version"), "split", "audio_id", F.col("audio_content_hash").alias("audio_sha256"), "duration_seconds", "direction", "reference", "baseline", "score", "unresolved_token_rate")
    out = finite_rows(out)
    return out.withColumn("content_hash", content_hash(out.columns)), x.where("reason IS NOT NULL").select("audio_id", "reason")


def freeze(references: DataFrame, path: str) -> None:
    """Writes references where nothing is yet."""
    references.write.mode("errorifexists").json(path)


def read(spark: SparkSession, path: str, split: str, calls: DataFrame | None = None) -> DataFrame:
    """Frozen references of a split; a row that was changed, occurs twice, has another schema or split, or whose call (id, content_sha256) has another sound now, is an error."""
    if split not in SPLITS:
        raise ValueError("the split must be development or holdout")
    x = spark.read.schema(SCHEMA).json(path)
    facts = [c for c in x.columns if c != "content_hash"]
    bad = F.when(F.col("schema_version").isNull() | (F.col("schema_version") != 1), "another schema").when(~F.col("split").eqNullSafe(split), "another split").when(~F.col("content_hash").eqNullSafe(content_hash(facts)), "changed after it was frozen")
    judged = x.select("audio_id", bad.alias("reason"))
    twice = x.groupBy("audio_id").count().where("count > 1").select("audio_id", F.lit("frozen twice").alias("reason"))
    judged = judged.where("reason IS NOT NULL").unionAll(twice)
    if calls is not None:
        now = calls.select(F.col("id").alias("audio_id"), "content_sha256")
        judged = judged.unionAll(x.select("audio_id", "audio_sha256").join(now, "audio_id", "left").where(~F.col("audio_sha256").eqNullSafe(F.col("content_sha256"))).select("audio_id", F.lit("the audio has changed").alias("reason")))
    first = judged.orderBy("audio_id", "reason").first()
    if first:
        raise Tampered(f"reference of call {first['audio_id']}: {first['reason']}")
    return x
