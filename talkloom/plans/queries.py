"""Registered queries over the stand-in tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.operators import evaluation, evidence, intervals, lexicon, listing, review, speakers, store
from talkloom.plans import oracles
from talkloom.plans.standins import NOW, cte, table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


_STORE = ("audio_files", "jobs", "processing_runs", "transcripts", "transcript_reviews")
_BASE = f"""{cte(*_STORE)},
totals AS (SELECT audio_file_id, max(id) AS latest_run_id, sum(date_diff('microsecond', started_at, coalesce(finished_at, TIMESTAMP '{NOW}')) / 1000000.0) AS sec FROM processing_runs WHERE stage = 'transcribe' GROUP BY 1),
base AS (
  SELECT a.*, j.status AS job_status, j.priority AS job_priority, j.attempts, j.max_attempts, j.last_error, r.latest_run_id,
    coalesce(r.sec, 0.0) AS processing_total_seconds, t.id AS transcript_id, t.version AS transcript_version, t.source AS transcript_source, t.unclear_count,
    coalesce(v.status, 'needs_review') AS review_status
  FROM audio_files a LEFT JOIN jobs j ON j.audio_file_id = a.id AND j.stage = 'transcribe'
  LEFT JOIN transcripts t ON t.audio_file_id = a.id AND t.is_current AND (j.status IS NULL OR j.status <> 'skipped')
  LEFT JOIN transcript_reviews v ON v.transcript_id = t.id LEFT JOIN totals r ON r.audio_file_id = a.id)"""
_LIST = "id, filename, direction, remote_number, recorded_at, duration_seconds, job_status, job_priority, attempts, max_attempts, latest_run_id, processing_total_seconds, transcript_id, transcript_version, transcript_source, unclear_count, review_status"


@query(f"{_BASE} SELECT {_LIST} FROM base ORDER BY recorded_at DESC NULLS LAST, id DESC LIMIT 50")
def list_calls(spark, d):
    """The newest page of all calls (the page is the feature)."""
    return listing.page(listing.list_calls(tables(spark, d), _now()), 50)


@query(f"{_BASE} SELECT {_LIST} FROM base WHERE (lower(filename) LIKE '%-urgent%' OR lower(relative_path) LIKE '%-urgent%' OR remote_number LIKE '%-urgent%' OR lower(call_id) LIKE '%-urgent%') AND direction = 'inbound' AND transcript_id IS NOT NULL")
def search_calls(spark, d):
    return listing.list_calls(tables(spark, d), _now(), search="-URGENT", direction="inbound", transcript="yes", status="unknown")


@query(f"{_BASE} SELECT {_LIST} FROM base WHERE transcript_id IS NOT NULL AND review_status = 'in_review' AND job_status <> 'skipped'")
def calls_in_review(spark, d):
    return listing.list_calls(tables(spark, d), _now(), review="in_review")


@query(f"{_BASE} SELECT {_LIST}, r.status AS latest_run_status, r.attempt AS latest_run_attempt FROM base LEFT JOIN processing_runs r USING (id)".replace("LEFT JOIN processing_runs r USING (id)", "LEFT JOIN (SELECT id AS rid, status, attempt FROM processing_runs) r ON r.rid = latest_run_id"))
def call_detail(spark, d):
    return listing.call_detail(tables(spark, d), _now())


@query(
    f"""{_BASE} SELECT j.audio_file_id AS audio_id, a.filename, j.status AS job_status, j.priority AS job_priority, j.attempts, substr(j.last_error, 1, 800) AS last_error,
    t.latest_run_id AS run_id, r.status AS run_status, r.attempt AS run_attempt, substr(r.error, 1, 800) AS run_error, coalesce(t.sec, 0.0) AS processing_total_seconds
  FROM jobs j JOIN audio_files a ON a.id = j.audio_file_id LEFT JOIN totals t ON t.audio_file_id = j.audio_file_id LEFT JOIN processing_runs r ON r.id = t.latest_run_id"""
)
def processing_snapshot(spark, d):
    return listing.processing_snapshot(tables(spark, d), _now())


@query(
    f"""{_BASE}, live AS (SELECT t.* FROM transcripts t JOIN jobs j ON j.audio_file_id = t.audio_file_id WHERE j.status <> 'skipped')
  SELECT 'total_audio_files' AS name, count(*) AS n FROM audio_files
  UNION ALL SELECT 'audio_files', count(*) FROM audio_files a LEFT JOIN jobs j ON j.audio_file_id = a.id WHERE j.status IS NULL OR j.status <> 'skipped'
  UNION ALL SELECT status, count(*) FROM jobs GROUP BY status
  UNION ALL SELECT 'transcripts', count(*) FROM live UNION ALL SELECT 'current_transcripts', count(*) FROM live WHERE is_current"""
)
def call_counts(spark, d):
    return listing.counts(tables(spark, d))


@query(f"{_BASE} SELECT a.filename, t.version, t.source, t.created_at FROM transcripts t JOIN audio_files a ON a.id = t.audio_file_id JOIN jobs j ON j.audio_file_id = a.id WHERE j.status <> 'skipped' ORDER BY t.created_at DESC, t.id DESC LIMIT 20")
def recent_transcripts(spark, d):
    return listing.recent_transcripts(tables(spark, d))


@query(
    f"""{_BASE} SELECT t.audio_file_id, t.id AS transcript_id, coalesce(v.status, 'needs_review') AS status, (SELECT list(x.version ORDER BY x.version DESC) FROM transcripts x WHERE x.audio_file_id = t.audio_file_id) AS versions
  FROM transcripts t LEFT JOIN transcript_reviews v ON v.transcript_id = t.id WHERE t.is_current"""
)
def review_versions(spark, d):
    return listing.review_versions(tables(spark, d))


@query(
    f"""{cte(*_STORE, "segments")}, s AS (
    SELECT *, coalesce(lag("text") OVER w, '') AS context_before, coalesce(lead("text") OVER w, '') AS context_after FROM segments WINDOW w AS (PARTITION BY call_id ORDER BY "index"))
  SELECT concat(s.call_id, ':', t.id, ':', s.id) AS key, s.call_id AS audio_id, t.id AS transcript_id, t.version AS transcript_version, coalesce(v.status, 'needs_review') AS review_status,
    s.id AS segment_id, s.start, s."end", s.speaker, s.text, s.context_before, s.context_after
  FROM s JOIN transcripts t ON t.audio_file_id = s.call_id AND t.is_current JOIN jobs j ON j.audio_file_id = s.call_id AND j.status NOT IN ('running', 'skipped')
  LEFT JOIN transcript_reviews v ON v.transcript_id = t.id WHERE s.confidence_tier = 'unresolved' AND coalesce(v.status, 'needs_review') <> 'approved'"""
)
def review_queue(spark, d):
    return listing.review_queue(table(spark, d, "segments").withColumn("flags", F.array().cast("array<string>")), tables(spark, d))


# ---- text ----

_NORM = f"trim(regexp_replace(translate(text, '{C.FOLD_FROM}', '{C.FOLD_TO}'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256(coalesce({_NORM}, '')) AS digest FROM documents")
def normalize_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.coalesce(T.normalize("text"), F.lit("")), 256).alias("digest"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce({_NORM}, ''), '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS n_tokens, array_to_string(regexp_extract_all(coalesce({_NORM}, ''), '\\p{{Nd}}+'), ',') AS numbers FROM documents")
def text_tokens(spark, d):
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(T.tokens(text)).cast("long").alias("n_tokens"), F.array_join(T.numbers(text), ",").alias("numbers"))


@query(oracles.TEXT_FLAGS)
def text_flags(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(T.text_flags("text"), ",").alias("flags"))


def _pairs(spark, d):
    w = Window.partitionBy("call_id").orderBy("index")
    return table(spark, d, "segments").withColumn("hypothesis", F.lead("text").over(w)).where("hypothesis is not null").withColumnRenamed("text", "reference")


@query()
def score_pairs(spark, d):
    return _pairs(spark, d).select("call_id", "index", T.score(F.col("reference"), F.col("hypothesis")).alias("s")).select("call_id", "index", "s.*")


@query()
def pass_similarity(spark, d):
    return _pairs(spark, d).select("call_id", "index", T.similarity(T.normalize("reference"), T.normalize("hypothesis")).alias("ratio")).withColumn("pass_disagreement", F.col("ratio") < 0.65)


# ---- evaluation ----

_SPLITS = """
 x AS (SELECT id, coalesce(direction, 'unknown') AS direction, CASE WHEN coalesce(duration_seconds, 0) < 60 THEN 'short' WHEN coalesce(duration_seconds, 0) < 180 THEN 'medium' ELSE 'long' END AS band, md5(concat('42:', id)) AS h FROM audio_files),
 y AS (SELECT *, row_number() OVER (PARTITION BY direction, band ORDER BY h, id) AS round FROM x),
 z AS (SELECT *, row_number() OVER (ORDER BY round, direction, band) - 1 AS position FROM y)"""


@query(f"{cte('audio_files')},{_SPLITS} SELECT id, direction, band, CAST(position AS INTEGER) AS position, CASE WHEN position < 30 THEN 'development' ELSE 'holdout' END AS evaluation_split FROM z WHERE position < 40")
def sample_calls(spark, d):
    """The evaluation sample of 40 calls (the sample is the feature)."""
    return evaluation.sample_calls(table(spark, d, "audio_files"), 40, 42)


_ASOF = """
 approved AS (SELECT transcript_id FROM transcript_reviews WHERE status = 'approved'),
 asof_rows AS (SELECT r.id AS reference_id, r.audio_file_id AS audio_id, r.version AS reference_version, b.id AS baseline_id, b.version AS baseline_version, row_number() OVER (PARTITION BY r.id ORDER BY b.version DESC NULLS LAST) AS rn
  FROM transcripts r JOIN approved a ON a.transcript_id = r.id
  LEFT JOIN transcripts b ON b.audio_file_id = r.audio_file_id AND b.audio_content_hash = r.audio_content_hash AND b.source = 'machine' AND b.version < r.version)"""


def _baselines(spark, d):
    t = table(spark, d, "transcripts").select("id", F.col("audio_file_id").alias("audio_id"), "version", "source", F.col("audio_content_hash").alias("audio_hash"))
    return evaluation.baselines(t, table(spark, d, "transcript_reviews").where("status = 'approved'"))


@query(f"{cte('transcripts', 'transcript_reviews')},{_ASOF} SELECT reference_id, audio_id, reference_version, baseline_id, baseline_version FROM asof_rows WHERE rn = 1")
def asof_baselines(spark, d):
    return _baselines(spark, d)


@query(
    f"""{cte('transcripts', 'transcript_reviews')},{_ASOF}, s AS (
    SELECT reference_id % 2 AS g, levenshtein(b.content, r.content) AS ce, length(replace(r.content, ' ', '')) AS rc, levenshtein(replace(b.content, 'text ', 't'), replace(r.content, 'text ', 't')) AS we, 2 AS rw FROM asof_rows a JOIN transcripts r ON r.id = reference_id JOIN transcripts b ON b.id = baseline_id WHERE rn = 1)
  SELECT CASE WHEN grouping(g) = 1 THEN 'all' WHEN g = 0 THEN 'development' ELSE 'holdout' END AS split, count(*) AS calls, CAST(sum(we) AS DOUBLE) / sum(rw) AS wer, CAST(sum(ce) AS DOUBLE) / sum(rc) AS cer FROM s GROUP BY ROLLUP (g)"""
)
def evaluate_calls(spark, d):
    t = table(spark, d, "transcripts").select("id", "content")
    x = _baselines(spark, d).where("baseline_id is not null").join(t.select(F.col("id").alias("reference_id"), F.col("content").alias("ref")), "reference_id").join(t.select(F.col("id").alias("baseline_id"), F.col("content").alias("hyp")), "baseline_id")
    scored = x.select(F.when(F.col("reference_id") % 2 == 0, "development").otherwise("holdout").alias("evaluation_split"), T.score(F.col("ref"), F.col("hyp")).alias("s")).select("evaluation_split", "s.*")
    return evaluation.micro_rates(scored).select("split", "calls", "wer", "cer")


_ENTRIES = """
 e AS (SELECT 'm' || CAST(o_custkey % 5 AS VARCHAR) AS model, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 100) / 200.0 + (o_custkey % 5) / 100.0 END AS wer, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 50) / 100.0 END AS cer,
   CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END AS number_precision, repeat('[نامفهوم] ', CAST(o_orderkey % 3 AS INTEGER)) || 'a b c' AS hypothesis, o_orderkey % 3 AS marks FROM orders),
 m AS (SELECT model, coalesce(avg(wer), 0) AS macro_wer, coalesce(avg(cer), 0) AS macro_cer, CAST(sum(marks) AS DOUBLE) / sum(marks + 3) AS unresolved_token_rate, coalesce(avg(number_precision), 0) AS number_precision, count(*) AS runs FROM e GROUP BY model)"""


def _entries(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.concat(F.lit("m"), c % 5).alias("model"),
        F.when(k % 13 != 0, (k % 100) / 200.0 + (c % 5) / 100.0).alias("wer"),
        F.when(k % 7 != 0, (k % 50) / 100.0).alias("cer"),
        F.when(k % 3 == 0, 1.0).otherwise(0.5).alias("number_precision"),
        F.concat(F.expr(f"repeat('{C.MARKER} ', CAST(o_orderkey % 3 AS INT))"), F.lit("a b c")).alias("hypothesis"),
        ((c % 5 == 4) & (k % 97 == 96)).alias("unsupported_numbers"),
        F.lit(False).alias("decoder_loop"),
        F.lit(False).alias("duplicate_intervals"),
    )


@query(f"WITH{_ENTRIES} SELECT * FROM m")
def candidate_metrics(spark, d):
    return evaluation.candidate_metrics(_entries(spark, d), ["model"])


@query(f"WITH{_ENTRIES} SELECT * FROM m WHERE macro_wer <= (SELECT min(macro_wer) FROM m) + 0.02 ORDER BY unresolved_token_rate, macro_cer, macro_wer, model LIMIT 1")
def benchmark_winner(spark, d):
    """The winning model (one row is the feature)."""
    return evaluation.winner(evaluation.candidate_metrics(_entries(spark, d), ["model"]), ["model"])


@query(oracles.promotion(_ENTRIES))
def promotion_gate(spark, d):
    """The winner's gate against 30 baselines, one a nation and region."""
    entries = _entries(spark, d)
    win = evaluation.winner(evaluation.candidate_metrics(entries, ["model"]), ["model"])
    names = spark.read.parquet(f"{d}/nation.parquet").select("n_name").union(spark.read.parquet(f"{d}/region.parquet").select("r_name"))
    base = names.select(F.lit(0.9).alias("wer"), F.lit(0.8).alias("cer"), F.lit(0.4).alias("number_precision"), F.lit(0.9).alias("unresolved_token_rate"))
    return evaluation.promotion(win, entries.join(F.broadcast(win.select("model")), "model", "left_semi"), base, 10)  # one row


@query(oracles.PUBLISH_GATE)
def publish_gate(spark, d):
    return evaluation.marker_only_share(table(spark, d, "segments"), ["call_id"])


# ---- intervals ----


@query(
    f"""{cte('intervals')}, o AS (SELECT *, max("end") OVER (PARTITION BY call_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
 SELECT call_id, min(start) AS start, max("end") AS "end", count(*) AS parts FROM g GROUP BY call_id, island"""
)
def merge_channels(spark, d):
    return intervals.merge_overlapping(table(spark, d, "intervals"), ["call_id"])


@query(oracles.CHANNEL_SEGMENTS)
def channel_segments(spark, d):
    """Segments of a call on two channels, some of them without text, as one timeline."""
    i = F.col("index")
    s = table(spark, d, "segments").select("call_id", (i % 2 + 1).alias("channel_id"), "start", "end", F.when(i % 5 != 4, F.col("text")).alias("text"), F.array(F.struct(F.col("text").alias("word"))).alias("words"), F.when(i % 3 == 0, F.array("speaker")).otherwise(F.array().cast("array<string>")).alias("flags"))
    out = intervals.merge_channels(s, ["call_id"])
    return out.select("call_id", "start", "end", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.size("words").cast("long").alias("n_words"), F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels"))


@query(
    f"""{cte('segments')}, calls AS (SELECT call_id, max("end") AS duration FROM segments GROUP BY 1),
 r AS (SELECT s.call_id, s.start, least(duration, s."end") AS "end", row_number() OVER (PARTITION BY s.call_id ORDER BY s.start, s."end") AS k FROM segments s JOIN calls USING (call_id) WHERE least(duration, s."end") - s.start >= 0.2),
 f AS (
   SELECT call_id, k, start AS ws, "end" AS we, 1 AS w FROM r WHERE k = 1
   UNION ALL
   SELECT r.call_id, r.k, CASE WHEN r.start - f.we <= 0.5 AND r."end" - f.ws <= 15 THEN f.ws ELSE r.start END, r."end", CASE WHEN r.start - f.we <= 0.5 AND r."end" - f.ws <= 15 THEN f.w ELSE f.w + 1 END
   FROM f JOIN r ON r.call_id = f.call_id AND r.k = f.k + 1),
 w AS (SELECT call_id, w, min(ws) AS start, arg_max(we, k) AS "end" FROM f GROUP BY 1, 2),
 p AS (SELECT call_id, start + i * 15 AS start, least(start + (i + 1) * 15, "end") AS "end" FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil(("end" - start) / 15)) AS BIGINT))) AS i FROM w))
 SELECT call_id, round(start, 3) AS start, round("end", 3) AS "end" FROM p WHERE "end" - start >= 0.2"""
)
def speech_windows(spark, d):
    s = table(spark, d, "segments")
    return intervals.tight_windows(s.select("call_id", "start", "end", F.max("end").over(Window.partitionBy("call_id")).alias("duration")), ["call_id"], "duration")


@query(
    f"""{cte('intervals')}, base AS (SELECT DISTINCT call_id, CAST(0 AS DOUBLE) AS start, CAST(2678400 AS DOUBLE) AS "end" FROM intervals),
 o AS (SELECT call_id, start, "end", max("end") OVER (PARTITION BY call_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
 g AS (SELECT call_id, coalesce(reach, 0) AS start, least(start, 2678400) AS "end" FROM o WHERE start > coalesce(reach, 0)
   UNION ALL SELECT call_id, max("end"), 2678400 FROM intervals GROUP BY 1)
 SELECT call_id, start, "end" FROM g WHERE "end" - start >= 3600"""
)
def uncovered_time(spark, d):
    x = table(spark, d, "intervals")
    base = x.select("call_id").distinct().select("call_id", F.lit(0.0).alias("start"), F.lit(2678400.0).alias("end"))
    return intervals.subtract(base, x, ["call_id"], minimum=3600.0, longest=None)


_TURNS = """
 seg AS (SELECT call_id, CAST(floor(start / 86400) AS BIGINT) AS id, floor(start / 86400) * 86400.0 AS start, floor(start / 86400) * 86400.0 + 43200 AS "end" FROM intervals GROUP BY 1, 2, 3, 4),
 hit AS (SELECT s.call_id, s.id, s.start, s."end", t.start AS ts, t."end" AS te, t.speaker_id FROM seg s LEFT JOIN intervals t ON t.call_id = s.call_id AND t.start < s."end" AND t."end" > s.start),
 pts AS (SELECT DISTINCT call_id, id, unnest([start, "end", coalesce(greatest(start, ts), start), coalesce(least("end", te), "end")]) AS p FROM hit),
 sl AS (SELECT * FROM (SELECT call_id, id, p, lead(p) OVER (PARTITION BY call_id, id ORDER BY p) AS q FROM pts) WHERE q IS NOT NULL),
 act AS (SELECT sl.call_id, sl.id, p, q, count(DISTINCT speaker_id) AS n, min(speaker_id) AS one FROM sl LEFT JOIN hit ON hit.call_id = sl.call_id AND hit.id = sl.id AND ts <= (p + q) / 2 AND (p + q) / 2 < te GROUP BY 1, 2, 3, 4),
 sums AS (SELECT call_id, id, coalesce(sum(q - p) FILTER (n > 1), 0) AS overlap_seconds, coalesce(sum(q - p) FILTER (n = 0), 0) AS silence_seconds, coalesce(sum(q - p) FILTER (n = 1), 0) AS exclusive_seconds FROM act GROUP BY 1, 2),
 ex AS (SELECT call_id, id, one, sum(q - p) AS sec FROM act WHERE n = 1 GROUP BY 1, 2, 3),
 top AS (SELECT *, row_number() OVER (PARTITION BY call_id, id ORDER BY sec DESC, one) AS rn FROM ex)
"""


def _day_segments(x):
    day = F.floor(F.col("start") / 86400)
    return x.select("call_id", day.alias("id"), (day * 86400.0).alias("start"), (day * 86400.0 + 43200).alias("end")).distinct()


@query(
    f"""{cte('intervals')},{_TURNS} SELECT s.call_id, s.id, s.start, s."end", round(exclusive_seconds, 3) AS exclusive_seconds, round(overlap_seconds, 3) AS overlap_seconds, round(silence_seconds, 3) AS silence_seconds,
   CASE WHEN coalesce(sec / nullif(exclusive_seconds + overlap_seconds, 0), 0) >= 0.8 AND (exclusive_seconds + overlap_seconds) / (s."end" - s.start) >= 0.5 THEN one END AS speaker_id
 FROM seg s JOIN sums USING (call_id, id) LEFT JOIN (SELECT * FROM top WHERE rn = 1) t USING (call_id, id)"""
)
def align_speakers(spark, d):
    x = table(spark, d, "intervals")
    out = speakers.align_segments(_day_segments(x), x)
    return out.select("call_id", "id", "start", "end", *(F.round(c, 3).alias(c) for c in ("exclusive_seconds", "overlap_seconds", "silence_seconds")), "speaker_id")


_MID = """
 b AS (SELECT DISTINCT call_id, p FROM (SELECT call_id, unnest([start, "end"]) AS p FROM ref UNION ALL SELECT call_id, unnest([start, "end"]) FROM hyp)),
 sl AS (SELECT * FROM (SELECT call_id, p, lead(p) OVER (PARTITION BY call_id ORDER BY p) AS q FROM b) WHERE q IS NOT NULL),
 r1 AS (SELECT sl.call_id, p, q, count(DISTINCT ref.speaker) AS nr, min(ref.speaker) AS r FROM sl LEFT JOIN ref ON ref.call_id = sl.call_id AND ref.start <= (p + q) / 2 AND (p + q) / 2 < ref."end" GROUP BY 1, 2, 3),
 h1 AS (SELECT r1.call_id, p, q, nr, r, count(DISTINCT hyp.speaker) AS nh, min(hyp.speaker) AS h FROM r1 LEFT JOIN hyp ON hyp.call_id = r1.call_id AND hyp.start <= (p + q) / 2 AND (p + q) / 2 < hyp."end" GROUP BY 1, 2, 3, 4, 5)"""


def _roles(spark, d):
    s = table(spark, d, "segments")
    ref = s.select("call_id", "start", "end", "speaker")
    hyp = s.where("index % 5 <> 4").select("call_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.when(F.col("index") % 3 == 0, "user").otherwise(F.col("speaker")).alias("speaker"))
    return ref, hyp


_ROLE_ROWS = f"""{cte('segments')}, ref AS (SELECT call_id, start, "end", speaker FROM segments), hyp AS (SELECT call_id, start + 1 AS start, "end" + 1 AS "end", CASE WHEN "index" % 3 = 0 THEN 'user' ELSE speaker END AS speaker FROM segments WHERE "index" % 5 <> 4)"""


@query(
    f"""{_ROLE_ROWS},{_MID} SELECT call_id, round(sum(q - p), 6) AS scored_seconds, round(coalesce(sum(q - p) FILTER (nh = 1 AND h = r), 0), 6) AS matched_seconds,
   round(coalesce(sum(q - p) FILTER (nh = 1 AND h <> r), 0), 6) AS wrong_seconds, round(coalesce(sum(q - p) FILTER (nh <> 1), 0), 6) AS unknown_seconds FROM h1 WHERE nr = 1 GROUP BY 1"""
)
def role_score(spark, d):
    out = speakers.role_score(*_roles(spark, d))
    return out.select("call_id", *(F.round(c, 6).alias(c) for c in ("scored_seconds", "matched_seconds", "wrong_seconds", "unknown_seconds")))


@query(f"{_ROLE_ROWS},{_MID} SELECT call_id, h AS label, r AS role, round(sum(q - p), 6) AS seconds FROM h1 WHERE nr = 1 AND nh = 1 GROUP BY 1, 2, 3")
def speaker_confusion(spark, d):
    _, cells = speakers.confusion(*_roles(spark, d))
    return cells.select("call_id", "label", "role", F.round("seconds", 6).alias("seconds"))


@query()
def speaker_score(spark, d):
    return speakers.speaker_score(*_roles(spark, d))


@query(
    f"""{cte('intervals')}, c AS (SELECT call_id, start, "end", count(*) OVER (PARTITION BY call_id, round(start, 6), round("end", 6)) > 1 AS dup, coalesce(start < lag("end") OVER (PARTITION BY call_id ORDER BY start, "end") - 1e-6, false) AS ov FROM intervals)
 SELECT call_id, start, "end", 'range' AS error FROM c WHERE NOT (start >= 0 AND start < "end" AND "end" <= 2000000 + 1e-6)
 UNION ALL SELECT call_id, start, "end", 'duplicate' FROM c WHERE dup UNION ALL SELECT call_id, start, "end", 'overlap' FROM c WHERE ov"""
)
def timeline_errors(spark, d):
    return intervals.timeline_errors(table(spark, d, "intervals").withColumn("duration", F.lit(2000000.0)), ["call_id"], "duration")


@query(
    f"""{cte('segments')}, c AS (SELECT call_id, start, "end", count(*) OVER (PARTITION BY call_id, "index" // 4, "index" % 3) > 1 AS twice, coalesce(start < lag("end") OVER (PARTITION BY call_id ORDER BY start, "end") - 1e-6, false) AS ov FROM segments)
 SELECT call_id, start, "end", 'range' AS error FROM c WHERE NOT (start >= 0 AND start < "end" AND "end" <= 60 + 1e-6)
 UNION ALL SELECT call_id, start, "end", 'overlap' FROM c WHERE ov UNION ALL SELECT call_id, start, "end", 'owner' FROM c WHERE twice"""
)
def token_owner_errors(spark, d):
    """Rows of which each owns one token; the first and last of four own the same."""
    i = F.col("index")
    s = table(spark, d, "segments").select("call_id", "start", "end", F.array(F.struct(F.floor(i / 4).alias("segment"), (i % 3).alias("word"))).alias("parts"), F.lit(60.0).alias("duration"))
    return intervals.timeline_errors(s, ["call_id"], "duration", "parts")


@query(
    f"""{cte('segments')}, w AS (SELECT call_id, "index" * 10 + k AS word, start + k AS start, start + k + 0.8 AS "end" FROM segments, (SELECT unnest(range(0, 6)) AS k)),
 j AS (SELECT w.*, s."index" AS owner, least(w."end", s."end") - greatest(w.start, s.start) AS o FROM w LEFT JOIN segments s ON s.call_id = w.call_id AND s.start < w."end" AND w.start < s."end"),
 r AS (SELECT *, row_number() OVER (PARTITION BY call_id, word ORDER BY o DESC NULLS LAST, owner) AS rn FROM j)
 SELECT call_id, word, owner, round(coalesce(greatest(o, 0), 0), 6) AS overlap FROM r WHERE rn = 1"""
)
def word_owners(spark, d):
    s = table(spark, d, "segments")
    w = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("call_id", (F.col("index") * 10 + F.col("k")).alias("word"), (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + F.lit(0.8)).alias("end"))
    return intervals.owners(w, s.select("call_id", "index", "start", "end"), ["call_id"]).select("call_id", "word", "owner", F.round("overlap", 6).alias("overlap"))


@query(oracles.DISPLAY_ROWS)
def display_rows(spark, d):
    return intervals.display_rows(table(spark, d, "segments"), ["call_id"], C.UNKNOWN_SPEAKER)


@query(oracles.CALL_DOCUMENTS)
def call_documents(spark, d):
    s = table(spark, d, "segments")
    return evidence.markdown(s, s.select("call_id").distinct().select("call_id", F.concat(F.lit("call-"), "call_id", F.lit(".mp3")).alias("filename"), (F.col("call_id") % 2 == 0).alias("human_reviewed")))


@query(
    f"""{cte('intervals')}, o AS (SELECT call_id, start, "end", row_number() OVER (PARTITION BY call_id ORDER BY start, "end", id) AS k, id FROM intervals),
 f AS (SELECT call_id, k, start AS gs, "end" AS ge, 1 AS g FROM o WHERE k = 1 UNION ALL
  SELECT o.call_id, o.k, CASE WHEN o.start - f.ge <= 7200 AND greatest(f.ge, o."end") - f.gs <= 80000 THEN f.gs ELSE o.start END, CASE WHEN o.start - f.ge <= 7200 AND greatest(f.ge, o."end") - f.gs <= 80000 THEN greatest(f.ge, o."end") ELSE o."end" END,
   CASE WHEN o.start - f.ge <= 7200 AND greatest(f.ge, o."end") - f.gs <= 80000 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.k + 1)
 SELECT call_id, round(min(gs), 3) AS gap_start, round(max(ge), 3) AS gap_end, count(*) AS n FROM f GROUP BY call_id, g"""
)
def retry_groups(spark, d):
    x = table(spark, d, "intervals").withColumn("duration", F.lit(2678400.0))
    out = intervals.retry_groups(x, ["call_id"], "duration", minimum=100.0, maximum=90000.0, context=5000.0, silence=7200.0)
    return out.select("call_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"), F.size("ids").cast("long").alias("n"))


# ---- state ----

_JOB_COLUMNS = "id, status, priority, attempts, claimed_by, last_error"


@query(
    f"""{cte('audio_files', 'jobs')}, e AS (SELECT *, status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}' AS gone FROM jobs),
 x AS (SELECT id, audio_file_id, CASE WHEN gone THEN 'pending' ELSE status END AS status, priority, attempts, max_attempts, CASE WHEN gone THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN gone THEN 'Previous worker lease expired' ELSE last_error END AS last_error FROM e),
 c AS (SELECT x.id FROM x JOIN audio_files a ON a.id = x.audio_file_id WHERE x.status = 'pending' AND x.attempts < x.max_attempts AND NOT coalesce(a.duration_seconds < 0.5, false) ORDER BY x.priority DESC, x.id LIMIT 25)
 SELECT x.id, CASE WHEN c.id IS NULL THEN x.status ELSE 'running' END AS status, priority, CASE WHEN c.id IS NULL THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN c.id IS NULL THEN claimed_by ELSE 'w9' END AS claimed_by, CASE WHEN c.id IS NULL THEN last_error END AS last_error
 FROM x LEFT JOIN c ON c.id = x.id"""
)
def claim_jobs(spark, d):
    """The jobs table after a worker claimed a batch of 25."""
    return store.claim(table(spark, d, "jobs"), table(spark, d, "audio_files"), 25, "w9", _now()).select(*_JOB_COLUMNS.split(", "))


@query(
    f"""{cte('audio_files', 'jobs')} SELECT j.id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 1000 ELSE priority END AS priority, CASE WHEN hit THEN 0 ELSE attempts END AS attempts, claimed_by, CASE WHEN hit THEN NULL ELSE last_error END AS last_error
 FROM (SELECT j.*, j.audio_file_id % 10 = 3 AND status <> 'running' AND NOT coalesce(a.duration_seconds < 0.5, false) AS hit FROM jobs j JOIN audio_files a ON a.id = j.audio_file_id) j"""
)
def queue_calls(spark, d):
    calls = table(spark, d, "audio_files")
    return store.queue(table(spark, d, "jobs"), calls, calls.where("id % 10 = 3").select(F.col("id").alias("audio_file_id")), _now()).select(*_JOB_COLUMNS.split(", "))


@query(
    f"""{cte('jobs')} SELECT id, CASE WHEN status <> 'running' OR id % 5 = 4 THEN status WHEN id % 5 = 0 THEN 'completed' WHEN id % 5 = 1 OR attempts >= max_attempts THEN 'failed' ELSE 'pending' END AS status, priority, attempts,
   CASE WHEN status = 'running' AND id % 5 <> 4 THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN status = 'running' AND id % 5 <> 4 THEN CASE WHEN id % 5 = 0 THEN NULL ELSE 'boom' END ELSE last_error END AS last_error FROM jobs"""
)
def finish_jobs(spark, d):
    j = table(spark, d, "jobs")
    k = F.col("audio_file_id") % 5
    o = j.where(k != 4).select("audio_file_id", (k == 0).alias("ok"), F.lit("boom").alias("error"), (k != 1).alias("retryable"))
    return store.finish(j, o, _now()).select(*_JOB_COLUMNS.split(", "))


@query(f"{cte('jobs')} SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, priority, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts, claimed_by, CASE WHEN status = 'failed' THEN NULL ELSE last_error END AS last_error FROM jobs")
def retry_failed(spark, d):
    return store.retry_failed(table(spark, d, "jobs"), _now()).select(*_JOB_COLUMNS.split(", "))


@query(
    f"""{cte('audio_files', 'jobs', 'transcripts')}, s AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE content_sha256 END AS h, CASE WHEN id % 9 = 0 THEN 0.1 ELSE duration_seconds END AS dur FROM audio_files WHERE id % 2 = 0),
 c AS (SELECT s.id, s.h <> a.content_sha256 AS changed, s.dur < 0.5 AS short FROM s JOIN audio_files a USING (id))
 SELECT j.id, CASE WHEN c.id IS NULL OR status = 'running' THEN status WHEN changed THEN CASE WHEN short THEN 'skipped' ELSE 'pending' END WHEN short THEN 'skipped' WHEN status = 'skipped' THEN 'pending' ELSE status END AS status,
  CASE WHEN c.id IS NOT NULL AND status <> 'running' AND (changed OR short) THEN 0 ELSE priority END AS priority,
  CASE WHEN c.id IS NOT NULL AND status <> 'running' AND (changed OR (NOT short AND status = 'skipped')) THEN 0 ELSE attempts END AS attempts,
  claimed_by, CASE WHEN c.id IS NOT NULL AND status <> 'running' AND (changed OR short) THEN NULL ELSE last_error END AS last_error
 FROM jobs j LEFT JOIN c ON c.id = j.audio_file_id
 UNION ALL SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY id), 'pending', 0, 0, NULL, NULL FROM (SELECT -1 AS id)"""
)
def scan_upsert(spark, d):
    """The jobs table after a scan that changed some calls, shortened some and found one."""
    calls = table(spark, d, "audio_files").withColumn("discovered_at", _now()).withColumn("updated_at", _now())
    seen = calls.where("id % 2 = 0").withColumn("content_sha256", F.when(F.col("id") % 6 == 0, "new").otherwise(F.col("content_sha256"))).withColumn("duration_seconds", F.when(F.col("id") % 9 == 0, 0.1).otherwise(F.col("duration_seconds"))).drop("id", "discovered_at", "updated_at")
    one = seen.limit(1).withColumn("absolute_path", F.lit("/calls/new.mp3")).withColumn("duration_seconds", F.lit(9.0))
    _, jobs, _ = store.upsert_calls(calls, table(spark, d, "jobs").withColumn("created_at", _now()), table(spark, d, "transcripts"), seen.unionByName(one), _now())
    return jobs.select(*_JOB_COLUMNS.split(", "))


@query(
    f"""{cte('transcripts')}, i AS (SELECT DISTINCT audio_file_id, concat('text ', audio_file_id % 5) AS content, audio_file_id % 10 = 0 AS forced FROM transcripts WHERE audio_file_id % 2 = 0),
 n AS (SELECT i.*, (SELECT max(version) FROM transcripts t WHERE t.audio_file_id = i.audio_file_id) + 1 AS version FROM i LEFT JOIN transcripts c ON c.audio_file_id = i.audio_file_id AND c.is_current WHERE c.content IS DISTINCT FROM i.content OR forced)
 SELECT audio_file_id, version, content, is_current AND audio_file_id NOT IN (SELECT audio_file_id FROM n) AS is_current FROM transcripts UNION ALL SELECT audio_file_id, version, content, true FROM n"""
)
def add_versions(spark, d):
    t = table(spark, d, "transcripts")
    i = t.where("audio_file_id % 2 = 0").select("audio_file_id").distinct().select("audio_file_id", F.concat(F.lit("text "), F.col("audio_file_id") % 5).alias("content"), (F.col("audio_file_id") % 10 == 0).alias("forced"))
    return store.add_versions(t, i, _now()).select("audio_file_id", "version", "content", "is_current")


@query(
    f"""{cte('audio_files', 'jobs', 'transcripts', 'transcript_reviews')}, g AS (SELECT id FROM audio_files WHERE relative_path LIKE 'inbox/7/%'), ok AS (SELECT count(*) = 0 AS go FROM jobs JOIN g ON g.id = jobs.audio_file_id WHERE status = 'running')
 SELECT 'audio_files' AS name, count(*) AS n FROM audio_files, ok WHERE NOT (go AND id IN (SELECT id FROM g)) UNION ALL SELECT 'transcripts', count(*) FROM transcripts, ok WHERE NOT (go AND audio_file_id IN (SELECT id FROM g))
 UNION ALL SELECT 'transcript_reviews', count(*) FROM transcript_reviews, ok WHERE NOT (go AND transcript_id IN (SELECT id FROM transcripts WHERE audio_file_id IN (SELECT id FROM g)))"""
)
def reset_folder(spark, d):
    """Rows left after a folder's reset (refused while one of its jobs is running)."""
    out, _ = store.reset(tables(spark, d), "/calls/inbox/7")
    one = lambda n: out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("audio_files").unionByName(one("transcripts")).unionByName(one("transcript_reviews"))


# ---- evidence, glossary, review, progress ----


def _hypotheses(spark, d):
    s = table(spark, d, "segments").select("call_id", "index", "start", "end", "text", F.when(F.col("index") % 6 == 5, -1.5).otherwise(-0.3).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), F.when(F.col("index") % 7 == 6, 3.0).otherwise(1.2).alias("compression_ratio"), F.array().cast("array<string>").alias("flags"))
    s = s.withColumn("end", F.greatest("end", F.col("start") + 0.5))
    w = F.split("text", "(?<= )")
    # the step is taken once a row, not once a word
    timed = lambda step: F.transform(w, lambda x, i: F.struct(x.alias("word"), (F.col("start") + i * step).alias("start"), (F.col("start") + (i + 1) * step).alias("end"), F.lit(0.8).alias("probability")))
    s = s.withColumn("words", T.bind((F.col("end") - F.col("start")) / F.size(w), timed))
    return s, s.where("index % 4 <> 3").withColumn("text", F.when(F.col("index") % 4 == 2, F.reverse("text")).otherwise(F.col("text"))).withColumn("words", F.when(F.col("index") % 4 == 2, F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")).otherwise(F.col("words")))


def _timeline(spark, d):
    primary, alternative = _hypotheses(spark, d)
    calls = primary.groupBy("call_id").agg((F.max("end") + 20).alias("duration"))
    return evidence.build(calls, primary, alternative, calls.select("call_id", (F.col("duration") - 20).alias("start"), F.col("duration").alias("end")))


@query()
def build_evidence(spark, d):
    return _timeline(spark, d).select("call_id", "id", "start", "end", "text", "alternative", F.array_join("flags", ",").alias("flags"))


@query()
def consensus(spark, d):
    x = _timeline(spark, d).withColumn("retry_text", F.lit(None).cast("string")).withColumn("providers", F.array(F.lit("mlx-whisper"))).withColumn("retry_aligned", F.lit(False)).withColumn("other_words", F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>"))
    return evidence.consensus(x).select("call_id", "id", "consensus_text", "confidence_tier", "reason")


TERMS = (lexicon.Term("Ladenda", "brand", ("the and", "der und")), lexicon.Term("Onea", "support_name", ("on", "en")))


@query(oracles.glossary())
def glossary(spark, d):
    s = table(spark, d, "segments").select("call_id", "index", lexicon.replace_aliases(F.col("text"), TERMS[:1]).alias("r"), lexicon.observed_alias(F.col("text"), TERMS[1]).alias("observed"))
    return s.select("call_id", "index", F.sha2("r.text", 256).alias("digest"), F.col("r.replacements").alias("replacements"), "observed")


@query(oracles.SUGGESTIONS)
def suggestions(spark, d):
    words = F.split("text", " ")
    swapped = lambda new: F.array_join(F.transform("words", lambda x, i: F.when(i == F.col("at"), new(x)).otherwise(x)), " ")
    s = table(spark, d, "segments").withColumn("words", words).withColumn("at", F.col("index") % F.size("words")).select("call_id", "id", swapped(lambda x: F.lit(C.MARKER)).alias("text"), F.col("text").alias("raw_text"), F.col("text").alias("consensus_text"), swapped(F.reverse).alias("alternative"), F.lit(None).cast("string").alias("retry_text"), F.array("speaker").alias("fragments"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("flags"))
    return review.suggestions(s, ["call_id", "id"])


@query(oracles.PROGRESS_EVENTS)
def progress_events(spark, d):
    from talkloom.streaming.progress import described

    e = spark.read.parquet(f"{d}/events.parquet")
    body = F.to_json(F.struct(F.lit("talkloom.stage").alias("type"), F.col("event_type").alias("stage"), F.lit("active").alias("state"), F.col("props").alias("message")))
    return described(e.select("event_id", body.alias("value")), "value", "event_id").drop("timestamp")


# ---- speakers, candidates, audio ----


def _words(spark, d):
    primary, _ = _hypotheses(spark, d)
    s = primary.select("call_id", F.concat(F.lit("s"), "index").alias("id"), "start", "end", "text", "flags", "words", "index")
    w = s.select("call_id", "id", F.posexplode("words").alias("word_index", "w")).select("call_id", "id", "word_index", "w.word", "w.start", "w.end", "w.probability")
    turns = s.select("call_id", F.col("start").alias("start"), (F.col("start") + 4 + F.col("index") % 5).alias("end"), F.when(F.col("index") % 2 == 0, "A").otherwise("B").alias("speaker_id"))
    return s, w, turns


@query(oracles.ATTRIBUTE_SPEAKERS)
def attribute_speakers(spark, d):
    s, w, turns = _words(spark, d)
    return speakers.attribute(s.drop("words", "index"), w, turns).select("call_id", "id", "source_segment_id", "start", "end", "speaker", F.array_join("flags", ",").alias("flags"))


@query(oracles.REFINE_SPEAKERS)
def refine_speakers(spark, d):
    """Words at one character's distance, with evidence that changes by word; segments with other gaps have an error."""
    s, _, turns = _words(spark, d)
    w = s.select("call_id", "id", "start", "end", T.fields("text").alias("w")).select("call_id", "id", "start", ((F.col("end") - F.col("start")) / F.size("w")).alias("step"), F.posexplode("w").alias("word_index", "word"))
    before = F.coalesce(F.sum(F.length("word")).over(Window.partitionBy("call_id", "id").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.col("word_index")
    w = w.withColumn("char_start", (before + k).cast("int")).withColumn("char_end", F.col("char_start") + F.length("word"))
    w = w.select("call_id", "id", k, "word", "char_start", "char_end", (F.col("start") + k * F.col("step")).alias("start"), (F.col("start") + (k + 1) * F.col("step")).alias("end"), F.lit(0.8).alias("score"), F.when(k % 5 == 0, 0.2).otherwise(0.9).alias("hits"), F.when(k % 5 == 0, C.ATTENTION).otherwise("ctc").alias("method"), (k % 7 != 6).alias("accepted"))
    aligned = speakers.align_segments(s, turns).join(s.select("call_id", "id", "text", "flags"), ["call_id", "id"])
    out = speakers.refine(aligned, w, turns)
    return out.select("call_id", "id", "speaker_id", "refined_id", "mixed", "error", F.array_join("flags", ",").alias("flags"))


@query(oracles.ROLE_ERRORS)
def role_errors(spark, d):
    s = table(spark, d, "segments").withColumn("speaker_id", F.when(F.col("speaker") != "system", F.col("speaker")))
    quote = F.struct(F.col("id").alias("segment_id"), F.substring("text", 1, 10).alias("quote"))
    roles = s.where("speaker_id = 'user'").groupBy("call_id", "speaker_id").agg(F.collect_list(quote).alias("evidence")).withColumn("role", F.lit(C.ROLES[0])).withColumn("reason", F.lit("asks"))
    calls = table(spark, d, "audio_files").select(F.col("id").alias("call_id"), "direction")
    return speakers.role_errors(roles, s, calls)


@query()
def decoding_candidates(spark, d):
    primary, alternative = _hypotheses(spark, d)
    both = primary.withColumn("variant", F.lit(0)).unionByName(alternative.withColumn("variant", F.lit(1)))
    texts = both.groupBy("call_id", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ").alias("text")).withColumn("prompt", F.lit(""))
    scored = evaluation.candidate_defects(both, texts, ["call_id", "variant"])
    best = evaluation.choose_candidate(scored, ["call_id"], "variant").withColumnRenamed("variant", "chosen")
    return scored.join(best, "call_id").select("call_id", "variant", F.array_join("defects", ",").alias("defects"), F.round("mean_logprob", 9).alias("mean_logprob"), F.round("coverage", 6).alias("coverage"), "chosen")


@query()
def retry_texts(spark, d):
    primary, _ = _hypotheses(spark, d)
    gaps = primary.select("call_id", (F.col("start") + 1).alias("start"), (F.col("start") + 5).alias("end"))
    out = evidence.retry_for_gaps(primary.withColumnsRenamed({"start": "s_start", "end": "s_end"}), gaps, ["call_id"])
    return out.select("call_id", "start", "end", "text", "n_segments", F.round(F.get("segments", F.lit(0))["start"], 3).alias("heard_from"))


@query(
    f"""{cte('segments')}, p AS (SELECT call_id, start, "end", round(greatest(0, start - 0.4), 3) AS ts, round(least(200, "end" + 0.4), 3) AS te, CASE WHEN call_id % 5 = 0 THEN round(greatest(0, start - 0.4), 3) ELSE greatest(0, start - 3) END AS cs,
   CASE WHEN call_id % 5 = 0 THEN round(least(200, "end" + 0.4), 3) ELSE "end" + 3 END AS ce, round(greatest(0, least(140, (start + "end") / 2 - 30)), 3) AS xs FROM segments)
 SELECT call_id, start AS gap_start, 'tight_vad' AS mode, ts AS a_start, te AS a_end FROM p WHERE te > ts
 UNION ALL SELECT call_id, start, 'contextual', round(cs, 3), round(ce, 3) FROM p WHERE ce > cs AND NOT (te > ts AND round(cs, 3) = ts AND round(ce, 3) = te)
 UNION ALL SELECT call_id, start, 'expanded', xs, round(xs + 60, 3) FROM p"""
)
def attempt_windows(spark, d):
    """The three windows of every segment; for some calls the contextual one is the tight one and is not tried twice."""
    s = table(spark, d, "segments")
    tight = F.col("call_id") % 5 == 0
    start = F.when(tight, F.round(F.greatest(F.lit(0.0), F.col("start") - 0.4), 3)).otherwise(F.greatest(F.lit(0.0), F.col("start") - 3))
    end = F.when(tight, F.round(F.least(F.lit(200.0), F.col("end") + 0.4), 3)).otherwise(F.col("end") + 3)
    plans = s.select("call_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), start.alias("start"), end.alias("end"), F.lit(200.0).alias("duration"))
    return intervals.attempt_windows(plans, "duration", 60.0).select("call_id", "gap_start", "mode", "a_start", "a_end")


@query(oracles.TIMED_UNITS)
def timed_units(spark, d):
    _, w, _ = _words(spark, d)
    return intervals.timed_units(w, ["call_id", "id"])


@query()
def clip_gain(spark, d):
    from talkloom.operators import audio

    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x / 20).cast("array<float>").alias("s"))
    louder = audio.gain(F.col("s"), rate=64)
    return e.select("vec_id", F.size("s").alias("n"), F.round(F.array_max(F.transform(louder, lambda x: F.abs(x))).cast("double"), 5).alias("peak"), audio.channels(F.col("s"), F.reverse("s"), rate=32).alias("c")).select("vec_id", "n", "peak", "c.*")
