"""Registered queries of recovery, name write-back, audits, frozen references, model grids and store versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.operators import evaluation, intervals, lexicon, listing, recovery, store
from talkloom.plans.queries import _NORM, ORACLES, _now, query
from talkloom.plans.standins import cte, table, tables
from talkloom.sources import references, scratch
from talkloom.sources.snapshots import Refused, Store

# ---- read models ----

_FULL = f"""{cte("recordings", "jobs", "processing_runs", "transcripts", "transcript_reviews")},
 l AS (SELECT a.*, j.status AS job_status, j.last_error, r.latest_run_id, t.id AS transcript_id, t.created_at AS transcript_created_at FROM recordings a LEFT JOIN jobs j ON j.audio_file_id = a.id
   LEFT JOIN transcripts t ON t.audio_file_id = a.id AND t.is_current AND j.status <> 'skipped' LEFT JOIN (SELECT audio_file_id, max(id) AS latest_run_id FROM processing_runs GROUP BY 1) r ON r.audio_file_id = a.id
   WHERE lower(filename) LIKE '%23\\_1%' ESCAPE '\\' OR lower(relative_path) LIKE '%23\\_1%' ESCAPE '\\' OR remote_number LIKE '%23\\_1%' ESCAPE '\\' OR agent_extension LIKE '%23\\_1%' ESCAPE '\\')"""
_SHOWN = ["id", "filename", "relative_path", "agent_extension", "size_bytes", "codec", "bitrate", "sample_rate", "channels", "metadata_error", "job_status", "last_error", "latest_run_id", "transcript_id", "transcript_created_at"]


@query(f"{_FULL} SELECT {', '.join(_SHOWN)}, (SELECT count(*) FROM l) AS total FROM l ORDER BY recorded_at DESC NULLS LAST, id DESC LIMIT 40 OFFSET 20")
def list_page(spark, d):
    """The second page of the calls that a search finds, with all that their headers say and the number of all of them (the page is the feature)."""
    t = tables(spark, d) | {"audio_files": table(spark, d, "recordings")}
    found = listing.list_calls(t, _now(), search="23_1", full=True)
    return listing.page_with_total(found, 40, 20).select(*_SHOWN, "total")


@query(
    f"""{cte("audio_files", "transcripts", "transcript_reviews")},
 x AS (SELECT t.*, v.status FROM transcripts t LEFT JOIN transcript_reviews v ON v.transcript_id = t.id)
 SELECT a.id AS audio_file_id, any_value(x.id) FILTER (x.is_current) AS transcript_id, coalesce(any_value(x.status) FILTER (x.is_current), 'needs_review') AS status, '{{}}' AS data_json, false AS markdown_synced,
   string_agg(x.version || ':' || x.source || ':' || coalesce(x.status, '-'), ',' ORDER BY x.version DESC) AS versions, max(absolute_path) AS absolute_path FROM audio_files a LEFT JOIN x ON x.audio_file_id = a.id GROUP BY a.id"""
)
def review_details(spark, d):
    """Review state and versions of all calls, and where their recordings are."""
    t = tables(spark, d)
    x = listing.review_details(t).join(listing.audio_paths(t, t["audio_files"]).withColumnRenamed("id", "audio_file_id"), "audio_file_id")
    shown = F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version"].cast("string"), v["source"], F.coalesce(v["status"], F.lit("-")))), ",")
    return x.select("audio_file_id", "transcript_id", "status", "data_json", "markdown_synced", shown.alias("versions"), "absolute_path")


@query(
    f"""{cte("audio_files", "segments", "transcripts", "jobs", "transcript_reviews")}, s AS (SELECT * FROM segments WHERE confidence_tier = 'unresolved')
 SELECT s.call_id || ':' || t.id || ':' || s.id AS key, a.filename, a.duration_seconds, CASE WHEN index % 2 = 0 THEN 'no_usable_decode' ELSE 'unclear' END AS reason, CASE WHEN index % 4 = 3 THEN 'n' ELSE '' END AS notes
 FROM s JOIN audio_files a ON a.id = s.call_id JOIN transcripts t ON t.audio_file_id = s.call_id AND t.is_current JOIN jobs j ON j.audio_file_id = s.call_id AND j.status NOT IN ('running', 'skipped')
 LEFT JOIN transcript_reviews v ON v.transcript_id = t.id WHERE coalesce(v.status, 'needs_review') <> 'approved'"""
)
def review_queue_details(spark, d):
    """The whole review queue with names, reasons and notes."""
    s = table(spark, d, "segments").withColumns({"flags": F.array().cast("array<string>"), "reason": F.when(F.col("index") % 2 == 0, "no_usable_decode"), "notes": F.when(F.col("index") % 4 == 3, "n")})
    return listing.review_queue(s, tables(spark, d), full=True).select("key", "filename", "duration_seconds", "reason", "notes")


# ---- what reviewers and counters get ----


@query(
    f"""{cte("segments")} SELECT call_id, count(*) AS n, max("end") AS duration_seconds, md5(string_agg(id || ':' || text, '|' ORDER BY start, "end", id)) AS digest FROM segments WHERE call_id IS NOT NULL AND index IS NOT NULL GROUP BY call_id"""
)
def review_input(spark, d):
    """What the reviewer of each call is given: number of rows, and a digest of their ids and texts in order."""
    s = table(spark, d, "segments").where("call_id IS NOT NULL AND index IS NOT NULL").withColumn("flags", F.array().cast("array<string>"))
    x = recovery.review_input(s, s.groupBy("call_id").agg(F.max("end").alias("duration")))
    one = F.transform("segments", lambda j: F.concat_ws(":", F.get_json_object(j, "$.id"), F.get_json_object(j, "$.text")))
    return x.select("call_id", F.size("segments").cast("long").alias("n"), "duration_seconds", F.md5(F.array_join(one, "|")).alias("digest"))


@query(
    f"""{cte("segments")} SELECT call_id, count(*) AS total, count(*) FILTER (index % 3 > 0) AS assigned, count(*) FILTER (index % 4 = 1) AS refined, count(*) FILTER (index % 5 = 2) AS mixed FROM segments WHERE call_id IS NOT NULL AND index IS NOT NULL GROUP BY call_id"""
)
def speaker_counters(spark, d):
    """Rows of each call with a known speaker, refined by words, and of mixed speakers."""
    k = F.col("index")
    s = table(spark, d, "segments").where("call_id IS NOT NULL AND index IS NOT NULL")
    s = s.withColumns({"speaker": F.when(k % 6 == 0, C.UNKNOWN_SPEAKER).when(k % 3 > 0, F.col("speaker")), "flags": F.when(k % 4 == 1, F.array(F.lit("word_aligned"))).otherwise(F.array().cast("array<string>"))})
    s = s.withColumn("flags", F.when(k % 5 == 2, F.array_append("flags", "mixed_speakers")).otherwise(F.col("flags")))
    return recovery.speaker_counters(s)


# ---- intervals ----


@query(
    f"""{cte("intervals")} SELECT a.call_id, a.id, b.id AS r_id, round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS seconds
 FROM intervals a JOIN intervals b ON a.call_id = b.call_id AND a.start < b."end" AND b.start < a."end" WHERE a.speaker_id IN ('click', 'view') AND b.speaker_id NOT IN ('click', 'view')"""
)
def speech_overlaps(spark, d):
    """Every overlap of two kinds of intervals of a call."""
    x = table(spark, d, "intervals")
    kind = F.col("speaker_id").isin("click", "view")
    pairs = intervals.overlap_join(x.where(kind), x.where(~kind), ["call_id"], seconds=4096.0)
    return pairs.select("call_id", "id", "r_id", F.round(F.least("end", "r_end") - F.greatest("start", "r_start"), 6).alias("seconds"))


# ---- gaps ----


def _rows(spark, d):
    """Rows of a timeline: every third has no text, some others a marker or flags."""
    k = F.col("index")
    s = table(spark, d, "segments").where("call_id IS NOT NULL AND index IS NOT NULL").withColumn("end", F.greatest("end", F.col("start") + 0.5))
    return s.select(
        "call_id", "id", "start", "end", k.alias("index"), F.when(k % 3 == 0, "").when(k % 5 == 1, C.MARKER).otherwise(F.lit("some words")).alias("text"),
        F.when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, "aaaaaaaa").when(k % 8 == 3, "other words").otherwise("").alias("alternative"),
        F.when(k % 5 == 0, F.array(F.lit("compression"))).when(k % 7 == 3, F.array(F.lit("speech_gap"), F.lit("low_logprob"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(k % 11 == 3, "heard before").alias("retry_text"),
    )


def _speech(rows):
    return rows.where("call_id % 4 > 0 AND (call_id + index) % 3 > 0").select("call_id", (F.col("start") + 1).alias("start"), "end")


_ROWS = f"""{cte("segments")},
 x AS (SELECT call_id, id, index, start, greatest("end", start + 0.5) AS "end", CASE WHEN index % 3 = 0 THEN '' WHEN index % 5 = 1 THEN '{C.MARKER}' ELSE 'some words' END AS text,
   CASE WHEN index % 5 = 0 THEN ['compression'] WHEN index % 7 = 3 THEN ['speech_gap', 'low_logprob'] ELSE [] END AS flags, CASE WHEN index % 11 = 3 THEN 'heard before' END AS retry_text, index % 8 = 3 AS told FROM segments WHERE call_id IS NOT NULL AND index IS NOT NULL),
 v AS (SELECT call_id, start + 1 AS start, "end" FROM x WHERE call_id % 4 > 0 AND (call_id + index) % 3 > 0),
 gaps AS (SELECT * FROM x WHERE (index % 3 = 0 OR index % 5 IN (0, 1)) AND NOT told AND retry_text IS NULL
   AND (call_id NOT IN (SELECT call_id FROM v) OR EXISTS (SELECT 1 FROM v WHERE v.call_id = x.call_id AND v.start < x."end" AND v."end" > x.start))),
 o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start, "end", id) AS k FROM gaps)"""


@query(f'{_ROWS} SELECT call_id, id, k - 1 AS position, start, "end" FROM o')
def gap_candidates(spark, d):
    """Rows of all calls without usable text that hold speech, in order."""
    rows = _rows(spark, d)
    return recovery.gap_candidates(rows, _speech(rows), ["call_id"]).select("call_id", "id", F.col("position").cast("long").alias("position"), "start", "end")


def _retries(plans, gaps):
    """Results of two windows, two decoders and two kinds of sound for each plan; some heard nothing, some loop, some failed."""
    x = plans.select("call_id", "plan", F.explode("ids").alias("id")).join(gaps.select("call_id", "id", "index", "start", "end"), ["call_id", "id"])
    rung = F.explode(F.array(*(F.struct(F.lit(a).alias("attempt"), F.lit(p).alias("provider"), F.lit(v).alias("variant")) for a in (0, 1) for p in (0, 1) for v in ("agc", "raw"))))
    x = x.withColumn("r", rung).select("*", "r.*")
    k = F.col("index") + 2 * F.col("attempt") + F.col("provider")
    text = F.when(k % 5 == 0, F.concat(F.lit("heard "), "variant")).when(k % 5 == 1, "aaaaaaaaa").otherwise("")
    return x.select(
        "call_id", "plan", "attempt", "provider", "variant", F.when((F.col("call_id") % 7 == 0) & (F.col("attempt") == 0), "failed").otherwise("completed").alias("status"), "index", F.col("start").alias("s_start"), F.col("end").alias("s_end"),
        text.alias("text"), F.when((F.col("provider") == 1) == (F.col("variant") == "agc"), -0.2).otherwise(-0.4).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), F.lit(1.2).alias("compression_ratio"),
        F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>").alias("words"), F.lit("").alias("prompt"),
    )


@query(
    f"""{_ROWS},
 f AS (SELECT call_id, k, id, index, start AS gs, "end" AS ge, 0 AS plan FROM o WHERE k = 1 UNION ALL
  SELECT o.call_id, o.k, o.id, o.index, CASE WHEN o.start - f.ge <= 3 AND greatest(f.ge, o."end") - f.gs <= 24 THEN f.gs ELSE o.start END, CASE WHEN o.start - f.ge <= 3 AND greatest(f.ge, o."end") - f.gs <= 24 THEN greatest(f.ge, o."end") ELSE o."end" END,
   CASE WHEN o.start - f.ge <= 3 AND greatest(f.ge, o."end") - f.gs <= 24 THEN f.plan ELSE f.plan + 1 END FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.k + 1),
 t AS (SELECT call_id, plan, id, attempt, provider, 'heard ' || CASE WHEN provider = 1 THEN 'agc' ELSE 'raw' END AS heard,
   (index + 2 * attempt + provider) % 5 = 0 AND NOT (call_id % 7 = 0 AND attempt = 0) AS ok FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) r(attempt, provider)),
 first AS (SELECT call_id, plan, min(2 * attempt + provider) AS rung FROM t WHERE ok GROUP BY ALL),
 got AS (SELECT t.* FROM t JOIN first USING (call_id, plan) WHERE ok AND 2 * attempt + provider = rung)
 SELECT x.call_id, x.id, coalesce(got.heard, retry_text) AS retry_text, array_to_string(CASE WHEN got.id IS NULL THEN flags ELSE list_sort(list_append(flags, '{recovery.RECOVERED}')) END, ',') AS flags, got.plan, got.attempt, got.provider
 FROM x LEFT JOIN got ON got.call_id = x.call_id AND got.id = x.id"""
)
def recovered_gaps(spark, d):
    """Rows of all calls with the texts of the first usable rung of each group of gaps."""
    rows, key = _rows(spark, d), ["call_id"]
    gaps = scratch.kept(recovery.gap_candidates(rows, _speech(rows), key))
    plans = scratch.kept(recovery.plans(gaps, rows.groupBy("call_id").agg((F.max("end") + 20).alias("duration")), key))
    texts = scratch.kept(recovery.recovered(plans, gaps, _retries(plans, gaps), key))
    out = recovery.attach(rows, texts, key).join(texts.select("call_id", "id", "plan", "attempt", "provider"), ["call_id", "id"], "left")
    return out.select("call_id", "id", "retry_text", F.array_join("flags", ",").alias("flags"), "plan", "attempt", "provider")


@query(
    f"""{_ROWS}, p AS (SELECT *, max("end") OVER (PARTITION BY call_id) + 0.5 AS duration, CASE WHEN index % 5 = 0 THEN 1 ELSE 2 END AS priority FROM x),
 q AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY priority, start, id) AS place FROM p WHERE len(flags) > 0 AND retry_text IS NULL)
 SELECT call_id, id, priority, place, greatest(0, start - 2) AS r_start, least(duration, "end" + 2) AS r_end FROM q WHERE place <= 3"""
)
def repair_list(spark, d):
    """The three rows of each call that most need another pass (the budget is the feature)."""
    rows = _rows(spark, d)
    duration = rows.groupBy("call_id").agg((F.max("end") + 0.5).alias("duration"))
    return recovery.repairs(rows.join(duration, "call_id"), ["call_id"])


# ---- names ----

PEOPLE = (
    lexicon.Term("Reza Karim", "person_name", ("Resa Karim", "Resa"), min_alignment_margin=0.05),
    lexicon.Term("Sara", "person_name", ("Zara",), min_alignment_margin=0.05),
)


def _named(spark, d):
    """Rows in which names are heard, with words of half a second each."""
    k = F.col("index")
    s = table(spark, d, "segments").where("call_id IS NOT NULL AND index IS NOT NULL")
    text = F.when(k % 4 == 0, "then Resa Karim, and Zara came").when(k % 4 == 1, "ask Resa today").when(k % 4 == 2, "nobody came").otherwise("Sara and ZARA.")
    s = s.select("call_id", "id", k.alias("index"), F.col("start"), text.alias("text"))
    words = F.transform(F.regexp_extract_all("text", F.lit(r" ?\S+"), F.lit(0)), lambda w, i: F.struct(w.alias("word"), (F.col("start") + i * 0.5).alias("start"), (F.col("start") + (i + 1) * 0.5).alias("end"), (0.9 - i / 100).alias("probability")))
    s = s.withColumn("words", words).withColumn("end", F.col("start") + F.size("words") * 0.5)
    return s.withColumns({"alternative": F.concat(F.lit("so "), "text"), "flags": F.array().cast("array<string>"), "consensus_text": F.col("text"), "confidence_tier": F.lit("high"), "reason": F.lit("r")})


def _decisions(rows):
    """Scores of an aligner: the call's number and the candidate decide."""
    asked = lexicon.alignment_requests(rows, PEOPLE)
    score = F.when(F.col("candidate") == "Sara", 0.7 + (F.col("call_id") % 3) * 0.1).otherwise(F.when(F.col("call_id") % 2 == 0, 0.95).otherwise(0.3))
    scores = asked.select("call_id", "id", "start", "end", "candidate", F.array(score, score).alias("word_scores"), F.array(F.lit(0.9)).alias("word_hits")).dropDuplicates(["call_id", "id", "start", "end", "candidate"])
    return lexicon.decide(asked, scores, PEOPLE)


_NAMED = f"""{cte("segments")},
 n AS (SELECT call_id, id, index % 4 AS k, start, CASE index % 4 WHEN 0 THEN 'then Resa Karim, and Zara came' WHEN 1 THEN 'ask Resa today' WHEN 2 THEN 'nobody came' ELSE 'Sara and ZARA.' END AS text,
   CASE WHEN call_id % 2 = 0 THEN 0.95 ELSE 0.3 END AS r, 0.7 + (call_id % 3) * 0.1 AS s FROM segments WHERE call_id IS NOT NULL AND index IS NOT NULL),
 best AS (SELECT *, CASE WHEN round(abs(r - s), 9) >= 0.05 THEN CASE WHEN r > s THEN 'Reza Karim' ELSE 'Sara' END END AS name FROM n)"""


@query(
    f"""{_NAMED},
 w AS (SELECT call_id, id, start, text, k, name,
   CASE WHEN name IS NULL OR k = 2 THEN text WHEN k = 0 THEN 'then ' || name || ', and Zara came' WHEN k = 1 THEN 'ask ' || name || ' today' ELSE name || ' and ' || name || '.' END AS changed FROM best)
 SELECT call_id, id, '0' AS part, changed AS a, CASE WHEN name IS NULL OR k = 2 THEN '' ELSE '{lexicon.VALIDATED}' END AS b, NULL AS t0, NULL AS t1 FROM w
 UNION ALL SELECT call_id, id, '1', 'so ' || changed, NULL, NULL, NULL FROM w"""
)
def names_written_back(spark, d):
    """Texts of all rows after accepted names are written into them."""
    rows = _named(spark, d)
    out = lexicon.write_back(rows, _decisions(rows), PEOPLE)
    null = lambda t: F.lit(None).cast(t)
    first = out.select("call_id", "id", F.lit("0").alias("part"), F.col("text").alias("a"), F.array_join("flags", ",").alias("b"), null("double").alias("t0"), null("double").alias("t1"))
    return first.unionAll(out.select("call_id", "id", F.lit("1"), "alternative", null("string"), null("double"), null("double")))


#: Words of each text, and the same with a name in place of the run that spells one: word, begin and end in half seconds.
_HEARD = {0: "then| Resa| Karim,| and| Zara| came", 1: "ask| Resa| today", 2: "nobody| came", 3: "Sara| and| ZARA."}
_WRITTEN = {0: (("then", 0, 1), (" N,", 1, 3), (" and", 3, 4), (" Zara", 4, 5), (" came", 5, 6)), 1: (("ask", 0, 1), (" N", 1, 2), (" today", 2, 3)), 3: (("N", 0, 1), (" and", 1, 2), (" ZARA.", 2, 3))}
_PIECES = ", ".join(
    [f"({k}, false, {i}, '{w}', {i}, {i + 1})" for k, text in _HEARD.items() for i, w in enumerate(text.split("|"))]
    + [f"({k}, true, {i}, '{w}', {a}, {b})" for k, words in _WRITTEN.items() for i, (w, a, b) in enumerate(words)]
)


@query(
    f"""{_NAMED}, p(k, changed, position, word, a, b) AS (VALUES {_PIECES})
 SELECT call_id, id, position, CASE WHEN p.changed THEN replace(word, 'N', name) ELSE word END AS word, start + p.a * 0.5 AS start, start + p.b * 0.5 AS "end" FROM best JOIN p ON p.k = best.k AND p.changed = (name IS NOT NULL AND best.k <> 2)"""
)
def words_written_back(spark, d):
    """Words and times of all rows after accepted names took the place of the runs of words that spelled them."""
    rows = _named(spark, d)
    out = lexicon.write_back(rows, _decisions(rows), PEOPLE)
    return out.select("call_id", "id", F.posexplode("words").alias("position", "w")).select("call_id", "id", "position", "w.word", "w.start", "w.end")


@query(
    f"""{_NAMED} SELECT call_id, id, CASE WHEN k = 2 OR name IS NOT NULL THEN text WHEN k = 0 THEN 'then {C.MARKER}, and {C.MARKER} came' WHEN k = 1 THEN 'ask {C.MARKER} today' ELSE '{C.MARKER} and ZARA.' END AS consensus_text,
 CASE WHEN k = 2 OR name IS NOT NULL THEN 'high' ELSE 'unresolved' END AS confidence_tier, CASE WHEN k = 2 OR name IS NOT NULL THEN 'r' ELSE 'sensitive_entity_requires_acoustic_evidence' END AS reason,
 CASE WHEN k = 2 THEN '' WHEN name IS NOT NULL THEN '{lexicon.VALIDATED}' ELSE '{lexicon.UNVERIFIED}' END AS flags FROM best"""
)
def names_masked(spark, d):
    """Consensus texts of all rows with names that no evidence supports masked."""
    rows = _named(spark, d)
    out = lexicon.guard_unverified(lexicon.write_back(rows, _decisions(rows), PEOPLE))
    return out.select("call_id", "id", "consensus_text", "confidence_tier", "reason", F.array_join("flags", ",").alias("flags"))


# ---- evaluation ----


def _audit(spark, d):
    t = tables(spark, d)
    versions = t["transcripts"].select("id", F.col("audio_file_id").alias("audio_id"), "version", "source", F.col("audio_content_hash").alias("audio_hash"), "is_current")
    approved = versions.where("is_current").join(t["transcript_reviews"].where("status = 'approved'").select(F.col("transcript_id").alias("id")), "id", "left_semi")
    sample = t["audio_files"].where("id % 3 > 0").select(F.col("id").alias("audio_id"), F.col("content_sha256").alias("audio_hash"), F.when(F.col("id") % 5 == 0, "holdout").otherwise("development").alias("evaluation_split"))
    return evaluation.audit(sample, approved.select("audio_id", F.col("id").alias("reference_id"), F.col("version").alias("reference_version"), "audio_hash"), versions), t["transcripts"]


_AUDIT = f"""{cte("audio_files", "transcripts", "transcript_reviews")},
 s AS (SELECT id AS audio_id, content_sha256 AS h, CASE WHEN id % 5 = 0 THEN 'holdout' ELSE 'development' END AS evaluation_split FROM audio_files WHERE id % 3 > 0),
 r AS (SELECT t.audio_file_id AS audio_id, t.id AS reference_id, t.version, t.audio_content_hash AS rh, t.content FROM transcripts t JOIN transcript_reviews v ON v.transcript_id = t.id WHERE t.is_current AND v.status = 'approved'),
 b AS (SELECT r.audio_id, max(t.version) AS bv FROM r JOIN transcripts t ON t.audio_file_id = r.audio_id AND t.audio_content_hash = r.rh AND t.source = 'machine' AND t.version < r.version GROUP BY 1),
 a AS (SELECT coalesce(s.audio_id, r.audio_id) AS audio_id, evaluation_split, reference_id, t.id AS baseline_id, r.content AS ref, t.content AS hyp,
   CASE WHEN reference_id IS NULL THEN 'no approved reference' WHEN s.audio_id IS NULL THEN 'not selected' WHEN h <> rh THEN 'audio hash changed' WHEN t.id IS NULL THEN 'no machine baseline' END AS reason
   FROM s FULL JOIN r ON s.audio_id = r.audio_id LEFT JOIN b ON b.audio_id = r.audio_id LEFT JOIN transcripts t ON t.audio_file_id = b.audio_id AND t.version = b.bv)"""


@query(f"{_AUDIT} SELECT audio_id, evaluation_split, reference_id, baseline_id, reason FROM a")
def evaluation_audit(spark, d):
    """Every sampled or approved call, evaluated or with the reason why not."""
    return _audit(spark, d)[0]


@query(
    f"""{_AUDIT} SELECT CASE WHEN grouping(evaluation_split) = 1 THEN 'all' ELSE evaluation_split END AS split, count(*) AS selected, count(*) FILTER (reason IS NULL) AS evaluated, count(*) FILTER (reason = 'no approved reference') AS unapproved,
 count(*) FILTER (reason = 'audio hash changed') AS changed, count(*) FILTER (reason = 'no machine baseline') AS no_baseline,
 CAST(sum(CAST(ref <> hyp AS INT)) FILTER (reason IS NULL) AS DOUBLE) / (2 * count(*) FILTER (reason IS NULL)) AS wer, CAST(sum(CAST(ref <> hyp AS INT)) FILTER (reason IS NULL) AS DOUBLE) / (5 * count(*) FILTER (reason IS NULL)) AS cer
 FROM a WHERE reason IS DISTINCT FROM 'not selected' GROUP BY ROLLUP (evaluation_split)"""
)
def evaluation_report(spark, d):
    """Counts that add up to the sample, and rates of the evaluated calls, by split and for all."""
    from talkloom.functions import text as T

    audited, versions = _audit(spark, d)
    text = lambda key, name: versions.select(F.col("id").alias(key), F.col("content").alias(name))
    both = audited.where("reason IS NULL").join(text("reference_id", "ref"), "reference_id").join(text("baseline_id", "hyp"), "baseline_id")
    scored = both.select("audio_id", T.score(F.col("ref"), F.col("hyp")).alias("s")).select("audio_id", "s.*")
    return evaluation.audit_report(audited, scored).select("split", "selected", "evaluated", "unapproved", "changed", "no_baseline", "wer", "cer")


_FREEZE = f"""{cte("audio_files", "transcripts", "transcript_reviews")},
 r AS (SELECT a.id AS audio_id, a.content_sha256, a.duration_seconds, t.id, t.version, t.content, t.audio_content_hash, v.status FROM audio_files a LEFT JOIN transcripts t ON t.audio_file_id = a.id AND t.is_current LEFT JOIN transcript_reviews v ON v.transcript_id = t.id),
 b AS (SELECT r.audio_id, max(t.version) AS bv FROM r JOIN transcripts t ON t.audio_file_id = r.audio_id AND t.audio_content_hash = r.audio_content_hash AND t.source = 'machine' AND t.version < r.version WHERE status = 'approved' GROUP BY 1),
 x AS (SELECT r.*, t.id AS b_id, t.content AS b_content, CASE WHEN status IS DISTINCT FROM 'approved' THEN 'the current version is not approved' WHEN t.id IS NULL THEN 'no matching machine baseline' WHEN content_sha256 <> r.audio_content_hash THEN 'the audio has changed since the review' END AS reason
   FROM r LEFT JOIN b ON b.audio_id = r.audio_id LEFT JOIN transcripts t ON t.audio_file_id = b.audio_id AND t.version = b.bv)"""


@query(
    f"""{_FREEZE} SELECT audio_id, CASE WHEN audio_id % 4 = 0 THEN 'holdout' ELSE 'development' END AS split, id AS reference_id, b_id AS baseline_id, CASE WHEN content <> b_content THEN 1 ELSE 0 END AS word_errors, 2 AS reference_words, 0.0 AS unresolved_token_rate, NULL AS reason FROM x WHERE reason IS NULL
 UNION ALL SELECT audio_id, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM x WHERE reason IS NOT NULL"""
)
def frozen_references(spark, d):
    """References of all approved calls, frozen and read again with their hashes checked, and why the others have none."""
    t = tables(spark, d)
    split = F.when(F.col("id") % 4 == 0, "holdout").otherwise("development")
    found, refused = references.assemble(t["audio_files"], t["transcripts"], t["transcript_reviews"], split)
    with scratch.folder(spark) as at:
        for name in references.SPLITS:
            references.freeze(found.where(F.col("split") == name), f"{at}/{name}")
        back = references.read(spark, f"{at}/development", "development", t["audio_files"]).unionByName(references.read(spark, f"{at}/holdout", "holdout", t["audio_files"]))
        good = back.select("audio_id", "split", F.col("reference.transcript_id").alias("reference_id"), F.col("baseline.transcript_id").alias("baseline_id"), "score.word_errors", "score.reference_words", "unresolved_token_rate", F.lit(None).cast("string").alias("reason"))
        good = scratch.kept(good)
    null = lambda k: F.lit(None).cast(k)
    return good.unionByName(refused.select("audio_id", null("string").alias("split"), null("long").alias("reference_id"), null("long").alias("baseline_id"), null("long").alias("word_errors"), null("long").alias("reference_words"), null("double").alias("unresolved_token_rate"), "reason"))


def _grid_results(grid, turn):
    """Results of a run over some of the cells: models differ in what they support, and the first turn stops half-way."""
    k = F.col("audio_id") + F.col("repeat")
    done = grid if turn else grid.where(k % 2 == 0)
    status = F.when((F.col("model") == "m2") & (F.col("prompt_mode") == "domain"), "unsupported").when((k % 7 == 0) & F.lit(not turn), "failed").otherwise("completed")
    return done.select("phase", "audio_id", "candidate", "repeat", "seed", status.alias("status"), (k % 10 / 10).alias("wer"))


@query(
    f"""{cte("audio_files")}, g AS (SELECT id AS audio_id, m || '|' || p || '|raw' AS candidate, 40 + rep AS seed, m = 'm2' AND p = 'domain' AS unsupported, rep, id + rep AS k FROM audio_files, (VALUES ('m1'), ('m2')) a(m), (VALUES ('off'), ('domain')) b(p), (VALUES (0), (1), (2)) c(rep) WHERE id % 50 = 0)
 SELECT candidate, seed, count(*) AS cells, count(*) FILTER (NOT unsupported) AS completed, count(*) FILTER (unsupported) AS unsupported, NOT bool_or(unsupported) AS complete,
   count(*) FILTER (k % 2 <> 0 OR (k % 7 = 0 AND NOT unsupported)) AS resumed, sum(CASE WHEN unsupported THEN 0 ELSE k % 10 END) AS tenths FROM g GROUP BY candidate, seed"""
)
def resumed_grid(spark, d):
    """A comparison of models that stopped half-way and was resumed: cells by candidate and seed, and how many the second run did."""
    refs = tables(spark, d)["audio_files"].where("id % 50 = 0").select(F.col("id").alias("audio_id"))
    grid = evaluation.model_grid(refs, ["m1", "m2"], ["off", "domain"], ["raw"], repeats=3, seed=40)
    before = _grid_results(grid, 0)
    left = evaluation.unfinished(grid, before)
    after = evaluation.resumed(before, _grid_results(left, 1))
    sums = after.where("status = 'completed'").groupBy("candidate", "seed").agg(F.sum(F.round(F.col("wer") * 10)).cast("long").alias("tenths"))
    again = left.groupBy("candidate", "seed").agg(F.count("*").alias("resumed"))
    x = evaluation.completeness(grid, after).join(again, ["candidate", "seed"], "left").join(sums, ["candidate", "seed"], "left")
    return x.select("candidate", "seed", "cells", "completed", "unsupported", "complete", F.coalesce("resumed", F.lit(0)).alias("resumed"), F.coalesce("tenths", F.lit(0)).alias("tenths"))


# ---- versions of the store ----


@query(
    f"""{cte("jobs", "transcripts")},
 n AS (SELECT audio_file_id, max(version) + 1 AS version FROM transcripts WHERE audio_file_id % 10 = 0 GROUP BY 1)
 SELECT 'job' AS name, CAST(id AS VARCHAR) AS key, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS a, CAST(CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS VARCHAR) AS b FROM jobs
 UNION ALL SELECT 'version', audio_file_id || ':' || version, content, CAST(is_current AND audio_file_id NOT IN (SELECT audio_file_id FROM n) AS VARCHAR) FROM transcripts
 UNION ALL SELECT 'version', audio_file_id || ':' || version, 'second writer', 'true' FROM n
 UNION ALL SELECT 'store', 'version', '3', 'refused'"""
)
def store_versions(spark, d):
    """Jobs and transcripts after two writers from one version: the second is refused and comes again, and neither change is lost."""
    t = tables(spark, d)
    with scratch.folder(spark) as at:
        s = Store(spark, at)
        s.commit(s.read(), {"jobs": t["jobs"], "transcripts": t["transcripts"]})
        first, second = s.read(), s.read()
        text = lambda now: store.add_versions(now["transcripts"], t["audio_files"].where("id % 10 = 0").select(F.col("id").alias("audio_file_id"), F.lit("second writer").alias("content"), F.lit("human").alias("source"), F.lit("0").alias("audio_content_hash"), F.lit(True).alias("forced")), _now())
        s.commit(first, first.tables | {"jobs": store.retry_failed(first.tables["jobs"], _now())})
        try:
            s.commit(second, second.tables | {"transcripts": text(second.tables)})
            outcome = "accepted"
        except Refused:
            outcome = "refused"
            s.transact(lambda now: now | {"transcripts": text(now)})
        now = s.read()
        rows = now.tables["jobs"].select(F.lit("job").alias("name"), F.col("id").cast("string").alias("key"), F.col("status").alias("a"), F.col("attempts").cast("string").alias("b"))
        key = F.concat_ws(":", F.col("audio_file_id").cast("string"), F.col("version").cast("string"))
        rows = rows.unionAll(now.tables["transcripts"].select(F.lit("version"), key, "content", F.col("is_current").cast("string")))
        return scratch.kept(rows.unionAll(spark.range(1).select(F.lit("store"), F.lit("version"), F.lit(str(now.version)), F.lit(outcome))))


# ---- decoding ----

_PROMPT = "this is what the decoder was told to expect"


def _repeats_sql(text: str) -> str:
    """A character six times in a row, or a word with the white space after it four times."""
    return f"""(coalesce(list_bool_or([substr({text}, i, 6) = repeat(substr({text}, i, 1), 6) AND length(substr({text}, i, 6)) = 6 AND substr({text}, i, 1) <> chr(10) FOR i IN range(1, length({text}) - 4)]), false)
   OR coalesce(list_bool_or([(regexp_extract_all({text}, '\\S+\\s+'))[i] = (regexp_extract_all({text}, '\\S+\\s+'))[i + 1] AND (regexp_extract_all({text}, '\\S+\\s+'))[i] = (regexp_extract_all({text}, '\\S+\\s+'))[i + 2] AND (regexp_extract_all({text}, '\\S+\\s+'))[i] = (regexp_extract_all({text}, '\\S+\\s+'))[i + 3] FOR i IN range(1, len(regexp_extract_all({text}, '\\S+\\s+')) - 2)]), false))"""


@query(
    f"""{cte("segments")},
 x AS (SELECT call_id, index, start, greatest("end", start + 0.5) AS "end", CASE WHEN index % 5 = 4 THEN '{_PROMPT}!' WHEN index % 11 = 7 THEN 'no no no no no no ' ELSE text END AS text, index % 7 = 6 AS dense, CASE WHEN index % 6 = 5 THEN -1.5 ELSE -0.3 END AS lp
   FROM segments WHERE call_id IS NOT NULL AND index IS NOT NULL),
 v AS (SELECT call_id, 0 AS variant, index, start, "end", text, dense, lp FROM x UNION ALL SELECT call_id, 1, index, start, "end", CASE WHEN index % 4 = 2 THEN '' ELSE text END, dense, lp FROM x WHERE index % 4 <> 3),
 f AS (SELECT *, {_repeats_sql("text")} AS loops, variant = 0 AND text = '{_PROMPT}!' AS leaks, coalesce(start < lag("end") OVER (PARTITION BY call_id, variant ORDER BY index), false) AS late FROM v),
 c AS (SELECT call_id, variant, list_sort(list_filter([CASE WHEN bool_or(dense) THEN 'compression' END, CASE WHEN bool_or(late) THEN 'invalid_timestamp' END, CASE WHEN bool_or(leaks) THEN 'prompt_leakage' END, CASE WHEN bool_or(loops) THEN 'repetition' END], lambda s: s IS NOT NULL)) AS d,
   bool_and(trim(text) = '') AS blank, avg(lp) AS mean_logprob, sum("end" - start) AS coverage FROM f GROUP BY 1, 2),
 e AS (SELECT *, CASE WHEN blank THEN list_append(d, 'empty') ELSE d END AS defects FROM c),
 r AS (SELECT *, first_value(variant) OVER (PARTITION BY call_id ORDER BY len(defects), round(-mean_logprob, 9), round(-coverage, 6), variant) AS chosen FROM e)
 SELECT call_id, variant, array_to_string(defects, ',') AS defects, round(mean_logprob, 9) AS mean_logprob, round(coverage, 6) AS coverage, chosen FROM r"""
)
def prompted_candidates(spark, d):
    """Defects of two decoder results of every call, one of which had a prompt that some segments echo, and the better one."""
    k = F.col("index")
    s = table(spark, d, "segments").where("call_id IS NOT NULL AND index IS NOT NULL")
    s = s.select("call_id", "index", "start", F.greatest("end", F.col("start") + 0.5).alias("end"), F.when(k % 5 == 4, f"{_PROMPT}!").when(k % 11 == 7, "no " * 6).otherwise(F.col("text")).alias("text"), F.when(k % 6 == 5, -1.5).otherwise(-0.3).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), F.when(k % 7 == 6, 3.0).otherwise(1.2).alias("compression_ratio"))
    both = s.withColumn("variant", F.lit(0)).unionByName(s.where("index % 4 <> 3").withColumn("text", F.when(k % 4 == 2, "").otherwise(F.col("text"))).withColumn("variant", F.lit(1)))
    texts = both.groupBy("call_id", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ").alias("text")).withColumn("prompt", F.when(F.col("variant") == 0, _PROMPT))
    scored = evaluation.candidate_defects(both, texts, ["call_id", "variant"]).withColumns({"mean_logprob": F.round("mean_logprob", 9), "coverage": F.round("coverage", 6)})
    best = evaluation.choose_candidate(scored, ["call_id"], "variant").withColumnRenamed("variant", "chosen")
    return scored.join(best, "call_id").select("call_id", "variant", F.array_join("defects", ",").alias("defects"), "mean_logprob", "coverage", "chosen")


_HEARD_SQL = f"""{cte("segments")},
 h AS (SELECT call_id, index, start, greatest("end", start + 0.5) AS "end", text, index % 7 = 6 AS dense, CASE WHEN index % 6 = 5 THEN -1.5 ELSE -0.3 END AS lp FROM segments)"""
ORACLES["decoding_candidates"] = f"""{_HEARD_SQL},
 v AS (SELECT call_id, 0 AS variant, * EXCLUDE (call_id) FROM h UNION ALL SELECT call_id, 1, index, start, "end", CASE WHEN index % 4 = 2 THEN reverse(text) ELSE text END, dense, lp FROM h WHERE index % 4 <> 3),
 f AS (SELECT *, {_repeats_sql("text")} AS loops, coalesce(start < lag("end") OVER (PARTITION BY call_id, variant ORDER BY index), false) AS late FROM v),
 c AS (SELECT call_id, variant, list_filter([CASE WHEN bool_or(dense) THEN 'compression' END, CASE WHEN bool_or(late) THEN 'invalid_timestamp' END, CASE WHEN bool_or(loops) THEN 'repetition' END], lambda s: s IS NOT NULL) AS d,
   bool_and(trim(text) = '') AS blank, avg(lp) AS mean_logprob, sum("end" - start) AS coverage FROM f GROUP BY 1, 2),
 e AS (SELECT *, CASE WHEN blank THEN list_append(d, 'empty') ELSE d END AS defects FROM c),
 r AS (SELECT *, first_value(variant) OVER (PARTITION BY call_id ORDER BY len(defects), round(-mean_logprob, 9), round(-coverage, 6), variant) AS chosen FROM e)
 SELECT call_id, variant, array_to_string(defects, ',') AS defects, round(mean_logprob, 9) AS mean_logprob, round(coverage, 6) AS coverage, chosen FROM r"""

ORACLES["retry_texts"] = f"""{_HEARD_SQL},
 g AS (SELECT call_id, start + 1 AS gs, start + 5 AS ge FROM h),
 w AS (SELECT *, string_split(text, ' ') AS parts FROM h WHERE NOT dense AND NOT coalesce({_repeats_sql("text")}, false) AND NOT contains(text, '{C.MARKER}') AND {_NORM.replace("text", "h.text")} <> ''),
 t AS (SELECT w.*, len(parts) AS n, ("end" - start) / len(parts) AS step, gs, ge FROM w JOIN g ON g.call_id = w.call_id AND start <= ge AND "end" >= gs),
 i AS (SELECT *, [k FOR k IN range(0, n) IF trim(parts[k + 1]) <> '' AND start + (k + 1) * step > start + k * step AND ((start + k * step) + (start + (k + 1) * step)) / 2 >= gs AND ((start + k * step) + (start + (k + 1) * step)) / 2 <= ge] AS ks FROM t),
 j AS (SELECT *, CASE WHEN len(ks) > 0 THEN trim(array_to_string([parts[k + 1] || CASE WHEN k < n - 1 THEN ' ' ELSE '' END FOR k IN ks], ''))
   WHEN (least("end", ge) - greatest(start, gs)) / greatest(0.001, "end" - start) >= 0.8 THEN trim(text) END AS said, CASE WHEN len(ks) > 0 THEN start + ks[1] * step ELSE greatest(gs, start) END AS heard FROM i),
 q AS (SELECT call_id, gs, ge, string_agg(said, ' ' ORDER BY index, heard) AS said, count(*) AS n, arg_min(heard, index) AS heard FROM j WHERE said <> '' AND NOT {_repeats_sql("said")} AND NOT contains(said, '{C.MARKER}') GROUP BY 1, 2, 3)
 SELECT call_id, gs AS start, ge AS "end", said AS text, n AS n_segments, round(heard, 3) AS heard_from FROM q WHERE NOT {_repeats_sql("said")}"""
