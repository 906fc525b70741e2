"""Reviews, corrections and refinement against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.operators import revisions, speakers, store

NOW = "2024-01-01 00:00:00"


@pytest.fixture()
def tables(spark):
    return {
        "audio_files": spark.createDataFrame([(1, "a.mp3", 9.0, "h"), (2, "b.mp3", 9.0, "other"), (3, "c.mp3", 9.0, "h")], "id long, filename string, duration_seconds double, content_sha256 string"),
        "jobs": spark.createDataFrame([(1, 1, "transcribe", "completed"), (2, 2, "transcribe", "completed"), (3, 3, "transcribe", "running")], "id long, audio_file_id long, stage string, status string"),
        "transcripts": spark.createDataFrame([(10, 1, 1, "old", "h", True), (20, 2, 1, "old", "h", True), (30, 3, 1, "old", "h", True)], "id long, audio_file_id long, version long, content string, audio_content_hash string, is_current boolean").withColumn("content_hash", F.sha2("content", 256)).withColumn("source", F.lit("machine")),
        "transcript_reviews": spark.createDataFrame([], "transcript_id long, status string, reviewer string, notes string, data_json string, base_transcript_id long"),
        "review_corrections": spark.createDataFrame([], "id long, audio_file_id long, segment_id string, source_transcript_id long, result_transcript_id long, original_text string, corrected_text string"),
    }


SEGMENTS = "audio_file_id long, id string, start double, end double, text string, speaker string, uncertain boolean"
REQUEST = "audio_file_id long, base_transcript_id long, status string, reviewer string, notes string, content string"


def test_review_checks(spark, tables):
    s = spark.createDataFrame([(1, "s1", 0.0, 3.0, "ok", "A", False), (2, "s1", 0.0, 3.0, "ok", "A", False), (3, "s1", 0.0, 3.0, "ok", "A", False)], SEGMENTS)
    asked = [(1, 10, "approved"), (2, 20, "approved"), (1, 9, "approved"), (1, 10, "done"), (3, 30, "approved"), (4, 40, "approved")]
    r = spark.createDataFrame([(*a, "r", "", None) for a in asked], REQUEST)
    got = {(x.audio_file_id, x.base_transcript_id, x.status): x.error for x in revisions.check_reviews(r, tables, s, s.select("audio_file_id", "id")).collect()}
    assert got == dict(zip(asked, [None, "audio changed", "stale base version", "invalid status", "call in progress or skipped", "unknown call"], strict=True))


@pytest.mark.parametrize(
    ("row", "notes", "error"),
    [
        (("s1", 0.0, 9.1, "ok", "A", False), "", None),
        (("s1", 0.0, 9.2, "ok", "A", False), "", "segment out of range"),
        (("s1", 2.0, 2.0, "ok", "A", False), "", "segment out of range"),
        (("s1", 0.0, float("nan"), "ok", "A", False), "", "segment out of range"),
        (("s1", 0.0, 3.0, " ", "A", False), "", "segment without text"),
        (("s1", 0.0, 3.0, "ok", None, False), "", "segment without speaker"),
        (("s1", 0.0, 3.0, "ok", "A", True), "", "notes required"),
        (("s1", 0.0, 3.0, f"so {C.MARKER}", "A", False), "", "notes required"),
        (("s1", 0.0, 3.0, f"so {C.MARKER}", "A", False), "heard", None),
        (("s2", 0.0, 3.0, "ok", "A", False), "", "notes required"),
    ],
)
def test_review_of_segments(spark, tables, row, notes, error):
    previous = spark.createDataFrame([(1, "s1")], "audio_file_id long, id string")
    r = spark.createDataFrame([(1, 10, "approved", "r", notes, None)], REQUEST)
    assert [x.error for x in revisions.check_reviews(r, tables, spark.createDataFrame([(1, *row)], SEGMENTS), previous).collect()] == [error]


def test_save_review_renders_segments(spark, tables):
    s = spark.createDataFrame([(1, "s2", 4.0, 5.0, " second ", "B", False), (1, "s1", 0.0, 3.0, "first", "A", False)], SEGMENTS)
    r = spark.createDataFrame([(1, 10, "approved", " r ", "", None), (1, 10, "in_review", "q", "", None)], REQUEST)
    out, refused = revisions.save_reviews(tables, r, s, s.select("audio_file_id", "id"), F.lit(NOW).cast("timestamp_ntz"))
    assert [(x.reviewer, x.error) for x in refused.collect()] == [("q", "stale base version")]
    new = out["transcripts"].where("audio_file_id = 1 and is_current").collect()
    assert [(x.version, x.source) for x in new] == [(2, "human_review")]
    assert C.REVIEWED in new[0].content and new[0].content.index("first") < new[0].content.index("second")
    review = out["transcript_reviews"].first()
    assert (review.transcript_id, review.status, review.reviewer, review.base_transcript_id) == (new[0].id, "approved", "r", 10)
    assert [x["text"] for x in json.loads(review.data_json)["segments"]] == ["first", "second"]


CORRECTED = "audio_file_id long, index long, id string, start double, end double, text string, speaker string, uncertain boolean, flags array<string>, confidence_tier string, reason string, candidates array<struct<id:string,text:string>>"


def test_corrections(spark, tables):
    open_ = f"a {C.MARKER}"
    s = spark.createDataFrame([(1, 0, "s1", 0.0, 2.0, open_, "A", True, ["unclear", "low_logprob"], "unresolved", None, [("raw-1", "a b 7")]), (1, 1, "s2", 3.0, 4.0, "fine", "B", False, [], "high", None, [])], CORRECTED)
    asked = [("s1", 10, "raw-1", None), ("s1", 10, None, open_), ("s1", 10, None, "  x \n y "), ("s1", 10, "raw-2", None), ("s2", 10, None, "x"), ("s3", 10, None, "x"), ("s1", 9, None, "x")]
    r = spark.createDataFrame([(1, b, i, "r", c, t) for i, b, c, t in asked], "audio_file_id long, base_transcript_id long, segment_id string, reviewer string, candidate_id string, custom_text string")
    got = {(x.segment_id, x.base_transcript_id, x.candidate_id, x.custom_text): (x.corrected_text, x.error) for x in revisions.check_corrections(r, tables, s).collect()}
    want = [("a b 7", None), (open_, "still unresolved"), ("x y", None), (None, "no text"), ("x", "segment is resolved"), ("x", "unknown segment"), ("x", "stale base version")]
    assert got == dict(zip(asked, want, strict=True))
    out, rows, refused = revisions.save_corrections(tables, r, s, F.lit(NOW).cast("timestamp_ntz"))
    fixed = {x.id: x for x in rows.collect()}
    assert (fixed["s1"].text, fixed["s1"].flags, fixed["s1"].confidence_tier, fixed["s1"].uncertain) == ("a b 7", ["low_logprob", "verify_numbers"], "human_corrected", False)
    assert fixed["s2"].text == "fine" and refused.count() == 6
    new = out["transcripts"].where("audio_file_id = 1 and is_current").first()
    example = out["review_corrections"].collect()
    assert [(x.original_text, x.corrected_text, x.source_transcript_id, x.result_transcript_id) for x in example] == [(open_, "a b 7", 10, new.id)]
    assert "a b 7" in new.content and new.version == 2


def test_correction_that_keeps_line_breaks_is_no_change(spark, tables):
    s = spark.createDataFrame([(1, 0, "s1", 0.0, 2.0, "a\nb  c ", "A", True, [], "unresolved", None, [("raw-1", "a b c")])], CORRECTED)
    asked = [(None, "a\nb  c "), (None, " a\nb  c"), (None, "a b c"), ("raw-1", "a\nb  c "), ("raw-1", None)]
    r = spark.createDataFrame([(1, 10, "s1", "r", c, t) for c, t in asked], "audio_file_id long, base_transcript_id long, segment_id string, reviewer string, candidate_id string, custom_text string")
    got = {(x.candidate_id, x.custom_text): x.error for x in revisions.check_corrections(r, tables, s).collect()}
    assert got == dict(zip(asked, ["no change", "no change", None, None, None], strict=True))


def test_ids_have_no_gaps(spark):
    ids = sorted(r.id for r in store.next_ids(spark.range(5000).select(F.col("id").alias("k")), spark.createDataFrame([(7,)], "id long"), ["k"]).collect())
    assert ids == list(range(8, 5008))


def test_refine_audits(spark):
    words = "call_id long, id string, word_index int, char_start int, char_end int, word string, start double, end double, score double, hits double, method string, accepted boolean"
    one = lambda i, a, b, t0, t1, hits=0.9, method="ctc", text="ab", score=0.9: [(1, i, 0, a, b, text, t0, t1, score, hits, method, True)]
    cases = {
        "good": one("good", 0, 2, 0.5, 1.0),
        "attention": one("attention", 0, 2, 0.5, 1.0, None, C.ATTENTION),
        "weak": one("weak", 0, 2, 0.5, 1.0, 0.2),
        "early": one("early", 0, 2, -0.4, 1.0),
        "shifted": one("shifted", 1, 2, 0.5, 1.0),
        "other": one("other", 0, 1, 0.5, 1.0, text="a"),
    }
    want = {"good": None, "attention": None, "weak": "insufficient evidence", "early": "word bounds or order", "shifted": "text not literal", "other": "words omitted or added"}
    aligned = spark.createDataFrame([(1, i, 0.0, 5.0, None, "ab", ["x"]) for i in cases], "call_id long, id string, start double, end double, speaker_id string, text string, flags array<string>")
    turns = spark.createDataFrame([(1, 0.0, 2.0, "A")], "call_id long, start double, end double, speaker_id string")
    got = {r.id: (r.refined_id, r.error, r.flags) for r in speakers.refine(aligned, spark.createDataFrame([w for c in cases.values() for w in c], words), turns).collect()}
    assert got == {i: ("A" if e is None else None, e, ["boundary_review_required", "word_aligned", "x"] if e is None else ["x"]) for i, e in want.items()}
