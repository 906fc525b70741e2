"""Gap recovery, names, frozen references and model grids on small tables."""

import pytest
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.operators import evaluation, lexicon, recovery
from talkloom.sources import references

ROW = "call_id long, id string, start double, end double, text string, alternative string, flags array<string>, retry_text string"
RETRY = "call_id long, plan long, attempt int, provider int, variant string, status string, index long, s_start double, s_end double, text string, avg_logprob double, no_speech_prob double, compression_ratio double, words array<struct<word:string,start:double,end:double,probability:double>>, prompt string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "a", 0.0, 2.0, "", None, [], None), (1, "b", 2.0, 4.0, "said", "", [], None), (1, "c", 4.0, 5.0, C.MARKER, "aaaaaaa", ["z"], None), (1, "d", 30.0, 31.0, "x", "", ["compression"], None),
        (1, "e", 40.0, 41.0, None, None, None, None), (1, "f", 50.0, 51.0, "", "", [], "heard"), (2, "a", 0.0, 1.0, "", "", ["repetition"], None), (3, "a", 0.0, 1.0, "fine", "", ["low_logprob"], None),
    ], ROW)


def test_gap_candidates(spark, rows):
    speech = spark.createDataFrame([(1, 0.5, 4.5), (1, 30.5, 40.0), (3, 0.0, 9.0)], "call_id long, start double, end double")
    got = [(r.call_id, r.id, r.position) for r in recovery.gap_candidates(rows, speech, ["call_id"]).orderBy("call_id", "position").collect()]
    assert got == [(1, "a", 0), (1, "c", 1), (1, "d", 2), (2, "a", 0)]  # e has no speech, of call 2 none is known
    assert recovery.gap_candidates(rows.where("false"), speech, ["call_id"]).count() == 0


def test_recovered_and_attached(spark, rows):
    key = ["call_id"]
    gaps = recovery.gap_candidates(rows, spark.createDataFrame([], "call_id long, start double, end double"), key)
    durations = spark.createDataFrame([(1, 60.0), (2, 60.0)], "call_id long, duration double")
    plans = recovery.plans(gaps, durations, key)
    assert [(r.call_id, r.plan, r.ids) for r in plans.orderBy("call_id", "plan").collect()] == [(1, 0, ["a", "c"]), (1, 1, ["d"]), (1, 2, ["e"]), (2, 0, ["a"])]
    word = lambda w, a, b, p: {"word": w, "start": a, "end": b, "probability": p}
    retry = lambda plan, attempt, provider, variant, index, a, b, text, words=(), status="completed", lp=-0.3, call=1: (call, plan, attempt, provider, variant, status, index, a, b, text, lp, 0.1, 1.0, list(words), "")
    retries = spark.createDataFrame([
        retry(0, 0, 0, "raw", 0, 0.0, 5.0, "aaaaaaaa"),  # a loop
        retry(0, 0, 1, "raw", 0, 0.0, 5.0, "one two", [word(" one", 0.5, 1.0, 0.9), word(" two", 4.2, 4.6, 0.8)]),
        retry(0, 0, 1, "agc", 0, 0.0, 5.0, "", lp=-0.1),  # empty: a defect
        retry(0, 1, 0, "raw", 0, 0.0, 5.0, "never looked at"),
        retry(1, 0, 0, "raw", 0, 30.0, 31.0, "failed", status="failed"),
        retry(1, 1, 0, "raw", 0, 30.0, 31.0, "weak", [word("weak", 30.2, 30.4, 0.4)]),  # one word of low probability
        retry(1, 1, 1, "raw", 0, 30.1, 30.9, "whole segment"),
        retry(0, 0, 0, "raw", 0, 0.0, 1.0, C.MARKER, call=2),
    ], RETRY)
    texts = recovery.recovered(plans, gaps, retries, key)
    assert sorted((r.call_id, r.plan, r.attempt, r.provider, r.variant, r.id, r.text) for r in texts.collect()) == [(1, 0, 0, 1, "raw", "a", "one"), (1, 0, 0, 1, "raw", "c", "two"), (1, 1, 1, 1, "raw", "d", "whole segment")]
    out = recovery.attach(rows, texts, key)
    got = {(r.call_id, r.id): (r.retry_text, r.flags, r.retry_segments) for r in out.collect()}
    assert got[1, "a"][:2] == ("one", [recovery.RECOVERED]) and got[1, "c"][:2] == ("two", [recovery.RECOVERED, "z"]) and got[1, "f"] == ("heard", [], None) and got[1, "e"] == (None, None, None)
    assert [(s.start, s.end, s.text) for s in got[1, "c"][2]] == [(4.2, 4.6, "two")]
    left = recovery.gap_candidates(out, spark.createDataFrame([], "call_id long, start double, end double"), key)
    calls = spark.createDataFrame([(1,), (2,), (3,)], "call_id long")
    assert sorted(tuple(r) for r in recovery.summary(plans, texts, left, calls, key).collect()) == [(1, 3, 2, 3, 1), (2, 1, 0, 0, 1), (3, 0, 0, 0, 0)]
    again = recovery.attach(out, texts.where("id = 'a'"), key)
    assert {(r.call_id, r.id): r.retry_segments is not None for r in again.collect()}[1, "c"]  # kept


def test_repairs_and_what_a_reviewer_gets(spark, rows):
    x = rows.withColumn("duration", F.lit(31.5)).unionByName(spark.createDataFrame([(1, f"r{k}", 10.0 + k, 11.0 + k, "", "", [f], None, 31.5) for k, f in enumerate(["low_logprob", "repetition", "speech_gap", "other"])], ROW + ", duration double"))
    got = [(r.call_id, r.id, r.priority, r.place, r.r_start, r.r_end) for r in recovery.repairs(x, ["call_id"]).orderBy("call_id", "place").collect()]
    assert got == [(1, "r1", 0, 1, 9.0, 14.0), (1, "d", 1, 2, 28.0, 31.5), (1, "r0", 2, 3, 8.0, 13.0), (2, "a", 0, 1, 0.0, 3.0), (3, "a", 2, 1, 0.0, 3.0)]
    calls = spark.createDataFrame([(1, 60.0), (9, 1.0)], "call_id long, duration double")
    got = {r.call_id: r for r in recovery.review_input(rows.withColumn("speaker", F.lit("s")), calls).collect()}
    import json

    first = [json.loads(s) for s in got[1].segments]
    assert [s["id"] for s in first] == ["a", "b", "c", "d", "e", "f"] and first[1]["speaker"] == "s" and first[5]["retry_text"] == "heard" and "words" not in first[0] and got[9].segments == []
    spoken = spark.createDataFrame([(1, "A", ["word_aligned"]), (1, "", ["mixed_speakers"]), (1, None, None), (1, C.UNKNOWN_SPEAKER, [])], "call_id long, speaker string, flags array<string>")
    assert [tuple(r) for r in recovery.speaker_counters(spoken).collect()] == [(1, 4, 1, 1, 1)]


TERMS = (lexicon.Term("Ann Lee", "person_name", ("An Li",)), lexicon.Term("Bo", "person_name", ("Boo", "Beau")))
DECISION = "call_id long, id string, trigger string, observed string, start double, end double, canonical string, score double, hits double, runner_up double, accepted boolean"


def test_names_are_written_back(spark):
    """Several disjoint runs, in words and texts; of one row and name the first decision; rejected names are masked; nulls."""
    word = lambda i, w, p=0.9: {"word": w, "start": i / 2, "end": i / 2 + 0.5, "probability": p}
    spoken = [word(i, w, None if i == 1 else 0.9 - i / 10) for i, w in enumerate([" An", " Li,", " then", " An", " Li", " Boo."])]
    rows = spark.createDataFrame([
        (1, "a", "An Li, then an  li Boo.", "AN LI and Boo", spoken, ["z"], "An Li, then Boo", "high", "r"), (1, "b", "Boo and Boot", None, None, None, "Boo, boo and Boot", "high", "r"),
        (1, "c", "An Li Boo", "", [], [], "An Li Boo", "high", "r"), (1, "d", None, None, None, None, None, None, None),
    ], "call_id long, id string, text string, alternative string, words array<struct<word:string,start:double,end:double,probability:double>>, flags array<string>, consensus_text string, confidence_tier string, reason string")
    decisions = spark.createDataFrame([
        (1, "a", "Ann Lee", "An Li", 1.5, 2.5, "Ann Lee", 0.9, 0.9, 0.1, True), (1, "a", "Ann Lee", "An Li", 0.0, 1.0, "Ann Lee", 0.9, 0.9, 0.1, True), (1, "a", "Bo", "Boo", 2.5, 3.0, "Bo", 0.8, 0.9, 0.1, True),
        (1, "b", "Bo", "Boo", 0.0, 1.0, None, 0.2, 0.1, 0.1, False), (1, "c", "Ann Lee", "An Li", 0.0, 1.0, None, 0.2, 0.1, 0.1, False), (1, "c", "Bo", "Boo", 1.0, 2.0, "Bo", 0.8, 0.9, 0.1, True),
    ], DECISION)
    out = lexicon.write_back(rows, decisions, TERMS)
    got = {r.id: r for r in out.collect()}
    assert (got["a"].text, got["a"].alternative, got["a"].flags) == ("Ann Lee, then Ann Lee Bo.", "Ann Lee and Bo", [lexicon.VALIDATED, "z"])
    assert [(w.word, w.start, w.end, w.probability) for w in got["a"].words] == [(" Ann Lee,", 0.0, 1.0, 0.9), (" then", 1.0, 1.5, pytest.approx(0.7)), (" Ann Lee", 1.5, 2.5, pytest.approx(0.5)), (" Bo.", 2.5, 3.0, pytest.approx(0.4))]
    assert [d.start for d in got["a"].entity_resolutions] == [0.0, 2.5] and len(got["a"].entity_candidates) == 3
    assert (got["b"].text, got["b"].flags, got["b"].entity_resolutions, len(got["b"].entity_candidates)) == ("Boo and Boot", None, [], 1)
    assert got["c"].text == "An Li Bo" and got["d"].text is None and got["d"].entity_candidates == []
    guarded = {r.id: r for r in lexicon.guard_unverified(out).collect()}
    assert (guarded["b"].consensus_text, guarded["b"].confidence_tier, guarded["b"].flags) == (f"{C.MARKER}, {C.MARKER} and Boot", "unresolved", [lexicon.UNVERIFIED])
    assert [tuple(s) for s in guarded["b"].uncertainty_spans] == [("Boo", "ctc_score_or_margin_below_threshold")]
    assert guarded["c"].consensus_text == "An Li Boo" and guarded["c"].confidence_tier == "high" and guarded["c"].uncertainty_spans == []  # one of its names was accepted
    assert guarded["d"].consensus_text is None and lexicon.term_snapshot(TERMS)[1]["aliases"] == ["Boo", "Beau"]


def test_references_are_frozen_and_read(spark, tmp_path):
    calls = spark.createDataFrame([(k, f"h{k}", 10.0, "inbound") for k in range(1, 7)], "id long, content_sha256 string, duration_seconds double, direction string")
    t = [(10, 1, 1, "text a b", "machine", "h1", False), (11, 1, 2, "text a c", "human", "h1", True), (20, 2, 1, "one", "machine", "h2", False), (21, 2, 2, f"two {C.MARKER}", "machine", "h2", False), (22, 2, 3, "two", "human", "h2", True), (30, 3, 1, "x", "human", "h3", True), (40, 4, 1, "x", "machine", "old", False), (41, 4, 2, "y", "human", "old", True), (50, 5, 1, "x", "machine", "h5", True)]
    transcripts = spark.createDataFrame(t, "id long, audio_file_id long, version long, content string, source string, audio_content_hash string, is_current boolean")
    reviews = spark.createDataFrame([(11, "approved"), (22, "approved"), (30, "approved"), (41, "approved"), (50, "in_review")], "transcript_id long, status string")
    found, refused = references.assemble(calls, transcripts, reviews, F.lit("development"))
    assert sorted((r.audio_id, r.reason) for r in refused.collect()) == [(3, "no matching machine baseline"), (4, "the audio has changed since the review"), (5, "the current version is not approved"), (6, "the current version is not approved")]
    where = str(tmp_path / "refs")
    references.freeze(found.coalesce(1), where)
    with pytest.raises(Exception, match="exist"):
        references.freeze(found, where)
    back = {r.audio_id: r for r in references.read(spark, where, "development", calls).collect()}
    assert {k: (r.reference.transcript_id, r.baseline.transcript_id, r.score.word_errors, r.score.reference_words, r.unresolved_token_rate) for k, r in back.items()} == {1: (11, 10, 1, 3, 0.0), 2: (22, 21, 1, 1, 0.5)}
    file = next((tmp_path / "refs").glob("part-*.json"))
    (tmp_path / "refs" / f".{file.name}.crc").unlink()
    whole = file.read_text()
    for edit, why in ((whole.replace("text a c", "text a d"), "changed after it was frozen"), (whole.replace('"version":2', '"version":3', 1), "changed after"), (whole + whole.splitlines()[0] + "\n", "frozen twice"), (whole.replace('"schema_version":1', '"schema_version":2', 1), "another schema")):
        file.write_text(edit)
        with pytest.raises(references.Tampered, match=why):
            references.read(spark, where, "development")
    file.write_text(whole)
    with pytest.raises(references.Tampered, match="another split"):
        references.read(spark, where, "holdout")
    with pytest.raises(references.Tampered, match="call 2: the audio has changed"):
        references.read(spark, where, "development", calls.withColumn("content_sha256", F.when(F.col("id") == 2, "new").otherwise(F.col("content_sha256"))))
    assert references.read(spark, where, "development").count() == 2


def test_a_grid_resumes_to_the_same_table(spark):
    refs = spark.createDataFrame([(1,), (2,), (2,)], "audio_id long")
    grid = evaluation.model_grid(refs, ["a", "b"], ["off", "glossary"], ["raw"], repeats=2, seed=7)
    assert grid.count() == 2 * 2 * 2 * 2 and {r.seed for r in grid.select("seed").collect()} == {7, 8}
    done = lambda g, status: g.select("phase", "audio_id", "candidate", "repeat", "seed", F.lit(status).alias("status"))
    half = done(grid.where("audio_id = 1"), "completed").unionByName(done(grid.where("audio_id = 2 AND repeat = 0"), "failed")).unionByName(done(grid.where("audio_id = 2 AND model = 'b' AND repeat = 1"), "unsupported"))
    left = evaluation.unfinished(grid, half)
    assert left.count() == 6  # failed cells and those never run, not the unsupported
    table = evaluation.resumed(half, done(left, "completed"))
    assert table.count() == grid.count() and evaluation.unfinished(grid, table).count() == 0
    assert sorted((r.candidate, r.seed, r.cells, r.completed, r.unsupported, r.complete) for r in evaluation.completeness(grid, table).collect()) == sorted([(f"{m}|{p}|raw", s, 2, 1 if (m, s) == ("b", 8) else 2, int((m, s) == ("b", 8)), m == "a") for m in "ab" for p in ("off", "glossary") for s in (7, 8)])
    for bad in ({"models": []}, {"models": ["a", "a"]}, {"models": ["a"], "repeats": 0}, {"models": ["a"], "prompt_modes": ["loud"]}, {"models": ["a"], "audio_variants": []}):
        with pytest.raises(ValueError):
            evaluation.model_grid(refs, **bad)


def test_an_audit_adds_up(spark):
    sample = spark.createDataFrame([(k, f"h{k}", "development") for k in range(1, 6)], "audio_id long, audio_hash string, evaluation_split string")
    approved = spark.createDataFrame([(1, 11, 2, "h1"), (2, 21, 2, "changed"), (3, 31, 1, "h3"), (9, 91, 2, "h9")], "audio_id long, reference_id long, reference_version long, audio_hash string")
    versions = spark.createDataFrame([(10, 1, 1, "machine", "h1"), (8, 1, 0, "machine", "h1"), (12, 1, 3, "machine", "h1"), (20, 2, 1, "machine", "changed"), (90, 9, 1, "machine", "h9")], "id long, audio_id long, version long, source string, audio_hash string")
    audited = evaluation.audit(sample, approved, versions)
    assert sorted((r.audio_id, r.baseline_id, r.reason) for r in audited.collect()) == [(1, 10, None), (2, 20, "audio hash changed"), (3, None, "no machine baseline"), (4, None, "no approved reference"), (5, None, "no approved reference"), (9, 90, "not selected")]
    scored = spark.createDataFrame([(1, 1, 4, 2, 10)], "audio_id long, word_errors long, reference_words long, character_errors long, reference_characters long")
    report = {r.split: r for r in evaluation.audit_report(audited, scored).collect()}
    r = report["all"]
    assert r.selected == 5 == r.evaluated + r.unapproved + r.changed + r.no_baseline and (r.wer, r.cer) == (0.25, 0.2) and report["development"].evaluated == 1
