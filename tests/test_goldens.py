"""Small literal cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import signal
from talkloom.functions import text as T
from talkloom.operators import evaluation, evidence, intervals, lexicon, review, speakers
from talkloom.sources.calls import parse_filename


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def seg(a, b, text, **more):
    return {"start": a, "end": b, "text": text, **more}


def times(rows):
    return [(r["start"], r["end"]) for r in rows]


def test_text(spark):
    r = one(
        spark,
        T.normalize(F.lit("علي  ۱۲۳٤ ")).alias("n"),
        T.text_flags(F.lit("از از از از از ")).alias("loop"),
        T.text_flags(F.lit("میفهوموییییییییی")).alias("letters"),
        T.text_flags(F.lit("۲۰۰ تومان")).alias("number"),
        T.text_flags(F.lit(" ")).alias("blank"),
        T.clock(F.lit(59.2)).alias("a"),
        T.clock(F.lit(6001.1), up=True).alias("b"),
        T.marker_spans(F.lit(f"a {C.MARKER} b {C.MARKER}")).alias("spans"),
        T.text_flags(F.lit("x"), F.lit(float("nan"))).alias("nan"),
    )
    assert r.n == "علی 1234"
    assert "repetition" in r.loop and "repetition" in r.letters
    assert r.number == ["verify_numbers"] and r.blank == ["unclear"]
    assert (r.a, r.b) == ("00:59", "100:02")
    assert [(s.start_char, s.end_char) for s in r.spans] == [(2, 11), (14, 23)]
    assert r.nan == ["invalid_asr_metrics"]


def test_score(spark):
    s = one(spark, T.score(F.lit("سلام مبلغ ۲۰۰ تومان"), F.lit("سلام مبلغ ۳۰۰ تومان")).alias("s")).s
    assert (s.wer, s.word_errors, s.number_recall, s.number_precision) == (0.25, 1, 0.0, 0.0)
    assert one(spark, T.score(F.lit(""), F.lit("a")).alias("s")).s.wer is None
    assert one(spark, T.score(F.lit("علي ۱۲۳"), F.lit("علی 123")).alias("s")).s.word_errors == 0
    assert T.edit_distance(list("kitten"), list("sitting")) == 3


def test_filename(spark):
    rows = spark.createDataFrame([("external-101-0912-20240102-030405-77.mp3",), ("OUT-0912-101-20240102-030405-77.WAV",), ("other.mp3",), ("internal-1-2-20241332-030405-7.ogg",)], "n string").select(parse_filename("n").alias("p")).collect()
    a, b, c, d = (r.p for r in rows)
    assert (a.direction, a.agent_extension, a.remote_number, a.call_id, str(a.recorded_at)) == ("inbound", "101", "0912", "77", "2024-01-02 03:04:05")
    assert (b.direction, b.agent_extension, b.remote_number) == ("outbound", "101", "0912")
    assert c.direction is None and d.direction == "internal" and d.recorded_at is None


def test_timeline():
    rows = evidence.build_one([seg(0, 2, "سلام")], [seg(3, 5, "خداحافظ")], 8, [{"start": 6, "end": 8}])
    assert times(rows) == [(0, 2), (3, 5), (6.4, 7.6)] and rows[1]["alternative"] == "خداحافظ" and rows[2]["flags"] == ["speech_gap"]
    same = [seg(1, 2, "سلام")]
    assert len(evidence.build_one(same, same, 3, [{"start": 0.6, "end": 2.4}])) == 1
    words = [{"start": 0, "end": 1, "word": "سلام"}, {"start": 2, "end": 2, "word": " خانم"}, {"start": 2.1, "end": 4.5, "word": " یوسفی"}]
    rows = evidence.build_one([seg(0, 2, "سلام"), seg(2, 4, "خانم یوسفی")], [seg(0, 4.5, "سلام خانم یوسفی", words=words)], 5)
    assert [r["alternative"] for r in rows] == ["سلام", "خانم یوسفی"] and sum(len(r["alternative_sources"]) for r in rows) == 3
    rows = evidence.build_one([seg(1, 2, "سلام"), seg(3, 4, "خوب هستین")], [seg(0.5, 4.5, "سلام حالتون خوبه")], 5)
    assert len(rows) == 1 and rows[0]["text"] == "سلام خوب هستین" and "alternative_timing_uncertain" in rows[0]["flags"]
    assert [b - a <= 8 for a, b in times(evidence.build_one([], [], 35, [{"start": 0, "end": 30}]))] == [True] * 4
    loop = [{"word": "۶", "start": 0.0, "end": 0.0}] * 15
    rows = evidence.build_one([], [seg(0, 29.98, "۶" * 15, words=loop, compression_ratio=3.1)], 30.0)
    assert times(rows) == [(0, 29.98)] and "failed_decode" in rows[0]["flags"] and len(rows[0]["alternative_sources"]) == 1
    rows = evidence.build_one([seg(i, i + 1, "شکر", compression_ratio=8.0) for i in (1, 2, 3)], [], 5)
    assert times(rows) == [(1, 4)] and rows[0]["text"] == C.MARKER
    assert evidence.build_one([seg(1, 1, "", words=[])], [], 2) == []


def test_consensus(spark):
    kind = "text string, alternative string, retry_text string, flags array<string>, words array<struct<word:string,start:double,end:double,probability:double>>, other_words array<struct<word:string,start:double,end:double,probability:double>>, providers array<string>, retry_aligned boolean"
    strong = [("a", 0.0, 1.0, 0.82)] * 6
    rows = [
        ("مبلغ ۲۰۰ تومان ثبت شد", "مبلغ ۹۰۰ تومان ثبت شد", None, [], [], [], [], False),
        ("سلام وقت بخیر", "سلام وقت بخیر", None, [], [], [], [], False),
        ("کارشناس مربوطه با شما تماس می‌گیرد", "کارشان مربوطه با اتون تماس می‌گیره", None, [], strong, [], [], False),
        ("مبلغ ۲۰۰ تومان", "مبلغ ۲۰۰ تومان", None, [], [], [], ["mlx-whisper"], False),
        ("", None, None, [], None, None, None, None),
        ("سلام", "", None, [], [], [], [], False),
    ]
    got = evidence.consensus(spark.createDataFrame(rows, kind)).collect()
    assert got[0].consensus_text == f"مبلغ {C.MARKER} تومان ثبت شد" and got[0].reason == "sensitive_disagreement"
    assert got[1].confidence_tier == "high"
    assert got[2].reason == "strong_primary_alignment_over_disagreement"
    assert got[3].consensus_text == f"مبلغ {C.MARKER} تومان" and got[3].confidence_tier == "unresolved"
    assert got[4].reason == "no_usable_decode" and got[5].confidence_tier == "low"


def test_windows(spark):
    r = spark.createDataFrame([(1, 1.328, 10.32), (1, 10.6, 12.0), (1, 20.0, 51.0)], "c int, start double, end double").withColumn("duration", F.lit(60.0))
    got = sorted(times(intervals.tight_windows(r, ["c"], "duration").collect()))
    assert got == [(1.328, 12.0), (20.0, 35.0), (35.0, 50.0), (50.0, 51.0)]


def test_attempts(spark):
    p = spark.createDataFrame([(1, 1.7, 9.9, 0.0, 30.0)], "c int, gap_start double, gap_end double, start double, end double").withColumn("duration", F.lit(100.0))
    rows = intervals.attempt_windows(p, "duration", 60.0).orderBy("attempt").collect()
    assert (rows[0].a_start, rows[0].a_end) == (1.3, 10.3) and rows[-1].mode == "expanded"


def test_speakers(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 4.0)], "call_id int, id string, start double, end double")
    turn = "call_id int, start double, end double, speaker_id string"
    t = spark.createDataFrame([(1, 0.0, 4.0, "A"), (1, 0.0, 4.0, "A")], turn)
    assert speakers.align_segments(s, t).first().speaker_id == "A"
    assert speakers.align_segments(s, t.unionAll(spark.createDataFrame([(1, 1.0, 3.0, "B")], turn))).first().speaker_id is None
    assert speakers.align_segments(s, spark.createDataFrame([(1, 0.0, 0.3, "A")], turn)).first().speaker_id is None
    label = "call_id int, start double, end double, speaker string"
    ref = spark.createDataFrame([(1, 0.0, 2.0, "x"), (1, 2.0, 5.0, "y")], label)
    swapped = spark.createDataFrame([(1, 0.0, 2.0, "2"), (1, 2.0, 5.0, "1")], label)
    assert speakers.speaker_score(ref, swapped).first().assignment_error_rate == 0
    wrong = spark.createDataFrame([(1, 0.0, 5.0, "1")], label)
    assert speakers.speaker_score(ref, wrong).first().assignment_error_rate == pytest.approx(0.4)
    assert speakers.speaker_score(ref, wrong.where("false")).first().assignment_error_rate == 1
    assert speakers.role_score(ref, ref).first().agreement == 1


def test_lexicon(spark):
    words = [{"word": w, "start": float(i), "end": i + 1.0, "probability": 0.8} for i, w in enumerate(["آجلی", " هستم", " از", " وینسی", " و", " بلو", " بانک"])]
    n = 0
    for t in (lexicon.Term("ونسی", "brand", ("وینسی", "اینسی")), lexicon.Term("بلوبانک", "brand", ("بلو بانک", "بولو بانک"))):
        words, k = lexicon.rewrite_words(words, t)
        n += k
    assert n == 2 and "".join(w["word"] for w in words) == "آجلی هستم از ونسی و بلوبانک"
    r = one(spark, lexicon.replace_aliases(F.lit("a VinSi b vinsix"), [lexicon.Term("Vensi$", "brand", ("vinsi",))]).alias("r")).r
    assert (r.text, r.replacements) == ("a Vensi$ b vinsix", 1)


def test_suggestions(spark):
    kind = "k int, text string, raw_text string, consensus_text string, alternative string, retry_text string, fragments array<string>, entities array<string>, flags array<string>"
    df = spark.createDataFrame([(1, f"سلام {C.MARKER}", "سلام دنیا", "سلام دنیا", "سلام  دنیا", None, ["خوب"], [], [])], kind)
    got = review.suggestions(df, ["k"]).orderBy("position").collect()
    assert [(r.source, r.text) for r in got] == [("raw", "سلام دنیا"), ("uncertainty", "سلام خوب")] and len({r.candidate_id for r in got}) == 2


def test_review_masks_unsupported_numbers(spark):
    ev = spark.createDataFrame([(1, "s1", 0.0, 3.0, "مبلغ ۲۰۰ تومان", "", None, [], "high")], "call_id int, id string, start double, end double, text string, alternative string, retry_text string, flags array<string>, confidence_tier string")
    rs = spark.createDataFrame([(1, "s1", "مبلغ ۹۰۰ تومان", "x", False, "")], "call_id int, id string, text string, speaker string, uncertain boolean, notes string")
    r = review.apply_review(rs, ev).first()
    assert r.text == f"مبلغ {C.MARKER} تومان" and "unsupported_number" in r.flags and r.uncertain and r.confidence_tier == "unresolved"
    assert review.review_errors(rs.withColumn("id", F.lit("zz")), ev).count() == 2


def test_signal():
    e = np.full((9, 4), -8.0)
    e[np.arange(9), [3, 0, 1, 1, 0, 1, 0, 2, 3]] = -0.01
    assert signal.ctc_path(e, [1, 1, 2], 0) == [[2, 3], [5], [7]]
    quiet = np.full(16000, 0.001, dtype=np.float32)
    assert np.array_equal(signal.agc(quiet, 16000, 0.1, 18, 0.01), quiet)
    assert signal.agc(np.full(16000, 0.05, dtype=np.float32), 16000, 0.1, 18, 0.01)[0] == pytest.approx(0.1)
    assert signal.literal_words("a bc", [(" a", 0, 1, 0.9), (" b", 1, 2, 0.8), ("c", 2, 3, 0.2)], 1.0)[1]["score"] == 0.2


def test_sampling_is_stratified_and_stable(spark):
    rows = [(i, d, s) for i, (d, s) in enumerate([("inbound", 20.0)] * 10 + [("inbound", 90.0)] * 10 + [("outbound", 200.0)] * 10)]
    df = spark.createDataFrame(rows, "id long, direction string, duration_seconds double")
    a = evaluation.sample_calls(df, 12, 42).orderBy("position").collect()
    b = evaluation.sample_calls(df.orderBy(F.desc("id")), 12, 42).orderBy("position").collect()
    assert a == b and len({r.id for r in a}) == 12 and {r.band for r in a} == {"short", "medium", "long"}
    assert sum(r.evaluation_split == "holdout" for r in a) == 3


def test_progress(spark, tmp_path):
    from talkloom.streaming import progress

    lines = ['{"type":"thread.started"}', "not json", '{"type":"item.completed","item":{"type":"command_execution","command":"ffprobe x","exit_code":1,"aggregated_output":"bad `x`"}}', '{"type":"item.completed","item":{"type":"agent_message","text":"{\\"segments\\":[]}"}}', '{"type":"other"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    q = progress.follow(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("progress").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(60)
    got = spark.table("progress").collect()
    assert [(r.stage, r.state) for r in got] == [("starting", "completed"), ("inspect_audio", "failed"), ("finalize", "active")]
    assert got[1].message.endswith(": bad x")


def test_finite_json(spark, tmp_path):
    from talkloom.sources.sinks import write_json

    write_json(spark.createDataFrame([(float("nan"), [float("inf"), 1.0])], "x double, y array<double>"), str(tmp_path / "j"))
    r = spark.read.json(str(tmp_path / "j")).first()
    assert r.y == [None, 1.0]
    with pytest.raises(Exception, match="already exists"):
        write_json(spark.range(1).toDF("x"), str(tmp_path / "j"))


def test_ctc_path_against_all_paths():
    import itertools

    import numpy as np

    from talkloom.functions import signal

    rng = np.random.default_rng(0)
    checked = 0
    for _ in range(80):
        frames, e = int(rng.integers(2, 7)), None
        e = np.log(rng.dirichlet(np.ones(4), frames))
        t = np.array([int(x) for x in rng.choice([-1, 1, 2, 3], int(rng.integers(1, 3)))])
        gain, last = signal._lattice(e, t, 0), 2 * len(t)
        step = lambda a, b, t=t: b - a in (0, 1) or (b - a == 2 and b % 2 == 1 and t[b // 2] != t[b // 2 - 1])
        sums = [sum(gain[f, s] for f, s in enumerate(p)) for p in itertools.product(range(last + 1), repeat=frames) if p[0] < 2 and p[-1] >= last - 1 and all(map(step, p, p[1:]))]
        try:
            found = signal.target_of_frames(e, t, 0)
        except ValueError:
            continue
        states, ahead = [], len(t)
        for k in reversed(found.tolist()):
            ahead = k if k >= 0 else ahead
            states.append(2 * k + 1 if k >= 0 else 2 * ahead)
        assert abs(sum(gain[f, s] for f, s in enumerate(reversed(states))) - max(sums)) < 1e-9
        checked += 1
    assert checked > 30


def test_best_mapping_against_all_mappings():
    import random
    from itertools import permutations

    from talkloom.operators.speakers import best_mapping

    rng = random.Random(1)
    for _ in range(300):
        cells = [(f"l{i}", f"r{j}", float(rng.randint(0, 4))) for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5)) if rng.random() < 0.8]
        value = {c[:2]: c[2] for c in cells}
        labels, roles = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
        every = permutations([*roles, *[None] * (len(labels) - len(roles))], len(labels))
        assert best_mapping(cells)[0] == max(sum(value.get(x, 0.0) for x in zip(labels, m, strict=True)) for m in every) if cells else best_mapping(cells) == (0.0, {})


def test_channels_fuse(spark):
    schema = "call_id int, channel_id int, start double, end double, text string, words array<string>, flags array<string>"
    rows = [(1, 1, 0.0, 2.0, " a ", ["a"], ["x"]), (1, 2, 1.0, 3.0, "b", ["b"], []), (1, 1, 2.5, 2.8, None, [], None), (1, 2, 3.0, 4.0, " c", ["c"], ["y"]), (2, 1, 0.0, 9.0, "d", None, None)]
    got = sorted(intervals.merge_channels(spark.createDataFrame(rows, schema), ["call_id"]).collect())
    assert [tuple(r) for r in got] == [
        (1, 0.0, 3.0, "a b", [], ["channel_overlap", "x"], [1, 2, 1]),
        (1, 3.0, 4.0, " c", ["c"], ["y"], [2]),
        (2, 0.0, 9.0, "d", None, None, [1]),
    ]


def test_a_token_has_one_owner(spark):
    rows = [(1, 0.0, 1.0, [(0, 0), (0, 1)], 9.0), (1, 1.0, 2.0, [(0, 1)], 9.0), (1, 2.0, 3.0, [(1, None)], 9.0), (1, 3.0, 4.0, [(1, None), (2, 0)], 9.0), (2, 0.0, 1.0, [(0, 0)], 9.0)]
    df = spark.createDataFrame(rows, "call_id int, start double, end double, parts array<struct<segment:int,word:int>>, duration double")
    got = sorted((r.call_id, r.start, r.error) for r in intervals.timeline_errors(df, ["call_id"], "duration", "parts").collect())
    assert got == [(1, k, "owner") for k in (0.0, 1.0, 2.0, 3.0)]


def test_retries_of_gaps(spark):
    """A segment that echoes the prompt, one with a stored flag and a lone unsure word are no recovery."""
    word = lambda w, a, p=0.9: {"word": w, "start": a, "end": a + 0.5, "probability": p}
    rows = [
        (1, 0, 0.0, 4.0, " one two", [word(" one", 0.5), word(" two", 2.0)], [], "names of brands and cities"),
        (1, 1, 4.0, 6.0, "names of brands and city", [], [], "names of brands and cities"),
        (1, 2, 4.0, 6.0, "cut off", [], ["decoder_truncated"], ""),
        (1, 3, 5.0, 6.0, "kept whole ", [], None, None),
        (1, 4, 6.0, 7.0, " hm", [word(" hm", 6.2, 0.4)], [], ""),
    ]
    schema = "call_id int, index int, s_start double, s_end double, text string, words array<struct<word:string,start:double,end:double,probability:double>>, flags array<string>, prompt string"
    retries = spark.createDataFrame(rows, schema).withColumns({"avg_logprob": F.lit(-0.2), "no_speech_prob": F.lit(0.1), "compression_ratio": F.lit(1.0)})
    gaps = spark.createDataFrame([(1, 1.0, 8.0), (1, 20.0, 21.0)], "call_id int, start double, end double")
    got = evidence.retry_for_gaps(retries, gaps, ["call_id"]).collect()
    assert [(r.start, r.text, r.n_segments, [tuple(s) for s in r.segments]) for r in got] == [(1.0, "two kept whole", 2, [(0, 2.0, 2.5, "two"), (3, 5.0, 6.0, "kept whole")])]


def test_calls_of_a_batch_are_built_in_slices_of_bounded_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"call_id": [*range(40)], "x": ["a" * (100_000 if k == 7 else 1000) for k in range(40)]})
    parts = [*evidence.call_slices(batch, 10_000)]
    assert [k for p in parts for k in p.column("call_id").to_pylist()] == [*range(40)]
    assert max(p.nbytes for p in parts if p.num_rows > 1) <= 10_000 and len(parts) < 20
    assert [*evidence.call_slices(batch.slice(0, 0), 10)] == []
