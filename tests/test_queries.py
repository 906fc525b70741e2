"""Registered queries over small tables against plain Python."""

import datetime

import pytest

from talkloom.plans import queries

EPOCH = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """(folder, turns by call): calls on both sides of any small id, with gaps, overlaps and touching turns."""
    d = tmp_path_factory.mktemp("events")
    rows, turns = [], {}
    for call in (3, 19, 20, 29, 30, 31, 500):
        for k in range(12):
            seconds = (call * 977 + k * k * 3701 + k * 9000) % 400_000
            value = float((call + 7 * k) % 40)
            rows.append((call * 100 + k, EPOCH + datetime.timedelta(seconds=seconds), call, "abc"[(call + k) % 3], value, ""))
            turns.setdefault(call, []).append((float(seconds), seconds + value * 200, str(call * 100 + k), "abc"[(call + k) % 3]))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return str(d), turns


def test_align_speakers_has_every_call(spark, events):
    d, turns = events
    want = {}
    for call, of in turns.items():
        for day in {int(a // 86400) for a, *_ in of}:
            start, end = day * 86400.0, day * 86400.0 + 43200
            points = sorted({start, end, *(min(max(p, start), end) for a, b, *_ in of if a < end and b > start for p in (a, b))})
            seconds, by = [0.0, 0.0, 0.0], {}
            for p, q in zip(points, points[1:], strict=False):
                who = {s for a, b, _, s in of if a <= (p + q) / 2 < b}
                seconds[min(len(who), 2)] += q - p
                if len(who) == 1:
                    by[min(who)] = by.get(min(who), 0.0) + q - p
            silent, single, several = seconds
            best = min(by, key=lambda s: (-by[s], s), default=None)
            sure = best is not None and by[best] >= 0.8 * (single + several) and single + several >= 0.5 * (end - start)
            want[call, day] = (pytest.approx(single), pytest.approx(several), pytest.approx(silent), best if sure else None)
    got = {(r.call_id, r.id): (r.exclusive_seconds, r.overlap_seconds, r.silence_seconds, r.speaker_id) for r in queries.align_speakers(spark, d).collect()}
    assert got == want


def test_retry_groups_has_every_call(spark, events):
    d, turns = events
    want = []
    for call, of in turns.items():
        groups = []
        for a, b, *_ in sorted(of):
            if groups and a - groups[-1][1] <= 7200 and max(groups[-1][1], b) - groups[-1][0] <= 80000:
                groups[-1][1:] = [max(groups[-1][1], b), groups[-1][2] + 1]
            else:
                groups.append([a, b, 1])
        want += [(call, *g) for g in groups]
    got = [(r.call_id, r.gap_start, r.gap_end, r.n) for r in queries.retry_groups(spark, d).collect()]
    assert sorted(got) == sorted(want) and max(g[3] for g in got) > 1


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    """(folder, text by call and turn): texts of some 50 to 290 characters without repeats."""
    d, texts = tmp_path_factory.mktemp("conversations"), {}
    for call in (1, 2):
        for turn in range(8):
            texts[call, turn] = " ".join(f"{a}{b}{c}" for a in "bdk"[: 1 + turn % 3] for b in "aeiou" for c in ("n", "rt", "lm", "sk", "p", f"x{chr(97 + turn)}")[: 2 + turn % 5]) + " end"
    spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", x) for (c, t), x in texts.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d), texts


def test_hypotheses_hold_whole_texts(spark, conversations):
    d, texts = conversations
    assert max(map(len, texts.values())) > 250
    primary, alternative = (x.collect() for x in queries._hypotheses(spark, d))
    assert {(r.call_id, r["index"]): r.text for r in primary} == texts
    assert all("".join(w.word for w in r.words) == r.text for r in primary)
    assert {(r.call_id, r["index"]): r.text for r in alternative} == {k: x[::-1] if k[1] % 4 == 2 else x for k, x in texts.items() if k[1] % 4 != 3}


def test_suggestions_offer_every_segment_whole(spark, conversations):
    d, texts = conversations
    got = {}
    for r in queries.suggestions(spark, d).collect():
        got.setdefault((r.call_id, int(r.id[1:])), {})[r.source] = r.text
    assert {k: v["raw"] for k, v in got.items()} == texts
    for (_, turn), v in got.items():
        words = v["raw"].split(" ")
        i = turn % len(words)
        words[i] = words[i][::-1]
        assert v.get("alternative", v["raw"]) == " ".join(words)
