"""One timed transcript from two decoding passes, and its consensus.

The predicates are expressions and ``consensus`` a chain of them.  ``build`` folds each call's
segments in time order, where every step depends on what was kept before; a
call is one row of arrays, so it runs as an Arrow map over calls.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.schemas import WORD

# ---- expressions ----


def overlaps_speech(start: Column, end: Column, regions: Column) -> Column:
    """Does the span touch a speech region?  True where none are known."""
    hit = F.exists(regions, lambda r: (r["start"] < end) & (r["end"] > start))
    return F.coalesce(hit | (F.size(regions) <= 0), F.lit(True))


def usable_retry(text: Column, segment_flags: Column, prompt: Column | None = None) -> Column:
    """The retry's text if nothing speaks against it, else null.  segment_flags: all flags of its segments."""
    ok = (F.trim(F.coalesce(text, F.lit(""))) != "") & ~T.has_any(segment_flags, C.UNUSABLE_RETRY) & ~T.has_any(T.text_flags(text), ("repetition", "unclear"))
    if prompt is not None:
        ok &= ~T.prompt_leakage(text, F.coalesce(prompt, F.lit("")))
    return F.when(ok, F.regexp_replace(text, r"^\s+|\s+$", ""))


def unusable(text: Column, alternative: Column, flags: Column, retry: Column) -> Column:
    """Neither pass nor the retry is usable."""
    blank = lambda t: T.normalize(F.coalesce(t, F.lit(""))).isin("", C.MARKER)
    primary = blank(text) | T.has_any(flags, C.UNUSABLE_PRIMARY)
    other = blank(alternative) | T.has_any(flags, ("alternative_prompt_leakage",)) | T.has_any(T.text_flags(alternative), C.UNUSABLE_PRIMARY)
    return primary & other & retry.isNull()


def retry_candidate(text: Column, alternative: Column, flags: Column, retry: Column, start: Column, end: Column, regions: Column) -> Column:
    """Neither pass nor the retry is usable, and the span holds speech."""
    return unusable(text, alternative, flags, retry) & overlaps_speech(start, end, regions)


def mean_probability(words: Column) -> Column:
    p = F.filter(F.transform(words, lambda w: w["probability"]), lambda x: T.finite(x))
    return F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.size(p).cast("double"))


def n_probabilities(words: Column) -> Column:
    return F.coalesce(F.size(F.filter(words, lambda w: T.finite(w["probability"]))), F.lit(0))


def consensus(df: DataFrame) -> DataFrame:
    """Adds consensus_text, confidence_tier and reason to rows of hypotheses.

    df: (text, alternative, retry_text, flags, words, other_words, providers, retry_aligned).  Each step is a column of
    its own, so that no later expression repeats it.
    """
    empty = F.array().cast(f"array<{WORD}>")
    fold = lambda c: T.normalize(F.coalesce(c, F.lit("")))
    usable = lambda c: (F.col(c) != "") & (F.col(c) != C.MARKER) & ~T.repeats(c)
    x = df.withColumns({"_w": F.coalesce("words", empty), "_all": F.concat(F.coalesce("words", empty), F.coalesce("other_words", empty)), "_p": fold("text"), "_e": F.when(T.has_any(F.col("flags"), ("alternative_failed_decode", "alternative_prompt_leakage")), F.lit("")).otherwise(fold("alternative")), "_r": fold("retry_text")})
    x = x.withColumns({"_given": F.filter(F.array(F.when(usable("_p"), F.col("_p")), F.when(usable("_e"), F.col("_e")), F.when(usable("_r"), F.col("_r"))), lambda t: t.isNotNull()), "_first": usable("_p")})
    at = lambda i: F.get("_given", F.lit(i))
    strong = lambda c, least: (n_probabilities(F.col(c)) >= 2) & F.coalesce(mean_probability(F.col(c)) >= least, F.lit(False))
    families = F.size(F.array_distinct(F.transform(F.filter(F.coalesce("providers", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.when(F.contains(p, F.lit("whisper")), F.lit("whisper")).otherwise(p))))
    x = x.withColumns({"_n": F.size("_given"), "_a": at(0), "_b": at(1), "_c": at(2), "_strong": strong("_w", 0.7), "_backed": strong("_all", 0.65) | (families >= 2)})
    x = x.withColumn("_agreed", F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_a") == F.col("_c"), F.col("_a")).when(F.col("_b") == F.col("_c"), F.col("_b")))
    x = x.withColumns({"_x": F.split("_a", " "), "_y": F.split("_b", " ")})
    common = lambda p, q, most: F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k <= most) & (F.slice(p, 1, k) == F.slice(q, 1, k))))
    x = x.withColumn("_least", F.least(F.size("_x"), F.size("_y")))
    x = x.withColumn("_pre", common(F.col("_x"), F.col("_y"), F.col("_least")))
    x = x.withColumn("_suf", common(F.reverse("_x"), F.reverse("_y"), F.col("_least") - F.col("_pre")))
    middle = lambda c: F.slice(c, F.col("_pre") + 1, F.greatest(F.size(c) - F.col("_pre") - F.col("_suf"), F.lit(0)))
    x = x.withColumns({
        "_differ": F.array_join(F.concat(middle("_x"), middle("_y")), " "),
        "_bridged": F.array_join(F.concat(F.slice("_x", 1, F.col("_pre")), F.array(F.lit(C.MARKER)), F.slice("_x", F.greatest(F.size("_x") - F.col("_suf") + 1, F.lit(1)), F.col("_suf"))), " "),
    })
    agreed = F.col("_agreed").isNotNull()
    sure = F.coalesce("retry_aligned", F.lit(False)) | F.col("_strong")
    rule = (
        F.when(agreed & F.col("_agreed").rlike(C.SENSITIVE) & ~F.col("_backed"), 1)
        .when(agreed, 2)
        .when(F.col("_n") == 0, 3)
        .when((F.col("_n") == 1) & sure, 4)
        .when(F.col("_n") == 1, 5)
        .when(F.col("_first") & F.col("_strong") & ~F.array_join("_given", " ").rlike(C.SENSITIVE_OR_NAME), 6)
        .when(F.col("_differ").rlike(C.SENSITIVE_OR_NAME), 7)
        .otherwise(8)
    )
    x = x.withColumn("_rule", rule)
    name = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("_rule"))
    r = F.col("_rule")
    text = F.when(r == 1, F.regexp_replace("_agreed", r"\p{Nd}+", C.MARKER)).when(r == 2, F.col("_agreed")).when(r == 3, F.lit(C.MARKER)).when(r <= 6, F.col("_a")).otherwise(F.col("_bridged"))
    out = x.withColumns({
        "consensus_text": text,
        "confidence_tier": name("unresolved", "high", "unresolved", "medium", "low", "medium", "unresolved", "unresolved"),
        "reason": name("sensitive_requires_independent_evidence", "two_valid_hypotheses_agree", "no_usable_decode", "strong_acoustic_alignment", "single_valid_hypothesis", "strong_primary_alignment_over_disagreement", "sensitive_disagreement", "hypothesis_disagreement"),
    })
    return out.select(*(f"`{c}`" for c in df.columns if c not in ("consensus_text", "confidence_tier", "reason")), "consensus_text", "confidence_tier", "reason")


def words_in_gap(words: Column, start: Column, end: Column) -> Column:
    """Words whose middle lies in the closed gap."""
    return F.filter(words, lambda w: T.finite(w["start"]) & T.finite(w["end"]) & (w["end"] > w["start"]) & ((w["start"] + w["end"]) / 2 >= start) & ((w["start"] + w["end"]) / 2 <= end) & (F.trim(w["word"]) != ""))


def retry_for_gaps(retries: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Text that a retry's segments have inside each gap: (keys, start, end, text, n_segments, segments), only where some is usable.

    retries: (keys, index, s_start, s_end, text, avg_logprob, no_speech_prob, compression_ratio, words), and if known the
    flags stored with a segment and the decoder's prompt, which no segment may echo; gaps: (keys, start, end).  segments:
    (index, start, end, text) clipped to the gap.
    """
    stored = F.col("flags") if "flags" in retries.columns else None
    r = retries.withColumn("_f", T.text_flags("text", F.col("avg_logprob"), F.col("no_speech_prob"), F.col("compression_ratio"), stored))
    r = r.where(T.finite(F.col("s_start")) & T.finite(F.col("s_end")) & (F.col("s_end") > F.col("s_start")) & ~T.has_any(F.col("_f"), (*C.UNUSABLE_RETRY, "unclear")))
    if "prompt" in retries.columns:
        r = r.where(~T.prompt_leakage(F.coalesce("text", F.lit("")), F.coalesce("prompt", F.lit(""))))
    x = r.join(gaps, keys).where((F.col("s_start") <= F.col("end")) & (F.col("s_end") >= F.col("start")))
    x = x.withColumn("_w", words_in_gap(F.coalesce("words", F.array().cast(f"array<{WORD}>")), F.col("start"), F.col("end")))
    spoken = F.trim(F.array_join(F.transform("_w", lambda w: w["word"]), ""))
    p, n = mean_probability(F.col("_w")), F.size("_w")
    weak = F.coalesce((p < 0.3) | ((n == 1) & (p < 0.5)) | (T.normalize(spoken).rlike(r"\p{Nd}") & (p < 0.5)), F.lit(False))
    inside = (F.least("s_end", "end") - F.greatest("s_start", "start")) / F.greatest(F.lit(0.001), F.col("s_end") - F.col("s_start"))
    text = F.when((n > 0) & ~weak, spoken).when((n == 0) & (inside >= 0.8), F.trim("text"))
    x = x.withColumn("_t", text).where(F.col("_t").isNotNull() & (F.col("_t") != "") & ~T.has_any(T.text_flags("_t"), ("repetition", "unclear")))
    first = F.when(n > 0, F.get("_w", F.lit(0))["start"]).otherwise(F.greatest("start", "s_start"))
    last = F.when(n > 0, F.element_at("_w", -1)["end"]).otherwise(F.least("end", "s_end"))
    heard = F.struct("index", first.alias("start"), last.alias("end"), F.col("_t").alias("text"))
    out = x.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(heard)).alias("segments"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    out = out.select(*keys, "start", "end", text.alias("text"), F.size("segments").cast("long").alias("n_segments"), "segments")
    return out.where(~T.repeats("text"))


# ---- timeline ----

_FOLD = str.maketrans(C.FOLD_FROM, C.FOLD_TO)
_LOOP = re.compile(r"(.)\1{5,}|(\b\S+\s+)\2{3,}")


def fold(text: str) -> str:
    return " ".join(text.translate(_FOLD).split())


def flags_of(text: str, seg: dict | None = None) -> list[str]:
    """The same flags as ``text_flags``, for the fold."""
    seg = seg or {}
    metric = {k: seg.get(k) for k in ("avg_logprob", "compression_ratio", "no_speech_prob")}
    known = {k: v for k, v in metric.items() if v is not None}
    tests = (
        ("repetition", bool(_LOOP.search(text))),
        ("verify_numbers", bool(re.search(r"\d", fold(text)))),
        ("unclear", C.MARKER in text or not text.strip()),
        ("invalid_asr_metrics", not all(map(math.isfinite, known.values()))),
        ("low_logprob", known.get("avg_logprob", 0) < -1),
        ("compression", known.get("compression_ratio", 0) > 2.2),
        ("possible_non_speech", known.get("no_speech_prob", 0) > 0.5),
    )
    return [*(seg.get("flags") or []), *(name for name, on in tests if on)]


def number(x) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)


def ordered_words(seg: dict) -> list[dict]:
    """The words if they spell the text and run forward in time, else none."""
    words = seg.get("words") or []
    if not words or fold("".join(w.get("word") or "" for w in words)) != fold(seg.get("text") or ""):
        return []
    at = 0.0
    for w in words:
        a, b = w.get("start"), w.get("end")
        if not (number(a) and number(b) and at <= a <= b):
            return []
        at = b
    return words


def broken(seg: dict, duration: float) -> list[str]:
    """Timing and text flags of a segment."""
    a, b, words = seg.get("start"), seg.get("end"), seg.get("words") or []
    late = not (number(a) and number(b) and 0 <= a < b and a < duration and b <= duration + 0.25)
    if late or words and not ordered_words(seg) or sum(w.get("start") == w.get("end") for w in words) > 1:
        return sorted({*flags_of(seg.get("text") or "", seg), "invalid_timestamp"})
    return sorted(set(flags_of(seg.get("text") or "", seg)))


def quarantined(seg: dict, duration: float) -> bool:
    return not set(broken(seg, duration)).isdisjoint(C.QUARANTINE)


@dataclass
class Unit:
    """A row of the timeline under construction."""

    start: float
    end: float
    text: str
    flags: set[str]
    words: list[dict] = field(default_factory=list)
    parts: list[dict] = field(default_factory=list)
    kind: str = "primary"  # primary, failed (no primary text), or open (alternative only, still growing)
    alternative: str = ""

    def meet(self, a: float, b: float) -> float:
        return max(0.0, min(self.end, b) - max(self.start, a))


class Timeline:
    """Builds the rows of one call; each hypothesis token gets one owner."""

    LONGEST, PAUSE, PAD, SHORTEST_GAP = 8.0, 0.65, 0.4, 1.0

    def __init__(self, duration: float):
        self.duration = duration
        self.units: list[Unit] = []

    def starts_inside(self, a, b, point: bool = False) -> bool:
        return number(a) and number(b) and 0 <= a < self.duration and (b >= a if point else b > a)

    def _phrases(self, seg: dict) -> list[dict]:
        words = ordered_words(seg)
        if not words:
            return [seg]
        groups: list[list[dict]] = []
        for w in words:
            if groups and w["end"] - groups[-1][0]["start"] <= self.LONGEST and w["start"] - groups[-1][-1]["end"] <= self.PAUSE:
                groups[-1].append(w)
            else:
                groups.append([w])
        return [{**seg, "start": g[0]["start"], "end": g[-1]["end"], "text": "".join(w["word"] for w in g).strip(), "words": g} for g in groups]

    def add_primary(self, segments: list[dict]) -> None:
        pending: list[dict] = []
        for seg in segments:
            if not quarantined(seg, self.duration):
                pending += self._phrases(seg)
                continue
            a, b = seg.get("start"), seg.get("end")
            if not (seg.get("text") or "").strip() and a == b:
                continue
            a = min(max(0.0, a if number(a) else 0.0), max(0.0, self.duration - 0.001))
            b = min(self.duration, max(a + 0.001, b if number(b) else 0.0))
            flags = {*broken(seg, self.duration), "failed_decode"}
            before = pending[-1] if pending else None
            if before and "failed_decode" in (before.get("flags") or ()) and a <= before["end"] + 0.1:
                before["end"] = max(before["end"], b)
                before["flags"] = sorted({*before["flags"], *flags})
            else:
                pending.append({"start": a, "end": b, "text": C.MARKER, "flags": sorted(flags), "words": []})
        reached = 0.0
        for seg in sorted((s for s in pending if self.starts_inside(s.get("start"), s.get("end"))), key=lambda s: (s["start"], s["end"])):
            a, b = max(reached, seg["start"]), min(seg["end"], self.duration)
            if b > a:
                reached = b
                text = (seg.get("text") or "").strip()
                self.units.append(Unit(a, b, text, set(flags_of(text, seg)), ordered_words(seg)))
            elif self.units:
                self.units[-1].flags |= {"invalid_timeline", "failed_decode"}

    def add_alternative(self, segments: list[dict]) -> None:
        bad = [s for s in segments if quarantined(s, self.duration)]
        good = [s for s in segments if not quarantined(s, self.duration) and self.starts_inside(s.get("start"), s.get("end"))]
        for index, seg in enumerate(bad):
            self._quarantine(index, seg)
        for seg in good:
            if not ordered_words(seg):
                self._fuse(seg)
        self._part()
        fixed = list(self.units)
        for index, seg in enumerate(good):
            words = ordered_words(seg)
            for k, atom in enumerate(words or [{**seg, "word": seg.get("text") or ""}]):
                if self.starts_inside(atom["start"], atom["end"], point=True) and (atom.get("word") or "").strip():
                    self._own(fixed, index, seg, k if words else None, atom)
        self._spell()

    def _quarantine(self, index: int, seg: dict) -> None:
        a = seg.get("start") if number(seg.get("start")) else 0.0
        a = max(0.0, min(self.duration, a))
        b = max(a, min(self.duration, seg.get("end") if number(seg.get("end")) else a))
        flags = {*broken(seg, self.duration), "failed_decode"}
        hit = [u for u in self.units if u.meet(a, b) > 0]
        for u in hit:
            u.flags |= {"alternative_failed_decode", *(f"alternative_{f}" for f in flags - {"failed_decode"})}
        if not hit and b > a:
            text = (seg.get("text") or "").strip()
            self.units.append(Unit(a, b, C.MARKER, flags, parts=[{"segment": -1 - index, "word": None, "start": a, "end": b, "text": text, "probability": None}], kind="failed"))

    def _fuse(self, seg: dict) -> None:
        """A phrase without word times over several rows makes them one."""
        hit = sorted((u for u in self.units if u.meet(seg["start"], seg["end"]) > 0), key=lambda u: (u.start, u.end))
        if len(hit) < 2:
            return
        one = Unit(hit[0].start, max(u.end for u in hit), " ".join(u.text for u in hit), {"alternative_timing_uncertain"}.union(*(u.flags for u in hit)), parts=hit[0].parts, kind=hit[0].kind)
        self.units = [u for u in self.units if u not in hit] + [one]

    def _part(self) -> None:
        self.units.sort(key=lambda u: (u.start, u.end))
        kept: list[Unit] = []
        for u in self.units:
            if kept and u.start < kept[-1].end:
                if u.kind == "failed":
                    kept[-1].flags |= u.flags
                    continue
                u.start = kept[-1].end
            if u.end > u.start:
                kept.append(u)
        self.units = kept

    def _own(self, fixed: list[Unit], index: int, seg: dict, k: int | None, atom: dict) -> None:
        a, b = atom["start"], atom["end"]
        score = [float(u.start <= a < u.end) if a == b else u.meet(a, b) for u in fixed]
        best = max(range(len(fixed)), key=lambda i: (score[i], -i), default=None)
        if best is not None and score[best] > 0:
            owner = fixed[best]
        else:
            owner = self._grow(fixed, seg, a, b)
            if owner is None:
                return
        owner.parts.append({"segment": index, "word": k, "start": a, "end": b, "text": atom["word"], "probability": atom.get("probability")})
        if "prompt_leakage" in (seg.get("flags") or ()):
            owner.flags.add("alternative_prompt_leakage")

    def _grow(self, fixed: list[Unit], seg: dict, a: float, b: float) -> Unit | None:
        """The open row of words outside all primary rows, grown or newly opened."""
        last = self.units[-1] if self.units else None
        if last and last.kind == "open" and last.end <= a and a - last.end <= self.PAUSE and b - last.start <= self.LONGEST:
            last.end = min(self.duration, b)
            return last
        if a == b:
            if fixed:
                return None
            a, b = seg["start"], seg["end"]
            if b <= a:
                return None
        self.units.append(Unit(a, min(self.duration, b), C.MARKER, {"speech_gap"}, kind="open"))
        return self.units[-1]

    def _spell(self) -> None:
        from difflib import SequenceMatcher

        for u in self.units:
            by: dict[int, str] = {}
            for p in u.parts:
                by[p["segment"]] = by.get(p["segment"], "") + p["text"]
            u.alternative = " ".join(t.strip() for t in by.values()).strip()
            if u.alternative and SequenceMatcher(None, fold(u.text), fold(u.alternative)).ratio() < 0.65:
                u.flags.add("pass_disagreement")

    def add_speech(self, regions: list[dict]) -> None:
        """Speech that no row or token covers becomes gap rows."""
        for r in regions:
            a, b = max(0.0, r["start"] + self.PAD), min(self.duration, r["end"] - self.PAD)
            cover = sorted((x for u in self.units for x in ((u.start, u.end), *((p["start"], p["end"]) for p in u.parts)) if x[0] < b and x[1] > a))
            free, at = [], a
            for x, y in [*cover, (b, b)]:
                if x > at:
                    free.append((at, min(x, b)))
                at = max(at, y)
            for x, y in free:
                if y - x >= self.SHORTEST_GAP:
                    n = max(1, math.ceil((y - x) / self.LONGEST))
                    step = (y - x) / n
                    self.units += [Unit(x + i * step, y if i == n - 1 else x + (i + 1) * step, C.MARKER, {"speech_gap"}, alternative=C.MARKER) for i in range(n)]

    def rows(self) -> list[dict]:
        order = sorted(self.units, key=lambda u: (u.start, u.end))
        return [{"id": f"s{i}", "start": float(u.start), "end": float(u.end), "text": u.text, "alternative": u.alternative, "flags": sorted(u.flags), "words": u.words, "alternative_sources": u.parts} for i, u in enumerate(order, 1)]


def build_one(primary: list[dict], alternative: list[dict], duration: float, speech: list[dict] | None = None) -> list[dict]:
    t = Timeline(duration)
    t.add_primary(primary)
    t.add_alternative(alternative)
    t.add_speech(speech or [])
    return t.rows()


_PART = "struct<segment:int,word:int,start:double,end:double,text:string,probability:double>"
#: Bytes of calls whose timelines a worker holds at once, about; a single longer call is a slice of its own.
SLICE_BYTES = 1 << 20
ROWS = f"array<struct<id:string,start:double,end:double,text:string,alternative:string,flags:array<string>,words:array<{WORD}>,alternative_sources:array<{_PART}>>>"


def call_slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most about ``most`` bytes, a row at least."""
    low = 0
    while low < batch.num_rows:
        high = batch.num_rows
        while high - low > 1 and batch.slice(low, high - low).nbytes > most:
            high = low + (high - low) // 2
        yield batch.slice(low, high - low)
        low = high


def build(calls: DataFrame, primary: DataFrame, alternative: DataFrame, speech: DataFrame, call: str = "call_id") -> DataFrame:
    """Timeline rows of all calls.

    calls: (call, duration); primary, alternative: (call, index, start, end, text, avg_logprob, no_speech_prob,
    compression_ratio, flags, words); speech: (call, start, end).
    """
    cols = ("index", "start", "end", "text", "avg_logprob", "no_speech_prob", "compression_ratio", "flags", "words")
    gather = lambda df, name: df.groupBy(call).agg(F.array_sort(F.collect_list(F.struct(*cols)), lambda x, y: F.when(x["index"] < y["index"], -1).when(x["index"] > y["index"], 1).otherwise(0)).alias(name))
    regions = speech.groupBy(call).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_v"))
    x = calls.select(call, "duration").join(gather(primary, "_p"), call, "left").join(gather(alternative, "_a"), call, "left").join(regions, call, "left")
    kind = x.schema[call].dataType.simpleString()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    rows_type = to_arrow_type(_parse_datatype_string(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in call_slices(whole, SLICE_BYTES)):
            rows = [build_one(r["_p"] or [], r["_a"] or [], r["duration"], r["_v"]) for r in batch.to_pylist()]
            for lists in rows:
                for row in lists:
                    row["words"] = [{k: w.get(k) for k in ("word", "start", "end", "probability")} for w in row["words"]]
            yield pa.RecordBatch.from_arrays([batch.column(call), pa.array(rows, rows_type)], names=[call, "rows"])

    built = x.mapInArrow(run, f"{call} {kind}, rows {ROWS}")
    return built.select(call, F.posexplode("rows").alias("index", "r")).select(call, "index", "r.*")


def markdown(rows: DataFrame, calls: DataFrame, call: str = "call_id") -> DataFrame:
    """Rendered document of each call: (call, content).  rows: presentation rows; calls: (call, filename, human_reviewed)."""
    from talkloom.operators.intervals import display_rows

    shown = display_rows(rows, [call], C.UNKNOWN_SPEAKER)
    warn = F.when(F.col("uncertain") & ~T.has_marker("text"), F.lit(C.ROW_WARNING)).otherwise(F.lit(""))
    line = F.concat(F.lit("**"), F.regexp_replace("speaker", r"[\r\n*]", ""), F.lit(":** `"), T.clock(F.col("start")), F.lit("–"), T.clock(F.col("end"), up=True), F.lit("` "), "text", warn)
    lines = shown.groupBy(call).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    x = calls.select(call, "filename", "human_reviewed").join(lines, call, "left")
    head = F.concat(F.lit(f"{C.DOCUMENT_TITLE}\n\n{C.DOCUMENT_FILE}`"), "filename", F.lit(f"`\n{C.DOCUMENT_REVIEW}"), F.when(F.col("human_reviewed"), F.lit(C.REVIEWED)).otherwise(F.lit(C.NEEDS_REVIEW)), F.lit(f"\n\n{C.DOCUMENT_BODY}\n\n"))
    return x.select(call, F.concat(head, F.coalesce(F.array_join("lines", "\n\n"), F.lit(C.NO_SPEECH)), F.lit("\n")).alias("content"))
