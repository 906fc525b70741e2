"""Text expressions.  All are built-in Spark expressions but ``similarity`` and ``word_errors``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from talkloom import constants as C

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column | str) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(_col(text), _SPACE + "+", " "))


def normalize(text: Column | str) -> Column:
    """Folds Arabic letter forms and digits, collapses white space."""
    return collapse(F.translate(_col(text), C.FOLD_FROM, C.FOLD_TO))


def tokens(text: Column | str) -> Column:
    """Words of the normalised text; a zero-width non-joiner separates."""
    return F.regexp_extract_all(F.replace(normalize(text), F.lit(C.ZWNJ), F.lit(" ")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def numbers(text: Column | str) -> Column:
    """Digit runs of the normalised text."""
    return F.regexp_extract_all(normalize(text), F.lit(r"\p{Nd}+"), F.lit(0))


def words(text: Column | str) -> Column:
    """Fields of the normalised text; none for blank text."""
    return F.filter(F.split(normalize(text), " "), lambda x: x != "")


def fields(text: Column | str) -> Column:
    """Runs of characters other than white space, as they stand."""
    return F.regexp_extract_all(_col(text), F.lit(_SPACE.replace("[", "[^", 1) + "+"), F.lit(0))


def fold_ascii(text: Column | str) -> Column:
    """Lower-cases A to Z only, as a case-insensitive LIKE of the stored queries does."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches_any(needle: str, columns: Iterable[str]) -> Column:
    """Does any column contain the needle, ASCII case apart?  Null columns don't."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.contains(fold_ascii(c), fold_ascii(F.lit(needle))), F.lit(False))
    return out


def is_marker_only(text: Column | str) -> Column:
    return normalize(text) == C.MARKER


def has_marker(text: Column | str) -> Column:
    return F.coalesce(F.contains(_col(text), F.lit(C.MARKER)), F.lit(False))


def marker_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"\[نامفهوم\]")), F.lit(0))


def marker_spans(text: Column | str) -> Column:
    """Array of (start_char, end_char) of each marker."""
    parts = F.split(_col(text), r"\[نامفهوم\]")
    n = len(C.MARKER)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), C.MARKER)))
    found = F.transform(starts, lambda s: F.struct(s.alias("start_char"), (s + n).alias("end_char")))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<start_char:int,end_char:int>>"))


def repeats(text: Column | str, times: int = 6) -> Column:
    """A decoder loop: one character ``times`` times in a row, or a word and its space four times (eight for 8)."""
    follow = 3 if times == 6 else times - 1
    return F.coalesce(_col(text).rlike(rf"(?U)(.)\1{{{times - 1},}}|(\b\S+\s+)\2{{{follow},}}"), F.lit(False))


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def scrub(x: Column | str) -> Column:
    """Null instead of NaN and infinities."""
    x = _col(x)
    return F.when(finite(x), x)


def text_flags(text: Column | str, avg_logprob: Column | None = None, no_speech_prob: Column | None = None, compression_ratio: Column | None = None, flags: Column | None = None) -> Column:
    """Quality flags of a segment in their fixed order, after the flags it has."""
    text = F.coalesce(_col(text), F.lit(""))
    metric = [m for m in (avg_logprob, no_speech_prob, compression_ratio) if m is not None]
    odd = F.lit(False)
    for m in metric:
        odd |= m.isNotNull() & ~finite(m)
    over = lambda m, bad: F.lit(False) if m is None else F.coalesce(~F.isnan(m.cast("double")) & bad(m), F.lit(False))
    pairs = [
        (repeats(text), "repetition"),
        (normalize(text).rlike(r"\p{Nd}"), "verify_numbers"),
        (has_marker(text) | (normalize(text) == ""), "unclear"),
        (odd, "invalid_asr_metrics"),
        (over(avg_logprob, lambda m: m < -1), "low_logprob"),
        (over(compression_ratio, lambda m: m > 2.2), "compression"),
        (over(no_speech_prob, lambda m: m > 0.5), "possible_non_speech"),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(f)) for c, f in pairs)), lambda x: x.isNotNull())
    return F.concat(F.coalesce(flags, F.array().cast("array<string>")), found) if flags is not None else found


def has_any(flags: Column, wanted: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(flags, F.array(*(F.lit(w) for w in wanted))), F.lit(False))


def retry_priority(flags: Column) -> Column:
    """0 for decoder loops to 4; order by it and the start."""
    return (
        F.when(has_any(flags, ("repetition", "invalid_asr_metrics", "decoder_truncated")), 0)
        .when(has_any(flags, ("compression",)), 1)
        .when(has_any(flags, ("low_logprob",)), 2)
        .when(has_any(flags, ("pass_disagreement",)), 3)
        .otherwise(4)
    )


def clock(seconds: Column, up: bool = False) -> Column:
    """mm:ss, floored or with ``up`` ceiled; minutes may pass 99."""
    whole = F.greatest(F.lit(0), (F.ceil(seconds) if up else F.floor(seconds)).cast("long"))
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def compact(text: Column, limit: int = 280) -> Column:
    """One line without back-quotes, cut to ``limit`` characters with an ellipsis."""
    t = F.replace(collapse(F.coalesce(text, F.lit(""))), F.lit("`"), F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def transcript_text(content: Column, segment_texts: Column) -> Column:
    """Spoken text of a stored transcript: of its segments, else of its Markdown."""
    body = F.element_at(F.split(content, C.DOCUMENT_BODY, 2), -1)
    body = F.regexp_replace(body, r"\*\*[^*\n]+:\*\*", "")
    body = F.regexp_replace(body, r"\[\d+:\d+[–-]\d+:\d+\]|`\d+:\d+[–-]\d+:\d+`", "")
    return F.when(segment_texts.isNotNull(), F.array_join(segment_texts, " ")).otherwise(F.regexp_replace(body, rf"^{_SPACE}+|{_SPACE}+$", ""))


@F.arrow_udf(DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of two strings, as difflib computes it."""
    from difflib import SequenceMatcher

    return pa.array([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())


def prompt_leakage(text: Column, prompt: Column) -> Column:
    """Does the text echo the decoder's prompt?"""
    a, b = normalize(text), normalize(prompt)
    return F.coalesce((F.length(a) >= 8) & (b != "") & (similarity(a, b) >= 0.65), F.lit(False))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists, by bit-parallel rows over the positions of equal elements."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    vp, vn = full, 0
    for x in b:
        eq = masks.get(x, 0) | vn
        d0 = (((eq & vp) + vp) ^ vp) | eq
        hp, hn = vn | ~(vp | d0) & full, vp & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, hp & d0
    return score


@F.arrow_udf(LongType())
def list_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edit distance of two arrays of strings."""
    for a, b in batches:
        yield pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def score(reference: Column, hypothesis: Column) -> Column:
    """Struct of word, character and number accuracy of a hypothesis."""
    ref, hyp = tokens(reference), tokens(hypothesis)
    ref_text, hyp_text = F.array_join(ref, ""), F.array_join(hyp, "")
    ref_numbers, hyp_numbers = numbers(reference), numbers(hypothesis)
    same = lambda n, x: F.size(F.filter(x, lambda y: y == n))
    matched = F.aggregate(F.array_distinct(ref_numbers), F.lit(0), lambda s, n: s + F.least(same(n, ref_numbers), same(n, hyp_numbers)))
    word_errors, char_errors = list_distance(ref, hyp), F.levenshtein(ref_text, hyp_text).cast("long")
    return F.struct(
        word_errors.alias("word_errors"),
        F.size(ref).cast("long").alias("reference_words"),
        char_errors.alias("character_errors"),
        F.length(ref_text).cast("long").alias("reference_characters"),
        F.try_divide(word_errors.cast("double"), F.size(ref).cast("double")).alias("wer"),
        F.try_divide(char_errors.cast("double"), F.length(ref_text).cast("double")).alias("cer"),
        matched.cast("long").alias("matched_numbers"),
        F.size(ref_numbers).cast("long").alias("reference_numbers"),
        F.size(hyp_numbers).cast("long").alias("hypothesis_numbers"),
        F.try_divide(matched.cast("double"), F.size(ref_numbers).cast("double")).alias("number_recall"),
        F.try_divide(matched.cast("double"), F.size(hyp_numbers).cast("double")).alias("number_precision"),
    )
