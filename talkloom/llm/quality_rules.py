"""Learned decision lists over text statistics.

A base filter fails texts that are too short or repeat themselves.  The list
is learned from labelled rows by sequential covering: a rule grows one
threshold condition at a time by FOIL gain on two thirds of the rows, is pruned
from its end on the other third, and is kept while its precision on both is
high; covered rows go and the next rule is grown.  The rules come out as one
ordered Spark ``when`` chain; the first rule that holds gives the verdict, and
a text that no rule names is kept.

Learning may use a bounded sample of the labelled rows (``max_labelled``,
by a hash of the id); all statistics are taken from whole texts.  Null and
empty texts have zero counts and fail the base filter.  Ids with several
labels take the largest; repeated rows are judged each, but of rows with one id
the list learns from that with the least ratios alone.  Without labels the list
is empty and only the base filter decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_letters", "n_lines")
#: Ratios that rules test, as (numerator, denominator).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "n_chars"),
    "letter_share": ("n_letters", "n_chars"),
}
_SYMBOLS = b"#*$%&|<>"
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[np.frombuffer(_SYMBOLS, dtype=np.uint8)] = 1
_KINDS[48:58] = 2
_LETTERS = re.compile(r"[^\W\d_]+")
_STRUCT = StructType([StructField(c, LongType()) for c in COUNTS])


def _repeats(words: list[bytes]) -> int:
    """Words inside a 3-word window whose words occur as a window twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    size = len(names) + 1
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)
        key = pair * size + ids[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def _measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    chars = len(text)
    dup, lines, seen = 0, 0, set()
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=3)
    spaces = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    if text.isascii():
        view = np.frombuffer(raw, dtype=np.uint8)
        upper = int(((view >= 65) & (view <= 90)).sum())
        letters = upper + int(((view >= 97) & (view <= 122)).sum())
    else:
        letters = sum(map(len, _LETTERS.findall(text)))
        upper = sum(a != b for a, b in zip(text, text.lower(), strict=False)) if len(text.lower()) == chars else sum(map(str.isupper, text))
    return len(words), chars - spaces, int(kinds[1]), dup, _repeats(words), chars, upper, int(kinds[2]), letters, lines


def statistics(column: Column) -> Column:
    """Struct of COUNTS for a text column; all zero for null."""

    @F.arrow_udf(_STRUCT)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([_measure(x.as_py() or "") for x in batch], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))

    return measure(column)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (ratio, is it at least, threshold); texts that meet it are dropped."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{r} {'>=' if up else '<'} {t:g}" for r, up, t in self.conditions)


def _holds(x: np.ndarray, names: list[str], conditions) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for r, up, t in conditions:
        v = x[:, names.index(r)]
        ok &= (v >= t) if up else (v < t)
    return ok


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 4) -> list[Rule]:
    """Sequential covering of the bad rows of x."""
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        grow, prune = left & ~fold, left & fold
        if (bad & grow).sum() < min_covered:
            break
        conditions: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(conditions) < max_conditions and (inside & ~bad).any():
            best, step = 1e-9, None
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            base = np.log2(p0 / (p0 + n0))
            for k, name in enumerate(names):
                order = np.argsort(x[inside, k], kind="stable")
                v, b = x[inside, k][order], bad[inside][order]
                edges = np.flatnonzero(v[1:] > v[:-1]) + 1
                if not len(edges):
                    continue
                below_p = np.cumsum(b)[edges - 1]
                below_n = edges - below_p
                for up, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1)
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, step = gain[j], (name, up, float((v[edges[j]] + v[edges[j] - 1]) / 2))
            if step is None:
                break
            conditions.append(step)
            inside &= _holds(x, names, [step])
        def worth(cs) -> float:
            on = prune & _holds(x, names, cs)
            p, n = (on & bad).sum(), (on & ~bad).sum()
            return (p - n) / max(1, p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        if not conditions:
            break
        on = left & _holds(x, names, conditions)
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        if p < min_covered or p < min_precision * (p + n) or worth(conditions) < 0:
            break
        rules.append(Rule(tuple(conditions), p + n, p / (p + n)))
        left &= ~on
    return rules


def ratios(stats: str = "s") -> dict[str, Column]:
    return {k: F.coalesce(F.try_divide(F.col(f"{stats}.{a}").cast("double"), F.col(f"{stats}.{b}").cast("double")), F.lit(0.0)) for k, (a, b) in RATIOS.items()}


def verdict(rules: list[Rule], stats: str = "s") -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    by, out = ratios(stats), F.lit(None).cast("int")
    for k, rule in reversed([*enumerate(rules, 1)]):
        met = F.lit(True)
        for r, up, t in rule.conditions:
            met &= (by[r] >= t) if up else (by[r] < t)
        out = F.when(met, k).otherwise(out)
    return out


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, **params) -> list[Rule]:
    """Learns from at most about ``max_labelled`` labelled rows, whose ratios are all that reaches the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("label"))
    n = known.count()
    if not n:
        return []
    share = min(1 << 20, -(-(max_labelled << 20) // n))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    measured = (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "id")  # at most about max_labelled rows
        .select("id", "label", statistics(F.col("text")).alias("s"))
        .where(F.col("s.n_words") > 0)
        .select("id", "label", F.struct(*(c.alias(k) for k, c in ratios().items())).alias("r"))
    )
    # sorted here: to sort in Spark would measure the texts twice, the first time for the ranges
    rows = measured.groupBy("id", "label").agg(F.min("r").alias("r")).select("id", "label", "r.*").toPandas().sort_values("id")
    names = list(RATIOS)
    return learn(rows[names].to_numpy(dtype=float), (rows["label"] == 0).to_numpy(), names, **params)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, **params) -> DataFrame:
    """One row per input row: counts, base_failed, the rule that dropped it (null if none) and kept."""
    rules = train(df, labels, id_col, text_col, **params)
    base = (F.col("s.n_words") < min_words) | (100 * F.col("s.n_repeat_words") > max_repeat_percent * F.col("s.n_words"))
    scored = df.select(F.col(id_col), statistics(F.col(text_col)).alias("s")).select(id_col, "s", base.alias("base_failed"), verdict(rules).alias("rule"))
    return scored.select(id_col, *(F.col(f"s.{c}").alias(c) for c in COUNTS[:5]), "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
