"""Glossary: whole-word alias replacement, and name candidates under acoustic evidence.

A glossary is a small configured table; ``Term`` rows live on the driver and
are folded into the expression, so no join is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom import constants as C
from talkloom.functions import text as T
from talkloom.schemas import WORD

_PART = r"[\p{L}\p{N}_\x{200C}]"


@dataclass(frozen=True)
class Term:
    canonical: str
    kind: str = "term"
    aliases: tuple[str, ...] = ()
    contexts: tuple[str, ...] = ()
    min_alignment_score: float = 0.6
    min_alignment_margin: float = 0.1
    min_character_hits: float = 0.6

    @property
    def sensitive(self) -> bool:
        """Person names need acoustic evidence."""
        return self.kind.endswith("name")

    @property
    def names(self) -> tuple[str, ...]:
        """Canonical form and aliases, in order, once each."""
        return tuple(dict.fromkeys((self.canonical, *self.aliases)))


_FOLD = str.maketrans(C.FOLD_FROM, C.FOLD_TO)


def words_of(text: str) -> list[str]:
    return [" ".join(w.translate(_FOLD).split()).replace(C.ZWNJ, "") for w in re.findall(rf"[\w{C.ZWNJ}]+", text)]


def _longest_first(names: Sequence[str]) -> list[str]:
    return sorted(names, key=lambda n: -len(words_of(n)))


def load_terms(path: str) -> list[Term]:
    """Terms of a TOML file: [[terms]] tables with canonical, type, aliases, contexts and thresholds."""
    import tomllib

    with open(path, "rb") as f:
        data = tomllib.load(f)
    out = []
    for t in data.get("terms", []):
        if not isinstance(t.get("canonical"), str) or not t["canonical"].strip():
            raise ValueError("a term needs a canonical form")
        more = {k: float(t[k]) for k in ("min_alignment_score", "min_alignment_margin", "min_character_hits") if k in t}
        out.append(Term(t["canonical"].strip(), t.get("type", "term"), tuple(t.get("aliases", ())), tuple(t.get("contexts", ())), **more))
    return out


def term_table(spark: SparkSession, terms: Sequence[Term]) -> DataFrame:
    rows = [(t.canonical, t.kind, list(t.aliases), list(t.contexts), t.sensitive, t.min_alignment_score, t.min_alignment_margin, t.min_character_hits) for t in terms]
    return spark.createDataFrame(rows, "canonical string, type string, aliases array<string>, contexts array<string>, requires_acoustic_validation boolean, min_alignment_score double, min_alignment_margin double, min_character_hits double")


def word_array(text: Column | str) -> Column:
    """Normalised words; a zero-width non-joiner is inside a word and then left out."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(t, F.lit(rf"{_PART}+"), F.lit(0)), lambda w: F.replace(T.normalize(w), F.lit(C.ZWNJ), F.lit("")))


def contains_words(words: Column, wanted: list[str]) -> Column:
    """Does the array hold the words in a row?"""
    n = len(wanted)
    if not n:
        return F.lit(False)
    target = F.array(*(F.lit(w) for w in wanted))
    return F.when(F.size(words) >= n, F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n) == target)).otherwise(F.lit(False))


def observed_alias(text: Column, term: Term) -> Column:
    """The longest form of the term that the text holds, or null."""
    return T.bind(word_array(text), lambda words: F.coalesce(*(F.when(contains_words(words, words_of(n)), F.lit(n)) for n in _longest_first(term.names)), F.lit(None).cast("string")))


def _pattern(alias: str) -> str:
    parts = [re.sub(r"([\\.^$|()\[\]{}*+?-])", r"\\\1", p) for p in alias.split()]
    return rf"(?iu)(?<!{_PART})" + r"\s+".join(parts) + rf"(?!{_PART})"


def replace_aliases(text: Column, terms: Sequence[Term]) -> Column:
    """Struct (text, replacements): aliases as whole words become their canonical form, longest first."""
    out, n = text, F.lit(0)
    for t in terms:
        for alias in _longest_first(t.names):
            if alias.split() and words_of(alias) != words_of(t.canonical):
                p = F.lit(_pattern(alias))
                n = n + F.regexp_count(out, p)
                out = F.regexp_replace(out, p, F.lit(t.canonical.replace("\\", "\\\\").replace("$", "\\$")))
    return F.struct(out.alias("text"), n.alias("replacements"))


def rewrite_words(words: list[dict], term: Term) -> tuple[list[dict], int]:
    """Runs of words that spell an alias become one word over their time."""
    def single(w: dict) -> str:
        found = words_of(w.get("word") or "")
        return found[0] if len(found) == 1 else ""

    rows, changed = list(words), 0
    for alias in _longest_first(term.names):
        wanted = words_of(alias)
        if not wanted or wanted == words_of(term.canonical):
            continue
        done, i = [], 0
        while i < len(rows):
            run = rows[i : i + len(wanted)]
            if [single(w) for w in run] != wanted:
                done.append(rows[i])
                i += 1
                continue
            lead = re.match(r"\s*", run[0]["word"])[0]
            tail = re.search(rf"[^\w؀-ۿ{C.ZWNJ}]*$", run[-1]["word"])[0]
            known = [w["probability"] for w in run if w.get("probability") is not None]
            done.append({"word": f"{lead}{term.canonical}{tail}", "start": run[0]["start"], "end": run[-1]["end"], "probability": min(known, default=None)})
            changed += 1
            i += len(wanted)
        rows = done
    return rows, changed


def normalize_segments(segments: DataFrame, terms: Sequence[Term], include_sensitive: bool = False) -> DataFrame:
    """Segments (.., text, words) with aliases of the terms rewritten in words and text, and the number of replacements."""
    from pyspark.sql.types import _parse_datatype_string

    chosen = [t for t in terms if include_sensitive or not t.sensitive]
    kind = _parse_datatype_string(f"text string, words array<{WORD}>, changed long")

    @F.arrow_udf(kind)
    def rewrite(text: pa.Array, words: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for t, w in zip(text.to_pylist(), words.to_pylist(), strict=True):
            total, w = 0, w or []
            for term in chosen:
                new, n = rewrite_words(w, term) if w else (w, 0)
                if n:
                    w, t, total = new, "".join(x["word"] or "" for x in new).strip(), total + n
            out.append({"text": t, "words": w, "changed": total})
        return pa.array(out, to_arrow_type(kind))

    x = segments.withColumn("_r", rewrite("text", F.coalesce("words", F.array().cast(f"array<{WORD}>"))))
    plain = replace_aliases(F.coalesce("text", F.lit("")), chosen)
    x = x.withColumn("_p", plain)
    return x.withColumn("replacements", F.when(F.col("_r.changed") > 0, F.col("_r.changed")).otherwise(F.col("_p.replacements"))).withColumn("text", F.when(F.col("_r.changed") > 0, F.col("_r.text")).otherwise(F.col("_p.text"))).withColumn("words", F.col("_r.words")).drop("_r", "_p")


def _spelled(single: Column, words: Column, wanted: list[str], name: str) -> Column:
    """Times of the runs of ``words`` that spell a name; single: their normalised forms, empty where a word is several."""
    target, k = F.array(*(F.lit(w) for w in wanted)), len(wanted)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(single) - k + 1, F.lit(1))), lambda i: F.slice(single, i, k) == target)
    return F.transform(at, lambda i: F.struct(F.get(words, i - 1)["start"].alias("start"), F.get(words, i + k - 2)["end"].alias("end"), F.lit(name).alias("observed")))


def alignment_requests(segments: DataFrame, terms: Sequence[Term], call: str = "call_id", longest: float = 8.0) -> DataFrame:
    """For each observed person name and place: one request per name of the glossary.

    segments: (call, id, start, end, text, alternative, words).  Rows: call, id, trigger, observed, start, end, candidate.
    """
    sensitive = [t for t in terms if t.sensitive]
    if not sensitive:
        return segments.select(call, "id", F.lit("").alias("trigger"), F.lit("").alias("observed"), "start", "end", F.lit("").alias("candidate")).limit(0)
    combined = F.concat_ws(" ", "text", "alternative")
    hits = []
    for t in sensitive:
        seen = observed_alias(combined, t)
        if t.contexts:
            context = F.lit(False)
            for c in t.contexts:
                context |= F.contains(T.normalize(combined), T.normalize(F.lit(c)))
            seen = F.when(context, seen)
        spans = F.array().cast("array<struct<start:double,end:double,observed:string>>")
        single = F.transform(F.col("words"), lambda w: F.when(F.size(word_array(w["word"])) == 1, F.get(word_array(w["word"]), F.lit(0))).otherwise(F.lit("")))
        for n in t.names:
            wanted = words_of(n)
            if wanted:
                spans = F.concat(spans, _spelled(single, F.col("words"), wanted, n))
        spans = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:double,end:double,observed:string>>")), lambda s: s["end"] > s["start"])
        whole = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"), seen.alias("observed")))
        spans = F.when(F.size(spans) > 0, spans).when(F.col("end") - F.col("start") <= longest, whole)
        hits.append(segments.where(seen.isNotNull()).select(call, "id", F.lit(t.canonical).alias("trigger"), F.explode(spans).alias("s")).select(call, "id", "trigger", "s.*"))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    w = Window.partitionBy(call, "id", "trigger", F.round("start", 2), F.round("end", 2)).orderBy("start", "end", "observed")
    once = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.withColumn("candidate", F.explode(F.array(*(F.lit(t.canonical) for t in sensitive))))


def decide(requests: DataFrame, scores: DataFrame, terms: Sequence[Term], call: str = "call_id") -> DataFrame:
    """The best candidate of each place, accepted if score, hits and margin to the runner-up suffice.

    scores: (call, id, start, end, candidate, word_scores array<double>, word_hits array<double>); a place without
    complete scores counts 0.
    """
    keys = [call, "id", "trigger", "observed", "start", "end"]
    whole = lambda c: F.when((F.size(c) > 0) & F.forall(c, lambda x: T.finite(x)), F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)
    s = scores.select(call, "id", "start", "end", "candidate", whole("word_scores").alias("score"), whole("word_hits").alias("hits"))
    x = requests.join(s, [call, "id", "start", "end", "candidate"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("hits", F.coalesce("hits", F.lit(0.0)))
    limit = lambda f: F.element_at(F.create_map(*(F.lit(v) for t in terms for v in (t.canonical, getattr(t, f)))), F.col("candidate"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate")
    best = x.withColumn("runner_up", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    ok = (F.col("score") >= limit("min_alignment_score")) & (F.col("hits") >= limit("min_character_hits")) & (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= limit("min_alignment_margin")))
    return best.select(*keys, F.when(ok, F.col("candidate")).alias("canonical"), F.round("score", 4).alias("score"), F.round("hits", 4).alias("hits"), F.round("runner_up", 4).alias("runner_up"), ok.alias("accepted"))


def mask_rejected(text: Column, observed: Sequence[str]) -> Column:
    """A consensus text with unverified names masked."""
    return replace_aliases(text, [Term(C.MARKER, aliases=tuple(observed))])["text"]


VALIDATED, UNVERIFIED = "lexicon_ctc_validated", "sensitive_entity_unverified"
_DECISION = "struct<trigger:string,observed:string,start:double,end:double,canonical:string,score:double,hits:double,runner_up:double,accepted:boolean>"


def _names_pattern(names: Sequence[str]) -> list[tuple[re.Pattern, list[str]]]:
    """Python's form of the aliases' patterns, longest first."""
    part = rf"[\w{C.ZWNJ}]"
    return [(re.compile(rf"(?i)(?<!{part})" + r"\s+".join(map(re.escape, n.split())) + rf"(?!{part})"), words_of(n)) for n in _longest_first(names) if n.split()]


def replace_names(text: str, names: Sequence[str], canonical: str) -> tuple[str, int]:
    """A text with whole-word names in their canonical form, and their number."""
    total = 0
    for pattern, words in _names_pattern(names):
        if words != words_of(canonical):
            text, n = pattern.subn(lambda _: canonical, text)
            total += n
    return text, total


def write_back(rows: DataFrame, decisions: DataFrame, terms: Sequence[Term], call: str = "call_id") -> DataFrame:
    """Timeline rows with accepted names written into their texts and words.

    rows: (call, id, text, alternative, words, flags, ..); decisions: rows of ``decide``.  In the order of the glossary, of
    a term's forms and of time, the first accepted decision of each row and name rewrites every form of its term: in text and alternative as
    whole words, in words run by run, where a run becomes one word over its time.  Adds entity_candidates (all decisions)
    and entity_resolutions (those applied), and flags changed rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    places = {(t.canonical, n): 1000 * i + k for i, t in enumerate(terms) for k, n in enumerate(t.names)}
    place = F.try_element_at(F.create_map(*(F.lit(v) for (t, n), i in places.items() for v in (f"{t}\n{n}", i))), F.concat_ws("\n", "trigger", "observed"))
    one = F.struct("trigger", "observed", "start", "end", "canonical", "score", "hits", "runner_up", "accepted").cast(_DECISION)
    listed = decisions.groupBy(call, "id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("start").alias("at"), F.col("end").alias("to"), F.col("observed").alias("seen"), one.alias("d")))).alias("_d"))
    x = rows.join(listed, [call, "id"], "left").withColumn("entity_candidates", F.coalesce(F.transform("_d", lambda d: d["d"]), F.array().cast(f"array<{_DECISION}>")))
    accepted = F.filter("entity_candidates", lambda d: d["accepted"])
    first = F.filter(accepted, lambda d, i: ~F.exists(F.slice(accepted, F.lit(1), i), lambda e: e["canonical"] == d["canonical"]))
    x = x.withColumn("entity_resolutions", first)
    kind = _parse_datatype_string(f"text string, alternative string, words array<{WORD}>")
    by_name = {t.canonical: t for t in terms}

    @F.arrow_udf(kind)
    def rewrite(text: pa.Array, alternative: pa.Array, words: pa.Array, candidates: pa.Array) -> pa.Array:
        out = []
        for t, a, w, c in zip(text.to_pylist(), alternative.to_pylist(), words.to_pylist(), candidates.to_pylist(), strict=True):
            first = {d["canonical"]: d for d in reversed(c or []) if d["accepted"]}
            for d in sorted(first.values(), key=c.index) if c else []:
                term = by_name[d["trigger"]]
                names = tuple(dict.fromkeys((*term.aliases, term.canonical)))
                t, a = (x if x is None else replace_names(x, names, d["canonical"])[0] for x in (t, a))
                w = rewrite_words(w or [], Term(d["canonical"], aliases=names))[0] if w else w
            out.append({"text": t, "alternative": a, "words": w})
        return pa.array(out, to_arrow_type(kind))

    hit = F.size("entity_resolutions") > 0
    new = x.where(hit).withColumn("_n", rewrite("text", "alternative", "words", "entity_candidates"))
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit(VALIDATED)))))
    changed = {"text": F.col("_n.text"), "alternative": F.col("_n.alternative"), "words": F.col("_n.words"), "flags": flags}
    columns = [c for c in rows.columns if c not in ("entity_candidates", "entity_resolutions")]
    out = [*columns, "entity_candidates", "entity_resolutions"]
    return x.where(~hit).select(out).unionByName(new.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in out)))


def guard_unverified(rows: DataFrame) -> DataFrame:
    """Masks names without evidence in the consensus of rows of ``write_back``.

    rows: (consensus_text, confidence_tier, reason, flags, entity_candidates, entity_resolutions, ..).  Where none of a row's
    names was accepted, the rejected ones are masked as whole words; if that changes the text, the row is unresolved, says
    why, names the spans and is flagged.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("text string, n long")

    @F.arrow_udf(kind)
    def mask(text: pa.Array, candidates: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(text.to_pylist(), candidates.to_pylist(), strict=True):
            total = 0
            for d in c or []:
                if not d["accepted"]:
                    t, n = replace_names(t or "", (d["observed"] or "",), C.MARKER)
                    total += n
            out.append({"text": t, "n": total})
        return pa.array(out, to_arrow_type(kind))

    rejected = F.filter("entity_candidates", lambda d: ~F.coalesce(d["accepted"], F.lit(False)))
    x = rows.withColumn("_r", F.when(F.size("entity_resolutions") == 0, rejected))
    asked = F.coalesce(F.size("_r") > 0, F.lit(False))
    masked = x.where(asked).withColumn("_m", mask("consensus_text", "entity_candidates"))
    span = F.transform("_r", lambda d: F.struct(d["observed"].alias("text"), F.lit("ctc_score_or_margin_below_threshold").alias("reason")))
    none = F.array().cast("array<struct<text:string,reason:string>>")
    hit = F.coalesce(F.col("_m.n") > 0, F.lit(False))
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit(UNVERIFIED)))))
    changed = {"consensus_text": F.col("_m.text"), "confidence_tier": F.lit("unresolved"), "reason": F.lit("sensitive_entity_requires_acoustic_evidence"), "flags": flags, "uncertainty_spans": span}
    columns = [*(c for c in rows.columns if c != "uncertainty_spans"), "uncertainty_spans"]
    old = F.col("uncertainty_spans") if "uncertainty_spans" in rows.columns else none
    rest = x.where(~asked).withColumn("uncertainty_spans", old)
    masked = masked.withColumn("uncertainty_spans", old)
    new = masked.select(*(F.when(hit, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in columns))
    return rest.select(columns).unionByName(new)


def term_snapshot(terms: Sequence[Term]) -> list[dict]:
    """The glossary as it is stored beside a result."""
    return [{"canonical": t.canonical, "type": t.kind, "aliases": list(t.aliases), "contexts": list(t.contexts), "min_alignment_score": t.min_alignment_score, "min_alignment_margin": t.min_alignment_margin, "min_character_hits": t.min_character_hits} for t in terms]
