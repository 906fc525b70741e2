"""Evaluation: sampling, as-of baselines, rates, candidate choice and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from talkloom.functions import text as T


def sample_calls(calls: DataFrame, count: int, seed: int) -> DataFrame:
    """Round-robin over direction and duration strata, in hash order inside each; with the evaluation split.

    Only the first ``count`` calls of a stratum can be taken, so each stratum is cut to them before the one global order.
    """
    d = F.coalesce("duration_seconds", F.lit(0.0))
    band = F.when(d < 60, "short").when(d < 180, "medium").otherwise("long")
    rows = calls.select("id", F.coalesce("direction", F.lit("unknown")).alias("direction"), band.alias("band"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("h"))
    place = F.row_number().over(Window.partitionBy("direction", "band").orderBy("h", "id"))
    first = rows.withColumn("round", place).where(F.col("round") <= count)
    order = F.row_number().over(Window.orderBy("round", "direction", "band"))
    taken = first.withColumn("position", order - 1).where(F.col("position") < count)
    n = F.count("*").over(Window.partitionBy())
    split = F.when(n == 40, F.when(F.col("position") < 30, "development").otherwise("holdout")).otherwise(F.when(F.col("position") % 5 == 0, "holdout").otherwise("development"))
    return taken.select("id", "direction", "band", "position", split.alias("evaluation_split"))


def baselines(transcripts: DataFrame, approved: DataFrame) -> DataFrame:
    """As-of join: each approved transcript with the last machine version before it of the same audio and content.

    transcripts: (id, audio_id, version, source, audio_hash); approved: (transcript_id).  baseline_id is null where there is none.
    """
    ref = transcripts.join(approved.select(F.col("transcript_id").alias("id")), "id", "left_semi").select(F.col("id").alias("reference_id"), "audio_id", F.col("version").alias("reference_version"), "audio_hash")
    base = transcripts.where("source = 'machine'").select("audio_id", F.col("version").alias("_v"), F.col("audio_hash").alias("_h"), F.col("id").alias("_id"))
    joined = ref.join(base, (ref["audio_id"] == base["audio_id"]) & (F.col("audio_hash") == F.col("_h")) & (F.col("_v") < F.col("reference_version")), "left")
    best = joined.groupBy("reference_id", ref["audio_id"], "reference_version").agg(F.max(F.struct("_v", "_id")).alias("b"))
    return best.select("reference_id", "audio_id", "reference_version", F.col("b._id").alias("baseline_id"), F.col("b._v").alias("baseline_version"))


def micro_rates(scored: DataFrame, by: str | None = "evaluation_split") -> DataFrame:
    """Summed errors over summed lengths, for all calls (split 'all') and by split, in one rollup."""
    sums = [F.count("*").alias("calls"), F.sum("word_errors").alias("we"), F.sum("reference_words").alias("rw"), F.sum("character_errors").alias("ce"), F.sum("reference_characters").alias("rc")]
    x = scored.rollup(by).agg(*sums, F.grouping(by).alias("g")) if by else scored.agg(*sums, F.lit(1).alias("g")).withColumn("split", F.lit(None))
    name = F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(by) if by else F.lit("all"))
    return x.select(name.alias("split"), "calls", F.try_divide(F.col("we").cast("double"), F.col("rw").cast("double")).alias("wer"), F.try_divide(F.col("ce").cast("double"), F.col("rc").cast("double")).alias("cer"))


def macro(column: str) -> Column:
    """Mean of what is known, 0 where nothing is."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def unresolved_rate(text: str) -> Column:
    """Markers per word over all rows, a blank row counting as one word."""
    return F.sum(T.marker_count(T.normalize(text))) / F.sum(F.greatest(F.lit(1), F.size(T.words(text))))


def candidate_metrics(entries: DataFrame, keys: list[str], expected_runs: int | None = None) -> DataFrame:
    """Per model: macro WER and CER, unresolved rate, number precision; only complete ones if ``expected_runs`` is given."""
    out = entries.groupBy(*keys).agg(macro("wer").alias("macro_wer"), macro("cer").alias("macro_cer"), unresolved_rate("hypothesis").alias("unresolved_token_rate"), macro("number_precision").alias("number_precision"), F.count("*").alias("runs"))
    return out if expected_runs is None else out.where(F.col("runs") == expected_runs)


def winner(metrics: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """Among those within ``tolerance`` of the best WER, the least unresolved, then the least CER, then WER and name."""
    least = metrics.agg(F.min("macro_wer").alias("_m"))
    near = metrics.join(F.broadcast(least), F.col("macro_wer") <= F.col("_m") + tolerance).drop("_m")  # a single row
    return near.orderBy("unresolved_token_rate", "macro_cer", "macro_wer", *keys).limit(1)


def promotion(win: DataFrame, entries: DataFrame, snapshots: DataFrame, holdout_count: int) -> DataFrame:
    """One row with the nine checks and their conjunction.

    win: one row of candidate_metrics; entries: the winner's runs with unsupported_numbers, decoder_loop,
    duplicate_intervals; snapshots: baseline wer, cer, number_precision, unresolved_token_rate.
    """
    base = snapshots.agg(
        F.count("*").alias("n"),
        F.avg("wer").alias("b_wer"),
        F.avg("cer").alias("b_cer"),
        F.avg("number_precision").alias("b_precision"),
        F.avg("unresolved_token_rate").alias("b_unresolved"),
        F.coalesce(F.every(F.col("wer").isNotNull() & F.col("cer").isNotNull()), F.lit(False)).alias("known"),
        F.coalesce(F.every(F.col("unresolved_token_rate").isNotNull()), F.lit(False)).alias("known_unresolved"),
    )
    runs = entries.agg(*(F.coalesce(F.every(~F.coalesce(F.col(c), F.lit(False))), F.lit(True)).alias(c) for c in ("unsupported_numbers", "decoder_loop", "duplicate_intervals")))
    x = win.select("macro_wer", "macro_cer", "unresolved_token_rate", "number_precision", "runs").join(F.broadcast(base)).join(F.broadcast(runs))  # one row each
    checks = {
        "reference_split_30_10": (F.col("n") == 30) & F.lit(holdout_count == 10),
        "seeded_repeats_at_least_3": F.col("runs") >= F.col("n") * 3,
        "wer_relative_reduction_20pct": F.col("macro_wer") <= F.col("b_wer") * 0.8,
        "cer_relative_reduction_20pct": F.col("macro_cer") <= F.col("b_cer") * 0.8,
        "number_precision_not_lower": F.col("b_precision").isNull() | (F.col("number_precision") >= F.col("b_precision")),
        "no_unsupported_numbers": F.col("unsupported_numbers"),
        "zero_decoder_loops": F.col("decoder_loop"),
        "zero_duplicate_intervals": F.col("duplicate_intervals"),
        "unresolved_relative_reduction_35pct": F.col("known_unresolved") & (F.col("unresolved_token_rate") <= F.col("b_unresolved") * 0.65),
    }
    x = x.select("known", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    every = F.col("known")
    for k in checks:
        every &= F.col(k)
    return x.select(*checks, every.alias("eligible"))


def candidate_defects(segments: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Defects, mean log probability and coverage of each decoding candidate.

    candidates: (keys, text, prompt); segments: (keys, index, start, end, text, avg_logprob, no_speech_prob, compression_ratio).
    """
    s = segments.join(candidates.select(*keys, F.coalesce("prompt", F.lit("")).alias("prompt")), keys)
    w = Window.partitionBy(*keys).orderBy("index")
    bad_time = ~(T.finite(F.col("start")) & T.finite(F.col("end"))) | ~(F.col("end") > F.col("start")) | F.coalesce(F.col("start") < F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    flags = T.text_flags("text", F.col("avg_logprob"), F.col("no_speech_prob"), F.col("compression_ratio"))
    flags = F.concat(flags, F.when(T.prompt_leakage(F.col("text"), F.col("prompt")), F.array(F.lit("prompt_leakage"))).otherwise(F.array().cast("array<string>")), F.when(F.coalesce(bad_time, F.lit(True)), F.array(F.lit("invalid_timestamp"))).otherwise(F.array().cast("array<string>")))
    counted = ("repetition", "compression", "invalid_asr_metrics", "decoder_truncated", "prompt_leakage", "invalid_timestamp")
    rows = s.select(*keys, F.array_intersect(flags, F.array(*(F.lit(x) for x in counted))).alias("f"), T.scrub("avg_logprob").alias("lp"), F.greatest(F.lit(0.0), F.col("end") - F.col("start")).alias("len"))
    sums = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("f"), F.coalesce(F.avg("lp"), F.lit(-10.0)).alias("mean_logprob"), F.sum("len").alias("coverage"))
    out = candidates.join(sums, keys, "left")
    f = F.coalesce("f", F.array().cast("array<string>"))
    defects = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.concat(f, F.array(F.lit("empty")))).otherwise(f)
    return out.select(*keys, defects.alias("defects"), F.coalesce("mean_logprob", F.lit(-10.0)).alias("mean_logprob"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def choose_candidate(scored: DataFrame, group: list[str], position: str) -> DataFrame:
    """The candidate with the fewest defects, then the best log probability, coverage and place."""
    rank = F.struct(F.size("defects").alias("d"), (-F.col("mean_logprob")).alias("l"), (-F.col("coverage")).alias("c"), F.col(position).alias("p"))
    return scored.groupBy(*group).agg(F.min_by(F.col(position), rank).alias(position))


def fine_tune_ready(calls: DataFrame, eligible: bool, hours: float = 5.0) -> DataFrame:
    return calls.agg((F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600).alias("hours")).withColumn("ready", (F.col("hours") >= hours) & F.lit(not eligible))


def parse_spec(spec: Column) -> Column:
    """Struct (provider, model, family, heavy) of a provider:model name; null if it isn't one."""
    names = F.create_map(*(F.lit(x) for pair in (("turbo", "mlx-whisper:large-v3-turbo"), ("turbo-q4", "mlx-whisper:large-v3-turbo-q4"), ("full", "mlx-whisper:large-v3")) for x in pair))
    s = F.coalesce(F.try_element_at(names, F.trim(spec)), F.trim(spec))
    provider, model = F.regexp_extract(s, r"^([^:]+):(.+)$", 1), F.regexp_extract(s, r"^([^:]+):(.+)$", 2)
    ok = provider.isin("mlx-whisper", "faster-whisper", "qwen3-asr") & (model != "")
    heavy = model.isin("large-v3", "Qwen3-ASR-1.7B") | (provider == "qwen3-asr")
    return F.when(ok, F.struct(provider.alias("provider"), model.alias("model"), F.when(F.contains(provider, F.lit("whisper")), F.lit("whisper")).otherwise(provider).alias("family"), heavy.alias("heavy")))


def marker_only_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Publish gate per call: rejected if it has a decoder loop or more than 35 % marker-only rows."""
    x = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(T.is_marker_only("text")).alias("marker_only"), F.count_if(T.repeats("text")).alias("looping"))
    return x.withColumn("status", F.when(F.col("looping") > 0, "looping").when(F.col("marker_only") > 0.35 * F.col("n_rows"), "unresolved").otherwise("publish"))


# ---- one audit of an evaluation ----


def audit(sample: DataFrame, approved: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row for every sampled or approved call: is it evaluated, and if not, why.

    sample: (audio_id, audio_hash, evaluation_split); approved: current approved versions (audio_id, reference_id,
    reference_version, audio_hash); transcripts: all versions (id, audio_id, version, source, audio_hash).  Rows: audio_id,
    evaluation_split, reference_id, baseline_id (the last machine version before of the same sound), reason: null for the
    evaluated, else ``no approved reference``, ``not selected``, ``audio hash changed`` or ``no machine baseline``.
    """
    s = sample.select("audio_id", F.col("audio_hash").alias("_s"), "evaluation_split", F.lit(True).alias("_selected"))
    r = approved.select("audio_id", "reference_id", "reference_version", F.col("audio_hash").alias("_r"))
    machine = transcripts.where("source = 'machine'").select("audio_id", F.col("audio_hash").alias("_r"), F.col("version").alias("_v"), F.col("id").alias("_id"))
    x = s.join(r, "audio_id", "full_outer")
    earlier = x.select("audio_id", "_r", "reference_version").join(machine, ["audio_id", "_r"]).where(F.col("_v") < F.col("reference_version"))
    base = earlier.groupBy("audio_id").agg(F.max(F.struct("_v", "_id")).alias("_b")).select("audio_id", F.col("_b._id").alias("baseline_id"))
    x = x.join(base, "audio_id", "left")
    reason = (
        F.when(F.col("reference_id").isNull(), "no approved reference")
        .when(F.col("_selected").isNull(), "not selected")
        .when(~F.col("_s").eqNullSafe(F.col("_r")), "audio hash changed")
        .when(F.col("baseline_id").isNull(), "no machine baseline")
    )
    return x.select("audio_id", "evaluation_split", "reference_id", "baseline_id", reason.alias("reason"))


def audit_report(audited: DataFrame, scored: DataFrame) -> DataFrame:
    """Rates and counts by split and for all (rollup): selected, evaluated, excluded by reason, wer, cer.

    scored: (audio_id, word_errors, reference_words, character_errors, reference_characters) of the evaluated calls.
    Calls that were not selected are not counted.
    """
    picked = audited.where(~F.col("reason").eqNullSafe("not selected"))
    x = picked.join(scored.select("audio_id", "word_errors", "reference_words", "character_errors", "reference_characters"), "audio_id", "left")
    none = F.col("reason").isNull()
    count = lambda why: F.count_if(F.coalesce(F.col("reason") == why, F.lit(False)))
    rate = lambda a, b: F.try_divide(F.sum(F.when(none, F.col(a))).cast("double"), F.sum(F.when(none, F.col(b))).cast("double"))
    out = x.rollup("evaluation_split").agg(
        F.grouping("evaluation_split").alias("_all"), F.count("*").alias("selected"), F.count_if(none).alias("evaluated"), count("no approved reference").alias("unapproved"), count("audio hash changed").alias("changed"), count("no machine baseline").alias("no_baseline"),
        rate("word_errors", "reference_words").alias("wer"), rate("character_errors", "reference_characters").alias("cer"),
    )
    return out.withColumn("split", F.when(F.col("_all") == 1, "all").otherwise(F.coalesce("evaluation_split", F.lit("unspecified")))).drop("_all", "evaluation_split")


# ---- model grid ----

#: What a model may hear.
AUDIO_VARIANTS, PROMPT_MODES = ("raw", "agc", "denoise"), ("off", "domain", "glossary")


def model_grid(references: DataFrame, models: list[str], prompt_modes: list[str] = ["off"], audio_variants: list[str] = ["raw", "agc"], repeats: int = 1, seed: int = 0, phase: str = "development") -> DataFrame:  # noqa: B006
    """All runs of a comparison: (phase, audio_id, candidate, model, prompt_mode, variant, repeat, seed), one row a cell.

    The settings are few and checked; each reference is repeated for all of them by one ``explode``.
    """
    if not models or repeats < 1 or len({*models}) != len(models):
        raise ValueError("models must be given, once each, and repeats be positive")
    for given, known in ((prompt_modes, PROMPT_MODES), (audio_variants, AUDIO_VARIANTS)):
        if not given or {*given} - {*known}:
            raise ValueError(f"choose among {', '.join(known)}")
    cells = [(f"{m}|{p}|{v}", m, p, v, r, seed + r) for m in models for p in prompt_modes for v in audio_variants for r in range(repeats)]
    cell = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(c, ("candidate", "model", "prompt_mode", "variant", "repeat", "seed"), strict=True))) for c in cells))
    return references.select("audio_id").distinct().select(F.lit(phase).alias("phase"), "audio_id", F.explode(cell).alias("c")).select("phase", "audio_id", "c.*")


_CELL = ["phase", "audio_id", "candidate", "repeat", "seed"]


def unfinished(grid: DataFrame, results: DataFrame) -> DataFrame:
    """The cells that no result has ended: completed and unsupported ones have, failed ones are tried again."""
    ended = results.where(F.col("status").isin("completed", "unsupported")).select(*_CELL).distinct()
    return grid.join(ended, _CELL, "left_anti")


def resumed(results: DataFrame, more: DataFrame) -> DataFrame:
    """One result a cell: of several the completed one, else the unsupported one, else the last failed; later tables win."""
    rank = F.element_at(F.create_map(*(F.lit(x) for x in ("completed", 0, "unsupported", 1, "failed", 2))), F.col("status"))
    x = results.withColumn("_turn", F.lit(0)).unionByName(more.withColumn("_turn", F.lit(1)), allowMissingColumns=True).withColumn("_rank", F.coalesce(rank, F.lit(3)))
    w = Window.partitionBy(*_CELL).orderBy("_rank", F.desc("_turn"))
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_turn", "_rank")


def completeness(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Per candidate and seed: cells, completed, unsupported, and whether the candidate has completed every cell of every seed."""
    x = grid.join(results.select(*_CELL, "status"), _CELL, "left")
    by_seed = x.groupBy("phase", "candidate", "seed").agg(F.count("*").alias("cells"), F.count_if(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("completed"), F.count_if(F.coalesce(F.col("status") == "unsupported", F.lit(False))).alias("unsupported"))
    whole = F.min((F.col("completed") == F.col("cells")).cast("int")).over(Window.partitionBy("phase", "candidate")) == 1
    return by_seed.withColumn("complete", whole)
