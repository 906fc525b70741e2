"""Interval operators over (call, start, end) rows.

Joins carry the call as an equality; ``overlap_join`` also carries bins of time,
so that a long call is spread over tasks.  Groups that depend on what was
grouped before come from ``greedy_groups``, in one pass over a call's sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _binned(df: DataFrame, seconds: float, levels: list[int], own: bool) -> DataFrame:
    """Rows (_level, _bin, ...) of intervals (_s, _e): at their own level, or at the coarser ones of ``levels``.

    The bins of a level are twice as long as those of the one before; an interval is no longer than the bins of its own
    level, so it meets two of them at most.
    """
    if own:
        x = df.withColumn("_level", F.col("_own"))
    else:
        x = df.withColumn("_level", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)).cast("array<int>"), lambda k: k > F.col("_own"))))
    size = F.lit(seconds) * F.pow(F.lit(2.0), "_level")
    return x.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], seconds: float = 16.0) -> DataFrame:
    """Pairs of rows of one key whose intervals (start, end) overlap: the columns of left, and those of right with ``r_`` before them.

    Intervals overlap if each starts before the other ends; a point overlaps what begins before and ends after it.  Each
    interval is put into bins of about its own length, from ``seconds`` upwards, and meets shorter ones of the other side
    there; the bin that holds the later start reports a pair.  So a call with very many rows fills as many tasks as it has
    bins, and no row is repeated more than twice for each level that the other side has (66 at most, which is all that the
    driver gets).  Intervals with a null, infinite or missing end, or that end before they start, overlap nothing.
    """
    sound = (F.abs("_s") < 1e15) & (F.abs("_e") < 1e15) & (F.col("_s") <= F.col("_e"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col("_e") - F.col("_s")) / seconds, F.lit(1.0))))).cast("int")

    def named(df: DataFrame, prefix: str) -> DataFrame:
        x = df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))
        return x.withColumns({"_s": F.col(prefix + "start").cast("double"), "_e": F.col(prefix + "end").cast("double")}).where(sound).withColumn("_own", level)

    a, b = named(left, ""), named(right, "r_")
    at = lambda df: [r[0] for r in df.select("_own").distinct().collect()]
    above, below = at(b), at(a)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnsRenamed({"_s": "_rs", "_e": "_re", "_level": "_rlevel", "_bin": "_rbin"}).drop("_own")
        on = (F.col("_level") == F.col("_rlevel")) & (F.col("_bin") == F.col("_rbin"))
        for k in keys:
            on &= F.col(k) == F.col(f"r_{k}")
        both = x.join(y, on).where((F.col("_s") < F.col("_re")) & (F.col("_rs") < F.col("_e")))
        owner = F.floor(F.greatest("_s", "_rs") / (F.lit(seconds) * F.pow(F.lit(2.0), "_level"))) == F.col("_bin")
        return both.where(owner).select(*left.columns, *(f"r_{c}" for c in right.columns))

    same = met(_binned(a, seconds, [], True), _binned(b, seconds, [], True))
    shorter = met(_binned(a, seconds, above, False), _binned(b, seconds, [], True))
    longer = met(_binned(a, seconds, [], True), _binned(b, seconds, below, False))
    return same.unionAll(shorter).unionAll(longer)


def greedy_groups(rows: DataFrame, keys: list[str], *, gap: float, longest: float, order: tuple[str, ...] = ("start", "end"), least_gap: float | None = None, alike: str | None = None, furthest: bool = False) -> DataFrame:
    """Adds ``group``, from 0 for each key: in ``order``, a row joins the group before it while that stays short.

    It joins if it starts at most ``gap`` (and at least ``least_gap``) after the row before it ends, if the group, from its
    first start to its end, is at most ``longest`` with it, and if both rows have the same ``alike``, not null.  With
    ``furthest`` a group ends with the latest end of its rows, not with the last one's.

    Rows are sorted by key and order and come as batches; a batch takes the open group of the one before along, so memory
    doesn't grow with a call, and the time is linear in its rows (``group_starts``).  Null times join nothing.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    names = rows.columns
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        began, ended, kind = 0.0, 0.0, None  # of the open group: its first start, its end, and what its last row is like
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            start, end = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            of = [*zip(*(batch.column(k).to_pylist() for k in keys), strict=True)]
            kinds = np.array(batch.column(alike).to_pylist() if alike else [True] * n, dtype=object)
            group, at = np.zeros(n, dtype=np.int64), 0
            while at < n:
                upto = at + 1
                while upto < n and of[upto] == of[at]:
                    upto += 1
                s, e, k, known = start[at:upto], end[at:upto], kinds[at:upto], of[at] == last
                if known:  # the open group stands before the batch as one row
                    s, e, k = np.append(began, s), np.append(ended, e), np.append(np.array([kind], dtype=object), k)
                first = group_starts(s, e, k, gap, longest, least_gap, furthest)
                numbers = np.cumsum(first) - 1 + (number if known else 0)
                group[at:upto] = numbers[1:] if known else numbers
                begun = int(np.flatnonzero(first)[-1])
                began, ended, kind = s[begun], e[begun:].max() if furthest else e[-1], k[-1]
                last, number, at = of[at], int(numbers[-1]), upto
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], names=[*names, "group"])

    return sorted_.mapInArrow(run, StructType([*rows.schema, StructField("group", LongType())]))


def group_starts(start: np.ndarray, end: np.ndarray, kind: np.ndarray, gap: float, longest: float, least_gap: float | None = None, furthest: bool = False) -> np.ndarray:
    """Does a group of ``greedy_groups`` begin at each row of one key?  NaN joins nothing, and no row joins one of kind None.

    Where ends don't decrease, the first row that can't join the group of row i depends on i only.  So every row points to
    it, by binary search, and the groups begin where pointers lead from the first row after each certain gap: those rows
    are marked by doubling the pointers.  Other rows are gone through one by one.
    """
    n = len(start)
    with np.errstate(invalid="ignore"):
        space = start[1:] - end[:-1]
        joins = (kind[1:] == kind[:-1]) & (kind[1:] != None)  # noqa: E711  element by element
        if not furthest:
            joins &= space <= gap
            if least_gap is not None:
                joins &= space >= least_gap
        plain = not furthest and bool((end[1:] >= end[:-1]).all()) and not np.isnan(start).any()
    broken = np.append(True, ~joins.astype(bool))
    if not plain:
        first, began, reach = broken, 0.0, 0.0
        for i, (s, e, b) in enumerate(zip(start.tolist(), end.tolist(), broken.tolist(), strict=True)):
            late = max(reach, e) if furthest else e
            if not b and late - began <= longest and (not furthest or s - reach <= gap):
                reach = late
            else:
                first[i], began, reach = True, s, e
        return first
    heads = np.flatnonzero(broken)
    after = np.append(heads[1:], n)[np.cumsum(broken) - 1]  # the first row behind the certain gap
    row, padded = np.arange(n), np.append(end, np.inf)
    point = np.minimum(np.maximum(np.searchsorted(end, start + longest, side="right"), row + 1), after)
    while (more := (point < after) & (padded[point] - start <= longest)).any():  # sums are rounded: the difference decides
        point[more] += 1
    while (less := (point > row + 1) & (padded[point - 1] - start > longest)).any():
        point[less] -= 1
    return reached(np.append(point, n), heads)


def reached(point: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The rows that pointers to later rows reach from ``heads``; the last place is the end.  Pointers are doubled, so there are as many rounds as the number of steps has bits."""
    n = len(point) - 1
    marked = np.zeros(n + 1, dtype=bool)
    marked[heads] = True
    jump = point.copy()
    while True:
        more = marked.copy()
        more[jump[np.flatnonzero(marked)]] = True
        if (jump == n).all():
            return more[:n]
        marked, jump = more, jump[jump]


def merge_overlapping(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", *, aggregates: list[Column] | None = None) -> DataFrame:
    """Fuses rows that overlap (touching rows stay apart): islands by a running maximum end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    islands = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"), *(aggregates or [])).drop("_island")


def merge_channels(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One timeline of segments heard on separate channels: overlapping ones fuse to (keys, start, end, text, words, flags, channels).

    segments: (keys, channel_id, start, end, text, words, flags).  Fused texts are joined in time order, lose their word
    times and are flagged channel_overlap; a segment that overlaps none keeps its text, words and flags.
    """
    order = F.array_sort(F.collect_list(F.struct("start", "end", "channel_id", "text", "words", "flags"))).alias("r")
    x = merge_overlapping(segments, keys, aggregates=[order])
    fused, first = F.col("parts") > 1, F.get("r", F.lit(0))
    texts = F.filter(F.transform("r", lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), lambda t: t != "")
    none = F.array().cast("array<string>")
    flags = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("r", lambda s: F.coalesce(s["flags"], none))), F.array(F.lit("channel_overlap")))))
    return x.select(
        *keys,
        "start",
        "end",
        F.when(fused, F.array_join(texts, " ")).otherwise(first["text"]).alias("text"),
        F.when(fused, F.slice(first["words"], 1, 0)).otherwise(first["words"]).alias("words"),
        F.when(fused, flags).otherwise(first["flags"]).alias("flags"),
        F.transform("r", lambda s: s["channel_id"]).alias("channels"),
    )


def merge_touching(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of closed intervals: rows that overlap or touch become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def subtract(base: DataFrame, cover: DataFrame, keys: list[str], minimum: float = 1.0, longest: float | None = 8.0) -> DataFrame:
    """Parts of base intervals outside the cover, at least ``minimum`` long, cut into equal parts of at most ``longest``."""
    cuts = merge_touching(cover.select(*keys, "start", "end"), keys).select(*keys, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    hit = base.select(*keys, "start", "end").join(cuts, keys, "left").where(F.col("c_start").isNull() | ((F.col("c_start") < F.col("end")) & (F.col("c_end") > F.col("start"))))
    touched = hit.where("c_start is not null")
    free = base.select(*keys, "start", "end").join(touched.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")
    w = Window.partitionBy(*keys, "start", "end").orderBy("c_start")
    edges = touched.select(*keys, "start", "end", F.coalesce(F.lag("c_end").over(w), F.col("start")).alias("g_start"), F.col("c_start").alias("g_end"))
    tail = touched.groupBy(*keys, "start", "end").agg(F.max("c_end").alias("g_start")).select(*keys, "start", "end", "g_start", F.col("end").alias("g_end"))
    gaps = edges.unionByName(tail).select(*keys, F.greatest("g_start", "start").alias("start"), F.least("g_end", "end").alias("end")).unionByName(free)
    gaps = gaps.where(F.col("end") - F.col("start") >= minimum)
    if longest is None:
        return gaps
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest)).cast("int")
    parts = gaps.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    size = (F.col("end") - F.col("start")) / F.col("_n")
    return parts.select(*keys, (F.col("start") + F.col("_i") * size).alias("start"), (F.col("start") + (F.col("_i") + 1) * size).alias("end"))


def tight_windows(regions: DataFrame, keys: list[str], duration: str, maximum: float = 15.0, silence: float = 0.5, shortest: float = 0.2) -> DataFrame:
    """Speech windows: regions clipped to the call, fused across short silences while at most ``maximum`` long, longer ones cut."""
    rows = regions.select(*keys, F.greatest(F.lit(0.0), F.col("start")).alias("start"), F.least(F.col(duration), F.col("end")).alias("end"), duration)
    rows = rows.where((F.col("end") - F.col("start") >= shortest) & (F.col(duration) > 0) & F.lit(maximum > 0))
    grouped = greedy_groups(rows.drop(duration), keys, gap=silence, longest=maximum)
    fused = grouped.groupBy(*keys, "group").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
    n = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / maximum) - 1).cast("int")
    parts = fused.withColumn("_i", F.explode(F.sequence(F.lit(0), n)))
    cut = parts.select(*keys, (F.col("start") + F.col("_i") * maximum).alias("start"), F.least(F.col("start") + (F.col("_i") + 1) * maximum, F.col("end")).alias("end"))
    return cut.where(F.col("end") - F.col("start") >= shortest).select(*keys, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def retry_groups(gaps: DataFrame, keys: list[str], duration: str, minimum: float = 30.0, maximum: float = 30.0, context: float = 3.0, silence: float = 3.0) -> DataFrame:
    """Groups nearby gaps and centres a decoding window on each: gap_start, gap_end, ids, start, end."""
    core = max(0.001, maximum - 2 * context)
    grouped = greedy_groups(gaps.select(*keys, duration, "start", "end", "id"), [*keys, duration], gap=silence, longest=core, order=("start", "end", "id"), furthest=True)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "id"))), lambda x: x["id"]).alias("ids")
    g = grouped.groupBy(*keys, duration, "group").agg(F.min("start").alias("gap_start"), F.max("end").alias("gap_end"), ids).drop("group")
    length = F.least(F.col(duration), F.greatest(F.lit(minimum), F.col("gap_end") - F.col("gap_start") + 2 * context), F.lit(float(max(maximum, minimum))))
    g = g.withColumn("_len", length)
    start = F.greatest(F.lit(0.0), F.least(F.col(duration) - F.col("_len"), (F.col("gap_start") + F.col("gap_end")) / 2 - F.col("_len") / 2))
    return g.withColumn("start", F.round(start, 3)).withColumn("end", F.round(F.col("start") + F.col("_len"), 3)).drop("_len")


def attempt_windows(plans: DataFrame, duration: str, expand: float) -> DataFrame:
    """Tight, contextual and expanded window of each plan, equal ones once: adds mode, attempt, a_start, a_end."""
    width = F.least(F.col(duration), F.lit(float(expand)))
    centre = (F.col("gap_start") + F.col("gap_end")) / 2
    wide = F.greatest(F.lit(0.0), F.least(F.col(duration) - width, centre - width / 2))
    window = lambda mode, a, b: F.struct(F.lit(mode).alias("mode"), F.round(a, 3).alias("start"), F.round(b, 3).alias("end"))
    all3 = F.array(
        window("tight_vad", F.greatest(F.lit(0.0), F.col("gap_start") - 0.4), F.least(F.col(duration), F.col("gap_end") + 0.4)),
        window("contextual", F.col("start"), F.col("end")),
        window("expanded", wide, wide + width),
    )
    kept = F.filter(all3, lambda x: x["end"] > x["start"])
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    first = F.filter(kept, lambda x, i: ~F.exists(F.when(i > 0, F.slice(kept, 1, F.greatest(i, F.lit(1)))).otherwise(F.slice(kept, 1, 0)), lambda y: same(x, y)))
    return plans.select("*", F.posexplode(first).alias("attempt", "a")).select(*plans.columns, "attempt", F.col("a.mode").alias("mode"), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"))


def elementary(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Elementary intervals between all boundaries of a key: start, end, mid."""
    points = df.select(*keys, F.explode(F.array(start, end)).alias("start")).distinct()
    w = Window.partitionBy(*keys).orderBy("start")
    slices = points.withColumn("end", F.lead("start").over(w)).where("end is not null")
    return slices.withColumn("mid", (F.col("start") + F.col("end")) / 2)


def labels_at(slices: DataFrame, rows: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Adds the sorted set of labels whose [start, end) holds each slice's middle."""
    r = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(label).alias("_l"))
    on = (F.col("_s") <= F.col("mid")) & (F.col("mid") < F.col("_e"))
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_k{i}")
    joined = slices.join(r, on, "left")
    return joined.groupBy(*slices.columns).agg(F.array_sort(F.collect_set("_l")).alias(name))


def timeline_errors(rows: DataFrame, keys: list[str], duration: str, parts: str | None = None) -> DataFrame:
    """One row per violated rule and row: interval out of range, duplicate, or overlapping the one before.

    parts, if given, names an array of (segment, word, ...): the hypothesis tokens a row owns; a token that is owned more
    than once is an error of each of its rows.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    same = Window.partitionBy(*keys, F.round("start", 6), F.round("end", 6))
    bad_range = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col(duration) + 1e-6), F.lit(False))
    checked = rows.select(*keys, "start", "end", bad_range.alias("_r"), (F.count("*").over(same) > 1).alias("_d"), F.coalesce(F.col("start") < F.lag("end").over(w) - 1e-6, F.lit(False)).alias("_o"))
    errors = F.filter(F.array(F.when(F.col("_r"), F.lit("range")), F.when(F.col("_d"), F.lit("duplicate")), F.when(F.col("_o"), F.lit("overlap"))), lambda x: x.isNotNull())
    out = checked.select(*keys, "start", "end", F.explode(errors).alias("error"))
    if parts is None:
        return out
    owned = rows.select(*keys, "start", "end", F.explode(parts).alias("_t"))
    claims = F.count("*").over(Window.partitionBy(*keys, "_t.segment", "_t.word"))
    shared = owned.withColumn("_n", claims).where("_n > 1").select(*keys, "start", "end").distinct()
    return out.unionByName(shared.withColumn("error", F.lit("owner")))


def owners(words: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """The segment that owns each word: most overlap, then the earliest; a word of no length belongs where [start, end) holds it."""
    s = segments.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("index").alias("owner"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    point = F.col("start") == F.col("end")
    on = F.when(point, (F.col("_s") <= F.col("start")) & (F.col("start") < F.col("_e"))).otherwise((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")))
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_k{i}")
    joined = words.join(s, on, "left").withColumn("_o", F.coalesce(overlap_seconds(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")), F.lit(0.0)))
    best = joined.groupBy(*words.columns).agg(F.max(F.struct("_o", (-F.col("owner")).alias("_n"))).alias("_b"))
    return best.select(*words.columns, (-F.col("_b._n")).alias("owner"), F.col("_b._o").alias("overlap"))


def display_rows(segments: DataFrame, keys: list[str], unknown: str, maximum: float = 15.0, gap: float = 0.35) -> DataFrame:
    """Presentation rows: neighbours of one known speaker fused while close and at most ``maximum`` long."""
    speaker = F.when(F.trim(F.coalesce("speaker", F.lit(""))) == "", F.lit(unknown)).otherwise(F.trim("speaker"))
    x = segments.select(*keys, "start", "end", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    x = x.withColumn("_known", F.when(F.col("speaker") != unknown, F.col("speaker")))
    x = greedy_groups(x, keys, gap=gap, longest=maximum, order=("start", "end", "speaker", "text", "uncertain"), least_gap=0.0, alike="_known")
    r = F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "text", "uncertain"))).alias("r")
    x = x.groupBy(*keys, F.col("group").cast("int").alias("position")).agg(r)
    said = F.filter(F.transform("r", lambda s: F.trim(s["text"])), lambda t: t != "")
    first, last = F.get("r", F.lit(0)), F.element_at("r", -1)
    text = F.when(F.size("r") == 1, first["text"]).otherwise(F.array_join(said, " "))
    return x.select(*keys, "position", first["start"].alias("start"), last["end"].alias("end"), first["speaker"].alias("speaker"), text.alias("text"), F.exists("r", lambda s: s["uncertain"]).alias("uncertain"))


def timed_units(words: DataFrame, keys: list[str], longest: float = 8.0, pause: float = 0.65) -> DataFrame:
    """Groups a segment's words into units: a word starts a new one if the unit would pass ``longest`` or follows a pause."""
    x = greedy_groups(words.select(*keys, "word_index", "start", "end", "word"), keys, gap=pause, longest=longest, order=("word_index",))
    r = F.array_sort(F.collect_list(F.struct("word_index", "start", "end", "word"))).alias("r")
    x = x.groupBy(*keys, F.col("group").cast("int").alias("unit")).agg(r)
    text = F.trim(F.array_join(F.transform("r", lambda w: w["word"]), ""))
    return x.select(*keys, "unit", F.get("r", F.lit(0))["start"].alias("start"), F.element_at("r", -1)["end"].alias("end"), text.alias("text"), F.size("r").alias("n_words"))
