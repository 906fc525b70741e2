"""Interval joins and groups against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.operators import intervals


def rows(rng, n, calls, longest):
    out = []
    for i in range(n):
        s = rng.choice([rng.uniform(-50, 400), float(rng.randrange(0, 200))])
        out.append((rng.choice(calls), i, s, s + rng.choice([0.0, 0.25, 16.0, 32.0, rng.uniform(0, 3), rng.uniform(0, longest)])))
    return out


@pytest.mark.parametrize("seconds", [0.5, 16.0, 1000.0])
def test_overlap_join(spark, seconds):
    rng = random.Random(3)
    a, b = rows(rng, 150, ["x", "y", "z"], 300), rows(rng, 120, ["x", "y", "w"], 40)
    a += [("x", 900, None, 5.0), ("x", 901, 5.0, None), ("x", 902, float("nan"), 5.0), ("x", 903, 9.0, 3.0), ("x", 904, 0.0, float("inf")), (None, 905, 0.0, 9.0), ("y", 906, -1e6, 1e6)]
    b += [("x", 900, None, None), (None, 901, 0.0, 9.0), ("y", 902, -1e6, 1e6), ("x", 903, 0.0, 400.0), ("x", 903, 0.0, 400.0)]
    schema = "call string, id int, start double, end double"
    got = sorted((r.call, r.id, r.r_id) for r in intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).repartition(5), ["call"], seconds).collect())
    ok = lambda s, e: s is not None and e is not None and np.isfinite(s) and np.isfinite(e) and s <= e
    want = sorted((c, i, j) for c, i, s, e in a for d, j, t, f in b if c is not None and c == d and ok(s, e) and ok(t, f) and s < f and t < e)
    assert got == want and len(want) > 500
    empty = spark.createDataFrame([], schema)
    assert intervals.overlap_join(empty, spark.createDataFrame(b, schema), ["call"]).count() == 0


def test_one_long_call_is_spread_over_tasks(spark):
    """A call of very many rows is joined in as many groups as it has bins; pairs stay few."""
    a = spark.range(100_000).select(F.lit("c").alias("call"), "id", (F.col("id") * 0.5).alias("start"), (F.col("id") * 0.5 + 0.4).alias("end"))
    b = spark.range(50_000).select(F.lit("c").alias("call"), "id", (F.col("id") * 1.0).alias("start"), (F.col("id") * 1.0 + 0.7).alias("end")).unionAll(spark.createDataFrame([("c", -1, 0.0, 50_000.0)], "call string, id long, start double, end double"))
    binned = intervals._binned(a.withColumns({"_s": F.col("start"), "_e": F.col("end"), "_own": F.lit(0)}), 16.0, [], True)
    assert binned.groupBy("_bin").count().agg(F.max("count")).first()[0] < 40
    pairs = intervals.overlap_join(a, b, ["call"])
    assert pairs.count() == 200_000


def greedy(seq, gap, longest, least_gap, furthest):
    """seq: (start, end, kind) in order.  Number of each row's group."""
    out, group = [], -1
    for k, (s, e, kind) in enumerate(seq):
        if k:
            space = s - reach
            late = max(reach, e) if furthest else e
            joins = space <= gap and late - began <= longest and kind is not None and kind == last and (least_gap is None or furthest or space >= least_gap)
        if k and joins:
            reach = late
        else:
            group, began, reach = group + 1, s, e
        last = kind
        out.append(group)
    return out


@pytest.mark.parametrize("furthest", [False, True])
@pytest.mark.parametrize("sorted_ends", [False, True])
def test_group_starts(furthest, sorted_ends):
    rng = random.Random(7)
    for n in [1, 2, 3, 40, 40, 40, 700]:
        seq, t = [], 0.0
        for _ in range(n):
            t += rng.choice([0.1, 0.3, 0.7, 0.0, 2.0])
            seq.append([t, t + rng.choice([0.1, 0.2, 0.5, 3.0]), rng.choice(["a", "a", "a", "b", None])])
        if sorted_ends:
            for x, e in zip(seq, sorted(x[1] for x in seq), strict=True):
                x[1] = e
        for gap, longest, least in ((0.35, 2.0, None), (0.7, 8.0, None), (0.3, 0.6, 0.0), (9.0, 9.0, None)):
            s, e, k = (np.array([x[c] for x in seq], dtype=object if c == 2 else float) for c in range(3))
            first = intervals.group_starts(s, e, k, gap, longest, least, furthest)
            assert (np.cumsum(first) - 1).tolist() == greedy(seq, gap, longest, least, furthest)
    e = np.array([0.1 + 0.2, 0.3, 0.7])  # rounding: the difference decides
    for longest in (0.3, 0.30000000000000004, 0.4, 0.7):
        s = np.array([0.0, 0.0, 0.0])
        assert (np.cumsum(intervals.group_starts(s, np.sort(e), np.array([1, 1, 1], dtype=object), 9.0, longest)) - 1).tolist() == greedy([(0.0, x, 1) for x in np.sort(e)], 9.0, longest, None, False)


def test_reached():
    point = np.array([2, 2, 5, 4, 5, 7, 7, 7])
    assert np.flatnonzero(intervals.reached(point, np.array([0]))).tolist() == [0, 2, 5]
    assert np.flatnonzero(intervals.reached(point, np.array([0, 3]))).tolist() == [0, 2, 3, 4, 5]
    chain = np.append(np.arange(1, 1001), 1000)
    assert intervals.reached(chain, np.array([0])).all()


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_greedy_groups(spark, batch):
    """Calls whose rows cross batches, null keys and times, and no rows."""
    rng, data = random.Random(2), []
    for call in ["a", "b", None, "c"]:
        t = 0.0
        for i in range(200 if call == "b" else 30):
            t += rng.choice([0.2, 0.5, 1.0])
            data.append((call, i, t, t + rng.choice([0.1, 0.4, 0.9]), rng.choice(["p", "p", "q", None])))
        data.append((call, 999, None, None, "p"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(data, "call string, id int, start double, end double, who string").repartition(4)
        got = {(r.call, r.id): r.group for r in intervals.greedy_groups(df, ["call"], gap=0.5, longest=3.0, order=("start", "end", "id"), alike="who").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for call in ["a", "b", None, "c"]:
        mine = sorted((x for x in data if x[0] == call), key=lambda x: (x[2] is not None, x[2] or 0, x[3] or 0, x[1]))
        want = greedy([(x[2] if x[2] is not None else float("nan"), x[3] if x[3] is not None else float("nan"), x[4]) for x in mine], 0.5, 3.0, None, False)
        assert [got[call, x[1]] for x in mine] == want
    assert intervals.greedy_groups(df.where("false"), ["call"], gap=1, longest=1).count() == 0
