"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from talkloom.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int, v int, distance double"


def brute(rows, k, dim, scale, rounds, seed):
    """rows: (id, vector).  Sorted (id, cluster, distance, cluster inertia, inertia, digest of the centroid)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [q for _, q in sorted((name(i), q) for i, q in kept)[:k]]
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    best = lambda q: min((far(q, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        of = [best(q)[1] for _, q in kept]
        for n in set(of):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == n]
            c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *best(q)[::-1]) for i, q in kept]
    inertia = [sum(d for _, n, d in found if n == m) for m in range(k)]
    digest = lambda n: hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()
    return sorted(((i, n, d, inertia[n], sum(inertia), digest(n)) for i, n, d in found), key=repr)


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("top", [1, 3, 700])
def test_nearest_is_exact_however_close(top):
    """Small components make many ties; the largest ones make every interval wide."""
    rng = np.random.default_rng(top)
    big = cc.largest(8)
    for scale in (1, big // top):
        x, c = rng.integers(-top, top + 1, (3000, 8)) * scale, rng.integers(-top, top + 1, (7, 8)) * scale
        c[5] = c[2]
        x[:9], c[6] = c[3] + 1 if scale == 1 else c[3], c[3]
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)), n) for n, q in enumerate(c)) for p in x]
        cluster, distance = cc.nearest(x, c)
        assert [*zip(distance.tolist(), cluster.tolist(), strict=True)] == want


def test_intervals_hold_the_exact_values():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-(2**27), 2**27, (500, 64)), rng.integers(-(2**27), 2**27, (16, 64))
    low, high = cc.intervals(x, c)
    exact = [[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    assert all(low[i, j] <= exact[i][j] <= high[i, j] for i in range(500) for j in range(16))


def test_cluster(spark):
    """Ties, repeated rows and ids, null and unusable vectors, clashing names; empty clusters stay."""
    rng, dim = random.Random(8), 6
    rows = [(i, [rng.choice([-1.5, -0.26, 0.0, 0.25, 1.0]) for _ in range(dim)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1])] + [(1000 + i, [0.5] * dim) for i in range(150)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [0.0] * 7), (404, [0.0] * 5 + [None]), (405, [math.nan] * dim), (406, [0.0] * 5 + [-math.inf])]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 0.5) for i, v in rows], SCHEMA).repartition(5)
    for k, rounds in ((16, 3), (3, 0), (500, 2)):
        assert got(cc.cluster(df, k=k, dim=dim, scale=4, rounds=rounds, seed=9)) == brute(rows, k, dim, 4, rounds, 9)


def test_few_and_no_vectors_and_too_large_ones(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (3, None)], "vec_id long, embedding array<double>")
    assert got(cc.cluster(df)) == brute([(1, [0.5] * 64), (2, [0.25] * 64)], 16, 64, 64, 3, 1)
    for none in (df.where("false"), df.where("vec_id = 3")):
        out = cc.cluster(none)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        cc.cluster(spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")).collect()
