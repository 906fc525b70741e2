"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from talkloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int, a int, depth int, words string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def label(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def brute(rows):
    """rows: (conv, turn, role, text).  The sorted rows of the trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), label(role, text), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members = {}
    ends = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out, below = [], {}
    for path in sorted(members, key=len, reverse=True):
        under = [below[k] for k in kids.get(path, [])]
        words = len(path[-1][1].encode().split()) if path else 0
        below[path] = (sum(x for x, _ in under) + (not under), sum(x for _, x in under) + (len(members[path]) - 1) * words)
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(under), *below[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Few different turns and long shared beginnings; null, tied and repeated turns; conversations without turns of their own."""
    rng = random.Random(6)
    turn = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "a b", "a  b\nc", "", None, "é ü"]))
    opening = [("system", "be good"), ("user", "hello there"), ("assistant", "hi")]
    out = []
    for c in [*range(0, 130), *range(1001, 1019), *range(-50, -30), 2**40 + 7]:
        if c in (40, 60):
            continue
        turns = (opening if rng.random() < 0.5 else []) + [turn() for _ in range(rng.choice([0, 1, 1, 2, 4]))] or [turn()]
        out += [(c, k, *t) for k, t in enumerate(turns)]
    out += [(5, 1, "user", "tied"), (5, 1, "user", "also tied"), (7, None, "x", "first"), (7, None, "x", "first"), (None, 0, "user", "no id"), (9, None, None, None)]
    for c in (2000, 2020, 2040, 2060):  # long, alike for most of their turns
        out += [(c, k, "user", f"turn {k}" if k < 250 or c < 2040 else f"turn {k} {c}") for k in range(400)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("limit", [0, 7, 300, 50_000])
def test_trie(table, rows, limit):
    """However many levels are heavy, and however shards are gathered."""
    out = pt.trie(table, limit=limit)
    assert out.columns == NAMES and got(out) == brute(rows)


def test_conversations_over_many_tasks(spark, rows):
    """Ranges so small that conversations cross tasks, one of them over most."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        few = [r for r in rows if r[0] is None or r[0] < 130] + [(2000, k, "user", f"turn {k % 50}") for k in range(3000)] + [(2007, k, "user", f"turn {k % 50}") for k in range(900)]
        df = spark.createDataFrame(few, "conv_id long, turn long, role string, text string")
        hashed = pt._hashed(pt.turns_of(df), pt.bases(1, pt.PRIMES), pt.PRIMES)
        assert hashed.where("conv = 2000").select("part").distinct().count() > 5
        assert got(pt.trie(df, limit=100)) == brute(few)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_colliding_hashes_are_made_again(table, rows, monkeypatch):
    """Primes so small that prefixes collide."""
    seeds = []
    whole = pt.rebuilt
    monkeypatch.setattr(pt, "rebuilt", lambda turns, seed, primes: seeds.append((seed, primes)) or whole(turns, seed, primes))
    assert got(pt.trie(table, limit=50, primes=(5, 5, 7, 7))) == brute(rows)
    assert seeds == [(1, (5, 5, 7, 7)), (2, pt.PRIMES)]


def test_hot_prefix_and_copies(spark):
    """Most conversations are copies, and all others begin like them; one id list is longer than a run."""
    copy = [("system", "s"), ("user", "u v"), ("assistant", "w")]
    rows = [(20 * c, k, *t) for c in range(700) for k, t in enumerate(copy)] + [(20 * c, k, *t) for c in range(700, 900) for k, t in enumerate([*copy[: c % 3 + 1], ("user", f"{c // 4} x y")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (50, 50_000):
        assert got(pt.trie(df, limit=limit)) == brute(rows)


def test_empty_single_and_turnless(spark):
    df = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for rows in ([(None, 1, "a", "b")], [(0, 1, "a", "b")], [(c, 0, "a", "b") for c in range(1, 20)], [(3, None, None, "x " * 200_000)]):
        assert got(pt.trie(df(rows))) == brute(rows)
    assert any(r[1] == 0 and r[4] == 0 for r in brute([(c, 0, "a", "b") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]))
    assert pt.trie(df([(1, 1, "a", "b")]).where("false")).collect() == []


def test_louds():
    """Bits, parents, children and sums of a handmade and of random tries."""
    parent, level = np.array([-1, 0, 0, -1, 1, 2, 2]), np.array([0, 1, 1, 0, 2, 2, 2])
    labels = np.array([[k, 0, 0, 0] for k in (5, 9, 2, 7, 1, 4, 3)])
    trie, rows = pt.Louds.of(parent, level, labels)
    assert rows.tolist() == [0, 3, 2, 1, 6, 5, 4]
    assert "".join(map(str, trie._unpacked())) == "110" + "110" + "0" + "110" + "10" + "0" * 3
    assert trie.parents().tolist() == [0, 0, 1, 1, 3, 3, 4] and trie.children().tolist() == [2, 0, 2, 1, 0, 0, 0]
    assert trie.sums(np.ones((7, 1), dtype=int)).ravel().tolist() == [6, 1, 3, 2, 1, 1, 1]
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        parent = np.array([rng.integers(-1, i) if i else -1 for i in range(n)])
        level = np.zeros(n, dtype=int)
        for i in range(n):
            level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
        trie, rows = pt.Louds.of(parent, level, rng.integers(0, 9, (n, 4)))
        up = trie.parents()
        assert [int(parent[r]) for r in rows] == [int(rows[p - 1]) if p else -1 for p in up]
        value, want = rng.integers(0, 9, n), np.zeros(n, dtype=int)
        for i in range(n):
            j = i
            while j >= 0:
                want[j] += value[i]
                j = parent[j]
        assert (trie.sums(value[rows][:, None]).ravel() == want[rows]).all()
