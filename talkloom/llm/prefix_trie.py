"""Prefix trie of conversations: succinct level-order tries per prefix shard, upper levels merged separately.

A conversation is the sequence of its turns (role, text) in the order of
``turn``, null first; turns with equal numbers go by the SHA-256 of role and
text.  ``rebuilt`` replaces its first h turns by those of the conversation whose
id starts its block of ``BLOCK`` ids, h = crc32(id) % ``SHARED``.  Every distinct
sequence of first turns is a node; its members are the conversations that start
with it, its owner is the smallest of them.

**Prefixes.** Turns are dealt by ranges of (conversation, turn), so that a
conversation with very many turns fills several tasks.  Each task adds up
polynomial hashes of its turns' SHA-256 modulo four primes; the few
conversations that cross tasks get the sums before them (the driver holds two
rows a task).  A node is a group of equal prefix hashes.  Groups are verified:
all members must agree on depth, parent and SHA-256 of the last turn, which by
induction proves equal sequences up to equal SHA-256; else the hashes are made
again with other bases.

**Tails.** A node with one member is a step of a single conversation, so its
fields are known at once.  The rest works on nodes with two members or more.

**Shards.** A node with more than ``limit`` turns at or below it is heavy, as is
the root; the light nodes below a heavy one are a shard.  Tasks get whole shards
in turn and gather about ``limit`` nodes, whose trie numpy builds level by level
as a LOUDS bitvector with an array of labels; parents are read off the bits, and
subtree sums are added with ``add.at`` in reverse level order.

**Upper levels.** A node's ancestors are prefixes of its owner.  So the sums of
shards and heavy nodes are added up along the heavy prefixes of their owners
(one running sum a conversation) and then by prefix.  No step depends on the
depth of the trie, and no group is gathered: a prefix that a third of all
conversations share is summed before it is shuffled.

The digest of the conversations that end in a node reads their ids as a stream,
in runs of 256 that other tasks have sorted and joined.

Rows with a null conversation id belong to no conversation and are left out.
Null roles and texts are empty.  Repeated rows are turns of their own.  An empty
table has no root.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm._spark import cut

BLOCK, SHARED = 20, 4
LIMIT = 50_000
#: The four largest primes below 2**31: products of two residues fit in 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_LANES = range(4)
_WORDS = r"[^\x20\x09-\x0D]+"
_RUN = 256


def bases(seed: int, primes: tuple[int, ...]) -> tuple[int, ...]:
    rng = random.Random(seed)
    return tuple(rng.randrange(2, p - 1) for p in primes)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i below n."""
    out = np.ones(max(n, 1), dtype=np.int64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * pow(base, size, prime) % prime
        size += step
    return out


def _hashed(turns: DataFrame, at: tuple[int, ...], primes: tuple[int, ...]) -> DataFrame:
    """turns: (conv, turn, label, words).  Adds rank and prefix hash of each turn; both start anew in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, rank, sums, power = None, 0, [0] * 4, [1] * 4
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy()
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype="<i8").reshape(n, 4)
            digest = label.view("<u4")
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            place = np.arange(n) - starts[of]
            if conv[0] != last:
                rank, sums, power = 0, [0] * 4, [1] * 4
            head = int(starts[1]) if len(starts) > 1 else n
            order = place.copy()
            order[:head] += rank
            columns = [pa.array(np.full(n, part, dtype=np.int32)), batch.column("conv"), pa.array(order)]
            totals, terms = [], []
            for k, prime in enumerate(primes):
                table = _powers(at[k], prime, int(place.max()) + 1)[place]
                table[:head] = table[:head] * power[k] % prime
                term = digest[:, k].astype(np.int64) % prime * table % prime
                total = np.cumsum(term)
                total -= (total - term)[starts][of]
                total[:head] += sums[k]
                total %= prime
                sums[k], power[k] = int(total[-1]), int(table[-1]) * at[k] % prime
                totals.append(pa.array(total))
                terms.append(pa.array(term))
            last, rank = conv[-1], int(order[-1]) + 1
            columns += [*totals, *terms, *(pa.array(np.ascontiguousarray(label[:, k])) for k in _LANES), batch.column("words")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "conv", "rank", *(f"c{k}" for k in _LANES), *(f"t{k}" for k in _LANES), *(f"l{k}" for k in _LANES), "words"]
    dealt = turns.repartitionByRange("conv", "turn", "label").sortWithinPartitions("conv", "turn", "label")
    return dealt.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'part' else 'long'}" for c in names))


def _joined(rows: DataFrame, at: tuple[int, ...], primes: tuple[int, ...]) -> DataFrame:
    """Ranks and prefix hashes over whole conversations; the driver gets two rows a task."""
    spark = rows.sparkSession
    parts_of: dict[int, set[int]] = {}
    for r in rows.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high")).collect():
        for conv in (r["low"], r["high"]):
            parts_of.setdefault(conv, set()).add(r["part"])
    crossing = [(conv,) for conv, parts in parts_of.items() if len(parts) > 1]
    if not crossing:
        return rows.drop("part")
    few = F.broadcast(spark.createDataFrame(crossing, "conv long"))  # at most one a task
    ends = rows.join(few, "conv").groupBy("conv", "part").agg(F.max(F.struct("rank", *(f"c{k}" for k in _LANES))).alias("end")).collect()
    before, known = {}, []
    for conv, part, end in sorted(ends):
        rank, sums = before.get(conv, (0, [0] * 4))
        power = [pow(b, rank, p) for b, p in zip(at, primes, strict=True)]
        known.append((conv, part, rank, *sums, *power))
        before[conv] = (rank + end[0] + 1, [(s + w * c) % p for s, w, c, p in zip(sums, power, end[1:], primes, strict=True)])
    offsets = F.broadcast(spark.createDataFrame(known, ", ".join(f"{c} {'int' if c == 'part' else 'long'}" for c in ("conv", "part", "before", *(f"s{k}" for k in _LANES), *(f"w{k}" for k in _LANES)))))  # at most two a task
    power = [F.coalesce(F.col(f"w{k}"), F.lit(1)) for k in _LANES]
    whole = [((F.coalesce(F.col(f"s{k}"), F.lit(0)) + power[k] * F.col(f"c{k}")) % primes[k]).alias(f"c{k}") for k in _LANES]
    terms = [(power[k] * F.col(f"t{k}") % primes[k]).alias(f"t{k}") for k in _LANES]
    x = rows.join(offsets, ["conv", "part"], "left")
    return x.select("conv", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), *whole, *terms, *(f"l{k}" for k in _LANES), "words")


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])


def rebuilt(turns: DataFrame, seed: int = 1, primes: tuple[int, ...] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, each with the hashes (a, b) of the prefix it ends and (pa, pb) of the one before; and (conv, length)."""
    at = bases(seed, primes)
    rows = _joined(cut(_hashed(turns, at, primes)), at, primes)
    lanes = [f"c{k}" for k in _LANES]
    one = F.struct("rank", *lanes, *(f"t{k}" for k in _LANES), *(f"l{k}" for k in _LANES), "words")
    held = rows.groupBy("conv").agg((F.max("rank") + 1).alias("n"), F.sort_array(F.collect_list(F.when(F.col("rank") < SHARED - 1, one))).alias("first"))
    own = held.select("*", (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    lent = held.select(F.col("conv").alias("base"), F.col("first").alias("lent"))
    plan = own.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(held.schema["first"].dataType)), F.lit(1), F.col("h").cast("int")))
    plan = plan.withColumn("m", F.size("lent").cast("long"))
    length = (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    last = lambda column, n, k: F.coalesce(F.get(F.col(column), n - 1)[f"c{k}"], F.lit(0))
    plan = cut(plan.select("conv", "h", "m", length, "lent", *(last("lent", F.col("m"), k).alias(f"a{k}") for k in _LANES), *(last("first", F.col("h"), k).alias(f"b{k}") for k in _LANES)))

    def numbered(x: DataFrame, depth: Column, hashes: list[Column], terms: list[Column]) -> DataFrame:
        x = x.select("conv", "length", depth.alias("depth"), *(h.alias(f"k{k}") for k, h in enumerate(hashes)), *(t.alias(f"u{k}") for k, t in enumerate(terms)), *(f"l{k}" for k in _LANES), "words")
        a, b = _packed([F.col(f"k{k}") for k in _LANES])
        pa_, pb = _packed([F.pmod(F.col(f"k{k}") - F.col(f"u{k}"), F.lit(primes[k])) for k in _LANES])
        return x.select("conv", "length", "depth", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), *(f"l{k}" for k in _LANES), "words")

    # own turns from h on follow m lent ones: their sum without the first h, moved by m - h places
    move = [F.element_at(F.array(*(F.lit(pow(at[k], -s, primes[k])) for s in range(SHARED))), (F.col("h") - F.col("m") + 1).cast("int")) for k in _LANES]
    after = rows.join(plan.drop("lent"), "conv").where("rank >= h")
    sums = [(F.col(f"a{k}") + move[k] * F.pmod(F.col(f"c{k}") - F.col(f"b{k}"), F.lit(primes[k])) % primes[k]) % primes[k] for k in _LANES]
    kept = numbered(after, F.col("m") + F.col("rank") - F.col("h") + 1, sums, [move[k] * F.col(f"t{k}") % primes[k] for k in _LANES])
    taken = plan.select("conv", "length", F.explode("lent").alias("x")).select("conv", "length", "x.*")
    taken = numbered(taken, F.col("rank") + 1, [F.col(c) for c in lanes], [F.col(f"t{k}") for k in _LANES])
    return cut(kept.unionAll(taken)), plan.select("conv", "length")


@dataclass(frozen=True)
class Louds:
    """A level-order trie: for the root above all others, then each node in level order, a 1 for every child and a 0."""

    bits: np.ndarray  # packed, eight to a byte
    labels: np.ndarray  # (nodes, 4): the SHA-256 of each node's last turn
    starts: np.ndarray  # the first node of each level, and their number

    @classmethod
    def of(cls, parent: np.ndarray, level: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of nodes given by their parents' rows (-1 at level 0), and the rows in level order."""
        n = len(parent)
        rows = np.argsort(level, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(level))])
        number = np.zeros(n + 1, dtype=np.int64)  # of each row, from 1; the last one is the root above
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            here = rows[low:high]
            if high - low > 1:
                here = here[np.lexsort((*labels[here].T[::-1], number[parent[here]]))]
                rows[low:high] = here
            number[here] = np.arange(low + 1, high + 1)
        kids = np.bincount(number[parent], minlength=n + 1)
        bits = np.ones(2 * n + 1, dtype=np.uint8)
        bits[np.cumsum(kids) + np.arange(n + 1)] = 0
        return cls(np.packbits(bits), labels[rows], starts), rows

    def _unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * len(self.labels) + 1)

    def parents(self) -> np.ndarray:
        """Number of each node's parent, 0 for the root above: the zeros before the node's 1."""
        ones = np.flatnonzero(self._unpacked())
        return ones - np.arange(len(ones))

    def children(self) -> np.ndarray:
        """Number of children of each node."""
        return np.diff(np.flatnonzero(self._unpacked() == 0)) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values, one row a node, over each subtree."""
        out, parents = values.copy(), self.parents() - 1
        for low, high in zip(self.starts[-2:0:-1].tolist(), self.starts[:1:-1].tolist(), strict=True):
            np.add.at(out, parents[low:high], out[low:high])
        return out


_SHARD = ["sa", "sb", "a", "b", "pa", "pb", *(f"l{k}" for k in _LANES), "conv", "depth", "n", "words", "tails"]
_STATS = ["a", "b", "pa", "pb", "conv", "depth", "n", "top", "children", "leaves", "saved"]


def _forest(t: pa.Table) -> pa.RecordBatch:
    """Fields of the nodes of whole shards, sorted by shard and depth."""
    x = {c: t.column(c).to_numpy() for c in _SHARD}
    n = len(x["a"])
    both = np.stack([np.concatenate([x["a"], x["pa"]]), np.concatenate([x["b"], x["pb"]])], axis=1)
    _, name = np.unique(both, axis=0, return_inverse=True)
    name = name.ravel()
    row = np.full(2 * n, -1)
    row[name[:n]] = np.arange(n)
    parent = row[name[n:]]
    top = (x["a"] == x["sa"]) & (x["b"] == x["sb"])
    parent[top] = -1
    level = x["depth"] - x["depth"][np.flatnonzero(top)][np.cumsum(top) - 1]
    trie, rows = Louds.of(parent, level, np.stack([x[f"l{k}"] for k in _LANES], axis=1))
    children = trie.children() + x["tails"][rows]
    leaves = x["tails"][rows] + (children == 0)
    sums = trie.sums(np.stack([leaves, (x["n"][rows] - 1) * x["words"][rows]], axis=1))
    out = {c: x[c][rows] for c in _STATS[:7]} | {"top": top[rows], "children": children, "leaves": sums[:, 0], "saved": sums[:, 1]}
    return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in _STATS], names=_STATS)


def _tries(shards: DataFrame, limit: int) -> DataFrame:
    """shards: the nodes of all shards.  Their fields, by tries of about ``limit`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > limit:
                t = pa.Table.from_batches(held).combine_chunks()
                a, b = t.column("sa").to_numpy(), t.column("sb").to_numpy()
                edges = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
                if len(edges):
                    yield _forest(t.slice(0, edges[-1]))
                    t = t.slice(edges[-1])
                held, size = t.to_batches(), t.num_rows
        if held:
            yield _forest(pa.Table.from_batches(held))

    whole = shards.select(*_SHARD).repartition("sa", "sb").sortWithinPartitions("sa", "sb", "depth")
    return whole.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in _STATS))


def _digests(ends: DataFrame) -> DataFrame:
    """ends: (a, b, conv).  (a, b, ends_sha256) with the SHA-256 of each group's ids, ascending, joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(c).to_numpy() for c in ("a", "b", "conv"))
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, dtype=bool)
            first = np.flatnonzero(new)
            place = np.arange(len(a)) - first[np.cumsum(new) - 1] if len(a) else first
            at = np.flatnonzero(place % _RUN == 0)
            texts = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(a)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array(texts, pa.string())], names=["a", "b", "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if key == group:
                    state.update(b"," + ids.encode())
                    continue
                if group:
                    done.append((*group, state.hexdigest()))
                group, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*done, strict=True))], names=["a", "b", "ends_sha256"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*group, state.hexdigest())], names=["a", "b", "ends_sha256"])

    joined = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(runs, "a long, b long, conv long, ids string")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "conv").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _nodes(steps: DataFrame) -> DataFrame:
    """The prefixes: members, owner, words of the last turn, turns at or below, and whether all members agree."""
    same = ["depth", "pa", "pb", *(f"l{k}" for k in _LANES)]
    agreed = F.lit(True)
    for c in same:
        agreed &= F.col(c) == F.col(f"max_{c}")
    of = steps.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("words").alias("words"), F.max("length").alias("length"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"max_{c}") for c in same),
    )
    return of.withColumn("agreed", agreed).drop(*(f"max_{c}" for c in same))


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, label, words) of the rows with a conversation id; the label is the SHA-256 of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    label = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), label.alias("label"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"))


def trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, seed = turns_of(df, conv_col, turn_col, role_col, text_col), 1
    while True:
        steps, convs = rebuilt(turns, seed, primes)
        nodes = cut(_nodes(steps))
        if not nodes.where(~F.col("agreed")).limit(1).count():
            break
        seed, primes = seed + 1, PRIMES
    key, null = ["a", "b"], F.lit(None).cast("long")
    keys = lambda df: df.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    members = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    root = members.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), null.alias("pa"), null.alias("pb"), "conv", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("words"))
    shared = nodes.where("n > 1")
    tails = nodes.where("n = 1")
    heavy = shared.where(F.col("weight") > limit).select(*root.columns).unionAll(root)
    light = shared.where(F.col("weight") <= limit)
    owners = shared.select(*key, "conv").unionAll(root.select(*key, "conv"))
    single = tails.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("tails"))

    tops = light.join(keys(heavy), ["pa", "pb"], "left_semi").select(*key, F.col("a").alias("sa"), F.col("b").alias("sb"))
    entry = steps.join(tops, key).select("conv", "sa", "sb")  # a conversation enters one shard at most
    shards = light.join(entry, "conv").join(single, key, "left").withColumn("tails", F.coalesce("tails", F.lit(0)))
    below = cut(_tries(shards, limit))

    zero = F.lit(0).cast("long")
    upper = below.where("top").select("pa", "pb", "conv", "depth", "leaves", "saved")
    kids = upper.select("pa", "pb").unionAll(heavy.select("pa", "pb")).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    top = heavy.join(kids, key, "left").join(single, key, "left").withColumn("children", F.coalesce("kids", zero) + F.coalesce("tails", zero))
    top = cut(top.withColumns({"leaves": F.coalesce("tails", zero) + (F.col("children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")}))
    values = upper.select("conv", "depth", null.alias("a"), null.alias("b"), "leaves", "saved").unionAll(top.select("conv", "depth", null, null, "leaves", "saved"))
    owning = values.select("conv").distinct()
    along = steps.join(owning, "conv", "left_semi").join(heavy.select(*key), key).select("conv", "depth", "a", "b", zero.alias("leaves"), zero.alias("saved"))
    along = along.unionAll(owning.select("conv", zero, zero, zero, zero, zero))
    down = Window.partitionBy("conv").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = values.unionAll(along).select(*key, F.sum("leaves").over(down).alias("leaves"), F.sum("saved").over(down).alias("saved")).where(F.col("a").isNotNull())
    summed = summed.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = top.drop("leaves", "saved").join(summed, key)

    stats = ["a", "b", "pa", "pb", "conv", "depth", "n", "children", "leaves", "saved"]
    ending = steps.where(F.col("depth") == F.col("length")).join(shared.select(*key), key, "left_semi").select(*key, "conv")
    digests = _digests(ending.unionAll(convs.where("length = 0").select(zero, zero, "conv")))
    parent = owners.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    nothing = F.sha2(F.lit(""), 256)
    many = below.select(*stats).unionAll(above.select(*stats)).join(parent, ["pa", "pb"], "left").join(digests, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    few = tails.join(parent, ["pa", "pb"], "left").select(
        "conv", "depth", F.coalesce("parent", "conv").alias("parent"), "n", F.when(last, zero).otherwise(one).alias("children"), one.alias("leaves"), zero.alias("saved"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    names = {"conv": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends_sha256": "ends_sha256"}
    return many.select(*names).unionAll(few.select(*names)).toDF(*names.values())


#: The same over prefixes joined with each other; crc32 bit by bit.
ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS label,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, label) - 1 AS rank FROM t),
convs AS (
  SELECT DISTINCT c, c - c % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
      lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM t),
turns AS (
  SELECT v.c, 0 AS part, rank, label, words FROM convs v JOIN r ON r.c = v.base AND rank < h
  UNION ALL
  SELECT v.c, 1, rank, label, words FROM convs v JOIN r ON r.c = v.c AND rank >= h),
steps AS (
  SELECT c, row_number() OVER w AS depth, words, md5(string_agg(label, ',') OVER w) AS k FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, rank)),
p AS (
  SELECT c, depth, words, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY depth), 'root') AS up FROM steps
  UNION ALL
  SELECT c, 0, 0, 'root', NULL FROM convs),
n AS (
  SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(c) AS c, count(*) AS n, any_value(words) AS words FROM p GROUP BY k),
kids AS (
  SELECT up AS k, count(*) AS kids FROM n GROUP BY up),
inside AS (
  SELECT DISTINCT x.k AS top, y.k FROM p x JOIN p y ON x.c = y.c AND y.depth >= x.depth),
sums AS (
  SELECT top AS k, count(*) FILTER (kids.k IS NULL) AS leaves, sum((n.n - 1) * n.words) AS saved FROM inside JOIN n USING (k) LEFT JOIN kids USING (k) GROUP BY top),
ends AS (
  SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, depth) AS k FROM p GROUP BY c) GROUP BY k)
SELECT n.c AS conv_id, CAST(n.depth AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN n u ON u.k = n.up
"""
