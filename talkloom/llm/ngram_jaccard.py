"""Exact Jaccard join of word-shingle sets over a count-vector R-tree.

Two documents link when 100 x |A & B| >= percent x |A | B| for their sets of
distinct n-word shingles.  The steps:

1. Each text gives its set's size, a digest of its words (texts with equal words
   are one class), its counts of shingles per hash group, and, for the shingles
   that several texts held at once share, their number; summed over all these
   name the frequent shingles.  At most ``FREQUENT`` of them are broadcast; they
   only steer the order below.
2. Blocking: sets that reach the threshold share one of the first
   n - ceil(n x percent / 100) + 1 shingles in any common order.  The order is
   infrequent shingles by hash, then frequent ones from rare to common, so
   common passages head a block only for texts that consist of them.  The
   entries travel packed, and those no other set shares are dropped at once.
3. Every set proposes the earlier set with which it shares most entries, then,
   where its blocks still span several components, the closest set by the
   bound below; proposals are verified and contracted.
4. Search: sets are points whose coordinates count the shingles of each hash
   group.  The overlap of two sets is at most the sum of the coordinate minima.
   Blocks of more than ``SMALL`` sets bulk-load an R-tree whose nodes keep the
   coordinate maxima and the sizes below them, and descend only where the bound
   allows; blocks of up to ``SMALL`` sets have their few pairs tested by the same
   bound.  Neighbouring shingles of one passage make blocks of the same sets: one
   of them is searched.  A block is cut by size into slices of ``SLICE`` sets, and
   a slice queries the trees of the slices whose sizes can fit, unless both lie
   in the block's largest component of step 3.  Connected pairs are left out, and
   a pair that several blocks have is searched in the first of them: a set brings
   the names of its first ``MARKS`` blocks, and trees descend only to pairs
   without an earlier name in common, so sets that share many blocks are not
   found once in each; names beyond those could only repeat a pair.  Sets without
   a partner left in a unit are dropped before coordinates travel.  The
   entries of a shingle that ``HOT_ENTRIES`` sets share are dealt over several
   buckets, whose slices make one block and whose first sets propose each other.
5. The search for the closest sets of step 3 shows which sets of a unit have a pair
   within the bound at all.  Those bring their words to the unit once more, where
   pairs of components still apart are compared, closest first, until no pair is
   left; only the links that joined two components leave the unit.  Links are
   joined to components.

Nothing is capped or sampled.  A group of near copies costs a proposal per
member, not its square, because connected pairs are not searched again, and a
unit gives fewer rows than it has sets, even where two large parts of a group
are linked by nearly all pairs.  Texts are read again only where one set of a
pair within the bound is theirs.  A slice has at most ``SLICE_SHINGLES`` shingles,
so long texts make no large unit.

Words are hashed with a key drawn for each run.  Set sizes are those of the words:
every worker compares the words that share a hash, and the five words of the
shingles of a text that do; where one hash stands for two, another key is drawn.
Between texts a shared hash only adds candidates, whose words are compared.
Classes go by half of a 128-bit BLAKE2 of the words, or by the other half where
texts with different words share the first.

Null and empty texts have size 0 and are alone.  A text with fewer than n words
has its whole sequence as its one shingle.  Repeated rows and equal texts share
a component.  A null id sorts below all others and shows as null; an id that is
no whole number raises an error.  Ties between proposals go to the larger
digest, which changes no component.  An empty table gives an empty result.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm import _text
from talkloom.llm._spark import batches_of, cut, packed_id, unpacked_id
from talkloom.llm.components import components, forest_roots

U64 = np.uint64
#: Frequent shingles that are broadcast at most (16 bytes each).
FREQUENT = 200_000
#: Coordinates of a point at least, and at most (for large sets, half as many as shingles).
GROUPS, MOST_GROUPS = 256, 4096
#: Largest block whose pairs are tested one by one; sets of a block in one slice.
SMALL = 4
SLICE = 1024
#: Shingles of a slice at most, unless one set has more.
SLICE_SHINGLES = 500_000
NODE = 16
#: Names of blocks that a set brings to a search.
MARKS = 64
#: A shingle that so many sets have among their entries, or more, is dealt over several buckets.
HOT_ENTRIES = 200_000
#: Entries in a block bucket, about; buckets are at least MIN_BUCKETS.
BUCKET_ENTRIES = 250_000
MIN_BUCKETS = 64
BLOOM_WORDS = 1 << 20
#: Shingles that a worker holds at once to find those that several texts share; rows it gets at once.
PROFILE_SHINGLES = 1_000_000
BATCH_ROWS = 1024
#: Pairs that a worker gets at once with both sets.
PAIR_ROWS = 256
VERIFY_BYTES = 1 << 20


def _digests(words: bytes) -> tuple[int, int]:
    """Two halves of a 128-bit digest of a text's words."""
    raw = hashlib.blake2b(words, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _key(words: bytes, split: frozenset[int]) -> int:
    """The class of a text; ``split`` has the first halves that unequal texts share."""
    key, twin = _digests(words)
    return twin if key in split else key


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of the texts of a batch, slice by slice."""
    for _, _, texts in _text.slices(batch.column("text")):
        yield [_text.words_of(t) for t in texts]
    _text.give_back()


@dataclass(frozen=True)
class Hashing:
    """How shingles are hashed: words of each, a key, and the bits that are kept of a word's hash."""

    size: int
    seed: int
    bits: int = 64

    def sets(self, words: list[bytes], across: bool = False, known: bool = False) -> tuple[list[np.ndarray], bool]:
        return _text.shingle_sets(words, self.size, self.seed, self.bits, across, known)


def _coordinates(s: np.ndarray) -> bytes:
    """Shingles per hash group, in the narrowest type that holds them, after the binary logarithm of their number."""
    groups = GROUPS
    while groups < MOST_GROUPS and 2 * groups < len(s):
        groups *= 2
    c = np.bincount((s >> U64(50)).astype(np.int64) % groups, minlength=groups)
    return bytes([groups.bit_length() - 1]) + c.astype(np.uint8 if c.max() < 256 else np.uint16 if c.max() < 65536 else np.uint32).tobytes()


def _point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"u{(len(raw) - 1) >> raw[0]}", offset=1)


def _fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.uint32) if len(point) > groups else point


def _matrix(points: list[np.ndarray]) -> np.ndarray:
    return np.stack([_fold(p, GROUPS).astype(np.uint32) for p in points]) if points else np.zeros((0, GROUPS), dtype=np.uint32)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of coordinate minima, over the finest groups that both points have."""
    groups = min(len(x), len(y))
    return int(np.minimum(_fold(x, groups), _fold(y, groups)).sum(dtype=np.int64))


def _repeated(distinct: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, times) of shingles that several of these sets have."""
    every = np.sort(np.concatenate([*distinct.values()])) if distinct else np.zeros(0, dtype=U64)
    first, times = _groups(every)
    many = times > 1
    if many.any():
        h = every[first[many]].view(np.int64)
        blank = pa.nulls(len(h), pa.int64())
        yield pa.RecordBatch.from_pydict({"rid": blank, "th": blank, "n": blank, "key": blank, "twin": blank, "counts": pa.nulls(len(h), pa.binary()), "exact": pa.nulls(len(h), pa.bool_()), "shingle": pa.array(h), "times": pa.array(times[many].astype(np.int64))})


def _profile(hashing: Hashing):
    """Rows (rid, th, n, key, twin, counts, exact) of documents; rows (shingle, times) of shingles that several sets held at once have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, known, held = {}, {}, 0
        for batch in batches:
            rows = []
            for texts in _texts(batch):
                if held > PROFILE_SHINGLES:
                    yield from _repeated(distinct)
                    distinct, known, held = {}, {}, 0
                digests = [_digests(t) for t in texts]
                new = {d: t for d, t in zip(digests, texts, strict=True) if d not in known}
                sets, exact = hashing.sets(list(new.values()))
                for d, s in zip(new, sets, strict=True):
                    known[d] = (len(s), *(d if len(s) else (0, 0)), _coordinates(s), exact)
                    if len(s):
                        distinct[d] = s
                        held += len(s) + GROUPS // 8
                rows += [known[d] for d in digests]
            n, keys, twins, counts, exact = zip(*rows, strict=True) if rows else ((),) * 5
            blank = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "th": batch.column("th"), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.int64()), "twin": pa.array(twins, pa.int64()), "counts": pa.array(counts, pa.binary()), "exact": pa.array(exact, pa.bool_()), "shingle": blank, "times": blank})
        yield from _repeated(distinct)

    return run


def _frequent(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) and their numbers, the most frequent FREQUENT at most."""
    times = cut(profile.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")))
    levels = times.groupBy(F.floor(F.log2("times") * 4).cast("int").alias("level")).agg(F.count("*").alias("n"), F.min("times").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    rows = times.where(F.col("times") >= least).toPandas()
    h, t = rows["shingle"].to_numpy(dtype=np.int64).view(U64), rows["times"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], t[order]


def _prefix(s: np.ndarray, percent: int, hot: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The entries of a sorted set: its first shingles in the common order."""
    keep = len(s) - (-(-len(s) * percent // 100)) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        if is_hot.any():
            h = s[is_hot]
            h = h[np.lexsort((h, times[at[is_hot]]))]
            s = np.concatenate((s[~is_hot], h))
    return s[:keep]


def _pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with each column's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, dtype=int)
    data = {"bucket": pa.array(bucket[cuts[:-1]].astype(np.int32))}
    for k, c in enumerate(columns):
        c = c[order]
        data[f"c{k}"] = pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(data)


@dataclass(frozen=True)
class Buckets:
    """Where entries go: by shingle, and those of hot shingles (sorted) by shingle and set."""

    plain: int
    hot: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, entries: int, hot: np.ndarray, times: np.ndarray) -> Buckets:
        many = times >= HOT_ENTRIES
        return cls(max(MIN_BUCKETS, -(-entries // BUCKET_ENTRIES)), hot[many], -(-times[many] // HOT_ENTRIES) + 1)

    def number(self, shingles: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = (shingles % U64(self.plain)).astype(np.int32)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, shingles), len(self.hot) - 1)
            on = self.hot[at] == shingles
            first = np.cumsum(self.parts) - self.parts
            out[on] = self.plain + first[at[on]] + (_text.mix(keys[on].view(U64)) % self.parts[at[on]].astype(U64)).astype(np.int64)
        return out


def _entries(hashing: Hashing, percent: int, buckets: Buckets, hot: np.ndarray, times: np.ndarray, split: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            h, keys, sizes, lengths = [], [], [], []
            for texts in _texts(batch):
                new = {key: t for t in texts if t and (key := _key(t, split)) not in done}
                done.update(new)
                for key, s in zip(new, hashing.sets(list(new.values()), known=True)[0], strict=True):
                    h.append(_prefix(s, percent, hot, times))
                    keys.append(key)
                    sizes.append(len(s))
                    lengths.append(len(h[-1]))
            if h:
                every, each = np.concatenate(h), np.repeat(np.array(keys, dtype=np.int64), lengths)
                yield _pack(buckets.number(every, each), every, each, np.repeat(np.array(sizes, dtype=np.int32), lengths))

    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(h)))


def _shared(plain: int):
    """A bucket's entries, sorted, without repetitions and, where the bucket has all of a shingle, without those of a single set."""

    def run(table: pa.Table) -> pa.Table:
        out = _shared_of(table, table.column("bucket")[0].as_py() < plain)
        _text.give_back()
        return out

    return run


def _shared_of(table: pa.Table, whole: bool) -> pa.Table:
    h, key, n = _column(table, "c0", U64), _column(table, "c1", np.int64), _column(table, "c2", np.int32)
    order = np.lexsort((key, h))
    h, key, n = h[order], key[order], n[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    h, key, n = h[new], key[new], n[new]
    first, length = _groups(h)
    kept = np.repeat((length > 1) | (not whole), length)
    row = {"bucket": table.column("bucket")[:1], "c0": [h[kept].tobytes()], "c1": [key[kept].tobytes()], "c2": [n[kept].tobytes()]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary()), ("c2", pa.binary())]))


def _compatible(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na, nb).astype(np.int64) >= percent * np.maximum(na, nb).astype(np.int64)


def _proposals(percent: int):
    """Pairs a < b with the number of shared entries: all pairs of small groups, and each member with the first one of large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, key, n = (np.frombuffer(r[c], dtype=t) for c, t in (("c0", U64), ("c1", np.int64), ("c2", np.int32)))
                first, length = _groups(h)
                for small in (True, False):
                    left, right = [], []
                    if small:
                        for step in range(1, SMALL):
                            for place in range(SMALL - step):
                                g = first[(length <= SMALL) & (length > place + step)]
                                left.append(g + place)
                                right.append(g + place + step)
                    else:
                        big = np.repeat(length > SMALL, length)
                        lead = np.repeat(first, length)
                        at = np.flatnonzero(big & (lead != np.arange(len(h))))
                        left.append(lead[at])
                        right.append(at)
                    a, b = np.concatenate(left), np.concatenate(right)
                    ok = _compatible(n[a], n[b], percent)
                    a, b = key[a[ok]], key[b[ok]]
                    if not len(a):
                        continue
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                    times = np.diff(np.append(new, len(a)))
                    yield pa.RecordBatch.from_pydict({"a": a[new], "b": b[new], "times": times.astype(np.int64), "small": pa.array(np.full(len(new), small))})

    return run


def _bloom(marks: DataFrame) -> np.ndarray:
    """Bits of the values in the one column of marks, hashes themselves; a filled filter only lets more through."""
    word = F.pmod(F.shiftrightunsigned("mark", 6), F.lit(BLOOM_WORDS)).alias("word")
    rows = marks.toDF("mark").groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(mark & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(BLOOM_WORDS, dtype=U64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(U64)
    return out


def _through(bloom: np.ndarray, column: str):
    """The rows whose mark the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(column).to_numpy().view(U64)
            yield batch.filter(pa.array((bloom[(u >> U64(6)) % U64(BLOOM_WORDS)] >> (u & U64(63)) & U64(1)).astype(bool)))

    return run


def _kept_texts(bloom: np.ndarray, split: frozenset[int]):
    """Rows (key, words) of the texts whose mark the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in _through(bloom, "mark")(batches):
            for texts in _texts(batch):
                new = {key: t for t in texts if t and (key := _key(t, split)) not in done}
                done.update(new)
                yield pa.RecordBatch.from_pydict({"key": pa.array(list(new), pa.int64()), "words": pa.array(list(new.values()), pa.binary())})

    return run


def _least_overlap(na, nb, percent: int):
    """100 x overlap >= percent x union means overlap >= percent x (na + nb) / (100 + percent)."""
    return percent * (na.astype(np.int64) + nb) / (100 + percent)


def _exact_sets(texts: list[bytes], hashing: Hashing) -> list[np.ndarray]:
    """The sets of different texts, such that equal values are equal shingles; where a hash stands for different words, the words themselves are numbered."""
    sets, exact = hashing.sets(texts, across=True)
    if exact:
        return sets
    ids: dict[tuple[bytes, ...], int] = {}
    shingles = ([tuple(w[i : i + hashing.size]) for i in range(max(1, len(w) - hashing.size + 1))] for w in (t.split(b" ") for t in texts))
    return [np.unique([ids.setdefault(x, len(ids)) for x in of]) for of in shingles]


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _overlaps(pairs: list[tuple[bytes, bytes]], hashing: Hashing) -> list[tuple[int, int, int]]:
    """Sizes and overlap of the sets of each pair of texts."""
    texts = [*dict.fromkeys(t for pair in pairs for t in pair)]
    of = dict(zip(texts, _exact_sets(texts, hashing), strict=True))
    return [(len(of[x]), len(of[y]), _overlap(of[x], of[y])) for x, y in pairs]


def _verify(percent: int, hashing: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, held, size = [], [], 0
            for pair in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                held.append(pair)
                size += len(pair[0]) + len(pair[1])
                if size >= VERIFY_BYTES:
                    linked += [100 * both >= percent * (p + q - both) for p, q, both in _overlaps(held, hashing)]
                    held, size = [], 0
            linked += [100 * both >= percent * (p + q - both) for p, q, both in _overlaps(held, hashing)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(linked, pa.bool_()))
        _text.give_back()

    return run


def _within_bound(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, whole.num_rows, 1024)):
            near = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = _point(p), _point(q)
                near.append(overlap_bound(x, y) >= _least_overlap(x.sum(dtype=np.int64), y.sum(dtype=np.int64), percent))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(near, pa.bool_()))

    return run


def _attach(pairs: DataFrame, points: DataFrame, column: str) -> DataFrame:
    left = points.select(F.col("key").alias("ka"), F.col(column).alias("x"))
    right = points.select(F.col("key").alias("kb"), F.col(column).alias("y"))
    return pairs.join(left, F.col("a") == F.col("ka")).select("a", "b", "x").join(right, F.col("b") == F.col("kb")).select("a", "b", "x", "y")


@dataclass
class Corpus:
    """What the steps share: base (rid, mark, text), docs (rid, th, n, key), one rid for each key, and coordinates of the keys in question."""

    base: DataFrame
    docs: DataFrame
    split: frozenset[int]
    hashing: Hashing
    percent: int
    points: DataFrame | None = None

    def texts_of(self, keys: DataFrame) -> np.ndarray:
        """A filter of the marks of one text for each key."""
        first = self.docs.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"))
        return _bloom(first.join(keys.distinct(), "key", "left_semi").select(F.xxhash64("rid")))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the bound allows."""
        return cut(_attach(pairs, self.points, "counts").mapInArrow(_within_bound(self.percent), "a long, b long"))

    def words(self, pairs: DataFrame) -> DataFrame:
        """Rows (key, words) with all sets of the pairs; few others may be among them."""
        wanted = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")))
        return self.base.mapInArrow(_kept_texts(wanted, self.split), "key long, words binary").dropDuplicates(["key"])

    def verified(self, pairs: DataFrame, words: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by the words of their sets."""
        with batches_of(pairs.sparkSession, PAIR_ROWS):
            return cut(_attach(pairs, words, "words").mapInArrow(_verify(self.percent, self.hashing), "a long, b long"))


class CountRTree:
    """A static R-tree over count vectors, packed by size and coordinates; searched level by level for many queries at once."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = max(NODE, int(len(sizes) ** 0.5) // NODE * NODE)
        by_size = np.argsort(sizes, kind="stable")
        spread = points.astype(np.float64) / np.maximum(1, sizes)[:, None]
        axis = spread.var(axis=0).argmax()
        self.order = np.concatenate([s[np.argsort(spread[s, axis], kind="stable")] for s in (by_size[i : i + slab] for i in range(0, len(sizes), slab))])
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(low) > NODE:
            at = np.arange(0, len(low), NODE)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) that the bound allows; of those in ``asked`` (a row a query, a column a point) if given."""
        last = len(self.levels) - 1
        if asked is not None:
            below = [asked[:, self.order]]
            for _, low, _ in self.levels[:-1]:
                below.append(np.logical_or.reduceat(below[-1], np.arange(0, len(low), NODE), axis=1))
        q = np.repeat(np.arange(len(sizes)), len(self.levels[last][1]))
        node = np.tile(np.arange(len(self.levels[last][1])), len(sizes))
        for level in range(last, -1, -1):
            top, low, high = self.levels[level]
            fits = (100 * high[node].astype(np.int64) >= percent * sizes[q].astype(np.int64)) & (100 * sizes[q].astype(np.int64) >= percent * low[node].astype(np.int64))
            if asked is not None:
                fits &= below[level][q, node]
            q, node = q[fits], node[fits]
            ok = np.zeros(len(q), dtype=bool)
            for i in range(0, len(q), 1 << 12):
                j = slice(i, i + (1 << 12))
                least = np.maximum(low[node[j]], -(-percent * sizes[q[j]].astype(np.int64) // 100))
                ok[j] = np.minimum(points[q[j]], top[node[j]]).sum(axis=1, dtype=np.int64) >= _least_overlap(sizes[q[j]], least, percent)
            q, node = q[ok], node[ok]
            if level:
                width = len(self.levels[level - 1][1])
                q = np.repeat(q, NODE)
                node = (node[:, None] * NODE + np.arange(NODE)).ravel()
                inside = node < width
                q, node = q[inside], node[inside]
        return q, self.order[node]


def _first_met(label: np.ndarray, marks: list[np.ndarray], asking: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of each asking and each held set: do their labels differ and have they no mark in common?  Of a set's own slice every pair once."""
    out = label[asking][:, None] != label[held]
    if len(asking) == len(held) and (asking == held).all():
        out = np.triu(out)
    places = []
    for of in (asking, held):
        place = np.full(len(label), -1)
        place[of] = np.arange(len(of))
        places.append(place)
    owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    every = np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64)
    order = np.argsort(every, kind="stable")
    for first, length in zip(*_groups(every[order]), strict=True):
        if length > 1:
            who = owner[order[first : first + length]]
            rows, columns = places[0][who], places[1][who]
            out[np.ix_(rows[rows >= 0], columns[columns >= 0])] = False
    return out


def _meeting(percent: int):
    """The rows of one unit whose sets have a partner in it: of another label and a size that fits, and not met in an earlier block."""

    def run(table: pa.Table) -> pa.Table:
        label, part, n = (table.column(c).to_numpy() for c in ("label", "part", "n"))
        held, asking = np.flatnonzero(part == 0), np.flatnonzero(part == part.max())
        asked = _first_met(label, [np.array(m, dtype=np.int64) for m in table.column("marks").to_pylist()], asking, held)
        asked &= _compatible(n[asking][:, None], n[held], percent)
        meets = np.zeros(len(label), dtype=bool)
        meets[asking[asked.any(axis=1)]] = True
        meets[held[asked.any(axis=0)]] = True
        marks = table.column("marks").cast(pa.list_(pa.field("element", pa.int64())))
        return table.select(["unit", "part", "name", "key", "label"]).append_column("marks", marks).filter(pa.array(meets))

    return run


def _candidates(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x and y of the pairs of one unit whose labels differ, that the bound allows and that no earlier block has, and the bound by both sizes."""
    label, part = (table.column(c).to_numpy() for c in ("label", "part"))
    held, asking = np.flatnonzero(part == 0), np.flatnonzero(part == part.max())
    asked = _first_met(label, [np.array(m, dtype=np.int64) for m in table.column("marks").to_pylist()], asking, held)
    left, right, ratios = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    if asked.any():
        some, other = asked.any(axis=1), asked.any(axis=0)
        asked, asking, held = asked[np.ix_(some, other)], asking[some], held[other]
        points = [_point(r) for r in table.column("counts").to_pylist()]
        matrix, fine = _matrix(points), np.array([len(p) > GROUPS for p in points])
        n = matrix.sum(axis=1, dtype=np.int64)
        tree = CountRTree(matrix[held], n[held])
        for low in range(0, len(asking), 512):
            q = asking[low : low + 512]
            i, j = tree.search(matrix[q], n[q], percent, asked[low : low + 512])
            i, j = q[i], held[j]
            for at in range(0, len(i), 1 << 12):
                x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
                bound = np.minimum(matrix[x], matrix[y]).sum(axis=1, dtype=np.int64)
                for k in np.flatnonzero(fine[x] & fine[y]).tolist():
                    bound[k] = overlap_bound(points[x[k]], points[y[k]])
                ok = bound >= _least_overlap(n[x], n[y], percent)
                left.append(x[ok])
                right.append(y[ok])
                ratios.append(bound[ok] / (n[x[ok]] + n[y[ok]]))
    return np.concatenate(left), np.concatenate(right), np.concatenate(ratios)


def _search(percent: int, best: bool):
    """Pairs a < b of one unit's candidates; with ``best`` each set's closest only, as (unit, the set, that one)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key = table.column("key").to_numpy()
        x, y, r = _candidates(table, percent)
        found = np.stack((np.minimum(key[x], key[y]), np.maximum(key[x], key[y])), axis=1)
        if len(key) > SLICE // 2:
            _text.give_back()
        if not best:
            found = np.unique(found, axis=0)
            return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy(), "ratio": np.zeros(len(found))})
        both, r = np.concatenate((found, found[:, ::-1])), np.concatenate((r, r))
        top = np.lexsort((both[:, 1], -r, both[:, 0]))
        both, r = both[top], r[top]
        one = np.concatenate(([True], both[1:, 0] != both[:-1, 0])) if len(both) else np.zeros(0, dtype=bool)
        return pa.table({"unit": pa.array([table.column("unit")[0].as_py()] * int(one.sum()), pa.binary()), "a": both[one, 0].copy(), "b": both[one, 1].copy(), "ratio": r[one]})

    return run


def _joining(percent: int, hashing: Hashing):
    """Links a < b that join what can be joined of one unit's labels: a forest, by the words of the candidates, closest first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, label = table.column("key").to_numpy(), table.column("label").to_numpy()
        x, y, r = _candidates(table, percent)
        order = np.argsort(-r, kind="stable")
        x, y, a, b = x[order], y[order], [], []
        root = np.unique(label, return_inverse=True)[1]
        if len(x):
            some, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            sets = _exact_sets(table.column("words").take(pa.array(some)).to_pylist(), hashing)
            x, y, root, key = at[: len(x)], at[len(x) :], root[some], key[some]
        while len(x):
            for p, q in zip(x[:256].tolist(), y[:256].tolist(), strict=True):
                if root[p] != root[q]:
                    both = _overlap(sets[p], sets[q])
                    if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                        a.append(min(key[p], key[q]))
                        b.append(max(key[p], key[q]))
                        root[root == root[q]] = root[p]
            x, y = x[256:], y[256:]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
        if table.num_rows > SLICE // 2 or table.nbytes > VERIFY_BYTES:
            _text.give_back()
        return pa.table({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def _leads(plain: int):
    """The first set of each part of a hot shingle: (h, key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] >= plain:
                    h, key, n = (np.frombuffer(r[c], dtype=t) for c, t in (("c0", U64), ("c1", np.int64), ("c2", np.int32)))
                    first, _ = _groups(h)
                    yield pa.RecordBatch.from_pydict({"h": h[first].view(np.int64), "key": key[first], "n": n[first].astype(np.int64)})

    return run


def _cuts(sizes: np.ndarray, width: int) -> list[int]:
    """Where slices of sets of these sizes begin, and the end: of at most ``width`` sets and, unless a set alone has more, SLICE_SHINGLES shingles."""
    ends, out = np.cumsum(sizes, dtype=np.int64), [0]
    while out[-1] < len(sizes):
        low = out[-1]
        most = int(np.searchsorted(ends, ends[low] - int(sizes[low]) + SLICE_SHINGLES, side="right"))
        out.append(max(low + 1, min(low + width, most, len(sizes))))
    return out


def _slices(plain: int, width: int = SLICE):
    """The blocks of more than SMALL sets in slices of up to ``width``, by size: (block, slice, members, least and most of their sizes).

    A block is named by a digest of its members, that of a hot shingle by the shingle; its parts have slices of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, key, n = (np.frombuffer(r[c], dtype=t) for c, t in (("c0", U64), ("c1", np.int64), ("c2", np.int32)))
                first, length = _groups(h)
                whole, seen, rows = r["bucket"] < plain, set(), []
                for a, m in zip(first.tolist(), length.tolist(), strict=True):
                    if whole and m <= SMALL:
                        continue
                    order = np.lexsort((key[a : a + m], n[a : a + m]))
                    members, sizes = key[a : a + m][order], n[a : a + m][order]
                    block = hashlib.blake2b(members.tobytes(), digest_size=16).digest() if whole else h[a : a + 1].tobytes()
                    if block in seen:
                        continue
                    seen.add(block)
                    part = 0 if whole else r["bucket"] << 32
                    rows += [(block, part + i, members[i:j].tobytes(), int(sizes[i]), int(sizes[j - 1])) for i, j in pairwise(_cuts(sizes, width))]
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "slice", "members", "low_n", "high_n"])

    return run


def _members(extra: tuple[str, ...]):
    """A row (key) for each member of a slice, with further columns of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("members").to_pylist()):
                key = np.frombuffer(raw, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(c)[i].as_py()] * len(key), batch.schema.field(c).type) for c in extra), pa.array(key)], names=[*extra, "key"])

    return run


def _units(slices: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Rows (unit, part, name, key): pairs of slices of a block, and slices with themselves, whose sizes can fit and that may hold sets of two components.

    Of each block all pairs but those of two slices that lie wholly in the block's largest component: so a block that is
    one component has none, and one with few strangers in it has the strangers' slices with all others.
    """
    each = _labelled(slices.mapInArrow(_members(("block", "slice")), "block binary, slice long, key long"), roots, "key", "label")
    of = cut(each.groupBy("block", "slice", "label").agg(F.count("*").alias("n")))
    top = of.groupBy("block", "label").agg(F.sum("n").alias("n")).groupBy("block").agg(F.max(F.struct("n", "label")).alias("t"), F.count("*").alias("labels")).where("labels > 1").select("block", F.col("t.label").alias("top"))
    kinds = of.groupBy("block", "slice").agg(F.min("label").alias("low"), F.max("label").alias("high")).join(top, "block")
    mixed = cut(slices.join(kinds, ["block", "slice"]).withColumn("name", F.xxhash64("block")).withColumn("own", (F.col("low") == F.col("high")) & (F.col("low") == F.col("top"))).drop("low", "high", "top"))
    a = mixed.where("NOT own").select("block", "name", F.col("slice").alias("a"), F.col("members").alias("a_members"), F.col("low_n").alias("a_low"), F.col("high_n").alias("a_high"))
    b = mixed.select("block", F.col("slice").alias("b"), F.col("members").alias("b_members"), F.col("low_n").alias("b_low"), F.col("high_n").alias("b_high"), "own")
    fits = (100 * F.col("a_high") >= percent * F.col("b_low")) & (100 * F.col("b_high") >= percent * F.col("a_low"))
    pairs = a.join(b, "block").where(fits & (F.col("own") | (F.col("a") <= F.col("b"))))
    unit = F.concat("block", F.encode(F.concat(F.lit(":"), F.col("a").cast("string"), F.lit(","), F.col("b").cast("string")), "utf-8"))
    pairs = pairs.select(unit.alias("unit"), "name", "a", "b", "a_members", "b_members")
    one = pairs.select("unit", F.lit(0).alias("part"), "name", F.col("a_members").alias("members"))
    two = pairs.where("a <> b").select("unit", F.lit(1).alias("part"), "name", F.col("b_members").alias("members"))
    return one.unionAll(two).mapInArrow(_members(("unit", "part", "name")), "unit binary, part int, name long, key long")


def _marks(units: DataFrame) -> DataFrame:
    """(key, marks): the first names of the blocks of each set.  Sets whose labels differ meet in a unit of every block that has both."""
    return units.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("name")), 1, MARKS).alias("marks"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has rid (the id, packed), th (xxhash64 of the text), n and key of its words; links has pairs a < b of keys that span the components."""
    rid = packed_id(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(rid.alias("rid"), F.xxhash64(rid).alias("mark"), text.alias("text"))
    while True:
        hashing = Hashing(size, secrets.randbits(64), bits)
        profile = cut(base.withColumn("th", F.xxhash64("text")).mapInArrow(_profile(hashing), "rid long, th long, n long, key long, twin long, counts binary, exact boolean, shingle long, times long"))
        if not profile.where(~F.col("exact")).limit(1).count():
            break
        bits = 64
    known = profile.where("n is not null")
    # texts with different words and one first half: some n * n / 2**65 of them
    split = [r["key"] for r in known.groupBy("key").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low <> high").select("key").collect()]
    known = known.withColumn("key", F.when(F.col("key").isin(split), F.col("twin")).otherwise(F.col("key"))) if split else known
    docs = known.select("rid", "th", "n", "key")
    corpus = Corpus(base, docs, frozenset(split), hashing, percent)
    hot, times = _frequent(profile)
    total = docs.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    buckets = Buckets.of(total, hot, times)
    packed = "bucket int, c0 binary, c1 binary, c2 binary"
    entries = cut(base.mapInArrow(_entries(hashing, percent, buckets, hot, times, corpus.split), packed).groupBy("bucket").applyInArrow(_shared(buckets.plain), packed))

    proposals = entries.mapInArrow(_proposals(percent), "a long, b long, times long, small boolean")
    slices = entries.mapInArrow(_slices(buckets.plain, SLICE), "block binary, slice long, members binary, low_n long, high_n long").dropDuplicates(["block", "slice"])
    if len(buckets.hot):  # parts of one shingle meet in their first sets
        leads = cut(entries.mapInArrow(_leads(buckets.plain), "h long, key long, n long"))
        least = leads.groupBy("h").agg(F.min(F.struct("key", "n")).alias("m")).select("h", F.col("m.key").alias("a"), F.col("m.n").alias("a_n"))
        met = leads.join(least, "h").where((F.col("key") != F.col("a")) & (100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")))
        proposals = proposals.unionAll(met.select("a", F.col("key").alias("b"), F.lit(1).cast("long"), F.lit(False)))
    proposed = cut(proposals.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("small").alias("small")))
    slices = cut(slices)
    active = _bloom(proposed.select(F.explode(F.array("a", "b")).alias("key")).unionAll(slices.mapInArrow(_members(()), "key long")).distinct())
    points = known.where("n > 0").select("key", "n", "counts").mapInArrow(_through(active, "key"), "key long, n long, counts binary")
    corpus.points = cut(points.dropDuplicates(["key"]))

    best = proposed.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = corpus.near(best)
    tree = corpus.verified(best, corpus.words(best))
    roots = cut(forest_roots(tree.select(F.col("b").alias("node"), F.col("a").alias("parent"))))
    units = cut(_units(slices, roots, percent))
    marked = cut(corpus.points.select("key", "n").join(_marks(units), "key"))
    met = cut(_open_units(units, roots, marked).groupBy("unit").applyInArrow(_meeting(percent), "unit binary, part int, name long, key long, label long, marks array<bigint>"))
    found = cut(_with(met, corpus.points, "counts").groupBy("unit").applyInArrow(_search(percent, best=True), "unit binary, a long, b long, ratio double"))
    closest = found.groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    rest = _labelled(_labelled(proposed.where("small").select("a", "b"), roots, "a", "la"), roots, "b", "lb").where("la <> lb").select("a", "b")
    pairs = cut(corpus.near(rest).unionAll(closest.select(F.least("a", "b"), F.greatest("a", "b"))).distinct())
    words = cut(corpus.words(pairs))
    tree = tree.unionAll(corpus.verified(pairs, words))
    roots = cut(components(tree))

    paired = met.select("unit", "part", "name", "key").join(found.select("unit", F.col("a").alias("key")), ["unit", "key"], "left_semi")
    worded = _with(_with(_open_units(paired, roots, marked), corpus.points, "counts"), words, "words")
    joined = cut(worded.groupBy("unit").applyInArrow(_joining(percent, corpus.hashing), "a long, b long"))
    return docs, tree.unionAll(joined)


def _labelled(rows: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the root of a key's component so far; a key without links is its own."""
    r = roots.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
    return rows.join(r, F.col(key) == F.col("r_node"), "left").withColumn(name, F.coalesce("r_root", key)).drop("r_node", "r_root")


def _with(rows: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Adds the column that another table has for the rows' keys."""
    return rows.join(of.select(F.col("key").alias("w_key"), column), F.col("key") == F.col("w_key")).drop("w_key")


def _open_units(units: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """Members, with labels, sizes and the marks before their block, of the units that span several components."""
    labelled = _labelled(units, roots, "key", "label")
    mixed = labelled.groupBy("unit").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("unit")
    return labelled.join(mixed, "unit", "left_semi").join(marked.withColumnRenamed("key", "p_key"), F.col("key") == F.col("p_key")).select("unit", "part", "name", "key", "label", "n", F.filter("marks", lambda m: m < F.col("name")).alias("marks"))


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bits: int = 64) -> DataFrame:
    """One row per input row: rid, th, n and root, which documents with a set (n > 0) have in common with those of their component."""
    with batches_of(df.sparkSession, BATCH_ROWS):
        docs, links = classes(df, id_col, text_col, size, percent, bits)
        roots = cut(components(links))
    return docs.join(roots, F.col("key") == F.col("node"), "left").select("rid", "th", "n", F.coalesce("root", "key").alias("root"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bits: int = 64) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id of its component).  ``bits`` of a word's hash are kept at first."""
    named = grouped(df, id_col, text_col, size, percent, bits)
    least = named.where("n > 0").groupBy("root").agg(F.min("rid").alias("least")).withColumnRenamed("root", "l_root")
    out = named.join(least, (F.col("root") == F.col("l_root")) & (F.col("n") > 0), "left").withColumn("least", F.coalesce("least", "rid"))
    return out.select(unpacked_id("rid").alias(id_col), F.col("n").alias("n_shingles"), unpacked_id("least").alias("component_id"))
