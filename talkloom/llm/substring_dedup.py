"""Exact removal of repeated byte strings across a corpus.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier: in a document with a smaller id, or earlier in the same document.

All suffixes matter only to depth ``length``, and equal strings must meet
without a shuffle of every position:

1. A document equal to an earlier one goes as a whole, so only first copies
   are searched.
2. Every string of ``length`` bytes has an anchor, the smallest hash among the
   ``GRAM``-byte strings inside it (leftmost on ties); equal strings have equal
   anchors at equal offsets.  Consecutive strings share anchors, so anchors
   are some 1 in 40 positions.  Packed by hash, they tell which anchors occur
   more than once; of an anchor that several places of a batch have, one place
   speaks for all, so that no hash gathers more than a place a batch.
3. Only around those, each run of strings with one anchor is sent as the bytes
   it spans to its anchor's bucket, once per distinct run of a batch.
4. In a bucket, of runs with equal bytes the earliest stays.  The suffixes that
   begin in the rest, but for those whose hash to depth ``length`` no other has,
   which equal none, are sorted to that depth by a stable mergesort, all
   suffixes with one anchor and offset at a time.  A comparison finds the common
   extension of two suffixes by binary search over prefix polynomial hashes, in
   the logarithm of ``length`` steps, and compares the byte behind it.  The
   sorted order is then verified on the bytes; where hashes collided, the bytes
   sort that group again.  A suffix equal to the one before it is a repetition,
   as the first of equal ones is the earliest.
5. Spans come back by document and are cut from the text.

The text table is shuffled once, by document; the three joins with it share
that exchange.  Nothing is quadratic in the size of a group of copies.

Null texts are empty; texts below ``length`` bytes never change.  Rows equal in
id and text are one document and get equal results; rows equal in id only are
ordered by a hash of the text.  A null id comes before all others; an id that is
no whole number raises an error.  Documents are told apart by 64 bits of a hash
of id and text, and where these mix documents by 64 others.  An empty table
gives an empty result.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talkloom.llm import _text
from talkloom.llm._spark import cut, packed_id, smaller_batches, unpacked_id

U64 = np.uint64
GRAM = 20
SLICE = 1 << 20
BUCKET_BYTES = 3 << 20
#: Rows that a Python worker gets at once; bytes of rows among which runs are compared before they are sent.
BATCH_ROWS = 2048
WINDOW = 16 << 20
MIN_BUCKETS = 64
_LOW = U64(0xFFFFFFFF)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    reach, m = 1, v
    while 2 * reach <= width:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - reach : width - reach + len(v) - width + 1])


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes): texts of at least ``length``, long ones in slices whose strings don't overlap."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, SLICE):
            part = t[at : at + SLICE + length - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= SLICE:
                yield group
                group, held = [], 0
    if group:
        yield group


def runs(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """Of one group: the buffer; per run of strings with one anchor its piece, first and last start, anchor position and anchor hash."""
    buf = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
    sizes = np.fromiter((len(p) for _, _, p in group), dtype=np.int64, count=len(group))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    gram = _text.rolling_hash(_text.prefix_hash(buf), GRAM)
    best = sliding_min((gram & ~_LOW) | np.arange(len(gram), dtype=U64), length - GRAM + 1) & _LOW
    inside = np.ones(len(best), dtype=bool)
    for b in begin[1:-1]:
        inside[b - length + 1 : b] = False
    start = np.flatnonzero(inside)
    anchor = best[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(start)) - 1
    piece = np.searchsorted(begin, start[first], side="right") - 1
    return buf, piece, begin[piece], start[first], start[last], anchor[first], gram[anchor[first]]


def _pack(bucket: np.ndarray, columns: list[np.ndarray], data: list[bytes] | None = None) -> dict:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, dtype=int)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    out = {"bucket": pa.array(b[cuts[:-1]].astype(np.int32))}
    for k, c in enumerate(columns):
        c = c[order]
        out[f"c{k}"] = pa.array([c[i:j].tobytes() for i, j in spans], pa.binary())
    if data is not None:
        out["data"] = pa.array([b"".join(data[x] for x in order[i:j].tolist()) for i, j in spans], pa.binary())
    return out


#: What an anchor's place says: it is alone in its batch, it speaks for several, another place speaks for it.
ALONE, SPEAKER, SPOKEN_FOR = 0, 1, 2
#: Anchors that a worker holds at once to find those that several places share.
HELD_ANCHORS = 1 << 20


def _anchors(length: int, buckets: int):
    """Packed (hash, document, position, what the place says) of every anchor."""

    def told(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, dk, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, dk, at = gram[order], dk[order], at[order]
        first = np.concatenate(([True], gram[1:] != gram[:-1]))
        followed = np.concatenate((~first[1:], [False]))
        says = np.where(first, np.where(followed, SPEAKER, ALONE), SPOKEN_FOR).astype(np.uint8)
        bucket = np.where(first, (gram % U64(buckets)).astype(np.int64), dk % buckets)
        return pa.RecordBatch.from_pydict(_pack(bucket.astype(np.int32), [gram, dk, at, says]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.windows(batches, WINDOW):
            keys, which = np.unique(batch.column("dk").to_numpy(), return_index=True)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for group in pieces(_text.utf8(batch.column("text").take(pa.array(which))), length):
                _, piece, begin, _, _, anchor, gram = runs(group, length)
                of = np.array([i for i, _, _ in group])[piece]
                offset = np.array([o for _, o, _ in group])[piece]
                held.append((gram, keys[of], (anchor - begin + offset).astype(np.int64)))
                if sum(len(x[0]) for x in held) >= HELD_ANCHORS:
                    yield told(held)
                    held = []
            if held:
                yield told(held)

    return run


def _join(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), dtype=kind)


def _repeated(table: pa.Table) -> pa.Table:
    """Per document, the positions of a bucket's anchors that occur more than once."""
    gram, dk, at, says = _join(table, "c0", U64), _join(table, "c1", np.int64), _join(table, "c2", np.int64), _join(table, "c3", np.uint8)
    sure = says == SPOKEN_FOR
    passed = (dk[sure], at[sure])
    gram, dk, at, says = gram[~sure], dk[~sure], at[~sure], says[~sure]
    order = np.lexsort((-says.astype(np.int8), at, dk, gram))
    gram, dk, at, says = gram[order], dk[order], at[order], says[order]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (dk[1:] != dk[:-1]) | (at[1:] != at[:-1]))) if len(gram) else np.zeros(0, dtype=bool)
    gram, dk, at, says = gram[new], dk[new], at[new], says[new]
    same = gram[1:] == gram[:-1]
    many = (says == SPEAKER) | np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(gram) else np.zeros(0, dtype=bool)
    dk, at = np.concatenate((passed[0], dk[many])), np.concatenate((passed[1], at[many]))
    order = np.argsort(dk, kind="stable")
    dk, at = dk[order], at[order]
    cuts = np.flatnonzero(np.concatenate(([True], dk[1:] != dk[:-1], [True]))) if len(dk) else np.zeros(1, dtype=int)
    return pa.table({"dk": dk[cuts[:-1]], "at": pa.array([at[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _segments(length: int, buckets: int):
    """Packed runs (id, text hash, document, first start, bytes) around repeated anchors.

    A run whose bytes an earlier run of the same batch has is a repetition as a
    whole; it travels as a span without bytes.  Rows equal in id and text are
    read once, so that none repeats itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.windows(batches, WINDOW):
            rid, th, dk = (batch.column(c).to_numpy() for c in ("rid", "th", "dk"))
            texts, wanted = _text.utf8(batch.column("text")), batch.column("ats").to_pylist()
            order = np.lexsort((th, rid))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (rid[order[1:]] != rid[order[:-1]]) | (th[order[1:]] != th[order[:-1]])
            order = order[new]
            texts, rid, th, dk = [texts[i] for i in order], rid[order], th[order], dk[order]
            wanted = [np.sort(np.frombuffer(b"".join(wanted[i]), dtype=np.int64)) for i in order]
            seen: set[bytes] = set()
            for group in pieces(texts, length):
                buf, piece, begin, first, last, anchor, gram = runs(group, length)
                of = np.array([i for i, _, _ in group])[piece]
                offset = np.array([o for _, o, _ in group])[piece]
                place = anchor - begin + offset
                keep = np.zeros(len(of), dtype=bool)
                cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    w = wanted[of[i]]
                    if len(w):
                        keep[i:j] = w[np.minimum(np.searchsorted(w, place[i:j]), len(w) - 1)] == place[i:j]
                at = np.flatnonzero(keep)
                raw, data, whole = buf.tobytes(), [], np.zeros(len(at), dtype=bool)
                for k, (a, b) in enumerate(zip(first[at].tolist(), last[at].tolist(), strict=True)):
                    x = raw[a : b + length]
                    mark = hashlib.blake2b(x, digest_size=16).digest()
                    whole[k] = mark in seen
                    seen.add(mark)
                    data.append(x)
                size = np.array([len(x) for x in data], dtype=np.int64)
                start = (first - begin + offset)[at].astype(np.int64)
                bucket = (gram[at] % U64(buckets)).astype(np.int32)
                lead = (anchor - first)[at].astype(np.int64)
                of = of[at]
                for part, kept in ((~whole, True), (whole, False)):
                    i = np.flatnonzero(part)
                    if len(i):
                        row = _pack(bucket[i] if kept else (dk[of[i]] % buckets).astype(np.int32), [rid[of[i]], th[of[i]], dk[of[i]], start[i], size[i], gram[at][i], lead[i]], [data[x] if kept else b"" for x in i.tolist()])
                        if not kept:
                            row["data"] = pa.nulls(len(row["bucket"]), pa.binary())
                        yield pa.RecordBatch.from_pydict(row)

    return run


def common_extension(prefix: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j, up to ``most``, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), dtype=np.int64), np.full(len(i), most, dtype=np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = _text.span_hash(prefix, i, i + mid) == _text.span_hash(prefix, j, j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _before(buf: np.ndarray, prefix: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Sign of the comparison of the suffixes at i with those at j, to depth ``length``."""
    out = np.zeros(len(i), dtype=np.int8)
    for low in range(0, len(i), 1 << 16):
        k = slice(low, low + (1 << 16))
        reach = common_extension(prefix, i[k], j[k], length)
        step = np.minimum(reach, length - 1)
        x, y = buf[i[k] + step].astype(np.int16), buf[j[k] + step].astype(np.int16)
        out[k] = np.where(reach == length, 0, np.sign(x - y))
    return out


def repeated_hashes(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share the hash of their first ``length`` bytes with another of their group?  All that equal another do."""
    prefix = _text.prefix_hash(buf)
    key = _text.span_hash(prefix, starts, starts + length) ^ _text.mix(group.astype(U64))
    order = np.argsort(key)
    pair = key[order[1:]] == key[order[:-1]]
    many = np.zeros(len(key), dtype=bool)
    many[order[1:][pair]] = True
    many[order[:-1][pair]] = True
    return np.flatnonzero(many)


def sorted_suffixes(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the suffixes at ``starts`` by group and, in a group, by their first ``length`` bytes; is each equal to the one before?

    A stable mergesort of all groups at once: in each round every element finds
    its place in the neighbouring run of its group by binary search.  The order
    is verified on the bytes.
    """
    prefix = _text.prefix_hash(buf)
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(head, len(g)))
    width = 1
    while (size > width).any():
        large = np.flatnonzero(size > width)
        at = np.repeat(head[large], size[large])
        place = np.arange(len(at)) - np.repeat(np.cumsum(size[large]) - size[large], size[large])
        end = np.repeat(size[large], size[large])
        block = place // width
        odd = (block & 1).astype(bool)
        other = np.where(odd, block - 1, block + 1) * width
        low, high = np.minimum(other, end), np.minimum(other + width, end)
        begin = low.copy()
        own = starts[order[at + place]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign = _before(buf, prefix, starts[order[at[open_] + mid]], own[open_], length)
            # an element of the later run goes behind equal ones of the earlier run
            ahead = (sign < 0) | ((sign == 0) & odd[open_])
            low[open_], high[open_] = np.where(ahead, mid + 1, low[open_]), np.where(ahead, high[open_], mid)
        merged = np.where(odd, place - width, place) + (low - begin)
        moved = order.copy()
        moved[at + merged] = order[at + place]
        order, width = moved, width * 2
    same = np.zeros(len(order), dtype=bool)
    pairs = np.flatnonzero(g[1:] == g[:-1]) + 1
    broken = set(group[np.bincount(order, minlength=len(group)) != 1].tolist())
    for low in range(0, len(pairs), 1 << 14):
        k = pairs[low : low + (1 << 14)]
        x, y = (buf[starts[order[j]][:, None] + np.arange(length)] for j in (k - 1, k))
        differ = x != y
        at = differ.argmax(axis=1)
        row = np.arange(len(k))
        same[k] = ~differ[row, at]
        broken.update(g[k[x[row, at] > y[row, at]]].tolist())
        broken.update(g[k[same[k] & (order[k - 1] >= order[k])]].tolist())
    for b in broken:  # hashes collided here
        at = np.flatnonzero(g == b)
        members = np.flatnonzero(group == b).tolist()
        texts = {m: buf[starts[m] : starts[m] + length].tobytes() for m in members}
        members.sort(key=texts.__getitem__)
        order[at] = members
        same[at] = [k > 0 and texts[m] == texts[members[k - 1]] for k, m in enumerate(members)]
    return order, same


def _spans(length: int):
    """Per document, the removed spans (start, end) that a bucket's runs show."""

    def run(table: pa.Table) -> pa.Table:
        bare = pa.compute.is_null(table.column("data"))
        found = []
        passed = table.filter(bare)
        dk, start, size = (_join(passed, c, np.int64) for c in ("c2", "c3", "c4"))
        found.append((dk, start, start + size))
        table = table.filter(pa.compute.invert(bare))
        rid, th, dk, start, size = (_join(table, f"c{k}", np.int64) for k in range(5))
        gram, lead = _join(table, "c5", U64), _join(table, "c6", np.int64)
        if len(rid):
            raw = b"".join(table.column("data").to_pylist())
            begin = np.cumsum(size) - size
            seen: set[bytes] = set()
            stay, whole, last = [], [], None
            for i in np.lexsort((start, th, rid)).tolist():
                if (place := (rid[i], th[i], start[i])) == last:  # a run of a repeated row
                    continue
                last = place
                text = raw[begin[i] : begin[i] + size[i]]
                (whole if text in seen else stay).append(i)
                seen.add(text)
            del seen
            w = np.array(whole, dtype=np.int64)
            found.append((dk[w], start[w], start[w] + size[w]))
            s = np.array(stay, dtype=np.int64)
            rid, th, dk, start, size, gram, lead, begin = (x[s] for x in (rid, th, dk, start, size, gram, lead, begin))
            n = size - length + 1
            # only runs of an anchor that several of them have can hold equal strings
            _, kind, count = np.unique(gram, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[kind] > 1)
            n, begin, kind, lead = n[again], begin[again], kind[again], lead[again]
            segment = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            buf = np.frombuffer(raw, dtype=np.uint8)
            starts, group = begin[segment] + within, kind[segment] * length + lead[segment] - within
            again_at = repeated_hashes(buf, starts, group, length)
            order, same = sorted_suffixes(buf, starts[again_at], group[again_at], length)
            gone = np.sort(again_at[order[same]])
            if len(gone):
                first = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (segment[gone[1:]] != segment[gone[:-1]])))
                head = np.flatnonzero(first)
                tail = np.append(head[1:], len(gone)) - 1
                o = again[segment[gone[head]]]
                found.append((dk[o], start[o] + within[gone[head]], start[o] + within[gone[tail]] + length))
        dk, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(dk, kind="stable")
        dk, ab = dk[order], np.stack((a[order], b[order]), axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], dk[1:] != dk[:-1], [True]))) if len(dk) else np.zeros(1, dtype=int)
        _text.give_back()
        return pa.table({"dk": dk[cuts[:-1]], "ab": pa.array([ab[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def merge(ab: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of half-open spans."""
    ab = ab[np.argsort(ab[:, 0], kind="stable")]
    end = np.maximum.accumulate(ab[:, 1])
    first = np.concatenate(([True], ab[1:, 0] > end[:-1]))
    return np.stack((ab[first, 0], end[np.append(np.flatnonzero(first)[1:], len(ab)) - 1]), axis=1)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the spans out: (rid, th, n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        texts = _text.utf8(batch.column("text"))
        out = {"rid": batch.column("rid"), "th": batch.column("th"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for t, lists in zip(texts, batch.column("abs").to_pylist(), strict=True):
            spans = merge(np.frombuffer(b"".join(lists), dtype=np.int64).reshape(-1, 2)) if lists else np.zeros((0, 2), dtype=np.int64)
            at, kept = 0, []
            for a, b in spans.tolist():
                kept.append(t[at:a])
                at = b
            kept.append(t[at:])
            out["n_bytes"].append(len(t))
            out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["n_spans"].append(len(spans))
            out["kept"].append(b"".join(kept))
        yield pa.RecordBatch.from_pydict({k: v if k in ("rid", "th") else pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})


def whole_characters(column: str) -> Column:
    """Text of a byte column; characters that a cut went through are left out."""

    @F.arrow_udf(StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else x.decode("utf-8", "ignore") for x in batch.to_pylist()], pa.string())

    return decode(F.col(column))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and kept, the remaining bytes."""
    return found(df, id_col, text_col, length, buckets).select(unpacked_id("rid").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, buckets: int | None = None) -> DataFrame:
    """The same by rid, the packed id, and th, xxhash64 of the text."""
    smaller_batches(df.sparkSession, BATCH_ROWS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(packed_id(id_col).alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))
    base = base.select(F.xxhash64("rid", "th").alias("dk"), "rid", "th", "text")
    heads = base.where(F.octet_length("text") >= length).select("dk", "rid", "th", F.sha2("text", 256).alias("sha"))
    firsts = heads.groupBy("sha").agg(F.min("rid").alias("first"))
    if buckets is None:
        total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    marked = cut(heads.join(firsts.withColumnRenamed("sha", "f_sha"), F.col("sha") == F.col("f_sha")).select("dk", F.xxhash64("sha", "rid").alias("twin"), (F.col("rid") > F.col("first")).alias("copy")))
    # documents that share a key: some n * n / 2**65 of them
    mixed = [r["dk"] for r in marked.groupBy("dk").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low <> high").select("dk").collect()]
    if mixed:
        base = base.withColumn("dk", F.when(F.col("dk").isin(mixed), F.xxhash64(F.sha2("text", 256), "rid")).otherwise(F.col("dk")))
        marked = marked.withColumn("dk", F.when(F.col("dk").isin(mixed), F.col("twin")).otherwise(F.col("dk")))
    alone = marked.where("not copy").select("dk").distinct()
    copies = marked.where("copy").select("dk").distinct()

    packed = "bucket int, c0 binary, c1 binary, c2 binary, c3 binary"
    anchors = base.join(alone, "dk", "left_semi").mapInArrow(_anchors(length, buckets), packed)
    places = anchors.groupBy("bucket").applyInArrow(_repeated, "dk long, at binary")
    places = places.groupBy("dk").agg(F.collect_list("at").alias("ats")).withColumnRenamed("dk", "p_dk")
    segments = base.join(places, F.col("dk") == F.col("p_dk")).drop("p_dk").mapInArrow(_segments(length, buckets), f"{packed}, c4 binary, c5 binary, c6 binary, data binary")
    spans = segments.groupBy("bucket").applyInArrow(_spans(length), "dk long, ab binary")
    whole = copies.select("dk", F.lit(None).cast("binary").alias("ab"))
    removed = spans.unionAll(whole).groupBy("dk").agg(F.collect_list("ab").alias("abs"), F.max(F.col("ab").isNull()).alias("whole")).withColumnRenamed("dk", "r_dk")
    joined = base.join(removed, F.col("dk") == F.col("r_dk"), "left").drop("r_dk")
    return joined.mapInArrow(_with_whole, "rid long, th long, n_bytes long, n_removed long, n_spans long, kept binary")


def _with_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(low, 1000) for b in batches for low in range(0, b.num_rows, 1000)):
        whole, sizes = batch.column("whole").to_pylist(), pa.compute.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
        lists = [[np.array([0, n], dtype=np.int64).tobytes()] if w else x for w, n, x in zip(whole, sizes, batch.column("abs").to_pylist(), strict=True)]
        columns = {c: batch.column(c) for c in ("rid", "th", "text")} | {"abs": pa.array(lists, pa.list_(pa.binary()))}
        yield from _finish(iter([pa.RecordBatch.from_pydict(columns)]))
    _text.give_back()
