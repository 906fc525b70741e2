"""Vectorised byte kernels shared by the shingle and substring operators.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes other than
space and the ASCII controls 9 to 13, which is what ``bytes.split()`` yields.
Sums modulo 2**64 (``prefix_hash``) collide on some made-up strings, so their
users compare the bytes too.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LONG_WORD = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
_BLOCK = 1 << 19

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), _BLOCK + 1)
        for base in (_BASE, _BASE_INV):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            t = np.multiply.accumulate(t)
            if base == _BASE:
                _powers = t
            else:
                _inverses = t
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * B**position over [i, j)."""
    pw, _ = _power_tables(len(buf))
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * pw[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of the bytes in [start, end)."""
    _, inv = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every ``width`` consecutive bytes."""
    n = len(prefix) - width
    _, inv = _power_tables(len(prefix))
    return mix((prefix[width:] - prefix[:n]) * inv[:n] + U64(width))


def words_of(text: bytes) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them."""
    return b" ".join(text.lower().split())


class Words:
    """The words of several texts as ``words_of`` gives them: buf (with eight more bytes), first and last of each word, and the words before each text."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts)
        self.buf = np.frombuffer(joined + bytes(8), dtype=np.uint8)
        gaps = np.flatnonzero(self.buf[: len(joined)] == 32)
        first, last = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
        word = last > first  # an empty text stands between two spaces
        self.first, self.last = first[word], last[word]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.cut = np.searchsorted(self.first, np.concatenate(([0], np.cumsum(lengths))))

    def _blocks(self) -> np.ndarray:
        """The eight bytes from each place on as one number."""
        return np.ndarray(len(self.buf) - 7, dtype="<u8", buffer=self.buf, strides=(1,))

    def hashes(self, seed: int, bits: int = 64) -> np.ndarray:
        """Keyed hash of each word: eight bytes at a time, long words by BLAKE2."""
        view, length = self._blocks(), self.last - self.first
        key = U64(seed & 0xFFFFFFFFFFFFFFFF)
        h = mix(length.astype(U64) * U64(_BASE) ^ key)
        live = np.flatnonzero(length <= _LONG_WORD)
        at, left = self.first[live], length[live]
        while len(live):
            block = view[at] & _LOW_BYTES[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ block) * U64(0xD6E8FEB86659FD93) + key)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > _LONG_WORD).tolist():
            word = self.buf[self.first[i] : self.last[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key.tobytes()).digest(), "little")
        return h if bits == 64 else h & U64((1 << bits) - 1)

    def told_apart(self, hashes: np.ndarray) -> bool:
        """Have words with equal hashes equal bytes?"""
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        i, j = order[:-1][same], order[1:][same]
        length = self.last - self.first
        if (length[i] != length[j]).any():
            return False
        view, a, b, left = self._blocks(), self.first[i], self.first[j], length[i]
        for k in np.flatnonzero(left > _LONG_WORD).tolist():
            if not np.array_equal(self.buf[a[k] : a[k] + left[k]], self.buf[b[k] : b[k] + left[k]]):
                return False
        short = left <= _LONG_WORD
        a, b, left = a[short], b[short], left[short]
        while len(left):
            if ((view[a] ^ view[b]) & _LOW_BYTES[np.minimum(left, 8)]).any():
                return False
            more = left > 8
            a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
        return True


def _combine(words: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    total = np.full(n, size, dtype=U64)
    for k in range(size):
        total = mix(total * U64(0xD6E8FEB86659FD93) + words[k : k + n])
    return total


def shingle_sets(texts: list[bytes], size: int = 5, seed: int = 0, bits: int = 64, across: bool = False, known: bool = False) -> tuple[list[np.ndarray], bool]:
    """Sorted distinct shingle hashes of each text (as ``words_of`` gives it), and whether they are exact.

    A text with fewer words gives its whole sequence as one shingle.  The sets are exact if equal hashes stand for equal
    words in all texts, and for equal shingles in each, or in all with ``across``.  Those ``known`` to be exact aren't looked at again.
    """
    if not texts:
        return [], True
    x = Words(texts)
    words = x.hashes(seed, bits)
    exact = known or x.told_apart(words)
    every = _combine(words, size) if len(words) >= size else np.zeros(0, dtype=U64)
    out, places = [], []
    for a, b in zip(x.cut[:-1].tolist(), x.cut[1:].tolist(), strict=True):
        if b - a < size:
            out.append(_combine(words[a:b], b - a) if b > a else np.zeros(0, dtype=U64))
            places.append(np.full(len(out[-1]), a))
            continue
        mine = every[a : b - size + 1]
        if known:
            out.append(np.unique(mine))
            continue
        order = np.argsort(mine)
        mine = mine[order]
        new = np.concatenate(([True], mine[1:] != mine[:-1]))
        again = np.flatnonzero(~new)
        exact = exact and all((words[a + order[again] + k] == words[a + order[again - 1] + k]).all() for k in range(size))
        out.append(mine[new])
        places.append(a + order[new])
    if across and exact and not known:
        hashes, place = np.concatenate(out), np.concatenate(places)
        length = np.repeat(np.minimum(np.diff(x.cut), size), [len(s) for s in out])
        order = np.argsort(hashes)
        again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        i, j = order[again], order[again + 1]
        exact = bool((length[i] == length[j]).all())
        for k in range(size if exact else 0):
            on = k < length[i]
            exact = exact and bool((words[place[i[on]] + k] == words[place[j[on]] + k]).all())
    return out, exact


def give_back() -> None:
    """Returns freed memory to the system where the C library can; workers live on between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(texts: list[bytes], limit: int = 4 << 20):
    """Index ranges [i, j) of at most ``limit`` bytes each, one text at least."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


def windows(batches, limit: int):
    """The same rows in batches of about ``limit`` bytes, one incoming batch at least."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            give_back()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        give_back()


def utf8(column) -> list[bytes]:
    """Bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(column, limit: int = 1 << 20):
    """(i, j, texts) over an Arrow string column: runs of at most ``limit`` bytes, one text at least, converted one run at a time."""
    import pyarrow.compute as pc

    i, held = 0, 0
    for j, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > limit:
            yield i, j, utf8(column.slice(i, j - i))
            i, held = j, 0
        held += n
    if i < len(column):
        yield i, len(column), utf8(column.slice(i))
