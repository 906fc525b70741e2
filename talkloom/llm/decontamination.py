"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in a folded form: lower case, every run of
characters other than letters and digits one space.  An item of n characters
may be found with up to k = n x ``max_error`` edits (rounded down).  Cut into
k + 1 pieces, one piece of it must then occur unchanged, so

1. an Aho-Corasick automaton of all pieces runs over each whole document;
2. every hit says where the item would lie; the window around it, k wider at
   both ends, is searched with Myers' bit-parallel algorithm for the item's
   smallest edit distance to any substring (windows of one item that overlap
   are searched as one);
3. distances up to k are matches.

The same rule holds for items of every length; where it allows no edit (below
1 / ``max_error`` characters), the one piece is the item with the spaces around
it, so that it is found as whole words.  Items that fold to the same text share
one search.  Items go in blocks of at most ``BLOCK_CHARS`` (one item at least),
each over all documents; one block at a time is in memory.

Null or empty texts have no matches; null or empty items match nothing.  Very
long texts are read as a whole.  Repeated rows are reported each, equal rows of
the items once.  Of equally near places of an item the first is reported.  A
null id is reported as null; an id that is no whole number raises an error.
Empty tables give no matches.  Other columns, whatever their names, are ignored
(``clean`` returns them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._spark import cut

BLOCK_CHARS = 8 << 20
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def budget(item: str, max_error: float) -> int:
    return int(len(item) * max_error)


def cut_pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    bounds = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def peq(item: str) -> dict[str, int]:
    """Bit i of a character's mask is set where the item has it at i."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(item: str, masks: dict[str, int], window: str) -> tuple[int, int]:
    """(smallest edit distance of the item to a substring of the window, first end where it is reached)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | ~(vp | d0) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | ~(d0 | hp) & full
        vn = hp & d0
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """All items of one block, ready to be run over documents."""

    def __init__(self, items: list[tuple[int, str]], max_error: float):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            folded = fold(text)
            if folded:
                by_text.setdefault(folded, []).append(item_id)
        self.items = []
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for text, ids in by_text.items():
            k = budget(text, max_error)
            for offset, piece in cut_pieces(text, k) if k else [(0, f" {text} ")]:
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((text, ids, k, peq(text)))
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item in the text; positions in its folded form."""
        if not self.items:
            return []
        doc = f" {fold(text)} "
        windows: dict[int, list[list[int]]] = {}
        for last, (size, found) in self.automaton.iter(doc):
            for index, offset in found:
                item, _, k, _ = self.items[index]
                start = last - size + 1 - offset - k
                end = start + len(item) + 2 * k
                mine = windows.setdefault(index, [])
                if mine and start <= mine[-1][1] and end >= mine[-1][0]:
                    mine[-1][0] = min(mine[-1][0], start)
                    mine[-1][1] = max(mine[-1][1], end)
                else:
                    mine.append([start, end])
        out = []
        for index, mine in windows.items():
            item, ids, k, masks = self.items[index]
            best = None
            for start, end in mine:
                start = max(0, start)
                if not k:
                    d, stop = 0, 1 + len(item)
                elif (at := doc.find(item, start, end)) >= 0:
                    d, stop = 0, at - start + len(item)
                else:
                    d, stop = myers(item, masks, doc[start:end])
                if d <= k and (best is None or d < best[0]):
                    best = (d, start + stop)
            if best:
                d, stop = best
                out += [(i, d, max(0, stop - 1 - len(item)), stop - 1) for i in ids]
        return out


def _matches(items: list[tuple[int, str]], max_error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, max_error)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    rows += [(doc, *m) for m in matcher.match(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("id", "item_id", "distance", "start", "stop"), columns, strict=True)})

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    block, held = [], 0
    rows = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).distinct().orderBy("id", "text")
    for r in rows.toLocalIterator():
        if held and held + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((r["id"], r["text"]))
        held += len(r["text"])
    if block or not held:
        yield block


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = 0.05) -> DataFrame:
    """One row per document row and item found in it: id, item_id, distance, and place in the folded text."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = [cut(docs.mapInArrow(_matches(block, max_error), "id long, item_id long, distance long, start long, stop long")) for block in _blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("id", id_col).withColumnRenamed("item_id", item_col)


def flagged(text_col: str, items: list[tuple[int, str]], max_error: float = 0.05):
    """Boolean column: does the text hold an item of a block?"""
    from pyspark.sql.types import BooleanType

    @F.arrow_udf(BooleanType())
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, max_error)
        for batch in batches:
            yield pa.array([bool(t) and bool(matcher.match(t)) for t in batch.to_pylist()], pa.bool_())

    return holds(F.col(text_col))


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = 0.05) -> DataFrame:
    """The rows of df, with all their columns, whose text holds no item."""
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        df = (cut(df) if k else df).where(~flagged(text_col, block, max_error))
    return df
