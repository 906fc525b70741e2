"""Token counts of whole texts under a fixed public vocabulary.

Arrow batches of texts are encoded by the library in groups of about
``GROUP_BYTES`` bytes, and lengths alone come back; ids never leave the worker.
A text of more than ``PART`` characters is split at safe boundaries, and the
counts of its parts add up.  A byte-level pre-tokenizer cuts texts into runs of
letters, of digits, of other characters and of white space, where a run may take
one space before it.  Between a character that is not white space and white
space, and between a letter and a mark of ``_MARKS``, two of its pieces always
meet.  No added token may hold such a boundary; vocabularies of other kinds, and
stretches without a boundary, are encoded whole.  A group is as large as its
last part, which only such a stretch makes larger than ``GROUP_BYTES``.

Null and empty texts count zero tokens.  Repeated rows are counted each, though
equal parts of a group are encoded once.  Other columns of the input, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes encoded at once, and characters from which a text is split.
GROUP_BYTES = 1 << 20
PART = 1 << 16

#: Marks that no contraction begins with.
_MARKS = ".,;:!?。、，！？"
#: Characters that are white space or letters by every version of Unicode.
_BLANK = r" \t\n\r"
_LETTER = r"A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_BOUNDARY = re.compile(rf"(?<=\S)[{_BLANK}]|(?<=[{_LETTER}])[{_MARKS}]")
_counters: dict[str, _Counter] = {}


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of at least ``size`` characters, each ending at the first safe boundary from there on."""
    at = 0
    while len(text) - at > size and (cut := _BOUNDARY.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Counter:
    """Counts with one tokenizer."""

    def __init__(self, vocabulary: str):
        if vocabulary.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            self.lengths = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
            self.splits = False
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(vocabulary)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.splits = self._byte_level(vocabulary)

    @staticmethod
    def _byte_level(vocabulary: str) -> bool:
        """Splitting is safe only where nothing rewrites the text before it is cut into pieces, and no added token holds a boundary."""
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not re.search(rf"\s|[{_MARKS}]", x["content"]) for x in added)
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and plain

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        group: dict[str, list[int]] = {}  # parts, and the texts that they are of
        held = 0

        def encode() -> None:
            for n, owners in zip(self.lengths(list(group)), group.values(), strict=True):
                for i in owners:
                    out[i] += n
            group.clear()

        for i, text in enumerate(texts):
            for part in (parts(text) if self.splits else (text,)) if text else ():
                if part in group:
                    group[part].append(i)
                    continue
                group[part] = [i]
                held += len(part) if part.isascii() else len(part.encode())
                if held >= GROUP_BYTES:
                    encode()
                    held = 0
        if group:
            encode()
        return out


def _counter(vocabulary: str) -> _Counter:
    if vocabulary not in _counters:
        _counters[vocabulary] = _Counter(vocabulary)
    return _counters[vocabulary]


def token_count(column: Column, vocabulary: str) -> Column:
    """Number of tokens of a string column, without added special tokens; null counts 0."""

    @F.arrow_udf(LongType())
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(vocabulary)
        for batch in batches:
            yield pa.array(counter.count(batch.to_pylist()), type=pa.int64())

    return counts(column)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
