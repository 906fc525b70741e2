"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1.  A trigram is bound by
multiplying its letters' vectors, each permuted by its place; a text's vector
is the bundle (sum) of its trigrams, a language's prototype the bundle of its
training texts' unit vectors.  A text gets the language of the prototype with
the largest cosine, and that cosine as score.

Training may take a bounded sample: at most about ``per_language`` different
texts of a language, chosen by a hash of the text, each once however many copies
it has.  More than ``most`` languages, which the model would have to hold in
memory, are refused with an error.  Prediction reads whole texts and
nothing but the text; very long ones are bundled slice by slice.  Null texts
and texts without a letter give ``und`` and score 0, as does every text where
nothing could be learned.  Ties go to the language first in code-point order.
Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from talkloom.llm import _text

UND = "und"
#: Letter classes: 0 is a space, 1 to 26 are a to z, other letters share the rest by their code point.
CLASSES = 64
SLICE = 1 << 19


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes, one row a language, in code-point order of the languages."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    seed: int


@cache
def _classes() -> np.ndarray:
    """The letter class of each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0x20000 <= cp < 0xE0000:
            continue
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (CLASSES - 27)
    table[0x20000:0x3FFFE] = 27 + np.arange(0x1FFFE) % (CLASSES - 27)
    return table


@cache
def _letters(dim: int, seed: int) -> np.ndarray:
    """Vectors of the classes at each of the three places of a trigram: permuted by rotation."""
    base = np.random.default_rng(seed).integers(0, 2, size=(CLASSES, dim), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(base, 2 - place, axis=1) for place in range(3)])


def _bundle(pieces: list[str], dim: int, seed: int) -> np.ndarray:
    """Sum of the trigram vectors of each piece."""
    padded = [f" {x} " for x in pieces]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(padded)), [len(x) for x in padded])
    code = _classes()[points]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep].astype(np.int64), owner[keep]
    gram = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
    inside = owner[:-2] == owner[2:]
    gram, owner = gram[inside], owner[:-2][inside]
    present = np.zeros(CLASSES**3, dtype=bool)
    present[gram] = True
    seen = np.flatnonzero(present)
    place = np.zeros(CLASSES**3, dtype=np.int64)
    place[seen] = np.arange(len(seen))
    out = np.zeros((len(pieces), dim), dtype=np.float32)
    first, second, third = _letters(dim, seed)
    width = 1 << 13
    at = place[gram]
    for low in range(0, len(seen), width):
        ids = seen[low : low + width]
        book = (first[ids // CLASSES**2] * second[ids // CLASSES % CLASSES] * third[ids % CLASSES]).astype(np.float32)
        mine = (at >= low) & (at < low + width) if len(seen) > width else slice(None)
        counts = np.bincount(owner[mine] * len(ids) + at[mine] - low, minlength=len(pieces) * len(ids))
        out += counts.reshape(len(pieces), len(ids)).astype(np.float32) @ book
    return out


def vectors(texts: list[str | None], dim: int, seed: int) -> np.ndarray:
    """Unit vector of each whole text; a text without a letter has the zero vector."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    rows: list[int] = []
    pieces: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            np.add.at(out, rows, _bundle(pieces, dim, seed))
        rows.clear()
        pieces.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text or not has_letter(text):
            continue
        for low in range(0, max(1, len(text) - 2), SLICE):
            piece = text[low : low + SLICE + 2].lower()
            rows.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= SLICE or len(pieces) >= 256:
                flush()
    flush()
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def has_letter(text: str) -> bool:
    head = text[:64]
    return any(map(str.isalpha, head)) or any(map(str.isalpha, text[64:]))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, per_language: int = 3000, seed: int = 7, most: int = 2000) -> Profiles:
    """Learns from the rows with a language; the driver gets ``dim`` numbers for each of at most ``most`` languages."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(most + 1).collect()
    if not sizes:
        return Profiles((), np.zeros((0, dim), dtype=np.float32), seed)
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    shares = df.sparkSession.createDataFrame([(r["lang"], -(-(per_language << 20) // max(1, r["n"]))) for r in sizes], "lang string, share long")
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share"))  # at most ``most`` rows
    sample = sample.select("text", "lang").distinct()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for low in range(0, len(texts), 2048):
                v = vectors(texts[low : low + 2048], dim, seed)
                for i, lang in enumerate(langs[low : low + 2048]):
                    sums[lang] = sums[lang] + v[i] if lang in sums else v[i].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    parts = sample.mapInArrow(partial, "lang string, v array<double>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    index = {lang: k for k, lang in enumerate(languages)}
    prototypes = np.zeros((len(languages), dim))
    for r in rows:
        prototypes[index[r["lang"]], r["i"]] = r["x"]
    norm = np.sqrt((prototypes**2).sum(axis=1, keepdims=True))
    return Profiles(languages, (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32), seed)


_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predict(column: Column, profiles: Profiles) -> Column:
    """Struct (lang, score) of a text column."""

    @F.arrow_udf(_RESULT)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, prototypes = profiles.languages, profiles.prototypes
        for batch in batches:
            langs, scores = [], []
            for low in range(0, len(batch), 2048):
                texts = batch[low : low + 2048].to_pylist()
                if not languages:
                    langs += [UND] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosine = vectors(texts, prototypes.shape[1], profiles.seed) @ prototypes.T
                best = cosine.argmax(axis=1)
                for i, text in enumerate(texts):
                    if text and has_letter(text):
                        langs.append(languages[best[i]])
                        scores.append(float(min(1.0, max(0.0, cosine[i, best[i]]))))
                    else:
                        langs.append(UND)
                        scores.append(0.0)
            _text.give_back()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return classify(column)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row: id, held_out, lang_pred, score."""
    profiles = train(df.where(~held_out(id_col)), text_col, lang_col, **params)
    return df.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(F.col(text_col), profiles).alias("p")).select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
