"""Sample and emission operators over array columns, one clip a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from talkloom.functions import signal


def gain(samples: Column, rate: int = 16000, target_rms: float = 0.1, max_gain: float = 18.0, gate_rms: float = 0.01) -> Column:
    """Samples after automatic gain; null stays null."""

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else signal.agc(np.asarray(x, dtype=np.float32), rate, target_rms, max_gain, gate_rms).tolist() for x in b.to_pylist()], pa.list_(pa.float32()))

    return run(samples)


_CHANNELS = StructType([StructField("independent", BooleanType()), StructField("correlation", DoubleType()), StructField("exclusive_activity", DoubleType()), StructField("simultaneous_activity", DoubleType())])


def channels(left: Column, right: Column, rate: int = 16000) -> Column:
    """Do two channels hold different speakers?"""

    @F.arrow_udf(_CHANNELS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for a, b in batches:
            out = []
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                n = min(len(x or []), len(y or []))
                got = signal.independent_channels(np.stack([np.asarray((x or [])[:n], dtype=np.float32), np.asarray((y or [])[:n], dtype=np.float32)], axis=1), rate)
                out.append({f.name: got.get(f.name) for f in _CHANNELS})
            yield pa.array(out, to_arrow_type(_CHANNELS))

    return run(left, right)


_ALIGNED = ArrayType(StructType([StructField("text", StringType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("score", DoubleType()), StructField("character_hits", DoubleType()), StructField("accepted", BooleanType())]))


def align(text: Column, emissions: Column, vocabulary: dict[str, int], blank: int, offset: Column, frame_seconds: float) -> Column:
    """Words of a text with times from frame-by-token log probabilities; empty where there is no complete path."""

    @F.arrow_udf(_ALIGNED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for t, e, o in batches:
            out = []
            for words, frames, at in zip(t.to_pylist(), e.to_pylist(), o.to_pylist(), strict=True):
                try:
                    out.append(signal.align_emissions(words or "", vocabulary, blank, frames or [], at or 0.0, frame_seconds))
                except ValueError:
                    out.append([])
            yield pa.array(out, to_arrow_type(_ALIGNED))

    return run(text, emissions, offset)


def coverage(words: Column) -> Column:
    """Share of accepted words among those with a score; 0 where none has one."""
    known = F.filter(words, lambda w: w["score"].isNotNull())
    return F.coalesce(F.try_divide(F.size(F.filter(known, lambda w: w["accepted"])).cast("double"), F.size(known).cast("double")), F.lit(0.0))
