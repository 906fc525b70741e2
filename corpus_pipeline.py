"""A corpus pipeline of five stages; each is written and read again by the next.

1. ``language``: documents without an identifiable language go.
2. ``near_duplicates``: of each component of near copies one document stays,
   that with the smallest id (of equal ids, the smallest hash of the text).
3. ``repeated_passages``: bytes of strings that occur earlier are cut out; a
   document of which nothing but white space is left goes.
4. ``decontamination``: documents that hold a benchmark item go.
5. ``mixture``: sources are mixed to target weights; documents that the mixture
   takes stay, with the words it takes of each.

Every stage works on all that the one before it kept.  The first four return
the columns of their input.  Null columns, empty and very long texts, repeated
rows and empty tables pass through with the results their operators define.
Stages find a document again by its id and a hash of its text, so null, repeated
and clashing ids keep their own fates; of rows equal in both, one stays where
the text has a word.  Columns whose names begin with ``_talkloom_`` must not be
in the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import decontamination, language_id, mixing, ngram_jaccard, substring_dedup
from talkloom.llm._spark import cut, packed_id
from talkloom.sources import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined."""
    profiles = language_id.train(docs.where(~language_id.held_out("doc_id")))
    judged = docs.withColumn("_talkloom_language", language_id.predict(F.col("text"), profiles))
    return judged.where(F.col("_talkloom_language.lang") != language_id.UND).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_talkloom_rid": packed_id("doc_id"), "_talkloom_th": F.xxhash64(F.coalesce("text", F.lit("")))})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component."""
    members = ngram_jaccard.grouped(docs).where("n > 0")
    first = members.groupBy("root").agg(F.min(F.struct("rid", "th")).alias("first"), F.count("*").alias("size")).where("size > 1")
    fates = members.join(first, "root").groupBy(F.col("rid").alias("_talkloom_rid"), F.col("th").alias("_talkloom_th")).agg(F.first(F.col("first") == F.struct("rid", "th")).alias("_talkloom_stays"))
    judged = _keyed(docs).join(cut(fates), ["_talkloom_rid", "_talkloom_th"], "left")
    alone = judged.where(F.col("_talkloom_stays").isNull())
    one = judged.where("_talkloom_stays").dropDuplicates(["_talkloom_rid", "_talkloom_th"])
    return alone.unionByName(one).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of the texts."""
    removed = substring_dedup.found(docs).where("n_removed > 0")
    changed = removed.select(F.col("rid").alias("_talkloom_rid"), F.col("th").alias("_talkloom_th"), substring_dedup.whole_characters("kept").alias("_talkloom_text")).dropDuplicates(["_talkloom_rid", "_talkloom_th"])
    joined = _keyed(docs).join(changed, ["_talkloom_rid", "_talkloom_th"], "left")
    cut_out = F.col("_talkloom_text").isNotNull()
    kept = F.when(cut_out, F.col("_talkloom_text")).otherwise(F.col("text"))
    columns = [kept.alias(c) if c == "text" else F.length(F.coalesce(kept, F.lit(""))).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.where(~cut_out | F.col("_talkloom_text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture takes, with the words it takes of each."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("mixture", mixture),
]

#: Stages 1 and 4 have no SQL, so the whole has none; each stage and the run are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    ``at`` names a folder of the run, which all executors share: stages that are complete there are read, not run again,
    so a run whose driver was lost goes on where it was.  Without it a new folder is taken, of which only the last stage
    stays.
    """
    own = at is None
    at = at or f"{scratch.shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        where = f"{at}/{name}"
        if not scratch.exists(spark, f"{where}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(where)
        docs = spark.read.parquet(where)
        if own and before:
            scratch.delete(spark, before)
        before = where
    return docs
