"""The corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

Each stage calls one operator of tidemark.llm, works on all that its predecessor kept, and lets the
operator's decisions take effect.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import without_contaminated
from tidemark.llm.language_id import UNDETERMINED, identify_languages
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_duplicates import near_duplicate_classes
from tidemark.llm.shared import discard, free_name, settle, table
from tidemark.llm.sharding import with_shards


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, empty or without letters) go; lang gets the predicted language where it is missing."""
    pred = free_name(docs, "lang_pred")
    judged = identify_languages(docs).where(F.col(pred) != UNDETERMINED)
    lang = F.coalesce(F.col("lang"), F.col(pred)).alias("lang")
    return judged.select(*[lang if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id, and one row of it.

    Rows without an id are in no class and stay.
    """
    classes = near_duplicate_classes(docs)
    kept = classes.where("class_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    # of rows that repeat a kept id, one stays: the least text hash
    chosen = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_hash")).join(kept, F.col("doc_id") == F.col("_kept")).select("_kept", "_hash")
    named = docs.where("doc_id is not null").join(chosen, (F.col("doc_id") == F.col("_kept")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a verified benchmark passage go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at target weights: for each pass over a document, the words taken in it."""
    return mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and output shard."""
    return with_shards(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Several stages (learned models, samples, permutations) have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
