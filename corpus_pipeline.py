"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurelab.llm import common, decontam, near_dedup, packing, quality, substring_dedup

#: documents at least so similar over five-word shingles, in percent, are near-duplicates
SIMILAR_PERCENT = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: the id and a hash of the text, so rows that share an id are judged apart."""
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a rule rejects."""
    return quality.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate group; of repeated rows, one."""
    docs = _keyed(docs)
    judged = near_dedup.near_duplicates(docs, SIMILAR_PERCENT, id_column="key")
    removed = judged.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("key"))
    # the key is never null, so the join compares ids null-safely field by field
    left = docs.join(removed, docs["key"].eqNullSafe(removed["key"]), "left_anti")
    first = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return left.withColumn("nth", first).where("nth = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every passage that occurs twice; a document may become empty, but stays."""
    docs = docs.withColumn("kept", F.struct("doc_id", "lang", "source"))
    out = substring_dedup.remove_repeats(docs, id_column="kept", keep_text=True)
    return out.select("doc_id.doc_id", F.col("kept_text").alias("text"), "doc_id.lang", "doc_id.source",
                      F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents: some words, and at least one in twenty, lie in benchmark windows."""
    docs = _keyed(docs)
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"), id_column="key")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    dirty = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("doc_id").alias("key")).distinct()
    return docs.join(dirty, docs["key"].eqNullSafe(dirty["key"]), "left_anti").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_sequences),
]

#: a tokenizer's ids cannot be stated in SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
