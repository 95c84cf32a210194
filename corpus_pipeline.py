"""Training-data pipeline over `documents`: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it to the shared folder and hands the reread
table to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.llm import bagminhash, packing, phrases, quality
from studylantern.llm.common import free_name, settle, table
from studylantern.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    prefix = free_name(docs.columns, "q_")
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")), prefix=prefix)
    return scored.filter(F.col(f"{prefix}keep")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return bagminhash.keep_one(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated passages. Texts that hold none stay as they are; the others are their kept words, by one space."""
    prefix = free_name(docs.columns, "p_")
    out, kept = phrases.remove_repeated(docs, prefix=prefix), F.col(f"{prefix}kept")
    changed = F.col(f"{prefix}removed") > 0
    text = F.when(changed, kept).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).withColumn("text", text).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("packing", pack)]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
