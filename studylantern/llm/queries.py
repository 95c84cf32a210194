"""Queries of the numbered operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from studylantern.llm import bagminhash, bpe, bwt, digest_cache, grammar, merkle, multiindex, packing, phrases, quality, resample, sampling, warc
from studylantern.llm.common import table
from studylantern.llm.reference_sql import STATEMENTS


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file, the same on every node."""
    return public_tokenizers.path(name)


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fingerprints(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.ids_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digests(table(spark, sf_dir, "documents"))


def op9_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs, quality.fit(docs, labels))
    return scored.select("doc_id", "q_evidence", "q_host_posterior", "q_path_posterior", "q_score", "q_keep")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op12_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_cache.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digest_cache.new_cache(spark))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_phrases": op1_phrases,
    "op2_bpe": op2_bpe,
    "op3_sampling": op3_sampling,
    "op4_packing": op4_packing,
    "op5_bagminhash": op5_bagminhash,
    "op6_repair": op6_repair,
    "op7_warc": op7_warc,
    "op8_bwt": op8_bwt,
    "op9_multiindex": op9_multiindex,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_digest_cache": op12_digest_cache,
    "op13_resample": op13_resample,
}
SQL: dict[str, str] = dict(STATEMENTS)
