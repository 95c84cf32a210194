"""Token counts by a digest cache (operator 12).

The cache is a Parquet table of (version, content, n_tokens): digest of the tokenizer (its file, kind and library release),
digest of the normalised content, and the stored count. Documents are joined to it by digest; only contents without a
count are encoded, each once however many copies there are, and appended. Any part of the cache is right by itself, so a lost job
leaves nothing to repair: what it had not committed is missing and encoded by the next one.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from studylantern.llm.common import settle, shared_folder, total

LIMIT = 1024
#: A content with at least this share of all rows has its count broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 10_000
ENCODE_ROWS = 64
CACHE_SCHEMA = "content binary, n_tokens long, version string"


def exact(text: Column) -> Column:
    """Every character counts; null is the empty text. Right for any tokenizer."""
    return F.coalesce(text.cast("string"), F.lit(""))


def folded(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space, none at the ends: for tokenizers that drop white space. Letters
    stay as they are, since lower-casing could turn a text into the name of a special token."""
    return F.trim(F.regexp_replace(exact(text), "[ \\t\\n\\r]+", " "))


@functools.cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library that a vocabulary file belongs to: tokenizers for .json, sentencepiece for .model. Loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        body = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {body} no special tokens added".encode()).hexdigest()


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content, n_tokens of one tokenizer; runs at the same time may both have appended a content."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:  # nothing has been appended yet
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.filter(F.col("version") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def encode(texts: DataFrame, tokenizer: str) -> DataFrame:
    """content, n_tokens of (content, text). Equal contents of one batch are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            at = {c: k for k, c in enumerate(batch.column(0).to_pylist())}
            first, counts = list(at.values()), []
            for k in range(0, len(first), ENCODE_ROWS):
                counts += count(batch.column(1).take(pa.array(first[k : k + ENCODE_ROWS])).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    limit: int = LIMIT,
    normalise: Callable[[Column], Column] = exact,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Count the tokens of every whole text and keep the counts in the folder `cache`.

    normalise maps texts to contents; it must not change any count. Returns doc_id, n_bytes (UTF-8, of the text; null: 0),
    n_tokens, over_limit. Repeated rows stay; rows without an id too; other columns are ignored.

    Digests are taken in one pass; from there rows are narrow. Only texts of misses are moved: of the rows with a missing
    content, that with the smallest id is encoded, chosen by a pre-aggregated minimum. Where the misses are few Spark
    broadcasts their keys and no text is moved at all. Rows equal in id and text share that choice; they are
    encoded once a batch, and stored once. Contents with many copies get their counts from a broadcast of bounded
    size, so no copy group meets in one task.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    content = F.unhex(F.sha2(normalise(docs[text_col]), 256))
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), normalise(docs[text_col]).alias("text"), content.alias("content"), exact(docs[text_col]).alias("whole"))
    keys = settle(plain.select("doc_id", "content", F.octet_length("whole").cast("long").alias("n_bytes")), "count-keys")
    kinds = settle(keys.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "count-kinds")
    missing = kinds.join(stored(spark, cache, version), "content", "left_anti").withColumnRenamed("content", "missing")
    chosen = plain.join(missing, (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    fresh = encode(chosen, tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    fresh.withColumn("version", F.lit(version)).write.mode("append").option("compression", "zstd").partitionBy("version").parquet(cache)

    counts = kinds.join(stored(spark, cache, version), "content")
    least = max(2, int(total(kinds, "copies") * HOT_SHARE) + 1)
    hot = F.broadcast(counts.filter(F.col("copies") >= least).select("content", "n_tokens"))
    rest = keys.join(hot, "content", "left_anti").join(counts.filter(F.col("copies") < least).select("content", "n_tokens"), "content")
    every = keys.join(hot, "content").unionByName(rest)
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    """Place of an empty cache in the shared folder."""
    return f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
