"""Operator 12 against the libraries, with an empty, a partly and a wholly filled cache."""

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studylantern.llm import digest_cache as cache
from studylantern.llm import queries

BYTE, WORD, PIECE = (queries.vocabulary(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def expected(rows, path=BYTE, limit=1024):
    if path.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(pieces.encode(text))
    else:
        library = Tokenizer.from_file(path)
        count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    out = []
    for r in rows:
        n = count(r["text"] or "")
        out.append((r["doc_id"], len((r["text"] or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_over_the_table(spark, sf):
    assert found(queries.op12_digest_cache(spark, sf)) == expected(spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_odd_rows(spark, odd_docs, path):
    place = cache.new_cache(spark)
    want = expected(odd_docs.collect(), path)
    assert found(cache.token_counts(odd_docs, path, place)) == want
    assert found(cache.token_counts(odd_docs, path, place)) == want
    assert cache.token_counts(odd_docs.limit(0), path, place).collect() == []
    assert cache.token_counts(odd_docs.limit(0), path, cache.new_cache(spark)).collect() == []


def test_only_misses_are_encoded_and_appended(spark):
    """Stored counts are taken as they are, so a marked one shows that its text was not encoded again."""
    place, version = cache.new_cache(spark), cache.tokenizer_version(BYTE)
    ddl = "doc_id long, text string"
    first = spark.createDataFrame([(1, "one text"), (2, "two text"), (2, "two text")], ddl)
    cache.token_counts(first, BYTE, place).collect()
    assert cache.stored(spark, place, version).count() == 2
    mark = spark.createDataFrame([("marked",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("content"), F.lit(777).cast("long").alias("n_tokens"), F.lit(version).alias("version"))
    mark.write.mode("append").partitionBy("version").parquet(place)
    more = spark.createDataFrame([(7, "marked"), (8, "one text"), (9, "a new text"), (None, "a new text"), (None, "no id"), (None, "no id")], ddl)
    rows = cache.token_counts(more, BYTE, place).collect()
    assert len(rows) == 6 and {r["n_tokens"] for r in rows if r["doc_id"] == 7} == {777}
    written = spark.read.parquet(place)
    assert written.count() == 5 and written.select("content").distinct().count() == 5
    assert cache.stored(spark, place, "another version").count() == 0


def test_copies_share_one_entry(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'the same text', concat('text ', id % 500))").alias("text"), F.lit(1).alias("copies"), F.lit("x").alias("content"))
    place = cache.new_cache(spark)
    rows = found(cache.token_counts(docs, BYTE, place, limit=2))
    assert rows == expected(docs.collect(), limit=2)
    assert spark.read.parquet(place).count() == docs.select("text").distinct().count()


def test_folded_contents_keep_counts(spark):
    texts = ["A  b\n\nC d ", "A b C d", "\tA b C\r\nd", "a b C d", "", None, "   ", "İ Ω\x0bx", "A<|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = cache.new_cache(spark)
    assert found(cache.token_counts(docs, WORD, place, normalise=cache.folded)) == expected(docs.collect(), WORD)
    assert spark.read.parquet(place).count() == 5


def test_versions_differ_by_file():
    assert len({cache.tokenizer_version(p) for p in (BYTE, WORD, PIECE)}) == 3
