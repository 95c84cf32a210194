"""Operator 13 against plain Python and its reference SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from studylantern.llm import queries, resample

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text):
    words = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return words, [zlib.crc32(x) % 10_000 for x in words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]]


def expected(docs, target, share=25):
    s, t = Counter(), Counter()
    bags = [(d, *features(x)) for d, x in docs]
    for _, _, f in bags:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0)))) for b in range(10_000)]
    rows = []
    for d, words, f in bags:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_over_the_table(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = found(queries.op13_resample(spark, sf))
    assert rows == expected(pairs(docs), [r["text"] for r in target.collect()])
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert sorted(duck.execute(queries.SQL["op13_resample"]).fetchall(), key=repr) == rows


def test_odd_rows(spark, odd_docs):
    words = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(i % 7 if i % 5 else None, f"{words} {i % 3} ÄÖ{'é' * 70}", None, None) for i in range(60)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema)).withColumn("rank", F.lit("x")).withColumn("score", F.lit(None))
    target = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    assert found(resample.resample(docs, target)) == expected(pairs(docs), ["a b c"])
    assert found(resample.resample(docs, target.limit(0))) == expected(pairs(docs), [])
    assert resample.resample(docs.limit(0), target).collect() == []
    few = docs.filter("length(text) < 30")
    assert all(r["rank"] is None for r in resample.resample(few, target).collect())


def test_hashes_are_crc32():
    rng = np.random.default_rng(4)
    texts = ["", "a", "A b", "-- ", "ß" * 40 + " x " + "y" * 64 + " " + "z" * 65, "x" * 500 + " tail"]
    texts += ["".join(rng.choice(list("ab Z9-é日\t"), 200)) for _ in range(30)]
    raw = [t.encode() for t in texts]
    words, joined, bounds, owner = resample.feature_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    want_words, want_pairs, at = [], [], [0]
    for t in texts:
        own, _ = features(t)
        want_words += map(zlib.crc32, own)
        want_pairs += [zlib.crc32(a + b" " + b) for a, b in zip(own, own[1:], strict=False)]
        at.append(len(want_words))
    assert words.tolist() == want_words and joined.tolist() == want_pairs and bounds.tolist() == at and len(owner) == len(joined)


@pytest.mark.parametrize("share", [0, 1, 33, 100])
def test_draw_with_ties(spark, share):
    """Equal scores and ids around the cutoff: exactly the wanted number is drawn, in order."""
    rows = [(i % 40, 25, 10, 0, (i * i) % 6) for i in range(400)] + [(None, 25, 10, 0, 3)] * 5 + [(1, 2, 10, 0, 99)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    k = share * 405 // 100
    drawn = resample.draw(table, k, 405, F.col("n_words") >= 20).collect()
    assert len(drawn) == 406
    got = [(r["score"], r["doc_id"]) for r in sorted((r for r in drawn if r["rank"]), key=lambda r: r["rank"])]
    want = sorted(((r[4], r[0]) for r in rows if r[1] >= 20), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert got == want[:k] and sorted(r["rank"] for r in drawn if r["rank"]) == list(range(1, k + 1))


def test_a_wrong_bracket_is_widened(spark):
    table = spark.range(5000).selectExpr("id % 1000 AS score")
    for k in (1, 1234, 5000):
        low, high, above = resample.bracket(table, k, 5000, accuracy=20)
        cut = 999 - (k - 1) // 5
        assert low <= cut <= high and above == (999 - high) * 5


def test_drawn_rows_resemble_the_target(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.expr("repeat('red green blue ', 10)")).otherwise(F.expr("repeat('one two three ', 10)")).alias("text"))
    drawn = resample.resample(docs, spark.createDataFrame([("green blue red green",)], "text string")).filter("rank is not null")
    assert drawn.count() == 500 and drawn.filter("doc_id % 4 = 0").count() > 250
