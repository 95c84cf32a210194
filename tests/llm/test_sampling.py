"""Operator 3: edits and neighbours against brute force, likeness against generalised Jaccard similarity."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylantern.llm import queries, sampling


def jaccard(a, b):
    x, y = (Counter(t.split() or [""]) for t in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def edits(docs):
    """(doc_id, text, edited text, next text) in descending order of ids."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(t) // 3
        out.append((d, t, t[: len(t) - cut] + after[:cut], after))
    return out


def check(rows, docs):
    want = {d: r for d, *r in edits(docs)}
    errors = []
    assert len(rows) == len(want)
    for r in rows:
        text, edited, after = want[r["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 4 * sampling.SAMPLES
        split = lambda f: [f[i : i + 4] for i in range(0, len(f), 4)]
        assert r["near_edited"] == np.mean([a == b for a, b in zip(split(r["fingerprint"]), split(r["edited_fingerprint"]), strict=True)])
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
    by_text = {}
    for r in rows:
        assert by_text.setdefault(want[r["doc_id"]][0], r["fingerprint"]) == r["fingerprint"]
    return np.array(errors)


def test_op3_over_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    errors = check(queries.op3_sampling(spark, sf).collect(), docs)
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.06 and np.abs(errors).max() < 0.3


def test_op3_sparse_ids_and_odd_texts(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(20_000))
    texts = ["a b c", "", None, " \n", long, "a b c", "é😀ü ß " * 9, "x", long + " more"]
    ids = [-(2**62), -7, 0, 1, 63, 64, 2**40, 2**40 + 64, 2**62]
    docs = list(zip(ids, texts, strict=True))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, place int, `group` string")
    check(sampling.fingerprints(frame).collect(), docs)
    check(sampling.fingerprints(frame.limit(1)).collect(), docs[:1])
    assert sampling.fingerprints(frame.limit(0)).count() == 0
    repeated = sampling.fingerprints(frame.union(frame).union(frame.select(F.lit(None).cast("long").alias("doc_id"), "text", "place", "group")))
    assert repeated.count() == 27 and repeated.filter("doc_id IS NULL").count() == 9


def test_rows_without_an_id_spread_over_groups(spark):
    ids = [5, 70, -(2**63)]
    docs = spark.createDataFrame([*((i, f"own {i}") for i in ids), *((None, f"text {i}") for i in range(3000))], "doc_id long, text string")
    rows = sampling.with_next(docs, 4).select("group", "doc_id", "text", "next_text").collect()
    assert max(Counter(r["group"] for r in rows).values()) < 400
    nameless = [r["text"] for r in docs.filter("doc_id IS NULL").orderBy(F.xxhash64("text")).collect()]
    chain = [(i, f"own {i}") for i in sorted(ids, reverse=True)] + [(None, t) for t in nameless]
    want = {(*a, b[1]) for a, b in zip(chain, [*chain[1:], chain[0]], strict=True)}
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in rows} == want and len(rows) == len(want)


def test_successors(spark):
    keys = sorted({*range(0, 30_000, 7), -5, -(2**57), 2**57, 2**30, 2**30 + 1})
    got = {r["key"]: r["next"] for r in sampling.successors(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None], strict=True))


def test_op3_plan_has_no_python_and_one_exchange_of_texts(spark, sf):
    out = queries.op3_sampling(spark, sf)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Python" not in plan and "Arrow" not in plan and "ReusedExchange" in plan


def test_bids_above_the_limit_are_not_worked_out_and_change_no_sample(spark):
    texts = [" ".join(f"w{(i * 31 + j * j) % 4001}" for j in range(300)) for i in range(150)] + ["", "one", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    numbers = spark.createDataFrame([(t, c, bound) for t in range(2000) for c in range(2) for bound in (sampling.MOST / 300, None)], "term long, chunk int, limit double")
    r0 = sampling.draws(numbers, ["limit"]).groupBy("limit").agg(F.count("r0").alias("r"), F.count("n3").alias("n"), F.count("*").alias("all")).collect()
    worked = {r["limit"]: (r["r"] / r["all"], r["n"] / r["all"]) for r in r0}
    assert worked[None] == (1, 1) and max(worked[sampling.MOST / 300]) < 0.5
    want = sorted(map(tuple, sampling.fingerprints(docs).collect()))
    assert sorted(map(tuple, sampling.fingerprints(docs, most=None).collect())) == want
    with pytest.raises(Exception, match="a lowest bid lies above"):  # told, not passed over
        sampling.fingerprints(docs, most=0.5).collect()
