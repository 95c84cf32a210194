"""The pipeline, stage by stage, against brute force on the small tables."""

import re
from collections import Counter

import corpus_pipeline
from test_near import classes
from test_tokens import check_packing

from studylantern.llm.common import settle


def without_passages(docs, width=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = {}
    for (doc_id, text), w in zip(docs, split, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[doc_id] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"]}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * (len(labels) - len(good))
    first = [(r["doc_id"], r["text"]) for r in seen["quality"]]
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted({c for _, c in classes(first)})
    second = [(r["doc_id"], r["text"]) for r in seen["near_dedup"]]
    third = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    assert third == without_passages(second)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"])
    check_packing(seen["packing"], {d: [t] for d, t in third.items()}, 2048)


def test_run_gives_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


def test_pipeline_without_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_stages_keep_columns_of_any_name(spark, sf):
    """Columns named like internal ones go through all filtering stages with their values."""
    extra = ("q_evidence", "Q_site", "q_score", "p_kept", "P_words", "dedup_words", "dedup_key", "class_key", "row", "k")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("*", *[docs["doc_id"].cast("string").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = settle(stage(spark, docs, sf), name)
        assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) > 50 and all(r[c] == str(r["doc_id"]) for r in rows for c in extra)
