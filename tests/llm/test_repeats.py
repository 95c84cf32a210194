"""Operator 1 against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from studylantern.llm import bwt, phrases, queries
from studylantern.llm.hashing import Words


def expected_words(docs, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(rng, n=60, vocabulary=30, longest=160):
    """Documents that share stretches of many lengths, within and across documents."""
    word = lambda: f"é{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    docs = []
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(longest):
            piece = rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
            cut = rng.randrange(len(piece) + 1)
            words += rng.choice((piece, piece[cut:], piece[:cut]))
        docs.append(rng.choice((" ", "\n", "\t \x0b", "\x0c\r")).join(words))
    return docs


def got_words(frame, **options):
    return sorted((tuple(r) for r in phrases.digests(frame, **options).collect()), key=str)


@pytest.mark.parametrize(("width", "gram", "vocabulary"), [(35, 8, 2000), (12, 4, 3), (6, 6, 8), (1, 1, 40)])
def test_op1_brute_force(spark, width, gram, vocabulary):
    docs = planted(random.Random(width), vocabulary=vocabulary)
    docs += ["a " * 500, "b " * 34, "b " * 35, "b " * 36 + "c " * 40, "", None, "x y z" + "\x1c q", "w " * 20_000, " ".join(f"v{i}" for i in range(5000))]
    docs = list(enumerate(docs)) + [(3, docs[3]), (None, docs[5]), (None, "alone")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, block string, shard int")
    assert got_words(frame, width=width, gram=gram, shard_bytes=3000) == expected_words(docs, width)
    whole = phrases.remove_repeated(frame, width=width, gram=gram)
    assert whole.columns == [*frame.columns, "p_words", "p_removed", "p_spans", "p_kept"] and whole.count() == len(docs)
    assert phrases.remove_repeated(frame.limit(0)).count() == 0


def test_op1_over_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op1_phrases(spark, sf).collect())) == sorted(expected_words(docs, 35))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 6, 4000)).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, 1500, 1500, len(text)]))
    number, first, n, anchor = phrases.blocks(words, 9, 3)
    own = {}
    for f, k, a in zip(first, n, anchor, strict=True):
        for s in range(f, f + k):
            assert own.setdefault(int(words.runs.of(np.array([s]), np.array([s + 9]))[0]), a) == a
    counts = np.diff(words.bounds)
    assert n.sum() == np.maximum(counts - 8, 0).sum() and set(number) == {0, 2}


def test_counting_steps_leave_rows_behind(spark):
    """The steps that read texts for windows and pieces neither shuffle nor decode the whole rows."""
    keyed = spark.range(4).selectExpr("id AS k", "repeat('a b ', 30) AS text", "named_struct('id', id, 'text', repeat('a b ', 30)) AS row")
    ask = "id AS k, cast(0 AS int) AS first, cast(5 AS int) AS n"
    windows = phrases.window_rows(keyed, spark.range(4).selectExpr(*ask.split(", "), "id AS block", "1L AS count"), 2)
    cuts = bwt.pieces(keyed, spark.range(4).selectExpr(*ask.split(", "), "id AS doc_id", "id AS anchor", "cast(0 AS int) AS at", "false AS many"), 2, 100)
    assert cuts.count() == 4
    for frame in (windows, cuts):
        assert "struct" not in frame._jdf.queryExecution().optimizedPlan().toString()
