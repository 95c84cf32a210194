"""Operator 5 against brute force over all pairs, and the statistics of its signatures."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from studylantern.llm import bagminhash as near
from studylantern.llm import common, queries
from studylantern.llm import components as contraction
from studylantern.llm.components import components
from studylantern.llm.hashing import Words


def shingles(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    if not a and not b:
        return 1.0
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(docs):
    """Smallest id of each row's component, by comparing all pairs."""
    kinds = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    where = defaultdict(set)
    for i, k in enumerate(kinds):
        for s in k or [None]:
            where[s].add(i)
    for i, k in enumerate(kinds):
        for j in {j for s in k or [None] for j in where[s] if j < i}:
            if similarity(k, kinds[j]) >= 0.8:
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(d, low[r])
    return [(d, low[find(i)]) for i, (d, _) in enumerate(docs)]


def rows(docs, spark):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, content string, band int")
    return frame, sorted((tuple(r)[:2] for r in near.near_duplicates(frame).select("doc_id", "class_id").collect()), key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for overlap in (0.2, 0.5, 0.9):
        n, m = 60, 4096
        base = rng.integers(1, 12, n)
        other = np.where(rng.random(n) < overlap, base, rng.integers(1, 12, n))
        want = np.minimum(base, other).sum() / np.maximum(base, other).sum()
        kinds = rng.integers(0, 2**63, n).astype(np.uint64)
        text = np.repeat([0, 1], n)
        sig = near.signatures(text, np.tile(kinds, 2), np.concatenate([base, other]), 2, m)
        got = np.mean(sig[0] == sig[1])
        assert np.isfinite(sig).all() and abs(got - want) < 5 * np.sqrt(want * (1 - want) / m)


def test_signatures_do_not_depend_on_the_batch():
    texts = [" ".join(f"w{i % 7}" for i in range(n)) for n in (1, 4, 5, 6, 300)] + [""]

    def of(some):
        data = np.frombuffer("".join(some).encode(), np.uint8)
        words = Words(data, np.cumsum([0, *map(len, some)]))
        return near.signatures(*near.counted(*words.shingles(5)), len(some), 130)

    assert (of(texts) == np.vstack([of([t]) for t in texts])).all()


def test_brute_force_with_copies_and_chains(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 5, 9, 60, 200)))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = word()
            docs.append("\n".join(copy))
    chain = [word() for _ in range(300)]
    for step in range(6):  # each is near the next only
        chain[step * 40 : step * 40 + 18] = [word() for _ in range(18)]
        docs.append(" ".join(chain))
    docs += ["a b a b a b a b a b a b", "a b a b a b a b a b a b a", "a b a b", "a  b\ta b", "", None, " \n", "word " * 30_000, "word " * 29_000]
    numbered = list(enumerate(docs)) + [(3, docs[3]), (None, docs[0]), (None, "only this row has no id and no copy")]
    frame, got = rows(numbered, spark)
    assert got == sorted(classes(numbered), key=str)
    kept = [tuple(r) for r in near.keep_one(frame).collect()]
    ids = {c if c is not None else None for _, c in got}
    assert sorted((r[0] for r in kept), key=str) == sorted(ids, key=str) and all(r[2:] == ("x", 1) for r in kept)
    assert rows(numbered[:0] or [(1, "x")], spark)[1] == [(1, 1)] and near.near_duplicates(frame.limit(0)).count() == 0 and near.keep_one(frame.limit(0)).count() == 0


def test_far_edits_of_one_text_are_compared_with_few(spark):
    """Edited copies too far from their original: some are near each other, most near none; all links are found."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(100)]

    def edited(words, n):
        copy = list(words)
        for i in rng.sample(range(len(copy)), n):
            copy[i] = f"x{rng.randrange(10**9)}"
        cut = rng.randrange(len(copy) - 20)
        return copy if rng.random() < 0.6 else copy[:cut] + copy[cut + rng.randrange(5, 20) :]

    docs = [" ".join(base)]
    for _ in range(60):
        far = edited(base, rng.choice((1, 3, 4, 5, 7)))
        docs.append(" ".join(far))
        if rng.random() < 0.2:
            docs.append(" ".join(edited(far, 1)))
    numbered = list(enumerate(docs))
    assert rows(numbered, spark)[1] == sorted(classes(numbered), key=str)


def test_own_shingles(spark):
    texts = [("a" * 16, "a b c d e f"), ("b" * 16, "a b c d e x x x x x x x"), ("\x80\xff" * 8, "q r s t u v"), ("c" * 16, "b c d e f")]
    frame = spark.createDataFrame([(c.encode("latin-1"), t) for c, t in texts], "content binary, text string")
    own = {bytes(r["content"]).decode("latin-1"): r["own"] for r in near.own_shingles(frame).collect()}
    # a: "b c d e f" is shared with c and "a b c d e" with b; b: all but the first; c shares its only one
    assert own == {"b" * 16: 7, "\x80\xff" * 8: 2}


def test_lacking(spark):
    """Bits are set for what a text has less often; with few cells a bit stands for several neighbouring shingles."""
    long = [f"w{i}" for i in range(304)]
    texts = [(b"a" * 16, " ".join(long)), (b"b" * 16, " ".join(long[:104] + long[204:])), (b"c" * 16, " ".join([*long, *long])), (b"d" * 16, "x x x x x x x"), (b"e" * 16, "x x x x x x")]
    frame = spark.createDataFrame(texts, "content binary, text string")
    pairs = spark.createDataFrame([(b"a" * 16, b"b" * 16), (b"a" * 16, b"c" * 16), (b"c" * 16, b"a" * 16), (b"d" * 16, b"e" * 16), (b"a" * 16, b"e" * 16)], "a binary, b binary")
    for cells in (1024, 64, 30):
        rows = {(bytes(r["a"])[:1] + bytes(r["b"])[:1]).decode(): (r["met"], sum(int(x % 2**64).bit_count() for x in r["lacks"])) for r in near.lacking(pairs, frame, cells).collect()}
        # b has 100 + 96 shingles of a, four new ones at the cut; c has all of a's and repeats them
        assert rows["ac"] == (300, 0) and rows["de"] == (2, 1) and rows["ae"] == (0, min(cells, 300))
        assert rows["ab"][0] == 196 and (rows["ab"][1] == 104 if cells == 1024 else 104 * cells // 300 <= rows["ab"][1] <= 104 * cells // 300 + 2)
        assert rows["ca"][0] == 300 and rows["ca"][1] >= min(cells, 304)


def test_near_copies_without_ids_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words)]
    docs = spark.createDataFrame([(None, t, 7, "own", i) for i, t in enumerate(texts)], "doc_id long, text string, dedup_words long, DEDUP_key string, content int")
    kept = near.keep_one(docs).collect()
    assert len(kept) == 1 and kept[0]["dedup_words"] == 7 and kept[0]["DEDUP_key"] == "own"
    one = near.keep_one(docs.union(docs.limit(1).selectExpr("5L AS doc_id", "text", "1L", "'with id'", "9"))).collect()
    assert [(r["doc_id"], r["DEDUP_key"]) for r in one] == [(5, "with id")]


def test_many_copies_of_one_text(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:50], f"x{i}", *base[50:]])) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(200)] + [(5000, "quite another text of six words")]
    assert Counter(c for _, c in rows(docs, spark)[1]) == {0: 600, 5000: 1}


def test_op5_over_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op5_bagminhash(spark, sf).collect())) == sorted(classes(docs))


def test_components_of_a_path_a_star_and_a_ring(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(30, 50)] + [(61, 62), (62, 63), (63, 61), (70, 70)]
    rng = random.Random(1)
    rng.shuffle(pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(30, 51), 30), 61: 61, 62: 61, 63: 61}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_settled_tables_have_few_files(spark, monkeypatch):
    """A small table is not written as one file for every partition of the session, whatever adaptive execution coalesces."""
    few = common.settle(spark.range(0, 1000, 1, 50), "few", 8)
    assert few.count() == 1000 and len(few.inputFiles()) == 8
    assert common.files_for(0) == common.LEAST_FILES and common.files_for(10**12) == 500_000
    asked = []
    settle = lambda df, name, files=None: asked.append(files) or common.settle(df, name, files)
    for module in (near, contraction):
        monkeypatch.setattr(module, "settle", settle)
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert asked and set(asked) == {common.LEAST_FILES}
