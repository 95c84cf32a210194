"""Operators 2, 4 and 6 against the tokenizers library and exact round trips."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from studylantern.llm import bpe, grammar, packing, queries
from studylantern.llm.common import settle, shared_folder

BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
ODD = [
    "", " ", "a", "  a  b ", "hello's we'll\n\n x <|endoftext|> y<|startoftext|>z", "ﬁ é ́x ΑΣ ΑΣΑ İ", "a\x1cb\x1f c\x85d\xa0e　f​g", "١٢٣ 12a b\t\tc   d",
    "日本語 テキスト", "😀😀 ok!!", "à́ \r\n x", "x " + "ab" * 3000, "�\U0010ffff", " lead", "trail ", "trail\n", "don't 'S 'll it's,'s x''re l'été ÑANDÚ'S 5'm ª º × a÷b",
]


def u4(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("entries", [3, 100_000])
def test_encoders_match_the_library(entries):
    for path, kind in ((BYTE, bpe.ByteBpe), (WORD, bpe.WordEncoder)):
        library, own = Tokenizer.from_file(path), kind(path, entries)
        for text in ODD + ODD[::-1]:
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == u4(ids), text
            if kind is bpe.ByteBpe:
                assert own.decode(u4(ids)) == library.decode(ids, skip_special_tokens=False)


def test_decode_replaces_broken_bytes():
    library, own = Tokenizer.from_file(BYTE), bpe.ByteBpe(BYTE)
    for ids in ([5, 222, 50256, 19526, 119, 17], [222, 223, 224], [147, 255, 0]):
        assert own.decode(u4(ids)) == library.decode(ids, skip_special_tokens=False)


def test_op2_over_the_table(spark, sf):
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())] += 1
    assert Counter(map(tuple, queries.op2_bpe(spark, sf).collect())) == want


def test_op2_odd_rows(odd_docs):
    rows = bpe.encoded_digests(odd_docs, BYTE).collect()
    assert len(rows) == 9 and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert bpe.encoded_digests(odd_docs.limit(0), BYTE).count() == 0


def check_packing(rows, docs, window):
    library = Tokenizer.from_file(WORD)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, copies in docs.items():
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r["start"])
        ids = library.encode(copies[0] or "", add_special_tokens=False).ids + [1]
        seen = Counter()
        for r in pieces:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(u4(piece)) and r["doc_tokens"] == len(ids)
            seen.update(range(r["start"], r["start"] + r["length"]))
        assert set(seen) == set(range(len(ids))) and set(seen.values()) == {len(copies)}
    assert not by_doc
    for placed in by_sequence.values():
        at = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_sequence


def test_op4_over_the_table(spark, sf):
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    placed = check_packing(queries.op4_packing(spark, sf).collect(), docs, 2048)
    sizes = [sum(r["length"] for r in rows) for rows in placed.values()]
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.05 * sum(sizes)


def test_op4_odd_rows(odd_docs):
    docs = {}
    for r in odd_docs.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    check_packing(packing.pack_documents(odd_docs, WORD).collect(), docs, 2048)
    assert packing.pack_documents(odd_docs.limit(0), WORD).count() == 0


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(3)
    for bins in (2, 7, 64):
        for left in (rng.integers(0, 50, bins + 1), np.eye(bins + 1, dtype=np.int64)[bins // 2 + 1] * 99, np.zeros(bins + 1, np.int64)):
            left[0] = 0
            used = np.zeros(bins + 1, np.int64)
            for shape, n in packing.plan(left):
                assert n > 0 and sum(b * k for b, k in shape.items()) <= bins
                for b, k in shape.items():
                    used[b] += n * k
            assert (used == left).all()


def test_least_squares_has_no_better_neighbour():
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 9)), rng.random(6)
    x = packing.least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max() < 1e-6


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 2), (50, 1), (5000, 3), (5000, 400)):
        ids = rng.integers(0, kinds, n)
        last = rng.random(n) < 0.02
        last[-1] = True
        rules, symbols, ends = grammar.compress(ids, last)
        assert (grammar.expand(symbols, rules) == ids).all()
        sizes = np.concatenate((np.ones(grammar.TERMINALS, np.int64), grammar.expansion_lengths(rules)))[symbols]
        assert (np.cumsum(sizes)[ends] - 1 == np.flatnonzero(last)).all()
        assert n < 5000 or kinds > 3 or len(symbols) < n / 3


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 40_000, 300)
    for ids in (rng.integers(0, 300, 60_000), rng.zipf(1.3, 60_000) % 40_000, np.tile(phrase, 50), np.zeros(50_001, np.int64), np.repeat(rng.integers(0, 9, 2000), rng.integers(1, 9, 2000))):
        last = rng.random(len(ids)) < 0.001
        last[-1] = True
        rules, symbols, ends = grammar.compress(ids, last)
        assert (grammar.expand(symbols, rules) == ids).all()
        found, before = Counter(), None
        for a, b, end in zip(symbols.tolist(), symbols[1:].tolist(), ends[:-1].tolist(), strict=False):
            before = None if end or before == (a, b) else (a, b)  # an occurrence that overlaps the one before does not count
            if before:
                found[before] += 1
        assert max(found.values(), default=0) < grammar.LEAST


def test_op6_over_the_table(spark, sf):
    library, want, start = Tokenizer.from_file(WORD), [], 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(u4(ids))))
        start += len(ids)
    assert sorted(map(tuple, queries.op6_repair(spark, sf).collect())) == want


def test_op6_random_access(spark, sf, odd_docs):
    path = f"{shared_folder(spark)}/test-ids-{id(odd_docs)}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grammar.write_ids(docs, path, WORD, block_ids=3000)
    every = {r["doc_id"]: tuple(r) for r in grammar.read_ids(spark, path).collect()}
    some = [tuple(r) for r in grammar.read_ids(spark, path, 17, 23).collect()]
    assert sorted(some) == [every[i] for i in range(17, 24)] and len(every) == docs.count()
    rows = grammar.ids_digests(odd_docs, WORD).collect()
    assert len(rows) == 9 and sorted(r["n_tokens"] for r in rows)[:2] == [1, 1]
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert grammar.ids_digests(odd_docs.limit(0), WORD).count() == 0


def test_settled_tables_keep_rows(spark):
    assert settle(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t").count() == 5


@pytest.mark.parametrize("entries", [3, 100_000])
def test_word_encoder_takes_texts_together(entries):
    library, own = Tokenizer.from_file(WORD), bpe.WordEncoder(WORD, entries)
    texts = [*ODD, "ÉCOLE École, straße STRASSE ÿŸ ×÷ª", "x" * 31 + "é" * 9 + " " + "=" * 70, "İé É́ H̱ <|ENDOFTEXT|>", "a b c　d\x85", ""]
    for repeat in range(2):
        raw = [t.encode() for t in texts]
        ids, bounds = own.encode_texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        for text, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist(), strict=False):
            assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], (repeat, text)


def test_grammar_recounts_only_places_that_changed(monkeypatch):
    """A long passage that recurs needs many rounds; they read its places, not the whole block."""
    rng, read, plain = np.random.default_rng(8), [0], np.bincount
    passage = rng.integers(0, 40_000, 400)
    ids = np.concatenate([np.concatenate((passage, rng.integers(0, 40_000, 9_600))) for _ in range(10)])
    last = np.zeros(len(ids), bool)
    last[9_999::10_000] = True

    def counting(x, *args, **named):
        read[0] += len(x)
        return plain(x, *args, **named)

    monkeypatch.setattr(np, "bincount", counting)
    rules, symbols, _ = grammar.compress(ids, last)
    assert len(rules) > 300 and (grammar.expand(symbols, rules) == ids).all()
    assert read[0] < 12 * len(ids)


def test_packing_reads_texts_together(monkeypatch, spark):
    """Pieces come from the encoder of many texts: one text at a time is not asked for."""
    batches = []
    monkeypatch.setattr(packing, "worker_encoder", lambda kind, path: type("Seen", (), {"encode_texts": lambda self, data, at, end: batches.append(len(at) - 1) or bpe.WordEncoder(path).encode_texts(data, at, end)})())
    taken = {}
    docs = type("Docs", (), {"selectExpr": lambda self, *_: self, "mapInArrow": lambda self, run, schema: taken.update(run=run)})()
    packing.cut_pieces(docs, WORD, window=4)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([7, None, 8], pa.int64()), pa.array(["a b c d e f", None, "a b c"], pa.string())], ["doc_id", "text"])
    (out,) = taken["run"](iter([batch]))
    assert batches == [3]
    assert [tuple(r.values())[:3] + (r["doc_tokens"],) for r in out.to_pylist()] == [(7, 0, 4, 7), (7, 4, 3, 7), (None, 0, 1, 1), (8, 0, 4, 4)]


def test_compressing_a_block_takes_little_memory_and_lengths_are_those_of_the_rules():
    ids = np.array([(i * 31 + i * i) % 9973 for i in range(300_000)], np.uint32)
    last = np.arange(1, len(ids) + 1) % 100 == 0
    tracemalloc.start()
    try:
        rules, symbols, ends = grammar.compress(ids, last)
        assert tracemalloc.get_traced_memory()[1] < 100 * len(ids)
    finally:
        tracemalloc.stop()
    sizes = []
    for pair in rules.tolist():
        sizes.append(sum(1 if x < grammar.TERMINALS else sizes[x - grammar.TERMINALS] for x in pair))
    assert len(rules) and grammar.expansion_lengths(rules).tolist() == sizes
    assert grammar.expansion_lengths(rules[:0]).tolist() == []
    assert (grammar.expand(symbols, rules) == ids).all() and ends.sum() == last.sum()
