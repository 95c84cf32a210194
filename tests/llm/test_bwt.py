"""Operator 8 against brute force over all strings, and its transforms against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylantern.llm import bwt, queries


def expected_bytes(docs, width):
    """Rows of equal id and text are one document."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs}, key=lambda r: r[:2])
    seen, found = set(), {}
    for known, d, t in order:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if s in seen:
                gone[i : i + width] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        found[(d if known else None, t)] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *found[(d, t or "")]) for d, t in docs), key=str)


def got_bytes(frame, **options):
    return sorted((tuple(r) for r in bwt.digests(frame, **options).collect()), key=str)


def planted(rng, n, letters, longest):
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 260))) for _ in range(10)]
    docs = []
    for _ in range(n):
        text = ""
        while len(text) < rng.randrange(longest):
            piece = rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
            cut = rng.randrange(len(piece) + 1)
            text += rng.choice((piece, piece[cut:], piece[:cut]))
        docs.append(text)
    return docs


@pytest.mark.parametrize(("width", "gram", "letters", "many"), [(100, 16, "abcdé 😀\n", 2000), (100, 16, "ab", 1), (40, 5, "xyz", 2), (30, 16, "abcdefgh", 2000)])
def test_op8_brute_force(spark, width, gram, letters, many):
    docs = planted(random.Random(width + many), 50, letters, 700)
    docs += ["a" * 3000, "ab" * 200, "b" * (width - 1), "q" * width, "é" * width, "", None, "".join(chr(97 + i * i % 26) for i in range(60_000))]
    docs = [(i * 3 - 20, t) for i, t in enumerate(docs)] + [(-14, docs[2]), (None, docs[7]), (None, docs[8]), (10**6, docs[-1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, block string, k int")
    assert got_bytes(frame, width=width, gram=gram, shard_bytes=5000, many_kinds=many) == expected_bytes(docs, width)
    out = bwt.remove_repeats(frame, width=width, gram=gram)
    assert out.columns == [*frame.columns, "b_bytes", "b_removed", "b_spans", "b_kept"] and out.count() == len(docs)


def test_op8_over_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op8_bwt(spark, sf)
    assert sorted(map(tuple, out.collect())) == sorted(expected_bytes(docs, 100))
    assert bwt.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_merged_order_and_prefixes():
    rng = random.Random(2)
    for trial in range(20):
        letters = rng.choice(("ab", "abcde", "a"))
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))).encode() for _ in range(9)]
        cuts = [0, 2, 3, 7, 9]
        shard, place, prefix = bwt.merge([bwt.transform(texts[a:b], 16) for a, b in zip(cuts, cuts[1:], strict=False)], 16)
        suffixes = []
        for s, p in zip(shard.tolist(), place.tolist(), strict=True):
            joined, at = texts[cuts[s] : cuts[s + 1]], p
            for t in joined:
                if at <= len(t):
                    suffixes.append(t[at:])
                    break
                at -= len(t) + 1
        short = [x[:16] for x in suffixes]
        assert len(short) == sum(len(t) + 1 for t in texts) and short == sorted(short)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix.tolist()[1:] == [common(a, b) for a, b in zip(short, short[1:], strict=False)], trial


@pytest.mark.parametrize("length", [92, 150])
def test_a_passage_in_most_documents_fills_no_merge_group(spark, monkeypatch, length):
    """Every document holds the passage between words of its own: no block is equal to another, and all share their core."""
    rng, sizes, merged = random.Random(length), [], bwt.merged_spans
    word = lambda n, letters="abcdefghij ": "".join(rng.choice(letters) for _ in range(n))
    passage = word(length)
    docs = [(i or None, word(rng.randrange(40)) + word(3, "abc") + passage + word(3, "abc") + word(60)) for i in range(300)]

    def watched(cut, *rest):
        sizes.append(cut.groupBy("group").agg(F.sum(F.octet_length("bytes")).alias("size")).agg(F.max("size")).first()[0] or 0)
        return merged(cut, *rest)

    monkeypatch.setattr(bwt, "merged_spans", watched)
    monkeypatch.setattr(bwt, "GROUP_BYTES", 4000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_bytes(frame, gram=16, many_kinds=20) == expected_bytes(docs, 100)
    assert 0 < max(sizes) < 12_000


def test_merge_reads_only_open_intervals(monkeypatch):
    """Suffixes that have parted from their neighbours are sorted no more: about as many symbols as common prefixes are long."""
    rng, sorted_, plain = random.Random(6), [0], np.argsort
    texts = ["".join(rng.choice("abcdefgh") for _ in range(130)).encode() for _ in range(300)]
    texts += [t[40:] + b"z" for t in texts[:10]]

    def counting(x, *args, **named):
        sorted_[0] += len(x)
        return plain(x, *args, **named)

    monkeypatch.setattr(np, "argsort", counting)
    found = bwt.repeated_starts(texts, [(True, i, 0, 0) for i in range(len(texts))], [max(0, len(t) - 79) for t in texts], 80, 8_000)
    assert [int(f.sum()) for f in found] == [0] * 300 + [11] * 10
    assert sorted_[0] < 30 * sum(map(len, texts))


def test_hashes_of_all_runs():
    symbols = bwt.BYTE_HASH[np.frombuffer(b"some bytes, some more bytes", np.uint8)]
    windows, starts = bwt.Windows(symbols, bwt.WORD_BASE), np.arange(len(symbols) - 4)
    assert (windows.runs(5) == windows.of(starts, starts + 5)).all()


def test_merge_moves_by_four_symbols(monkeypatch):
    """Strings that stay together for all of the width take a pass for every four symbols."""
    rng, summed, plain = random.Random(9), [0], np.cumsum
    passages = ["".join(rng.choice("abcdefgh") for _ in range(140)) for _ in range(40)]
    texts = [(rng.choice("xyz") + rng.choice(passages) + rng.choice("xyz")).encode() for _ in range(400)]

    def counting(x, *args, **named):
        summed[0] += len(x)
        return plain(x, *args, **named)

    monkeypatch.setattr(np, "cumsum", counting)
    for width in (97, 98, 99, 100):
        summed[0] = 0
        found = bwt.repeated_starts(texts, [(True, i, 0, 0) for i in range(len(texts))], [len(t) - width + 1 for t in texts], width, 8_000)
        seen = set()
        for text, again in zip(texts, found, strict=True):
            strings = [text[i : i + width] for i in range(len(text) - width + 1)]
            assert again.tolist() == [s in seen for s in strings]
            seen.update(strings)
        assert summed[0] < 60 * sum(map(len, texts))
