"""Substring dedup by repeated-phrase automata (operator 1).

A window is `width` consecutive words of one document; words covered by a window that also starts elsewhere are removed.

1. Each window has an anchor, its smallest run of `gram` words; windows with the same anchor lie side by side and form a
   block. Equal windows have equal anchors, so only blocks with an anchor that recurs are looked at further.
2. Recurring passages are confirmed. Blocks that recur as a whole are repeated throughout. Of the other blocks with a
   recurring anchor one example each is compared with the others window by window: sums of counts by window.
3. Documents are dealt to shards of bounded size. Each shard gets one example of every confirmed passage its documents
   hold, compiles them to an Aho-Corasick automaton over word numbers, and streams all its documents through it:
   every occurrence of a passage is located, word by word.

Rows of the counting steps are a few numbers for about each 15 words and are pre-aggregated before they are shuffled, so
passages that a third of all documents share are no hot spot. Texts are shuffled twice, by shard. Windows are compared by
64-bit hashes of their words; the automata compare the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylantern.llm.common import files_for, in_slices, parts, settle, total, utf8
from studylantern.llm.hashing import Words

WIDTH, GRAM = 35, 8
SLICE_BYTES = 1_000_000
#: Text of a shard, about: a task holds one shard's documents and their automaton.
SHARD_BYTES = 6_000_000
BLOCK_SCHEMA = "anchor long, block long, k long, first int, n int"


def lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each `span` neighbours."""
    step = 1
    while 2 * step <= span:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values if step == span else np.minimum(values[: len(values) - (span - step)], values[span - step :])


def blocks(words: Words, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows and anchor of each block; windows are numbered by their first word overall."""
    n = len(words.hash)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    starts = np.arange(n - gram + 1)
    grams = words.runs.of(starts, starts + gram)
    place = np.uint64(max(1, int(n).bit_length()))
    keys = ((grams >> place) << place) | starts.astype(np.uint64)  # equal grams: the leftmost is the anchor
    anchor = (lowest(keys, width - gram + 1) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(words.bounds, np.arange(n - width + 1), side="right") - 1
    inside = np.arange(n - width + 1) + width <= words.bounds[text + 1]
    cut = np.flatnonzero(inside & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1])))
    stop = np.flatnonzero(inside & np.concatenate(((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[1:], [True]))) + 1
    return text[cut], cut, stop - cut, grams[anchor[cut]]


def block_rows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """anchor, block (hash of its words), k (the document), first (window within the document) and n (windows). docs: k, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            words = Words(*utf8(batch, "text"))
            text, first, n, anchor = blocks(words, width, gram)
            block = words.runs.of(first, first + n + width - 1)
            k = batch.column("k").to_numpy(zero_copy_only=False)[text]
            arrays = [anchor.view(np.int64), block.view(np.int64), k, (first - words.bounds[text]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["anchor", "block", "k", "first", "n"])

    return docs.select("k", "text").mapInArrow(run, BLOCK_SCHEMA)


def bare(keyed: DataFrame) -> DataFrame:
    """Documents (k, text, row) for steps that do not return their rows: these are neither shuffled nor sent to Python."""
    return keyed.select("k", "text", F.lit(None).cast("int").alias("row"))


def by_shard(keyed: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """Rows of wanted (k, first, and more) before the documents (k, text, row) of the same shard, shard by shard."""
    extra = [c for c in wanted.columns if c != "k"]
    docs = keyed.select(F.lit(1).alias("kind"), "k", "text", "row", *(F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra))
    asks = wanted.select(F.lit(0).alias("kind"), "k", F.lit(None).cast("string").alias("text"), F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), *extra)
    both = docs.union(asks).withColumn("shard", F.pmod("k", F.lit(shards)))
    return both.repartition(max(parts(keyed), shards), "shard").sortWithinPartitions("shard", "kind")


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The wanted rows and the documents of each shard in turn."""
    held: list[pa.RecordBatch] = []

    def split() -> tuple[pa.Table, pa.Table]:
        rows = pa.Table.from_batches(held)
        cut = int(np.searchsorted(rows.column("kind").to_numpy(), 1))
        return rows.slice(0, cut), rows.slice(cut)

    now = None
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and shard[a] != now:
                yield split()
                held = []
            now = shard[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield split()


def window_rows(keyed: DataFrame, examples: DataFrame, shards: int, width: int = WIDTH) -> DataFrame:
    """block, at (window within it), window (hash) and count for each window of the example blocks. examples: k, first, n, block, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, docs in shards_of(batches):
            wanted: dict[int, list[tuple]] = {}
            for k, *ask in zip(*(asks.column(c).to_pylist() for c in ("k", "first", "n", "block", "count")), strict=True):
                wanted.setdefault(k, []).append(ask)
            for k, text in zip(docs.column("k").to_pylist(), docs.column("text"), strict=True):
                if k not in wanted:
                    continue
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                words = Words(raw, np.array([0, len(raw)]))
                first, n, block, count = (np.array(x, np.int64) for x in zip(*wanted.pop(k), strict=True))  # once, also for repeated rows
                if (first + n + width - 1 > len(words.hash)).any():
                    continue
                same = words.runs.of(first, first + n + width - 1).view(np.int64) == block
                first, n, block, count = first[same], n[same], block[same], count[same]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first, n) + at
                arrays = [np.repeat(block, n), at.astype(np.int32), words.runs.of(start, start + width).view(np.int64), np.repeat(count, n)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["block", "at", "window", "count"])

    return by_shard(bare(keyed), examples, shards).mapInArrow(run, "block long, at int, window long, count long")


def confirmed(keyed: DataFrame, shards: int, width: int = WIDTH, gram: int = GRAM, files: int | None = None) -> DataFrame:
    """k, first and mask: for each shard one example of every block with repeated windows, and which of its windows are."""
    every = settle(block_rows(keyed, width, gram), "blocks", files)
    recurring = settle(every.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "anchors", files)
    every = settle(every.join(recurring, "anchor"), "recurring", files)
    kinds = settle(every.groupBy("anchor", "block").agg(F.count("*").alias("count"), F.min(F.struct("k", "first", "n")).alias("x")), "kinds", files)
    mixed = settle(kinds.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "mixed", files)
    examples = kinds.join(mixed, "anchor").select("x.*", "block", "count")
    windows = settle(window_rows(keyed, examples, shards, width), "windows", files)
    again = settle(windows.groupBy("window").agg(F.sum("count").alias("c")).filter("c > 1").drop("c"), "again", files)
    some = windows.join(again, "window").groupBy("block").agg(F.expr("bit_or(shiftleft(1L, at))").alias("some"))
    whole = kinds.filter("count > 1").select("block", F.lit(-1).cast("long").alias("some"))
    masks = settle(some.union(whole).groupBy("block").agg(F.bit_or("some").alias("mask")), "masks", files)
    # a block has one row a shard before it meets its mask, however many documents hold it
    found = every.groupBy(F.pmod("k", F.lit(shards)).alias("shard"), "block").agg(F.min(F.struct("k", "first", "n")).alias("x"))
    return found.join(masks, "block").select("x.*", "mask")


def passages(text: list[bytes], first: int, n: int, mask: int, width: int) -> Iterator[list[bytes]]:
    """The runs of neighbouring repeated windows of a block."""
    j = 0
    while j < n:
        if mask >> j & 1:
            a = j
            while j < n and mask >> j & 1:
                j += 1
            yield text[first + a : first + j - 1 + width]
        j += 1


def compile_automaton(phrases: Iterator[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """An automaton over word numbers whose values are phrase lengths, and the numbers (from 1) of the words in it."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in phrase]), len(phrase))
    if len(automaton):
        automaton.make_automaton()
    return automaton, numbers


def covered(words: list[bytes], automaton: ahocorasick.Automaton, numbers: dict[bytes, int]) -> list[tuple[int, int]]:
    """Spans of words, merged, that lie within an occurrence of a phrase."""
    spans: list[tuple[int, int]] = []
    for end, length in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
        first, last = end + 1 - length, end + 1
        while spans and spans[-1][1] >= first:
            first = min(first, spans.pop()[0])
        spans.append((first, last))
    return spans


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with p_words, p_removed, p_spans (removed runs of words, [first, last)) and p_kept (the other words, by one space).

    Words are stretches without space, tab, line feed, vertical tab, form feed and carriage return. Windows are judged on the
    input. `prefix` names the added columns; take another one (`free_name`) where docs has such columns. A null text has no words. Repeated rows count as documents of their own, so their windows are repeated.
    """
    if not 0 < gram <= width <= 63:
        raise ValueError("0 < gram <= width <= 63 is required")
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    size = total(docs, F.octet_length(text_col))
    shards, files = max(parts(docs), size // shard_bytes), files_for(size)
    wanted = settle(confirmed(keyed, shards, width, gram, files), "wanted", files)
    added = [T.StructField("p_words", T.LongType()), T.StructField("p_removed", T.LongType()), T.StructField("p_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("p_kept", T.StringType())]
    schema = T.StructType([T.StructField("row", docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, shard in shards_of(batches):
            if not shard.num_rows:
                continue
            wanted: dict[int, list[tuple]] = {}
            for k, *ask in zip(*(asks.column(c).to_pylist() for c in ("k", "first", "n", "mask")), strict=True):
                wanted.setdefault(k, []).append(ask)
            ids, texts = shard.column("k").to_pylist(), shard.column("text")
            named = ((texts[i].as_py().encode().split(), wanted.pop(k)) for i, k in enumerate(ids) if k in wanted)
            automaton, numbers = compile_automaton(p for words, asked in named for ask in asked for p in passages(words, *ask, width))
            for piece in shard.to_batches(max_chunksize=500):
                sizes, gone, runs, kept = [], [], [], []
                for text in piece.column("text"):
                    words = text.as_py().encode().split()
                    spans = covered(words, automaton, numbers) if numbers else []
                    rest, at = [], 0
                    for a, b in spans:
                        rest += words[at:a]
                        at = b
                    rest += words[at:]
                    sizes.append(len(words))
                    gone.append(len(words) - len(rest))
                    runs.append([list(s) for s in spans])
                    kept.append(b" ".join(rest).decode())
                arrays = [piece.column("row"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "p_words", "p_removed", "p_spans", "p_kept"])

    return by_shard(keyed, wanted, shards).mapInArrow(run, schema).select("row.*", *[F.col(c).alias(prefix + c[2:]) for c in ("p_words", "p_removed", "p_spans", "p_kept")])


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = remove_repeated(narrow, **options)
    return out.select("doc_id", F.col("p_words").alias("n_words"), F.col("p_removed").alias("n_removed"), F.sha2(F.col("p_kept").cast("binary"), 256).alias("kept_sha256"))
