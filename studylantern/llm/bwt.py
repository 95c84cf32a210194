"""Substring dedup by merged Burrows-Wheeler transforms (operator 8).

Bytes covered by a string of `width` bytes that also starts earlier are removed; the first occurrence stays.

1. Strings are grouped as blocks by their anchor, the smallest run of `gram` bytes (as in operator 1, on bytes): equal
   strings have equal anchors, so only blocks whose anchor recurs can hold repeats. Blocks that are equal as a whole are
   collapsed to the earliest; in all later copies every string starts earlier too.
2. What is left are different blocks with a common anchor. Their bytes are dealt to merge groups by anchor. A group cuts
   its texts into shards, builds the suffix order and the Burrows-Wheeler transform of each shard, and merges them: the
   interleave of the shards' suffixes is refined by four leading symbols in each pass, by reading each shard's transform
   in interleave order and placing its symbols stably. Where two neighbours part is their common prefix.
   After `width` symbols the intervals that never parted are the repeated strings; no suffixes are sorted again.
3. In each interval the earliest start stays; the spans of the others are removed from their documents.

Blocks of an anchor with very many kinds are cut, and a cut goes by its core, the bytes around the anchor that all its
strings share. Equal cuts are collapsed to the earliest as whole blocks are. A core with one kind of cut left holds no
other repeat; one with very many kinds still is compared string by string, by 128-bit hashes that are pre-aggregated. So
a merge group holds about GROUP_BYTES and at most MANY_KINDS kinds of an anchor or core, also where a third of all
documents share a passage, whatever surrounds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylantern.llm.common import in_slices, parts, settle, total, utf8
from studylantern.llm.hashing import BYTE_HASH, WORD_BASE, Windows
from studylantern.llm.phrases import SHARD_BYTES, bare, by_shard, lowest, shards_of

WIDTH, GRAM = 100, 32
SLICE_BYTES = 1_000_000
#: Bytes of a merge group and of a shard within it, about.
GROUP_BYTES, LEAF_BYTES = 1_000_000, 128_000
#: Kinds of blocks from which an anchor's blocks are cut, and the strings in a cut.
MANY_KINDS, CUT = 2_000, 12
BLOCK_SCHEMA = "anchor long, block long, doc_id long, k long, first int, n int, at int"


def byte_blocks(batch: pa.RecordBatch, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first string within it, number of strings, anchor, its place after the first string, and block hash."""
    data, at = utf8(batch, "text")
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    windows = Windows(BYTE_HASH[data], WORD_BASE)
    grams = windows.runs(gram)
    place = np.uint64(max(1, int(n).bit_length()))
    keys = ((grams >> place) << place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (lowest(keys, width - gram + 1) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    begin = np.arange(n - width + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(begin)]
    inside = begin + width <= at[1:].take(text)
    change = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
    stop = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True]))) + 1
    a = anchor[first]
    return text[first], first - at[text[first]], stop - first, grams[a].view(np.int64), a - first, windows.of(first, stop + width - 1).view(np.int64)


def block_rows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row for each block of docs (doc_id, k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            text, first, n, anchor, at, block = byte_blocks(batch, width, gram)
            own = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "k")]
            small = [pa.array(x.astype(np.int32)) for x in (first, n, at)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(block), *own, *small], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    return docs.select("doc_id", "k", "text").mapInArrow(run, BLOCK_SCHEMA)


def in_order(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 to most in order, and their places; equal ones by place."""
    n, bits = len(keys), int(len(keys)).bit_length()
    if most.bit_length() + bits < 64:  # keys made distinct by their place sort faster, and carry it along
        both = keys.astype(np.int64)
        both <<= bits
        both |= np.arange(n)
        both.sort()
        order = both & ((1 << bits) - 1)
        both >>= bits
        return both, order
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def packed(symbols: Iterator[np.ndarray]) -> np.ndarray:
    """Four symbols as one number; what follows an end mark counts as end marks."""
    out, live = np.uint32(0), np.True_
    for s in symbols:
        s = s * live
        out, live = (out << np.uint32(8)) | s.astype(np.uint32), s > 0
    return out


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, from four by doubling; equal ones by place, and end marks (0)
    differ by place. Only suffixes that are still equal to another are sorted again."""
    n, step = len(symbols), 4
    padded = np.concatenate((symbols, np.zeros(3, np.uint8)))
    key, order = in_order(packed(padded[i : i + n] for i in range(4)), 2**32 - 1)
    slot, row, rank = np.arange(n), order, np.empty(n, np.int64)
    starts = np.concatenate(([True], (key[1:] != key[:-1]) | (key[1:] & 255 == 0)))[:n]
    while True:
        rank[row] = slot[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        slot = slot[~(starts & np.append(starts[1:], True))]
        if step >= depth or not len(slot):
            return order
        row = order[slot]
        beyond = row + step
        key = rank[row] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key, by = in_order(key, n * (n + 1))
        row = row[by]
        starts = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        order[slot] = row
        step *= 2


def transform(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The Burrows-Wheeler transform of texts, each with an end mark of its own (symbol 0), the places of its suffixes, and the number of marks.

    Bytes are raised by one; UTF-8 has no byte above 0xF4, so they stay within eight bits.
    """
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)
    order = suffix_order(joined, depth)
    return joined[order - 1], order, len(texts)


def merge(parts_: list[tuple[np.ndarray, np.ndarray, int]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix in merged order: its shard, its place there, and its common prefix with the one before, at most `depth`.

    A pass reads the four symbols before the suffixes in interleave order and moves each suffix to the one that is longer by them
    (four LF steps of its shard's transform), stably by these symbols. Suffixes of an interval longer by four symbols come from
    one interval, so a suffix that has parted from both neighbours is at its place, and those longer than it need no pass:
    only intervals of several suffixes are read on.
    """
    sizes = [len(b) for b, _, _ in parts_]
    symbols, places = (np.concatenate([p[i] for p in parts_]) for i in (0, 1))
    n = sum(sizes)
    longer, shorter = np.empty(n, np.int32), np.empty(n, np.int32)  # the row of the suffix with the symbol before, and without its first
    for (b, _, _), at in zip(parts_, np.cumsum([0, *sizes]).tolist(), strict=False):
        longer[at + np.argsort(b, kind="stable")] = np.arange(at, at + len(b), dtype=np.int32)
    shorter[longer] = np.arange(n, dtype=np.int32)
    first, twice, two = symbols.take(shorter), shorter.take(shorter), longer.take(longer)
    lead, row = in_order(packed((first, first.take(shorter), first.take(twice), first.take(shorter.take(twice)))), 2**32 - 1)
    ahead = packed((symbols.take(longer.take(two)), symbols.take(two), symbols.take(longer), symbols))
    marked = (symbols == 0) | (symbols.take(longer) == 0)
    ahead[marked | marked.take(two)] = 0  # with an end mark among them
    longer, row = two.take(two), row.astype(np.int32)
    # parted: by how many symbols before the last of those read a suffix differs from the one before (0: not yet, 5: by five at least)
    common, size = np.zeros(max(0, n - 1), np.uint8), np.zeros(n, np.uint8)
    for k in (0, 8, 16, 24):
        common += (lead[1:] ^ lead[:-1]) >> k == 0
        size += (lead >> k) & 255 > 0
    parted = np.concatenate((np.array([5], np.uint8), 4 - np.minimum(common, size[1:])))[:n]
    merged, slot, prefix, read = row.copy(), np.arange(n, dtype=np.int32), np.full(n, depth, np.int32), 4
    while True:
        starts = parted > 0
        found = parted[starts]  # one for each interval
        new = found < 5
        prefix[slot[starts][new]] = read - found[new]
        slot = slot[~(starts & np.append(starts[1:], True))]  # slots in merged order of intervals that are still open
        if read >= depth or not len(slot):
            break
        symbol, order = in_order(ahead.take(row), 2**32 - 1)
        row, interval = row.take(order), np.cumsum(starts, dtype=np.int32).take(order) - np.int32(1)
        turn = symbol[1:] != symbol[:-1]
        parted = np.zeros(len(row), np.uint8)
        parted[:1] = 5
        parted[1:][turn] = 5
        new = np.flatnonzero((interval[1:] != interval[:-1]) & ~turn)
        here, before, most = interval[new + 1], interval[new], np.ones(len(new), np.uint8)
        for k in (2, 3, 4, 5):
            level = np.cumsum(found >= k, dtype=np.int32)
            most[level.take(here) != level.take(before)] = k
        parted[new + 1] = most
        coarse = parted == 5
        stay = ~(coarse & np.append(coarse[1:], True)) & (symbol > 0)
        row, parted = longer.take(row[stay]), parted[stay]
        merged[slot] = row
        read += 4
    prefix[:1] = 0
    shard = np.repeat(np.arange(len(parts_), dtype=np.uint8), sizes)
    return shard[merged], places[merged], np.minimum(prefix, depth)


def repeated_starts(texts: list[bytes], rank: list[tuple], strings: list[int], width: int, leaf_bytes: int = LEAF_BYTES) -> list[np.ndarray]:
    """For each text, which of its first `strings` starts begin a string that also starts earlier: in a text of lower rank, or before it in one of equal rank.

    rank: order of a text's document and start; texts of a document overlap, so the start itself is compared.
    """
    held, cuts, size = [], [0], 0
    leaf = max(leaf_bytes, 1 + sum(map(len, texts)) // 200)  # at most 255 shards
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= leaf or i + 1 == len(texts):
            held.append(transform(texts[cuts[-1] : i + 1], width))
            cuts.append(i + 1)
            size = 0
    shard, place, prefix = merge(held, width)
    lengths = np.array([len(t) + 1 for t in texts])
    base = np.cumsum(lengths) - lengths
    where = place + base[np.array(cuts[:-1])][shard]
    text = np.repeat(np.arange(len(texts)), lengths)[where]
    offset = where - base[text]
    interval = np.cumsum(prefix < width)
    shared = prefix >= width
    chosen = (shared | np.append(shared[1:], False)) & (offset < np.array(strings)[text])
    if not chosen.any():
        return [np.zeros(n, bool) for n in strings]
    text, offset, interval = text[chosen], offset[chosen], interval[chosen]
    documents = sorted({r[:-1] for r in rank})
    number = {d: i for i, d in enumerate(documents)}
    document = np.array([number[r[:-1]] for r in rank])[text]
    start = np.array([r[-1] for r in rank])[text] + offset
    order = np.lexsort((start, document, interval))
    interval, document, start = interval[order], document[order], start[order]
    head = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    lead = np.repeat(head, np.diff(np.append(head, len(interval))))
    later = (document != document[lead]) | (start != start[lead])
    ends = np.cumsum(strings)
    out = np.zeros(ends[-1], bool)
    out[(ends - strings)[text[order][later]] + offset[order][later]] = True
    return np.split(out, ends[:-1])


def pieces(keyed: DataFrame, examples: DataFrame, shards: int, width: int) -> DataFrame:
    """The bytes of example blocks (anchor, doc_id, k, first, n, at, many): whole ones by their anchor, cuts by the hash of their core and with a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, docs in shards_of(batches):
            wanted: dict[int, list[tuple]] = {}
            for k, *ask in zip(*(asks.column(c).to_pylist() for c in ("k", "doc_id", "anchor", "first", "n", "at", "many")), strict=True):
                wanted.setdefault(k, []).append(ask)
            for k, text in zip(docs.column("k").to_pylist(), docs.column("text"), strict=True):
                if k not in wanted:
                    continue
                raw, rows = text.as_py().encode(), []
                for doc_id, anchor, first, n, at, many in wanted.pop(k):
                    if not many:
                        rows.append((anchor, None, doc_id, k, first, n, raw[first : first + n + width - 1]))
                        continue
                    p, s = first + at, first
                    while s < first + n:  # strings whose distance to the anchor lies in one range of CUT
                        j = (p - s) // CUT
                        stop = min(first + n, p - j * CUT + 1)
                        core = raw[p - j * CUT : p - j * CUT - CUT + 1 + width]
                        own = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=j.to_bytes(4, "little")).digest(), "little", signed=True)
                        piece = raw[s : stop + width - 1]
                        rows.append((own, hashlib.blake2b(piece, digest_size=16).digest(), doc_id, k, s, stop - s, piece))
                        s = stop
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["core", "digest", "doc_id", "k", "first", "n", "bytes"])

    return by_shard(bare(keyed), examples, shards).mapInArrow(run, "core long, digest binary, doc_id long, k long, first int, n int, bytes binary")


def collapsed(made: DataFrame, width: int, many_kinds: int) -> tuple[DataFrame, int, DataFrame]:
    """What is left of pieces to be merged (group and more), its number of groups, and the spans (k, lo, hi) that are settled without a merge.

    Equal cuts hold equal strings, so all but the earliest are spans. Equal strings have equal cores, so a core with one
    kind of cut needs no merge, and the strings of a core with very many kinds are compared among themselves.
    """
    place = [F.col("doc_id").isNotNull().alias("known"), "doc_id", "k", "first"]
    cuts = made.filter("digest IS NOT NULL")
    kinds = cuts.groupBy("core", "digest").agg(F.min(F.struct(*place, "n", "bytes")).alias("x"), F.count("*").alias("c"))
    kinds = settle(kinds.select("core", "digest", "c", "x.doc_id", "x.k", "x.first", "x.n", "x.bytes"), "cuts")
    cores = kinds.groupBy("core").agg(F.count("*").alias("c"), F.sum(F.octet_length("bytes")).alias("size")).filter("c > 1")
    cores = settle(cores.select("core", "size", (F.col("c") > many_kinds).alias("many")), "cores")
    copies = cuts.select("core", "digest", "k", "first", "n").join(kinds.filter("c > 1").select("core", "digest", F.col("k").alias("k1"), F.col("first").alias("first1")), ["core", "digest"]).filter("k <> k1 OR first <> first1")
    done = copies.select("k", F.col("first").cast("long").alias("lo"), (F.col("first") + F.col("n") + width - 1).cast("long").alias("hi"))
    each = kinds.join(cores.filter("many").select("core"), "core").select("doc_id", "k", "first", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    strings = settle(each.select("doc_id", "k", (F.col("first") + F.col("i")).alias("first"), F.unhex(F.md5(F.substring("bytes", F.col("i") + 1, F.lit(width)))).alias("string")), "strings")
    earliest = settle(strings.groupBy("string").agg(F.min(F.struct(*place)).alias("x"), F.count("*").alias("c")).filter("c > 1").select("string", F.col("x.k").alias("k1"), F.col("x.first").alias("first1")), "earliest")
    again = strings.join(earliest, "string").filter("k <> k1 OR first <> first1")
    done = done.union(again.select("k", F.col("first").cast("long").alias("lo"), (F.col("first") + width).cast("long").alias("hi")))
    few = cores.filter("NOT many")
    whole = made.filter("digest IS NULL")
    groups = max(1, (total(whole, F.octet_length("bytes")) + total(few, "size")) // GROUP_BYTES)
    columns = [F.pmod("core", F.lit(groups)).alias("group"), "doc_id", "k", "first", "n", "bytes"]
    return whole.select(*columns).union(kinds.join(few.select("core"), "core").select(*columns)), groups, done


def merged_spans(cut: DataFrame, groups: int, width: int) -> DataFrame:
    """k, lo, hi: bytes of the pieces covered by strings that start earlier in their merge group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def spans() -> pa.RecordBatch:
            found = repeated_starts([r[5] for r in held], [(r[1] is not None, r[1] or 0, r[2], r[3]) for r in held], [r[4] for r in held], width)
            rows = []
            for (_, _, k, first, _, _), again in zip(held, found, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], again.astype(np.int8), [0]))))
                rows += [(k, first + a, first + b - 1 + width) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["k", "lo", "hi"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield spans()
                    held = []
                held.append(row)
        if held:
            yield spans()

    dealt = cut.repartition(max(parts(cut), min(groups, 4 * parts(cut))), "group").sortWithinPartitions("group", "k", "first")
    return dealt.mapInArrow(run, "k long, lo long, hi long")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", many_kinds: int = MANY_KINDS, prefix: str = "b_") -> DataFrame:
    """docs with b_bytes, b_removed, b_spans (removed runs of bytes, [lo, hi)) and b_kept (the other bytes).

    Earlier is: a smaller id, or the same id and an earlier start; a row without an id comes before all others, and of
    different texts with the same id the one with the smaller hash. Rows equal in id and text are one document: each gets its
    result. Null texts count as empty; strings are judged on the input. `prefix` names the added columns; take another one
    (`free_name`) where docs has such columns.
    """
    if not 0 < gram <= width - CUT:
        raise ValueError("gram must be positive and at most width - 12")
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row")
    )
    shards = max(parts(docs), total(docs, F.octet_length(text_col)) // shard_bytes)
    recurring = settle(block_rows(keyed, width, gram).groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "anchors")
    every = settle(block_rows(keyed, width, gram).join(recurring, "anchor"), "recurring")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "k", "first", "n", "at")
    kinds = settle(every.groupBy("anchor", "block").agg(F.min(place).alias("x"), F.count("*").alias("c")), "kinds")
    mixed = settle(kinds.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", (F.col("c") > many_kinds).alias("many")), "mixed")
    examples = settle(kinds.join(mixed, "anchor").select("anchor", "x.doc_id", "x.k", "x.first", "x.n", "x.at", "many"), "examples")
    left, groups, done = collapsed(settle(pieces(keyed.drop("doc_id"), examples, shards, width), "pieces"), width, many_kinds)
    copies = every.join(kinds.filter("c > 1").select("block", F.col("anchor").alias("a"), F.col("x.k").alias("k1"), F.col("x.first").alias("first1")), "block").filter("anchor = a AND (k <> k1 OR first <> first1)")
    copied = copies.select("k", F.col("first").cast("long").alias("lo"), (F.col("first") + F.col("n") + width - 1).cast("long").alias("hi"))
    spans = settle(merged_spans(left, groups, width).union(done).union(copied), "spans")
    added = [T.StructField("b_bytes", T.LongType()), T.StructField("b_removed", T.LongType()), T.StructField("b_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("b_kept", T.BinaryType())]
    schema = T.StructType([T.StructField("row", docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, shard in shards_of(batches):
            wanted: dict[int, list[tuple[int, int]]] = {}
            for k, lo, hi in zip(*(asks.column(c).to_pylist() for c in ("k", "lo", "hi")), strict=True):
                wanted.setdefault(k, []).append((lo, hi))
            for piece in shard.to_batches(max_chunksize=500):
                sizes, gone, runs, kept = [], [], [], []
                for k, text in zip(piece.column("k").to_pylist(), piece.column("text"), strict=True):
                    raw, merged, rest, at = text.as_py().encode(), [], [], 0
                    for lo, hi in sorted(wanted.get(k, ())):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(hi, merged[-1][1])
                        else:
                            merged.append([lo, hi])
                    for lo, hi in merged:
                        rest.append(raw[at:lo])
                        at = hi
                    rest.append(raw[at:])
                    sizes.append(len(raw))
                    gone.append(sum(hi - lo for lo, hi in merged))
                    runs.append(merged)
                    kept.append(b"".join(rest))
                arrays = [piece.column("row"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "b_bytes", "b_removed", "b_spans", "b_kept"])

    return by_shard(keyed.drop("doc_id"), spans, shards).mapInArrow(run, schema).select("row.*", *[F.col(c).alias(prefix + c[2:]) for c in ("b_bytes", "b_removed", "b_spans", "b_kept")])


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return out.select("doc_id", F.col("b_bytes").alias("n_bytes"), F.col("b_removed").alias("n_removed"), F.size("b_spans").cast("long").alias("n_spans"), F.sha2("b_kept", 256).alias("kept_sha256"))
