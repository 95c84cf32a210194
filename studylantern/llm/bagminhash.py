"""Near-duplicate documents by BagMinHash (operator 5).

A document is the multiset of its runs of five words. A shingle that occurs w times covers the weights (0, w]. Those are
cut into blocks (0, 1], (1, 2], (2, 4], (4, 8] ...; each block of each shingle has a Poisson process of its own whose
rate is the block's length, seeded by shingle and block. A point has a time, a register and a weight in its block, found
by halving the block; points above w are passed over. A register keeps the earliest time. Two documents agree in a
register with the probability of their weighted Jaccard similarity, sum of minima over sum of maxima. A document's
processes run only until its last register is filled and no earlier time can follow.

Registers are banded. Documents with equal words are one node. In each bucket of a band a leader is compared with the
other nodes: first the node that meets most others over all bands, which is the original of a group of edited copies, then
another one. What is linked becomes one component.

At last the pairs within a bucket that still lie in different components are compared, but for those that cannot be
alike, by two bounds on their overlap. Shingles that a node shares with no other node of such buckets are part of none.
And each node is compared with the leader of its bucket: what either of two nodes lacks of the leader's shingles they
do not share. Copies that are edited or cut too far for a link to their original have so many shingles of their own, or
lack so many different ones, that their pairs are ruled out without comparing them. Each comparison is exact: overlap
of both multisets. So a group of thousands of copies costs a few comparisons a copy, and no link that a bucket shows is
lost between components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylantern.llm.common import discard, files_for, free_name, in_slices, settle, total, utf8
from studylantern.llm.components import components
from studylantern.llm.hashing import Words, mix

SHINGLE, SIMILARITY = 5, 0.8
#: 26 bands of 5 registers: of pairs with similarity 0.8, all but 0.00003 share a bucket.
BANDS, ROWS = 26, 5
LEADER_ROUNDS = 2
SLICE_BYTES = 1_000_000
#: Bits that tell which of a leader's shingles a text lacks, at most.
LACK_CELLS = 1024


def counted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count of each distinct shingle of each text."""
    kinds, counts, sizes = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k, c = np.unique(hashes[a:b], return_counts=True)
        kinds.append(k)
        counts.append(c)
        sizes.append(len(k))
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*kinds, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Earliest time for each of n texts (rows) and register (columns); infinite for a text without shingles."""
    sig = np.full(n * registers, np.inf)
    blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1  # blocks (0, 1], (1, 2], (2, 4] ... up to the weight
    at = np.repeat(np.arange(len(text)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    rate = np.maximum(low, 1.0)
    seed = mix(shingle[at] ^ mix(block.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
    share = (weight[at] - low) / rate  # of the block that lies within the weight
    owner, time, step = text[at], np.zeros(len(at)), 0
    while len(owner):
        draw = mix(seed + np.uint64(step * 0xA0761D6478BD642F % 2**64))
        time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        last = sig.reshape(n, registers).max(axis=1)
        keep = time < last[owner]
        owner, time, seed, rate, share, draw = owner[keep], time[keep], seed[keep], rate[keep], share[keep], draw[keep]
        more = mix(draw)
        register = ((more >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        inside = np.ones(len(owner), bool)
        part = share < 1
        if part.any():  # halve the block by the bits of the draw: the point's weight, as a share of the block
            inside[part] = (more[part] & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[part]
        np.minimum.at(sig, owner[inside] * registers + register[inside].astype(np.int64), time[inside])
        step += 1
    return sig.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(sig), bands))
    for k in range(rows):
        key = mix(key ^ bits[:, :, k])
    return key


def contents(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit digest of each text's words."""
    raw = data.tobytes()
    return [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, n (shingles, with repeats) and bands of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            data, at = utf8(batch, "text")
            hashes, bounds = Words(data, at).shingles(SHINGLE)
            keys = band_keys(signatures(*counted(hashes, bounds), batch.num_rows, BANDS * ROWS)).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents(data, at), pa.binary()), pa.array(np.diff(bounds)), bands], ["doc_id", "content", "n", "bands"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, content binary, n long, bands array<long>")


def with_content(docs: DataFrame, text_col: str = "text", into: str = "content") -> DataFrame:
    """docs and the digest of the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents(*utf8(batch, text_col)), pa.binary())], [*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())]))


def _multiset(text: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, in order of their hashes, the place of each one's first occurrence, and counts."""
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)])).shingles(SHINGLE)[0], return_index=True, return_counts=True)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    second = pairs.join(texts.selectExpr("content AS b", "text AS y").hint("merge"), "b")
    return second.join(texts.selectExpr("content AS a", "text AS x").hint("merge"), "a").select("a", "b", "x", "y")


def _met(batch: pa.RecordBatch, held: dict) -> Iterator[tuple]:
    """For each pair the first text's places and counts, the second one's size, and for shared shingles the index in the first and the lesser and own counts."""
    for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
        if a not in held:
            held.clear()
            held[a] = _multiset(x)
        kinds, place, counts = held[a]
        other, _, often = _multiset(y)
        _, p, q = np.intersect1d(kinds, other, assume_unique=True, return_indices=True)
        yield place, counts, int(often.sum()), p, np.minimum(counts[p], often[q])


def overlaps(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles have at least that similarity. texts: content, text of every node in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keep = [both.sum() >= least * (counts.sum() + size - both.sum()) - 1e-9 for _, counts, size, _, both in _met(batch, held)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, texts).mapInArrow(run, "a binary, b binary")


def lacking(pairs: DataFrame, texts: DataFrame, most_cells: int = LACK_CELLS) -> DataFrame:
    """a, b, met (overlap) and lacks: a bit for each shingle of a that b has less often.

    Of a text with more than most_cells shingles neighbouring ones share a bit, which is set if b lacks any of them. So two
    texts lack together at least as many of a's shingles as bits are set in either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            met, bits = [], []
            for place, counts, _, p, both in _met(batch, held):
                less = np.ones(len(counts), bool)
                less[p] = both < counts[p]
                rank = np.empty(len(place), np.int64)
                rank[np.argsort(place)] = np.arange(len(place))
                cells = min(len(place), most_cells)
                cell = np.zeros(-(-cells // 64) * 64, bool)
                cell[(rank * cells // len(place))[less]] = True
                met.append(int(both.sum()))
                bits.append(np.packbits(cell).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(met, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["a", "b", "met", "lacks"])

    return _with_texts(pairs, texts).mapInArrow(run, "a binary, b binary, met long, lacks array<long>")


def own_shingles(texts: DataFrame) -> DataFrame:
    """content, own: how many shingles (with repeats) of each text no other of the texts has. texts: content, text.

    Counted by shingle, with a pre-aggregation in the map tasks, so a shingle that a third of all texts share is one row a
    task. Shingles of equal hash count as shared, which only weakens the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            text, shingle, weight = counted(*Words(*utf8(batch, "text")).shingles(SHINGLE))
            node = np.frombuffer(b"".join(batch.column("content").to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)[text]
            arrays = [shingle.view(np.int64), np.ascontiguousarray(node[:, 0]), np.ascontiguousarray(node[:, 1]), weight.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["shingle", "high", "low", "weight"])

    rows = texts.select("content", "text").mapInArrow(run, "shingle long, high long, low long, weight long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("c"), *[F.min(x).alias(x) for x in ("high", "low", "weight")]).filter("c = 1")
    sums = alone.groupBy("high", "low").agg(F.sum("weight").alias("own"))
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    return sums.select(F.unhex(F.concat(half("high"), half("low"))).alias("content"), "own")


def open_pairs(labelled: DataFrame, texts: DataFrame, similarity: float, near, files: int | None = None) -> DataFrame:
    """a, b: pairs of one bucket in different components that may be similar. labelled: band, content, n, degree, component.

    Left out are only pairs that cannot reach the similarity: an overlap is at most the shingles that are not a node's own, and
    at most the leader's shingles that neither lacks and those common ones that the leader does not have.
    """
    open_nodes = settle(labelled.select("content").distinct(), "open", files)
    own = settle(own_shingles(texts.join(open_nodes.hint("merge"), "content", "left_semi")), "own", files)
    shared = labelled.join(own.hint("merge"), "content", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    # an overlap of that similarity with any text, the shortest allowed one included, takes so many shingles
    able = settle(shared.filter(F.col("common") >= similarity * F.col("n") - 1e-6).drop("own"), "able", files)
    first = F.min(F.struct((-F.col("degree")).alias("h"), "content", "n")).alias("x")
    leaders = settle(able.groupBy("band").agg(first).select("band", F.col("x.content").alias("leader"), F.col("x.n").alias("whole")), "leaders", files)
    led = settle(able.join(leaders, "band"), "led", files)
    asked = settle(led.filter("content <> leader").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct(), "asked", files)
    found = settle(lacking(asked, texts).selectExpr("a AS leader", "b AS content", "met", "lacks"), "lacking", files)
    rows = settle(led.join(found.hint("merge"), ["leader", "content"], "left").withColumn("extra", F.col("common") - F.coalesce("met", "common")), "bounded", files)
    other = rows.selectExpr("band", "content AS a", "n AS n2", "component AS c2", "common AS common2", "lacks AS lacks2", "extra AS extra2")
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n2")) - 1e-6
    gone = F.aggregate(F.zip_with("lacks", "lacks2", lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    lacked = F.coalesce(gone, F.aggregate(F.transform(F.coalesce("lacks", "lacks2"), F.bit_count), F.lit(0), lambda s, x: s + x), F.lit(0))
    bound = F.col("whole") - lacked + F.least("extra", "extra2")
    likely = near & (F.least("common", "common2") >= needed) & (bound >= needed)
    met = rows.join(other, "band").filter((F.col("component") != F.col("c2")) & (F.col("a") < F.col("content")) & likely)
    return met.select("a", F.col("content").alias("b"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, class_id and class_key of every row. class_id: the smallest doc_id among all that equal words or links
    connect, null where none of them has an id; class_key tells classes apart in any case.

    Linked are texts whose multisets of five-word runs have a weighted Jaccard similarity of at least `similarity`; a
    text of fewer words is one run. A null text counts as empty; empty texts equal each other and nothing else. Rows
    without an id are classed too. Repeated rows stay.
    """
    files = files_for(total(docs, F.octet_length(F.col(text_col).cast("string"))))
    rows = settle(sketches(docs, id_col, text_col), "sketches", files)
    nodes = rows.filter("n > 0").groupBy("content").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    every = settle(nodes.select("content", "n", F.explode("bands").alias("band")), "bands", files)
    buckets = settle(every.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1"), "buckets", files)
    met = settle(every.join(buckets.hint("merge"), "band"), "met", files)
    degrees = settle(met.groupBy("content").agg(F.sum("k").alias("degree")), "degrees", files)
    members = settle(met.drop("k").join(degrees.hint("merge"), "content"), "members", files)
    discard(every, buckets, met)
    subjects = with_content(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))).join(degrees.select("content").hint("merge"), "content", "left_semi")
    texts = settle(subjects.groupBy("content").agg(F.first("text").alias("text")), "texts", files)
    near = (F.col("n") >= similarity * F.col("n2")) & (F.col("n2") >= similarity * F.col("n"))
    links, labels, labelled = None, None, members.withColumn("component", F.col("content"))
    for turn in range(LEADER_ROUNDS + 1):
        if turn < LEADER_ROUNDS:
            first = -F.col("degree") if turn == 0 else F.xxhash64("content", F.lit(turn))
            order = F.struct(first.alias("h"), "content", "n", "component")
            leaders = settle(labelled.groupBy("band").agg(F.min(order).alias("x")).select("band", F.col("x.content").alias("a"), F.col("x.n").alias("n2"), F.col("x.component").alias("c2")), "leaders", files)
            pairs = labelled.join(leaders, "band").filter((F.col("component") != F.col("c2")) & near).select("a", F.col("content").alias("b"))
        else:
            pairs = open_pairs(labelled, texts, similarity, near, files)
        pairs = settle(pairs.distinct(), "pairs", files)
        if pairs.isEmpty():
            break
        found = settle(overlaps(pairs, texts, similarity), "links", files)
        links = found if links is None else links.union(found)
        labels = components(links, files).selectExpr("node AS content", "component AS c")
        discard(pairs)
        if turn < LEADER_ROUNDS:  # buckets of one component are done
            now = settle(members.join(labels, "content", "left").select("band", "content", "n", "degree", F.coalesce("c", "content").alias("component")), "labelled", files)
            mixed = settle(now.groupBy("band").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").drop("mixed"), "mixed", files)
            labelled = settle(now.join(mixed, "band"), "labelled", files)
            discard(now, mixed, leaders)
    classed = rows.select("doc_id", "content")
    if labels is not None:
        classed = classed.join(labels, "content", "left").select("doc_id", "content", F.coalesce("c", "content").alias("class_key"))
    else:
        classed = classed.withColumn("class_key", F.col("content"))
    classed = settle(classed, "classed", files)
    lowest = settle(classed.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "classes", files)
    discard(texts, members, degrees)
    return classed.join(lowest, "class_key").select("doc_id", "content", "class_id", "class_key")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest id stays (one without an id only
    where no row of the class has one), and one of repeated rows. All columns stay, whatever their names."""
    classed = near_duplicates(docs, similarity, id_col, text_col)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("x")
    kept = settle(classed.groupBy("class_key").agg(lowest).select(F.struct(F.col("x.doc_id"), F.col("x.content")).alias("key")), "kept")
    words = free_name(docs.columns, "dedup_")
    key, place = f"{words}key", f"{words}n"
    keyed = with_content(docs, text_col, words).withColumn(key, F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(words).alias("content")))
    chosen = kept.withColumnRenamed("key", f"{words}kept")
    same = F.col(f"{key}.doc_id").eqNullSafe(F.col(f"{words}kept.doc_id")) & (F.col(f"{key}.content") == F.col(f"{words}kept.content"))
    first = Window.partitionBy(key).orderBy(F.lit(1))
    return keyed.join(chosen, same, "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(docs.columns)
