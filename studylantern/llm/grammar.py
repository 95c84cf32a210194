"""Token-id files compressed by a grammar (operator 6).

A file row is a block of documents in ascending order of their ids: within the block, the frequent pairs of adjacent
symbols are replaced by nonterminals, round after round, until none is frequent. The row holds the rules, each nonterminal's expansion length,
the remaining symbols, and the first symbol of each document. Pairs never span documents, so one document is decoded
from its own symbols and the rules alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.llm.bpe import ENCODE_BYTES, WordEncoder, worker_encoder
from studylantern.llm.common import in_slices, parts, shared_folder, utf8

#: Ids gathered in a block; a longer document has a block of its own.
BLOCK_IDS = 500_000
#: How often a pair must be replaced to get a rule, and the table that sorts out rare pairs.
LEAST, SLOT_BITS = 4, 18
TERMINALS = 1 << 16
END_ID = 1
BLOCK_SCHEMA = (
    "shard int, block int, first_doc long, last_doc long, before long, n_ids long, doc_ids binary, first_symbol binary, "
    "rules binary, expansion binary, symbols binary"
)


def compress(ids: np.ndarray, last: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols; rule k stands for TERMINALS + k), symbols, and for each symbol whether it ends a document.

    In a round, all pairs that occur `least` times without overlapping themselves compete by count, and of overlapping
    occurrences the more frequent pair is replaced. The most frequent pair is replaced wherever it occurs, so the rounds
    end when no pair occurs `least` times. Pairs are counted exactly; a table of hash slots, whose counts are at least
    those of their pairs, only keeps rare pairs out of the count. Replacing never makes a pair of older symbols more
    frequent, so after the first round only those places are counted where the pair was frequent or has a new symbol;
    symbols keep their places and are linked to their neighbours.
    """
    n, rules, made = len(ids), [np.zeros((0, 2), np.int64)], 0
    symbols, after, before = ids.astype(np.int32), np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # a second symbol of a rule becomes -1; place n is none
    after[:-1][last] = n
    before[np.flatnonzero(last) + 1] = n
    before[0] = after[n] = n
    counted = np.zeros(n, bool)
    at = np.flatnonzero(~last)
    while len(at) >= least:
        then = after.take(at)
        pair = symbols.take(at).astype(np.int64)
        pair <<= 32
        pair |= symbols.take(then)
        passed = at[:0]
        follows = np.flatnonzero((pair[1:] == pair[:-1]) & (at[1:] == then[:-1])) + 1
        if len(follows):  # in a run of one symbol every other occurrence counts
            run = np.cumsum(np.concatenate(([0], np.diff(follows) != 1)))
            head = follows[np.concatenate(([True], run[1:] != run[:-1]))]
            odd = follows[(follows - head[run]) % 2 == 0]
            passed = at[odd]
            at, then, pair = (np.delete(x, odd) for x in (at, then, pair))
        if made and len(at) > 1 << SLOT_BITS - 2:  # most pairs of the first round pass
            slot = pair.view(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            slot >>= np.uint64(64 - SLOT_BITS)
            slot = slot.view(np.int64)
            maybe = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least).take(slot))
            at, then, pair = (x.take(maybe) for x in (at, then, pair))
        coded = pa.array(pair).dictionary_encode()
        distinct, which = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        count = np.bincount(which, minlength=len(distinct))
        frequent = np.flatnonzero((count >= least).take(which))
        at, then, which = (x.take(frequent) for x in (at, then, which))
        rated = ((count << 32) | np.arange(len(distinct))).take(which)
        won, apart = np.ones(len(at), bool), at[1:] != then[:-1]
        won[1:] &= apart | (rated[1:] > rated[:-1])
        won[:-1] &= apart | (rated[1:] < rated[:-1])
        keep = np.bincount(which[won], minlength=len(distinct)) >= least
        if not keep.any():
            break
        number = np.cumsum(keep) - 1 + TERMINALS + made
        won = np.flatnonzero(won & keep.take(which))
        here, second = at.take(won), then.take(won)
        third = after.take(second)
        symbols[here], symbols[second] = number.take(which.take(won)), -1
        after[here], before[third] = third, here
        rules.append(np.column_stack([distinct[keep] >> 32, distinct[keep] & 0xFFFFFFFF]))
        made += len(rules[-1])
        ahead = before.take(here)
        if len(at) < n >> 4:
            at = np.sort(np.concatenate((at, ahead, passed)))
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        else:
            counted[at] = counted[passed] = counted[ahead[ahead < n]] = True
            at = np.flatnonzero(counted)
            counted[at] = False
        at = at.take(np.flatnonzero((symbols.take(at, mode="clip") >= 0) & (after.take(at) < n)))
    left = symbols >= 0
    return np.concatenate(rules), symbols[left].astype(np.int64), after[:-1][left] == n


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids below each nonterminal. A rule only names earlier symbols."""
    sizes = np.ones(TERMINALS + len(rules), np.int64)
    highest, first = np.maximum.accumulate(rules.max(axis=1, initial=0)), 0
    while first < len(rules):  # as many rules at once as name none of each other
        last = int(np.searchsorted(highest, TERMINALS + first))
        sizes[TERMINALS + first : TERMINALS + last] = sizes[rules[first:last]].sum(axis=1)
        first = last
    return sizes[TERMINALS:]


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; sizes: the rules' expansion_lengths, where known. Each distinct symbol is expanded once."""
    length = np.concatenate((np.ones(TERMINALS, np.int64), expansion_lengths(rules) if sizes is None else sizes))
    used = np.zeros(len(length), bool)
    used[symbols] = True
    open_ = np.flatnonzero(used)
    place = np.cumsum(length[open_]) - length[open_]
    first = np.zeros(len(length), np.int64)
    first[open_] = place
    flat = np.empty(int(length[open_].sum()), np.int64)
    while len(open_):
        inner = open_ >= TERMINALS
        flat[place[~inner]] = open_[~inner]
        left, right = rules[open_[inner] - TERMINALS].T
        place = place[inner]
        open_, place = np.concatenate((left, right)), np.concatenate((place, place + length[left]))
    size = length[symbols]
    ends = np.cumsum(size)
    return flat[np.repeat(first[symbols] - ends + size, size) + np.arange(int(size.sum()))]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts with their end id and write them in ascending order of doc_id.

    One shuffle, of the texts by ranges of ids; rows of one id, or without one, are dealt on by the hash of their text. A null text counts as empty; rows without an id come first; repeated
    rows follow each other. Files are Parquet with one row for each block, on any store that Spark writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(WordEncoder, tokenizer)
        shard, block, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            ends = np.cumsum([len(x) for _, x in held])
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            rules, symbols, last = compress(ids, last)
            first_symbol = np.concatenate(([0], np.flatnonzero(last) + 1)).astype("<u4")
            names = [d for d, _ in held]
            known = [d for d in names if d is not None]
            doc_ids = pa.array(names, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("d", pa.int64())])) as stream:
                stream.write_batch(pa.record_batch([doc_ids], names=["d"]))
            values = [shard, block, min(known, default=None), max(known, default=None), before, len(ids), sink.getvalue().to_pybytes()]
            values += [first_symbol.tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules).astype("<u4").tobytes(), symbols.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in in_slices(batches, "text", ENCODE_BYTES):
            every, bounds = encoder.encode_texts(*utf8(batch, "text"), end_id)
            cuts = bounds.tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                if held and size + b - a > block_ids:
                    yield row()
                    block, before, held, size = block + 1, before + size, [], 0
                held.append((doc_id, every[a:b]))
                size += b - a
        if held:
            yield row()

    plain = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text")
    ranged = plain.repartitionByRange(parts(docs), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    ranged.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _u4(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<u4").astype(np.int64)


def read_ids(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of the documents.

    With bounds only the blocks, and within them the symbols, of documents in the range are decoded. The driver holds one
    total for each shard.
    """
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    start_of, start = {}, 0
    for r in totals:
        start_of[r["shard"]], start = start, start + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = {c: batch.column(c)[k] for c in batch.schema.names}
                with pa.ipc.open_stream(value["doc_ids"].as_buffer()) as stream:
                    docs = stream.read_all().column(0).to_pylist()
                rules, symbols, first = _u4(value["rules"]).reshape(-1, 2), _u4(value["symbols"]), _u4(value["first_symbol"])
                expansion = _u4(value["expansion"])
                sizes = np.ones(len(symbols), np.int64)
                inner = symbols >= TERMINALS
                sizes[inner] = expansion[symbols[inner] - TERMINALS]
                at = np.concatenate(([0], np.cumsum(sizes)))[first]
                low, high = 0, len(docs)
                if first_doc is not None:
                    low = sum(d is None or d < first_doc for d in docs)
                if last_doc is not None:
                    high = sum(d is None or d <= last_doc for d in docs)
                ids = expand(symbols[first[low] : first[high]], rules, expansion).astype("<u4")
                base = start_of[value["shard"].as_py()] + value["before"].as_py()
                cuts = (at[low : high + 1] - at[low]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[low:high], pa.int64()),
                        pa.array(at[low:high] + base),
                        pa.array(np.diff(at[low : high + 1])),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    wanted = files
    if first_doc is not None:
        wanted = wanted.filter(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        wanted = wanted.filter(F.col("first_doc") <= last_doc)
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def ids_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_ids(docs.sparkSession, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
