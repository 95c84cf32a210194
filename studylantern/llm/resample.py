"""Target-distribution importance resampling (operator 13).

A document is a bag of hashed features: its words and pairs of neighbouring words, in lower case. Feature counts of the
corpus and of the target texts give each bucket a gain, the log ratio of both distributions; the gains are an array of fixed
length, and a document's weight is the mean over its features. Adding Gumbel noise and taking the highest scores draws
without replacement in proportion to exp(weight).

The cutoff is sought by a quantile sketch: it brackets the score at the wanted rank, exact counts outside show whether
the cutoff lies in the bracket (else it is widened), and only the bracket is sorted.

Hashes are crc32 of UTF-8 bytes. As crc32 is linear, all of a batch's are found at once: a word's from a table of what a
byte adds at its distance from the word's end, a pair's from those of both words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylantern.llm.common import in_slices, ranked, settle, total, utf8

BUCKETS = 10_000
SHARE_PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Rank error of the sketch is rows / ACCURACY; the first bracket reaches two errors to each side.
ACCURACY = 10_000
SLICE_BYTES = 8_000_000
#: Words up to this many bytes are hashed by table.
TABLE_BYTES = 64
POLYNOMIAL = 0xEDB88320


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What byte values add at each distance from the end, the start value after n bytes, and states moved on by n zero bytes (by state byte)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (step & np.uint32(1)))

    def on(state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ step[state & np.uint32(255)]

    adds, starts = [step], [np.full(1, 0xFFFFFFFF, np.uint32)]
    moved = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(TABLE_BYTES):
        adds.append(on(adds[-1]))
        starts.append(on(starts[-1]))
        moved.append(on(moved[-1]))
    return np.stack(adds), np.concatenate(starts), np.stack(moved)


ADDS, STARTS, MOVED = _tables()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _moved(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = MOVED[n, 0, state & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ MOVED[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def feature_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of all words and of all pairs of texts in one byte array (at: the n + 1 offsets); words by text (n + 1 bounds); texts of the pairs' first words."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    bounds = np.searchsorted(start, at)
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), bounds, np.zeros(0, np.int64)
    letters = np.flatnonzero(inside)
    away = np.repeat(end, size) - 1 - letters
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    body = np.bitwise_xor.reduceat(ADDS[np.minimum(away, TABLE_BYTES), data[letters]], first)
    words = ~(body ^ STARTS[np.minimum(size, TABLE_BYTES)])
    text = data.tobytes()
    for k in np.flatnonzero(size > TABLE_BYTES).tolist():
        words[k] = zlib.crc32(text[start[k] : end[k]])
    joined = np.ones(len(size), bool)
    joined[bounds[:-1][bounds[:-1] < len(size)]] = False  # the first word of a text ends no pair
    second = np.flatnonzero(joined)
    head = ~words[second - 1]
    head = (head >> np.uint32(8)) ^ ADDS[0][(head ^ np.uint32(32)) & np.uint32(255)]
    pairs = ~(_moved(head, np.minimum(size[second], TABLE_BYTES)) ^ ~words[second] ^ STARTS[np.minimum(size[second], TABLE_BYTES)])
    for k in np.flatnonzero(size[second] > TABLE_BYTES).tolist():
        w = second[k]
        pairs[k] = zlib.crc32(text[start[w] : end[w]], int(~head[k] & np.uint32(0xFFFFFFFF)))
    return words, pairs, bounds, second - 1


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all texts. Each task adds up its own array, so at most `buckets` rows of a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in in_slices(batches, "text", SLICE_BYTES):
            words, pairs, _, _ = feature_hashes(*utf8(batch, "text"))
            sums += np.bincount(words % buckets, minlength=buckets) + np.bincount(pairs % buckets, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["bucket", "n"])

    return texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from feature counts of corpus and target. The driver holds one number a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for array, counts in ((s, corpus), (t, target)):
        for bucket, n in counts.collect():
            array[bucket] = n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            words, pairs, bounds, owner = feature_hashes(*utf8(batch, "text"))
            each = gain[words % buckets]
            each[owner] += gain[pairs % buckets]
            n_words = np.diff(bounds)
            sums = np.diff(np.concatenate(([0], np.cumsum(each)))[bounds])
            n_features = n_words + np.maximum(n_words - 1, 0)
            weight = sums // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds the score: weight plus Gumbel noise in thousandths, from a digest of seed and id (a null id counts as empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def bracket(scores: DataFrame, k: int, rows: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of `rows` scores lies in [low, high], and `above` scores are higher than high.

    A sketch proposes the bracket; counts over all rows say whether it holds the cutoff. It is widened fourfold until it does.
    """
    reach = 2 / accuracy
    while True:
        at = 1 - k / rows
        low, high = scores.agg(F.percentile_approx("score", [max(0.0, at - reach), min(1.0, at + reach)], accuracy)).first()[0]
        if reach >= 1:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        reach *= 4


def draw(table: DataFrame, k: int, rows: int, eligible) -> DataFrame:
    """table with `rank`: 1 to k for the k highest scores of the `rows` eligible rows, ties to the smaller doc_id (null last), null for all others.

    The bracket is sorted to find the cutoff; the rows above it are numbered by ranges. Both are dealt over all tasks.
    """
    if k <= 0:
        return table.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(table.filter(eligible), k, rows)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    sure, open_rows = eligible & (F.col("score") > high), eligible & F.col("score").between(low, high)
    top = ranked(table.filter(sure), order).withColumn("rank", F.col("rank") + 1).drop("rank_of")
    place = F.col("rank") + F.lit(above + 1)
    edge = ranked(table.filter(open_rows), order).withColumn("rank", F.when(place <= k, place)).drop("rank_of")
    rest = table.filter(~eligible | (F.col("score") < low)).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(edge).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Draw share_percent of the documents of at least least_words words so that they resemble the target texts.

    Returns doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows not drawn. Null texts have no
    words; repeated rows each take part; an empty table gives an empty frame, an empty target flat gains from the
    corpus alone. Other columns are ignored.
    """
    gain = gains(feature_counts(docs, buckets=buckets), feature_counts(target, buckets=buckets), buckets)
    table = settle(scored(weights(docs, gain), seed), "resample-scores")
    eligible = F.col("n_words") >= least_words
    rows = total(table, F.when(eligible, 1))
    return draw(table, share_percent * rows // 100, rows, eligible).select("doc_id", "n_features", "weight", "score", "rank")
