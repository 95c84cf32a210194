"""Packing of token sequences (operator 4) by non-negative least squares over length combinations.

1. One pass encodes each text, cuts its ids after every `window` ids and notes length and checksum of each piece.
2. Piece lengths are counted in bins of `unit` tokens, rounded up; this histogram has window / unit entries.
3. On the driver (a problem of fixed size): all combinations of two or three bins that fill the window exactly, and
   non-negative repeat counts for them that fit the histogram best in the least-squares sense. Counts are rounded down;
   what they leave over is packed greedily, largest bin first, again as combinations with repeat counts.
4. Each piece gets its rank within its bin; combination, repeat and slot follow from the rank by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylantern.llm.bpe import WordEncoder, worker_encoder
from studylantern.llm.common import in_slices, settle, utf8

WINDOW, UNIT, END_ID = 2048, 8, 1
SLICE_BYTES = 1_000_000
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows that one task ranks within a bin; more rows of a bin are dealt to more tasks.
ROWS_PER_RANKING = 500_000


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of each text's ids and end id. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(WordEncoder, path)
        for batch in in_slices(batches, "text", SLICE_BYTES):
            ids, bounds = encoder.encode_texts(*utf8(batch, "text"), END_ID)
            sizes = np.diff(bounds)
            pieces = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(sizes[row] - start, window)
            first = bounds[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[row]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, PIECES_SCHEMA)


def combinations(bins: int) -> np.ndarray:
    """One row for each way to fill the window with two or three bins: how often it takes each of the bins 1 .. bins."""
    rows = []
    for a in range(1, bins // 2 + 1):
        rows.append((a, bins - a))
        rows += [(a, b, bins - a - b) for b in takewhile(lambda b: bins - a - b >= b, range(a, bins)) if bins - a - b >= 1]
    out = np.zeros((len(rows), bins + 1))
    for k, row in enumerate(rows):
        np.add.at(out[k], list(row), 1)
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method, one column at a time."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    floor = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if slope.max(initial=-np.inf) <= floor:
            break
        active[int(slope.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > floor).all():
                x[:] = 0
                x[at] = best
                break
            low = best <= floor
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300), initial=1.0)
            x[at] += step * (best - x[at])
            gone = at[low & (x[at] <= floor)]
            if not len(gone):
                gone = at[low]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Combinations (bin: how often) with their repeat counts that together use up the histogram of bins 1 .. n exactly."""
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out = [({bins: 1}, int(left[bins]))] if left[bins] else []
    left[bins] = 0
    shapes = combinations(bins)
    shapes = shapes[(shapes[:, left == 0] == 0).all(axis=1)]
    if len(shapes):
        repeats = np.floor(least_squares(shapes.T, left.astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            used = np.flatnonzero(shapes[k])
            often = shapes[k][used].astype(np.int64)
            n = int(min(repeats[k], (left[used] // often).min()))
            if n > 0:
                left[used] -= n * often
                out.append((dict(zip(used.tolist(), often.tolist(), strict=True)), n))
    while left.any():
        room, used = bins, {}
        for b in np.flatnonzero(left)[::-1].tolist():
            if take := min(room // b, int(left[b])):
                used[b] = take
                room -= take * b
        n = min(int(left[b]) // often for b, often in used.items())
        for b, often in used.items():
            left[b] -= n * often
        out.append((used, n))
    return out


def slots(shapes: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (bin, first rank, repeats of the bin in the combination, first sequence, slots before), ordered by bin and rank."""
    rows, dealt, sequence = [], {}, 0
    for used, n in shapes:
        before = 0
        for b, often in used.items():
            rows.append((b, dealt.get(b, 0), often, sequence, before))
            dealt[b] = dealt.get(b, 0) + n * often
            before += often
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Place pieces of 1 to `window` tokens into sequences of at most `window`.

    pieces: the columns of cut_pieces, read more than once, so a written table. Adds sequence_id and offset; every row is
    placed once, repeated rows too. Only narrow rows are shuffled: once by bin, once by sequence. Bins are dealt to
    several ranking tasks, so a length that a third of all pieces share stays spread out. The driver holds the counts
    by bin and deal, at most 256 x 4096 numbers.
    """
    rows = pieces.count()
    deals = int(np.clip(rows // ROWS_PER_RANKING, 64, 4096))
    dealt = pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int")).withColumn(
        "deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(deals)).cast("int")
    )
    bins = -(-window // unit)
    counts = np.zeros((bins + 1, deals), np.int64)
    for r in dealt.groupBy("bin", "deal").count().toLocalIterator():
        counts[r[0], r[1]] = r[2]
    before = np.cumsum(counts, axis=1) - counts
    table = slots(plan(counts.sum(axis=1)))
    keys = (table[:, 0] << 40) + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, deal, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bin", "deal", "n"))
            rank = before[b, deal] + n - 1
            slot = table[np.searchsorted(keys, (b << 40) + rank, side="right") - 1]
            rank -= slot[:, 1]
            sequence, order = slot[:, 3] + rank // slot[:, 2], slot[:, 4] + rank % slot[:, 2]
            columns = [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(order)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    ranking = Window.partitionBy("bin", "deal").orderBy("doc_id", "start", "ids_crc32")
    placed = dealt.withColumn("n", F.row_number().over(ranking)).mapInArrow(place, PIECES_SCHEMA + ", sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack whole texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    return pack(settle(cut_pieces(docs, path, window, id_col, text_col), "pieces"), window, unit)
