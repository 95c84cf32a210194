"""Approximate nearest neighbours by multi-index hashing (operator 9).

1. A rotation is learned on a bounded sample: principal directions, then the orthogonal matrix that brings rotated
   vectors closest to their own signs. The signs are a binary code; the rotation of a further random orthogonal basis
   gives each following set of bits.
2. Codes are cut into substrings, each with an index of its own: rows in order of the substring. By the pigeonhole
   principle a code within Hamming distance R differs in at most R / m bits in one of m substrings at least, so probing
   all substring values within that distance finds every code in the radius. Their float vectors rank the results.
3. The radius is the one within which `reach` of the true neighbours lie in the sample.

Rows are dealt to shards by a hash; the stated queries meet each shard in blocks. Queries that find fewer rows than they
need in all shards together are asked again with the full radius, so the result is never short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylantern.llm.common import parts, settle

#: Rows of the sample for the rotation, rows and queries of the one for the radius, bits of a code and of a substring.
ROTATION_ROWS, RADIUS_ROWS, RADIUS_QUERIES, BITS, PART_BITS = 20_000, 20_000, 300, 256, 8
REACH = 0.98
SHARD_ROWS, LEAST_ROWS, BLOCK_QUERIES = 50_000, 2_000, 20_000
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Codes:
    """Rotations (one square matrix for each set of bits) and the Hamming radius to probe."""

    rotations: tuple[np.ndarray, ...]
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Code of each row as bytes; a byte is a substring."""
        return np.packbits(np.concatenate([unit @ r > 0 for r in self.rotations], axis=1), axis=1)


def learn_rotations(unit: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, ...]:
    """Alternate between signs and the best orthogonal map to them, from the principal directions and from random bases."""
    rng, d, out = np.random.default_rng(11), unit.shape[1], []
    values, vectors = np.linalg.eigh(unit.T @ unit)
    start = vectors[:, np.argsort(-values)]
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            signs = np.where(unit @ start @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd((unit @ start).T @ signs)
            turn = u @ v
        out.append(start @ turn)
        start = np.linalg.qr(rng.standard_normal((d, d)))[0]
    short = bits - d * (len(out) - 1)
    return (*out[:-1], out[-1][:, :short])


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return _ONES[codes ^ query].sum(axis=1, dtype=np.int32)


def fit(vectors: DataFrame, neighbours: int, bits: int = BITS, reach: float = REACH) -> Codes | None:
    """Rotations and radius from bounded samples: the rows with the lowest hashes of their ids. None without rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(ROTATION_ROWS, RADIUS_ROWS)).select("vec_id", "v").collect()
    if not rows:
        return None
    unit = normal(np.array([r["v"] for r in sorted(rows, key=lambda r: r["vec_id"])]))
    codes = Codes(learn_rotations(unit[:ROTATION_ROWS], bits), 0)
    unit = unit[:RADIUS_ROWS]
    own, seen = codes.of(unit), []
    for i in np.linspace(0, len(unit) - 1, min(RADIUS_QUERIES, len(unit))).astype(int):
        near = unit @ unit[i]
        near[i] = -np.inf
        seen.append(distances(own[np.argsort(-near)[: min(neighbours, len(unit) - 1)]], own[i]))
    found = np.concatenate(seen)
    return Codes(codes.rotations, int(np.quantile(found, reach)) if len(found) else bits)


def normal(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that large or small components neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: no null, non-finite or all-zero ones."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


class MultiIndex:
    """One index for each substring of the codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.parts)]
        self.cuts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.flips = [np.array([sum(1 << b for b in c) for r in range(n + 1) for c in combinations(range(PART_BITS), r)], np.uint8) for n in range(PART_BITS + 1)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius, in no order."""
        spread, rest = divmod(radius, self.parts)
        hit = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            # only the first rest + 1 substrings need the full distance: if each of those exceeded it and the others reached it, the sum would exceed the radius
            reach = spread if j <= rest else spread - 1
            if reach < 0:
                continue
            for value in (query[j] ^ self.flips[min(reach, PART_BITS)]).tolist():
                hit[self.order[j][self.cuts[j][value] : self.cuts[j][value + 1]]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], query) <= radius]


def search(rows: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], codes: Codes, neighbours: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the nearest rows within the radius in a shard (ids, cosines), ties to smaller ids."""
    ids, v = rows
    unit, asked = normal(v), normal(queries[1])
    index = MultiIndex(codes.of(unit))
    for q, x, code in zip(queries[0].tolist(), asked, codes.of(asked), strict=True):
        found = index.within(code, codes.radius)
        found = found[ids[found] != q]
        cosine = (unit[found] * x).sum(axis=1)
        best = np.lexsort((ids[found], -cosine))[:neighbours]
        yield q, ids[found][best], cosine[best]


def vectors_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("vec_id").to_numpy(), flat.reshape(t.num_rows, -1)


def meet(rows: DataFrame, asked: DataFrame, shards: int, blocks: int, codes: Codes, neighbours: int) -> DataFrame:
    """query_id, vec_id and score of the nearest rows within the radius for each query and shard."""
    every_shard, every_block = (F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>")) for k in (shards, blocks))
    asked = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), "vec_id", "v").withColumn("s", every_shard)
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("s"), "vec_id", "v").withColumn("b", every_block)

    def run(some: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if some.num_rows and questions.num_rows:
            for q, ids, scores in search(vectors_of(some), vectors_of(questions), codes, neighbours):
                out += zip([q] * len(ids), ids.tolist(), scores.tolist(), strict=True)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return dealt.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, neighbours: int = 5, bits: int = BITS, reach: float = REACH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of each query: the rows whose id `every` divides, against all other rows.

    Nearness is the cosine in double precision, ties to the smaller id; a query's own id is no candidate. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do ids that are null; vectors of another
    length than the most frequent one are left out likewise. Rows that repeat the query's id are no candidates; other
    repeated rows are candidates one by one. Blocks of queries are sent to every shard of rows: the stated query set
    against all rows.
    """
    rows = valid(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = settle(rows.filter(F.size("v") == common["d"]), "vectors")
    codes, n = fit(rows, neighbours, bits, reach), common["count"]
    shards, blocks = max(-(-n // SHARD_ROWS), min(parts(rows), -(-n // LEAST_ROWS))), -(-n // (every * BLOCK_QUERIES))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.first("v").alias("v"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

    first = settle(ranked(meet(rows, asked, shards, blocks, codes, neighbours)), "nearest")
    full = first.groupBy("query_id").count().filter(F.col("count") == neighbours).select(F.col("query_id").alias("vec_id"))
    short = settle(asked.join(full, "vec_id", "left_anti"), "short")
    again = ranked(meet(rows, short, shards, blocks, Codes(codes.rotations, bits), neighbours))
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(first.columns).union(again)
