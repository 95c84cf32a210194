"""Operator 11 against a plain recursive tree and its reference SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from studylantern.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(run):
    """All levels of a tree over digests."""
    levels = [run]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 16]) for i in range(0, len(low), 16)])
    return levels


def way(levels, i):
    """(before, after) of each level above leaf i."""
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def expected(rows):
    trees = {}
    for r in rows:
        lower = r["text"]
        if r["doc_id"] is not None and lower is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in lower)
        trees.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r["doc_id"], leaf(r, lower)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: up([k[2] for k, _, _ in sorted(trees[s])]) for s in order}
    above = up([below[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, ((_, _, own), doc_id, claim) in enumerate(sorted(trees[s])):
            steps, node = way(below[s], i) + way(above, place), claim
            for before, after in steps:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in steps for x in before + after])
            out.append((doc_id, own, below[s][-1][0], above[-1][0], proof, node, node == above[-1][0]))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


DDL = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int, rank int"


def test_over_the_table(spark, sf):
    rows = found(queries.op11_merkle(spark, sf))
    assert rows == expected(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 3
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(duck.execute(queries.SQL["op11_merkle"]).fetchall(), key=repr) == rows


def test_odd_rows(spark):
    long = "Xy " * 200_000
    rows = [(i, "s", "en", 1, "T" * (i % 3), "d", 1, 1) for i in range(17)] + [(None, None, None, None, None, None, None, None)] * 2
    rows += [(3, "s", "en", 1, "again", None, None, None), (3, "s", "en", 1, "again", None, None, None), (4, "", None, 0, "", None, None, None), (40, "é", "x", 9, long, None, None, None)]
    rows += [(-5, f"lone {i}", None, None, "A-Z", None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, DDL)
    assert found(merkle.tampered(docs)) == expected(docs.collect())
    assert merkle.tampered(docs.limit(0)).collect() == []
    one = docs.filter("doc_id = 40")
    assert found(merkle.tampered(one)) == expected(one.collect())


def test_heights():
    assert [merkle.height(n) for n in (1, 2, 16, 17, 256, 257, 4096, 4097)] == [0, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096])
def test_positions_are_postorder(n):
    leaves = [h(str(i)).encode() for i in range(n)]
    levels = merkle.height(n)
    nodes, tree = merkle.completed(leaves, levels), up([x.decode() for x in leaves])
    at = [merkle.position(k, np.arange(len(level)), n, levels) for k, level in enumerate(tree)]
    assert sorted(np.concatenate(at).tolist()) == list(range(len(nodes)))
    assert all(nodes[p].decode() == d for level, ps in zip(tree, at, strict=True) for d, p in zip(level, ps.tolist(), strict=True))
    ways = merkle.paths(nodes, n, levels)
    assert len(ways) == n
    for i in {0, n // 2, n - 1}:
        shape, siblings = ways[i]
        assert siblings.decode() == "".join(x for before, after in way(tree, i) for x in before + after)
        assert merkle.fold(leaves[i], shape, siblings) == nodes[-1]
        assert n == 1 or merkle.fold(h("other").encode(), shape, siblings) != nodes[-1]


def test_log_of_a_big_tree(spark):
    """10,000 leaves of one tree need two stages; each node stands once, at its place in the postorder of the whole tree."""
    rows = spark.range(10_000).select(F.expr("if(id < 9990, 'big', cast(id as string))").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    log = merkle.append_log(rows, [F.col("doc_id")], ["doc_id"])
    assert len(log.stages) == 2 and log.roots().count() == 11
    tree = up([h(str(i)) for i in range(9990)])
    big = sorted(map(tuple, log.nodes().filter("tree = 'big'").select("position", "level", "index", "digest").collect()))
    assert [r[0] for r in big] == list(range(sum(map(len, tree))))
    assert all(tree[level][index] == digest for _, level, index, digest in big)
    assert log.nodes().filter("tree <> 'big'").count() == 10


def test_whole_manifest_over_two_stages(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("if(id < 8500, 'hot', cast(id % 40 as string))").alias("source"), F.lit("en").alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.expr("concat('Text ', id)").alias("text"))
    assert found(merkle.tampered(docs)) == expected(docs.collect())
