"""Merkle manifest of a dataset as a postorder append log (operator 11).

Each tree (a source) has its rows as leaves in order; 16 consecutive nodes close into their parent. Nodes are logged in the
order in which they are completed, which is postorder: a node follows its last leaf, above all smaller subtrees. The place of
any node follows from the sizes of the subtrees before it, so siblings of a proof are addressed without a search.

Leaves are dealt to aligned builders: builder b has the leaves from 4096 b on, closes three levels by itself and writes one
segment of the log. The segments' roots are the leaves of the next stage, and so on until each tree has one segment; the roots
of the trees are leaves of a last tree. Proofs come down the same way: a segment hands each of its leaves its siblings, level by
level, before those that the segment itself was handed. So each task holds a segment at a time, however big a tree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylantern.llm.common import ranked, settle

FAN = 16
#: Levels that a builder closes: its segment has at most FAN ** LEVELS leaves.
LEVELS = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHECKED_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH_SCHEMA = "tree string, block long, shape binary, siblings binary, subroot string, root string"


def digest(*parts: bytes) -> bytes:
    """Lowercase hex sha256 of the parts one after the other; digests go in as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(column: Column) -> Column:
    """`-` for null, else the byte count, `:` and the value: no two rows of fields give the same string."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def height(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fan), levels + 1
    return levels


def position(level: int, index, leaves: int, levels: int, fan: int = FAN):
    """Places in the log of the nodes `index` of a level, in a tree (or segment) of so many leaves and levels.

    A node is written `level` places after its last leaf; before that leaf stand the leaves before it and, of each level, the
    nodes that these fill.
    """
    last = np.minimum((np.asarray(index, np.int64) + 1) * fan**level, leaves) - 1
    return last + sum(last // fan**k for k in range(1, levels + 1)) + level


def completed(leaves: list[bytes], levels: int, fan: int = FAN) -> list[bytes]:
    """The nodes of a segment in the order of their completion."""
    nodes, open_runs = [], [[] for _ in range(levels + 1)]
    for i, node in enumerate(leaves):
        nodes.append(node)
        open_runs[0].append(node)
        for level in range(levels):
            if len(open_runs[level]) < fan and i < len(leaves) - 1:
                break
            node = digest(*open_runs[level])
            open_runs[level].clear()
            nodes.append(node)
            open_runs[level + 1].append(node)
    return nodes


def paths(nodes: list[bytes], leaves: int, levels: int, shape: bytes = b"", siblings: bytes = b"", fan: int = FAN) -> list[tuple[bytes, bytes]]:
    """For each leaf of a segment the shape and the siblings of its way up, which goes on with the segment's own.

    The shape has two bytes a level: the node's place in its run, and the number of its siblings.
    """
    found = [(shape, siblings)]
    for level in range(levels - 1, -1, -1):
        size = -(-leaves // fan**level)
        at = position(level, np.arange(size), leaves, levels, fan)
        lower = []
        for parent, (up_shape, up_siblings) in enumerate(found):
            run = [nodes[p] for p in at[parent * fan : (parent + 1) * fan].tolist()]
            for place in range(len(run)):
                lower.append((bytes((place, len(run) - 1)) + up_shape, b"".join(run[:place] + run[place + 1 :]) + up_siblings))
        found = lower
    return found


def fold(leaf: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for place, others in zip(shape[::2], shape[1::2], strict=True):
        mine, end = at + 64 * place, at + 64 * others
        leaf, at = digest(siblings[at:mine], leaf, siblings[mine:end]), end
    return leaf


@dataclass(frozen=True)
class Log:
    """The written log. Each stage has a row for each segment: tree, block, n (leaves of the tree in this stage), entries (the
    segment's leaves in order, with what is carried along), nodes (digests in completion order), root."""

    stages: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, root."""
        last = [s.filter(F.col("n") <= FAN**LEVELS).select("tree", "root") for s in self.stages]
        out = last[0]
        for more in last[1:]:
            out = out.union(more)
        return out

    def nodes(self) -> DataFrame:
        """tree, level, index, position (its place in the tree's postorder) and digest of every node, each once."""
        out = None
        for stage, segments in enumerate(self.stages):
            rows = segments.join(self.stages[0].select("tree", F.col("n").alias("leaves")).distinct(), "tree").mapInArrow(
                lambda batches, stage=stage: _addressed(batches, stage), "tree string, level int, index long, position long, digest string"
            )
            out = rows if out is None else out.union(rows)
        return out


def _segment_levels(n: int) -> int:
    return height(n) if n <= FAN**LEVELS else LEVELS


def _split(nodes: bytes) -> list[bytes]:
    text = nodes.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str] | None = None) -> Iterator[dict]:
    """Rows of batches, a segment at a time in Python objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield (batch.select(columns) if columns else batch).slice(k, 1).to_pylist()[0]


def _addressed(batches: Iterator[pa.RecordBatch], stage: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches, ["tree", "block", "n", "entries", "nodes", "leaves"]):
        nodes, m, levels = _split(row["nodes"]), len(row["entries"]), _segment_levels(row["n"])
        for level in range(1 if stage else 0, levels + 1):  # the leaves of a later stage are roots of an earlier one
            index = np.arange(-(-m // FAN**level))
            own = position(level, index, m, levels)
            index = index + row["block"] * FAN ** (LEVELS - level)
            above = stage * LEVELS + level
            whole = position(above, index, row["leaves"], height(row["leaves"]))
            yield pa.RecordBatch.from_pydict(
                {"tree": [row["tree"]] * len(own), "level": pa.array([above] * len(own), pa.int32()), "index": index, "position": whole, "digest": [nodes[p].decode() for p in own]}
            )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        written, roots = [], []
        for entries, n in zip(batch.column("entries"), batch.column("n").to_pylist(), strict=True):
            leaves = [d.encode() for d in entries.values.field("digest").to_pylist()]
            nodes = completed(leaves, _segment_levels(n))
            written.append(bytes.fromhex(b"".join(nodes).decode()))
            roots.append(nodes[-1].decode())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(written, pa.binary()), pa.array(roots, pa.string())], [*batch.schema.names, "nodes", "root"])


def _stage(leaves: DataFrame, carried: list[str], number: int) -> DataFrame:
    """Segments of leaves (tree, rank, n, digest and the carried columns)."""
    block = F.floor(F.col("rank") / F.lit(FAN**LEVELS)).cast("long")
    entry = F.struct("rank", "digest", *carried)
    groups = leaves.withColumn("block", block).groupBy("tree", "block", "n").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return settle(groups.mapInArrow(_build, T.StructType([*groups.schema, T.StructField("nodes", T.BinaryType()), T.StructField("root", T.StringType())])), f"merkle-log-{number}")


def append_log(rows: DataFrame, order: list[Column], carried: list[str]) -> Log:
    """Build the log of rows (tree: no nulls; digest: the leaf as lowercase hex; and the carried columns), by trees in the given order.

    One pass over the rows; then narrow rows are ranked and dealt to the builders. A tree with a third of all rows has as
    many builders as its leaves need. Rows equal in the order have their digests next, so equal tables give equal logs.
    """
    leaves = ranked(rows, [F.col("tree"), *order, F.col("digest")], ["tree"])
    stages = [_stage(leaves.withColumnRenamed("rank_of", "n"), carried, 0)]
    while True:
        unfinished = stages[-1].filter(F.col("n") > FAN**LEVELS)
        if unfinished.isEmpty():
            return Log(stages)
        above = unfinished.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(FAN**LEVELS)).cast("long").alias("n"), F.col("root").alias("digest"))
        stages.append(_stage(above, [], len(stages)))


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments with their paths to the paths of their leaves, which are segments of the stage below."""
    for row in _rows(batches):
        m = len(row["entries"])
        found = paths(_split(row["nodes"]), m, _segment_levels(row["n"]), row["shape"], row["siblings"])
        yield pa.RecordBatch.from_pydict(
            {
                "tree": [row["tree"]] * m,
                "block": [e["rank"] for e in row["entries"]],
                "shape": pa.array([s for s, _ in found], pa.binary()),
                "siblings": pa.array([s for _, s in found], pa.binary()),
                "subroot": [row["subroot"]] * m,
                "root": [row["root"]] * m,
            }
        )


def segment_paths(log: Log, tops: DataFrame) -> DataFrame:
    """The ways from the segments of the lowest stage to the root, given those of the trees (tops: PATH_SCHEMA without block)."""
    below = None
    for number in range(len(log.stages) - 1, -1, -1):
        ends = log.stages[number].filter(F.col("n") <= FAN**LEVELS).select("tree", "block").join(tops, "tree")
        ends = ends.select("tree", "block", "shape", "siblings", "subroot", "root")
        found = ends if below is None else ends.union(below)
        if number == 0:
            return found
        below = log.stages[number].drop("root").join(found, ["tree", "block"]).mapInArrow(_down, PATH_SCHEMA)
        below = settle(below, f"merkle-paths-{number}")
    raise AssertionError("a log has at least one stage")


def forest_tops(log: Log, names: DataFrame) -> DataFrame:
    """Way of each tree's root to the root of all, over the tree of trees in the order of their names (null first)."""
    leaves = log.roots().select("tree", F.col("root").alias("digest")).join(names, "tree")
    over = append_log(leaves.select(F.lit("").alias("tree"), F.col("tree").alias("below"), "name", "digest"), [F.col("name").asc_nulls_first()], ["below"])
    empty = F.lit(b"")
    top = over.roots().select("tree", empty.alias("shape"), empty.alias("siblings"), F.lit("").alias("subroot"), "root")
    found = over.stages[0].withColumnRenamed("root", "own").join(segment_paths(over, top), ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ways = paths(_split(row["nodes"]), len(row["entries"]), _segment_levels(row["n"]), row["shape"], row["siblings"])
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": [e["below"] for e in row["entries"]],
                    "shape": pa.array([s for s, _ in ways], pa.binary()),
                    "siblings": pa.array([s for _, s in ways], pa.binary()),
                    "subroot": [e["digest"] for e in row["entries"]],
                    "root": [row["root"]] * len(ways),
                }
            )

    return settle(found.mapInArrow(run, "tree string, shape binary, siblings binary, subroot string, root string"), "merkle-tops")


def manifest(docs: DataFrame, claims: list[Column] | None = None, columns: tuple[str, ...] = LEAF_COLUMNS, id_col: str = "doc_id", tree_col: str = "source") -> DataFrame:
    """Build the manifest of docs and check claimed rows against it.

    claims: the columns as somebody presents them (default: unchanged). Returns per row doc_id, leaf, subroot (of its
    tree), root, proof_sha256 (of its siblings), folded_root (of the claimed row and these siblings) and verified. Rows
    without an id come first, a null tree is a tree of its own, repeated rows are leaves of their own, and rows equal in
    tree and id follow their digests. Other columns are ignored, whatever their names; an empty table gives an empty frame.
    """
    name = docs[tree_col].cast("string")
    rows = docs.select(
        field(name).alias("tree"),
        name.alias("name"),
        docs[id_col].cast("long").alias("doc_id"),
        leaf_digest([docs[c] for c in columns]).alias("digest"),
        leaf_digest(claims or [docs[c] for c in columns]).alias("claim"),
    )
    rows = settle(rows.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim"))), "merkle-rows")
    log = append_log(rows.drop("name"), [F.col("doc_id").asc_nulls_first()], ["doc_id", "claim"])
    tops = forest_tops(log, rows.select("tree", "name").distinct())
    ready = log.stages[0].drop("root").join(segment_paths(log, tops), ["tree", "block"])
    return ready.mapInArrow(_checked, CHECKED_SCHEMA)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            value = {c: batch.column(c)[k] for c in batch.schema.names}
            entries = value["entries"].values
            leaves, claims = entries.field("digest").to_pylist(), entries.field("claim").to_pylist()
            ways = paths(_split(value["nodes"].as_py()), len(leaves), _segment_levels(value["n"].as_py()), value["shape"].as_py(), value["siblings"].as_py())
            root = value["root"].as_py()
            folded = [fold((c or d).encode(), *way).decode() for d, c, way in zip(leaves, claims, ways, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": entries.field("doc_id"),
                    "leaf": leaves,
                    "subroot": [value["subroot"].as_py()] * len(leaves),
                    "root": [root] * len(leaves),
                    "proof_sha256": [hashlib.sha256(s).hexdigest() for _, s in ways],
                    "folded_root": folded,
                    "verified": [f == root for f in folded],
                }
            )


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy whose texts are lower-cased in A-Z where 5 divides the crc32 of the id."""
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(hit, F.translate(docs["text"], UPPER, UPPER.lower())).otherwise(docs["text"])
    return manifest(docs, [text if c == "text" else docs[c] for c in LEAF_COLUMNS])
