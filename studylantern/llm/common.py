"""Shared helpers: tables written to the cluster's shared folder, and text columns in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine (tests) a temporary one of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="studylantern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Text whose rows in a settled table are worth a file, and files that are always allowed.
FILE_TEXT_BYTES, LEAST_FILES = 2_000_000, 32


def files_for(text_bytes: int) -> int:
    """Files enough for a table about so much text."""
    return max(LEAST_FILES, text_bytes // FILE_TEXT_BYTES)


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    files: as many at most, where there are more partitions. Without Hadoop's native library an executor starts two processes
    for each file it writes (chmod of the file and of its checksum), so a step of many small tables should not write one of each for every partition.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.settled_at = path
    return written


def discard(*frames: DataFrame) -> None:
    """Remove settled tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores until no column begins with it (names are compared without case)."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def total(df: DataFrame, column) -> int:
    """One sum over a frame."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long")).first()[0]


def ranked(df: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """df with `rank`: 0, 1, 2 ... in the given order, in each group of the columns `group` anew (they lead the order), and `rank_of`, the group's rows.

    No group and no rank passes one task whole: rows are dealt by ranges of the order, numbered within their range, and shifted
    by the rows of the ranges before. Rows equal in all of `order` are dealt by a row number of their own, so they spread as
    well. The shifts are one row for each range and group that meet; without groups that is at most one for each partition,
    which is broadcast. `group` holds no nulls.
    """
    group = group or []
    rows = settle(df.withColumn("rank_row", F.monotonically_increasing_id()), "rank-rows")
    keys = [*order, F.col("rank_row")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = settle(dealt.withColumn("rank_part", F.spark_partition_id()).withColumn("rank_at", F.monotonically_increasing_id()), "rank-dealt")
    met = dealt.groupBy("rank_part", *group).agg(F.min("rank_at").alias("rank_first"), F.count("*").alias("rank_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rank_n").over(before), F.lit(0)) - F.col("rank_first")
    shifts = met.select("rank_part", *group, shift.alias("rank_shift"), F.sum("rank_n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rank_of"))
    out = dealt.join(shifts if group else F.broadcast(shifts), ["rank_part", *group])
    return out.select(*df.columns, (F.col("rank_at") + F.col("rank_shift")).alias("rank"), "rank_of")


def utf8(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    strings = batch.column(column)
    if strings.null_count:
        strings = strings.fill_null("")
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of text, or one row: bounds the memory of array work."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch, column)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last
