"""Parquet tables: current state in key-hash buckets under a manifest, logs in batches.

A table's rows lie in buckets by the hash of one of its key columns. Commit N is the file ``commits/N.json``, which names
for every bucket the folder that holds its files; it appears whole or not at all, and only once. A merge rewrites the
buckets that its batch touches and names the untouched files again, so a nightly batch of one per cent costs about that
much writing. A job that is lost half way leaves files that no commit names; a writer that finds its commit number
taken is refused. ``expire`` removes what only old commits name.

A log batch has its own folder and counts only with its ``_SUCCESS`` marker. A committed batch is never written again,
so a log only grows. ``compact`` folds committed batches into buckets by learner under a commit of the same kind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.operators import merge as merging
from studylantern.schemas import TABLES, table_schema
from studylantern.sources.files import CommitConflict, Folder

__all__ = ["CommitConflict"]

#: Buckets of a table that was not given a number by ``create``. At 100 TB some ten thousand give files of a few GB; the
#: manifest has one short entry for each.
BUCKETS = 8
BUCKET = "bucket"
#: A folder that no commit names is taken for a running writer's until it is this old.
ORPHAN_SECONDS = 24 * 3600

# --- fixed values: the key column that deals a table's rows ------------------
LAYOUT = {
    "users": "user_id", "enrollments": "enrollment_id", "assignments": "assignment_id", "submissions": "user_id",
    "quizzes": "quiz_id", "quiz_submissions": "user_id", "gate_calendar": "gate_name", "student_summaries": "user_id",
    "course_activity": "activity_date", "student_risk_signals": "user_id", "student_pii": "user_id",
    "student_demographics": "user_id", "learner_timing": "user_id", "learner_courses": "user_id",
    "flag_events": "user_id", "nudge_events": "user_id", "feed_rejects": "feed", "sync_runs": "run_id",
}


@dataclass(frozen=True)
class Commit:
    """A version of a table: where each non-empty bucket lies, and what the writer noted."""

    version: int = 0
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "folders": self.folders, "notes": self.notes})


def _commits(folder: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names("commits") if n.endswith(".json") and not n.startswith("."))


def commit(spark: SparkSession, base: str, name: str, version: int | None = None) -> Commit:
    """The newest commit of a table, or a given one; version 0 is the empty table."""
    folder = Folder(spark, f"{base}/{name}")
    if version is None:
        version = max(_commits(folder), default=0)
    if version == 0:
        return Commit()
    found = json.loads(folder.read(f"commits/{version}.json"))
    return Commit(version, found["buckets"], {int(b): f for b, f in found["folders"].items()}, found["notes"])


def bucket_of(name: str, buckets: int) -> Column:
    """The bucket of a row of a table."""
    return F.pmod(F.xxhash64(F.col(LAYOUT[name])), F.lit(buckets)).cast("int")


def buckets_of_keys(keys: DataFrame, name: str, buckets: int) -> set[int]:
    """The buckets of the keys in a frame; at most ``buckets`` numbers reach the driver."""
    return {r[0] for r in keys.select(bucket_of(name, buckets).alias(BUCKET)).distinct().collect()}


def _read(spark: SparkSession, base: str, name: str, at: Commit, only: Iterable[int] | None, extra: str = "") -> DataFrame:
    wanted = at.folders if only is None else {b: at.folders[b] for b in only if b in at.folders}
    if not wanted:
        return spark.createDataFrame([], TABLES[name] + extra)
    paths = [f"{base}/{name}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())]
    return spark.read.schema(TABLES[name] + extra).parquet(*paths)


def load(spark: SparkSession, base: str, name: str, only: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
    """Rows of a table: all, or those of some buckets, as of the newest or a given commit. An unwritten table is empty."""
    return _read(spark, base, name, commit(spark, base, name, version), only)


def lookup(spark: SparkSession, base: str, name: str, key) -> DataFrame:
    """Rows with one value of the column that deals the table: one bucket is opened, the filter reaches the scan."""
    at = commit(spark, base, name)
    return _read(spark, base, name, at, [_bucket_of_value(spark, name, at.buckets, key)]).filter(F.col(LAYOUT[name]) == F.lit(key))


def _bucket_of_value(spark: SparkSession, name: str, buckets: int, key) -> int:
    column = LAYOUT[name]
    one = spark.createDataFrame([(key,)], f"{column} {table_schema(name)[column].dataType.simpleString()}")
    return one.select(bucket_of(name, buckets)).first()[0]


def _write(df: DataFrame, base: str, name: str, buckets: int) -> dict[int, str]:
    """Write rows by bucket; returns the new folders. A bucket with a third of all rows is split over tasks, small ones share one."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    dealt = df.withColumn(BUCKET, bucket_of(name, buckets)).hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(f"{base}/{name}/data/{own}")
    prefix = f"{BUCKET}="
    return {int(n.removeprefix(prefix)): own for n in Folder(spark, f"{base}/{name}").names(f"data/{own}") if n.startswith(prefix)}


def _publish(spark: SparkSession, base: str, name: str, at: Commit) -> Commit:
    Folder(spark, f"{base}/{name}").publish(f"commits/{at.version}.json", at.text())
    return at


def create(spark: SparkSession, base: str, name: str, buckets: int) -> Commit:
    """Commit an empty table of so many buckets; refused where the table exists."""
    return _publish(spark, base, name, Commit(1, buckets))


def replace(df: DataFrame, base: str, name: str, buckets: int | None = None, notes: dict | None = None) -> Commit:
    """Commit a table anew, all buckets of it. The frame may read the table itself."""
    spark = df.sparkSession
    old = commit(spark, base, name)
    buckets = buckets or old.buckets
    folders = _write(df, base, name, buckets)
    return _publish(spark, base, name, Commit(old.version + 1, buckets, folders, notes or {}))


def replace_buckets(df: DataFrame, base: str, name: str, old: Commit, touched: Iterable[int], notes: dict | None = None) -> Commit:
    """Commit new rows of the touched buckets on top of the commit they were made from; the other buckets stay as they are."""
    kept = {b: folder for b, folder in old.folders.items() if b not in set(touched)}
    folders = kept | _write(df, base, name, old.buckets)
    return _publish(df.sparkSession, base, name, Commit(old.version + 1, old.buckets, folders, notes or {}))


def merge(
    incoming: DataFrame, base: str, name: str, rule: merging.MergeRule | None = None, ordinal: str | None = None
) -> Commit:
    """Merge a batch into a table, rewriting the buckets that it touches.

    The batch is settled to one row per key and staged by bucket, so it is evaluated once and the touched buckets are
    known by name. A batch that touches nothing commits nothing.
    """
    spark, own, rule = incoming.sparkSession, uuid.uuid4().hex, rule or merging.rule_for(name)
    folder, old = Folder(spark, f"{base}/{name}"), commit(spark, base, name)
    settled = merging.settled(incoming, rule, ordinal)
    settled.withColumn(BUCKET, bucket_of(name, old.buckets)).write.partitionBy(BUCKET).parquet(f"{base}/{name}/staged/{own}")
    touched = [int(n.removeprefix(f"{BUCKET}=")) for n in folder.names(f"staged/{own}") if n.startswith(f"{BUCKET}=")]
    if not touched:
        folder.remove(f"staged/{own}")
        return old
    staged = spark.read.schema(settled.schema).parquet(*[f"{base}/{name}/staged/{own}/{BUCKET}={b}" for b in touched])
    merged = merging.upsert(_read(spark, base, name, old, touched), staged, rule)
    done = replace_buckets(conform(merged, name), base, name, old, touched)
    folder.remove(f"staged/{own}")
    return done


def changed(spark: SparkSession, base: str, name: str, since: int | None) -> set[int] | None:
    """Buckets that differ between a former commit and the newest one; None where that cannot be told and all count as changed."""
    now = commit(spark, base, name)
    if since is None or (since and since not in _commits(Folder(spark, f"{base}/{name}"))):
        return None
    then = commit(spark, base, name, since)
    if since and then.buckets != now.buckets:
        return None
    return {b for b in then.folders.keys() | now.folders.keys() if then.folders.get(b) != now.folders.get(b)}


def expire(spark: SparkSession, base: str, name: str, keep: int = 3, orphan_seconds: float = ORPHAN_SECONDS) -> int:
    """Forget all but the newest ``keep`` commits and remove the files that only forgotten ones name; returns the folders removed.

    Readers of a kept commit are not disturbed. Files that no commit names are a lost writer's once they are old enough.
    """
    folder = Folder(spark, f"{base}/{name}")
    versions = _commits(folder)
    named = {v: {(f, b) for b, f in commit(spark, base, name, v).folders.items()} for v in versions}
    kept = set().union(*[named[v] for v in versions[-keep:]])
    gone = set().union(*[named[v] for v in versions[:-keep]]) - kept
    for v in versions[:-keep]:
        folder.remove(f"commits/{v}.json")
    for own, b in gone:
        folder.remove(f"data/{own}/{BUCKET}={b}")
    known = {own for own, _ in kept}
    removed = len(gone)
    for own in folder.names("data"):
        forgotten = own in {f for f, _ in gone}
        if own not in known and (forgotten or folder.age_seconds(f"data/{own}") > orphan_seconds):
            folder.remove(f"data/{own}")
            removed += not forgotten
    for own in folder.names("staged"):
        if folder.age_seconds(f"staged/{own}") > orphan_seconds:
            folder.remove(f"staged/{own}")
    return removed


def batches(spark: SparkSession, base: str, name: str) -> list[str]:
    """Committed batches of a log, compacted ones included."""
    at = commit(spark, base, name)
    return sorted({*at.notes.get("batches", []), *_open_batches(spark, base, name, at)})


def _open_batches(spark: SparkSession, base: str, name: str, at: Commit) -> list[str]:
    """Committed batches that have a folder of their own and that the commit has not folded in."""
    folder, folded = Folder(spark, f"{base}/{name}"), set(at.notes.get("batches", []))
    found = [n.removeprefix("batch=") for n in folder.names() if n.startswith("batch=")]
    return [b for b in found if b not in folded and folder.exists(f"batch={b}/_SUCCESS")]


def load_log(
    spark: SparkSession, base: str, name: str, except_batch: str | None = None, only_batch: str | None = None, key=None
) -> DataFrame:
    """Committed batches of an append-only log: all, all but the one being repeated, or one.

    ``key`` keeps the rows of one learner (``LAYOUT``): of the compacted batches one bucket is opened.
    """
    at = commit(spark, base, name)
    wanted = lambda b: b != except_batch and only_batch in (None, b)
    folded = [b for b in at.notes.get("batches", []) if wanted(b)]
    folders = [f"{base}/{name}/batch={b}" for b in _open_batches(spark, base, name, at) if wanted(b)]
    out = spark.read.schema(TABLES[name]).parquet(*folders) if folders else None
    if folded:
        only = None if key is None else [_bucket_of_value(spark, name, at.buckets, key)]
        rows = _read(spark, base, name, at, only, ", log_batch string")
        if except_batch is not None:
            rows = rows.filter(F.col("log_batch") != except_batch)
        if only_batch is not None:
            rows = rows.filter(F.col("log_batch") == only_batch)
        rows = rows.drop("log_batch")
        out = rows if out is None else rows.unionByName(out)
    if out is None:
        out = spark.createDataFrame([], TABLES[name])
    return out if key is None else out.filter(F.col(LAYOUT[name]) == F.lit(key))


def append(df: DataFrame, base: str, name: str, batch: str) -> None:
    """Add one batch to a log. A committed batch stays as it is; what a lost job left of one is replaced."""
    if batch in batches(df.sparkSession, base, name):
        return
    df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")


def compact(spark: SparkSession, base: str, name: str, least: int = 2) -> Commit:
    """Fold the batches that have a folder of their own into the log's buckets, if there are ``least`` of them.

    Only buckets that the batches touch get new files, beside the ones they have: rows of a bucket are rewritten
    together with it. Rows keep their ids and the name of their batch. The folders of folded batches are removed
    by ``expire_batches`` once no reader can hold them any more.
    """
    old = commit(spark, base, name)
    folded = _open_batches(spark, base, name, old)
    if len(folded) < least:
        return old
    fresh = None
    for b in folded:
        rows = spark.read.schema(TABLES[name]).parquet(f"{base}/{name}/batch={b}").withColumn("log_batch", F.lit(b))
        fresh = rows if fresh is None else fresh.unionByName(rows)
    touched = buckets_of_keys(fresh, name, old.buckets)
    merged = _read(spark, base, name, old, touched, ", log_batch string").unionByName(fresh)
    notes = {"batches": sorted({*old.notes.get("batches", []), *folded})}
    return replace_buckets(merged, base, name, old, touched, notes)


def expire_batches(spark: SparkSession, base: str, name: str, older_than: float = ORPHAN_SECONDS) -> int:
    """Remove the own folders of batches that were compacted long enough ago; returns how many."""
    folder, folded = Folder(spark, f"{base}/{name}"), set(commit(spark, base, name).notes.get("batches", []))
    gone = [b for b in folded if folder.exists(f"batch={b}") and folder.age_seconds(f"batch={b}") > older_than]
    for b in gone:
        folder.remove(f"batch={b}")
    return len(gone)


def with_ids(df: DataFrame, id_col: str, highest: int | None, step: str | None = None, steps: int = 1) -> DataFrame:
    """Number new log rows after ``highest``: unique and increasing across batches, without a global sort.

    ``step`` (0..steps-1) orders the rows that one input row produced. The ids
    depend on how rows fall into partitions, so later stages read the written
    batch rather than re-evaluating this frame.
    """
    offset = F.lit(steps) * F.monotonically_increasing_id()
    if step is not None:
        offset = offset + F.col(step)
    return df.withColumn(id_col, F.lit((highest or 0) + 1) + offset)


def highest_id(df: DataFrame, id_col: str) -> int | None:
    """Largest id of a log (one aggregate row on the driver)."""
    return df.agg(F.max(id_col)).first()[0]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project to the declared columns and types of a table; absent columns are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(name).fields
        ]
    )
