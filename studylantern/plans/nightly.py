"""The nightly batch and the review step over stored tables.

Every step reads committed tables and commits its own output, so a lost
executor costs a task, a lost job costs one step, and a repeated step gives
the same tables: merges rewrite the buckets they touch, committed log batches stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.functions import moment
from studylantern.operators import delivery, drafts, flags, lifecycle, merge
from studylantern.plans import incremental
from studylantern.schemas import FEEDS
from studylantern.session import prepare
from studylantern.sources import dims, feeds, runlog, tables
from studylantern.sources.files import Folder

FEED_STEPS = (
    "users", "assignments", "enrollments", "student_summaries", "submissions", "quizzes", "quiz_submissions", "course_activity",
)
STATE_TABLES = (*FEED_STEPS, "gate_calendar", "learner_timing", "learner_courses", "student_risk_signals", "student_pii", "student_demographics")
LOGS = ("flag_events", "nudge_events", "feed_rejects", "sync_runs")


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write a frame and return its row count, observed during the write."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def _appended(df: DataFrame, base: str, name: str, batch: str) -> int:
    """Append a batch to a log, or find it there; returns its row count."""
    spark = df.sparkSession
    if batch in tables.batches(spark, base, name):
        return tables.load_log(spark, base, name, only_batch=batch).count()
    return _counted(df, lambda rows: tables.append(rows, base, name, batch))


def _attempt(spark: SparkSession, base: str, batch: str) -> str:
    """A name for the rejects of one attempt: numbered by the committed batches of those before."""
    return f"{batch}-{sum(b.startswith(batch) for b in tables.batches(spark, base, 'feed_rejects'))}"


def _stored(df: DataFrame, path: str) -> DataFrame:
    """A frame written next to the tables and read back, so that it is evaluated once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seed_gates(spark: SparkSession, base: str, gates: DataFrame | None = None) -> int:
    """Add missing gates by name, then keep the lowest id per name."""
    stored = tables.load(spark, base, "gate_calendar")
    fresh = tables.with_ids(dims.gate_dim(spark) if gates is None else gates, "gate_id", tables.highest_id(stored, "gate_id"))
    merged = merge.dedupe_keep_first(merge.insert_missing(stored, fresh, ["gate_name"]), ["gate_name"], "gate_id")
    return _counted(tables.conform(merged, "gate_calendar"), lambda df: tables.replace(df, base, "gate_calendar"))


def _rows(spark: SparkSession, feed: DataFrame, name: str, base: str, as_of, cfg: Config) -> DataFrame:
    if name == "users":
        return feeds.users_from_feed(feed, as_of, cfg)
    if name == "assignments":
        return feeds.assignments_from_feed(feed, dims.deadline_dim(spark), as_of, cfg)
    if name == "enrollments":
        return feeds.enrollments_from_feed(feed, cfg)
    if name == "student_summaries":
        return feeds.summaries_from_feed(feed, as_of, cfg)
    if name == "submissions":
        return feeds.submissions_from_feed(feed, tables.load(spark, base, "assignments"), as_of, cfg)
    if name == "quizzes":
        return feeds.quizzes_from_feed(feed, as_of, cfg)
    if name == "quiz_submissions":
        return feeds.quiz_submissions_from_feed(feed, as_of, cfg)
    stored = tables.load(spark, base, "course_activity")
    return tables.with_ids(feeds.activity_from_feed(feed), "activity_id", tables.highest_id(stored, "activity_id"))


def ingest_feed(
    spark: SparkSession, landing: str, base: str, name: str, as_of=None, cfg: Config = DEFAULT, batch: str | None = None
) -> tuple[int, int]:
    """Merge one landed feed into its table; returns the records merged and those rejected.

    Pages that cannot be read and records without a key go to the
    ``feed_rejects`` log, never into the table. Each call without ``batch`` has
    a log batch of its own; with one, a committed batch stays as it is.
    """
    if batch is None:
        batch = _attempt(spark, base, "manual")
    aside = f"landed/{name}-{uuid.uuid4().hex}"
    parsed = _stored(feeds.parse_pages(spark, f"{landing}/{name}", FEEDS[name], wrapper=feeds.WRAPPERS.get(name)), f"{base}/{aside}")
    feed, broken = feeds.records_of(parsed), feeds.rejects_of(parsed)
    incoming, keyless = merge.split_keyless(_rows(spark, feed, name, base, as_of, cfg), merge.rule_for(name))

    def logged(rows: DataFrame, reason: str, page: Column, record: Column, part: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("feed"), F.lit(reason).alias("reason"), page.alias("page"), record.alias("record"), part.alias("parsed"))

    none = F.lit(None).cast("string")
    rejects = logged(broken, "unreadable page", F.col("page"), F.col("record"), F.col("parsed"))
    for rows in (keyless, feeds.without_keys(feed, name)):
        if rows is not None:
            text = F.to_json(F.struct(*[c for c in rows.columns if c != feeds.ORDINAL]))
            rejects = rejects.unionByName(logged(rows, "no key", none, text, none))
    n_rejects = _appended(tables.conform(rejects, "feed_rejects"), base, "feed_rejects", f"{batch}-{name}")
    seen = Observation()
    tables.merge(incoming.observe(seen, F.count(F.lit(1)).alias("n")), base, name, ordinal=feeds.ORDINAL)
    Folder(spark, base).remove(aside)
    return seen.get["n"], n_rejects


def refresh_signals(spark: SparkSession, base: str, as_of=None, cfg: Config = DEFAULT) -> int:
    """Bring the signals up to date from stored parts; learners that vanished from ``users`` keep their old row."""
    fresh = incremental.refreshed_signals(spark, base, as_of, cfg)
    stored = tables.load(spark, base, "student_risk_signals")
    merged = merge.upsert(stored, fresh, merge.rule_for("student_risk_signals"))
    return _counted(
        tables.conform(merged, "student_risk_signals"), lambda df: tables.replace(df, base, "student_risk_signals")
    )


def raise_flags(spark: SparkSession, base: str, batch: str, as_of=None, cfg: Config = DEFAULT) -> int:
    """Append the new flags as one batch; a batch that is committed already stays as it is."""
    known = tables.load_log(spark, base, "flag_events", except_batch=batch)
    new = flags.run_flags(
        tables.load(spark, base, "student_risk_signals"), tables.load(spark, base, "enrollments"), known, as_of, cfg
    )
    rows = tables.conform(tables.with_ids(new, "flag_id", tables.highest_id(known, "flag_id")), "flag_events")
    return _appended(rows, base, "flag_events", batch)


def write_drafts(spark: SparkSession, base: str, batch: str, as_of=None, cfg: Config = DEFAULT) -> int:
    """Append pending drafts for the open flags that have none; a committed batch stays as it is."""
    known = tables.load_log(spark, base, "nudge_events", except_batch=batch)
    new = drafts.generate_drafts(
        tables.load_log(spark, base, "flag_events"), known, tables.load(spark, base, "users"),
        tables.load(spark, base, "student_risk_signals"), tables.load(spark, base, "enrollments"), as_of, cfg,
    )
    rows = tables.conform(tables.with_ids(new, "nudge_id", tables.highest_id(known, "nudge_id")), "nudge_events")
    return _appended(rows, base, "nudge_events", batch)


def run_nightly(
    spark: SparkSession, landing: str, base: str, run_id: int, as_of=None, cfg: Config = DEFAULT
) -> dict[str, int]:
    """All steps in order, with a run-log row for success or failure. Committed steps stay on failure."""
    prepare(spark)
    batch = f"run-{run_id:09d}"
    started = _clock(spark)
    counts: dict[str, int] = {}
    rejected: dict[str, int] = {}
    # rejects of a repeated run are those of what it read then; its outcome is a row of its own
    attempt = _attempt(spark, base, batch)
    number = sum(b.startswith(batch) for b in tables.batches(spark, base, "sync_runs"))
    try:
        counts["gate_calendar"] = seed_gates(spark, base)
        for name in FEED_STEPS:
            counts[name], rejected[name] = ingest_feed(spark, landing, base, name, as_of, cfg, attempt)
        counts["student_risk_signals"] = refresh_signals(spark, base, as_of, cfg)
        counts["flag_events"] = raise_flags(spark, base, batch, as_of, cfg)
        counts["nudge_events"] = write_drafts(spark, base, batch, as_of, cfg)
    except Exception as error:
        row = runlog.run_row(spark, run_id, started, _clock(spark), "failed", str(error), counts, cfg, number)
        tables.append(row, base, "sync_runs", f"{batch}-{number}")
        raise
    row = runlog.run_row(spark, run_id, started, _clock(spark), "success", None, counts, cfg, number)
    tables.append(row, base, "sync_runs", f"{batch}-{number}")
    tidy(spark, base)
    return counts | {"feed_rejects": sum(rejected.values())}


def tidy(spark: SparkSession, base: str, keep: int = 3, least_batches: int = 30) -> None:
    """Fold many small log batches into files by learner, and drop versions and folders that nobody reads any more."""
    for name in STATE_TABLES:
        tables.expire(spark, base, name, keep)
    for name in LOGS:
        tables.compact(spark, base, name, least_batches)
        tables.expire(spark, base, name, keep)
        tables.expire_batches(spark, base, name)


def _clock(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp()).first()[0]


def record_reviews(
    spark: SparkSession, base: str, decisions: DataFrame, outcomes: DataFrame, batch: str, as_of=None, cfg: Config = DEFAULT
) -> DataFrame:
    """Append the rows of one batch of decisions and its hand-over briefings; returns the rejected decisions.

    Send results of drafts that were approved in an earlier batch are recorded
    too. ``decisions`` and ``outcomes`` should be stored tables: they are read
    again when the returned frame is evaluated.
    """
    known = tables.load_log(spark, base, "nudge_events", except_batch=batch)
    users, risk, courses = (tables.load(spark, base, n) for n in ("users", "student_risk_signals", "enrollments"))
    rows, rejects = lifecycle.apply_decisions(known, decisions, outcomes, tables.load(spark, base, "student_pii"), as_of, cfg)
    handed_over = rows.filter(F.col("delivery_status") == "escalated")
    briefings, unbriefed = delivery.ta_briefings(handed_over, users, risk, courses, outcomes, as_of, cfg)
    # one row per event, rows of one draft adjacent and in step order
    late = lifecycle.record_outcomes(known, outcomes, as_of)
    numbered = tables.with_ids(rows.unionByName(briefings).unionByName(late), "nudge_id", tables.highest_id(known, "nudge_id"), "step", 3)
    tables.append(tables.conform(numbered, "nudge_events"), base, "nudge_events", batch)
    failed = unbriefed.select(
        F.lit(None).cast("long").alias("decision_id"), "draft_id", F.lit("escalate").alias("action"),
        F.lit(None).cast("string").alias("reviewer_id"), F.col("failure_reason").alias("reject_reason"),
    )
    return rejects.unionByName(failed)


def load_demographics(spark: SparkSession, path: str, base: str, as_of=None) -> tuple[int, int]:
    """Match the export to learners and merge both parts; returns (loaded, skipped) row counts.

    Records and their match are stored once and feed both tables, the count of skipped rows included.
    """
    from studylantern.sources.demographics import match_demographics, read_demographics, split_pii

    aside = f"landed/demographics-{uuid.uuid4().hex}"
    export = _stored(read_demographics(spark, path), f"{base}/{aside}/records")
    found, skipped = match_demographics(export, tables.load(spark, base, "users"))
    matched = _stored(found, f"{base}/{aside}/matched")
    pii, rest = split_pii(matched, moment(as_of))
    for name, part in (("student_pii", pii), ("student_demographics", rest)):
        tables.merge(part, base, name, ordinal=feeds.ORDINAL)
    counts = {r["table_name"]: r["n_rows"] for r in runlog.run_metrics({"loaded": matched, "skipped": skipped}).collect()}
    Folder(spark, base).remove(aside)
    return counts["loaded"], counts["skipped"]
