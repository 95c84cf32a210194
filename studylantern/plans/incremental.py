"""Risk signals kept up from stored parts: a night reads only the facts that the last merges touched.

Two parts hold one row per learner and no date: the sums behind average and trend (``learner_timing``) and the enrollment
that counts (``learner_courses``). Their commits note which commits of the facts they stand for. A refresh compares the
manifests, recomputes the parts of the buckets that differ, and leaves all other files alone. What depends on the date or on
the whole course (silence, gates, highest view count) is worked out from the parts, which are as small as the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.operators import signals
from studylantern.sources import tables


def _since(part: tables.Commit, source: str) -> int | None:
    """The commit of the facts that a part stands for; None before the first refresh."""
    return part.notes.get(source)


def refresh_timing(spark: SparkSession, base: str, cfg: Config = DEFAULT) -> set[int] | None:
    """Bring ``learner_timing`` up to the newest submissions; returns the recomputed buckets (None: all).

    Submissions and sums are dealt by learner into the same buckets, so a bucket of sums follows from one bucket of
    submissions.
    """
    part, now = tables.commit(spark, base, "learner_timing"), tables.commit(spark, base, "submissions")
    touched = tables.changed(spark, base, "submissions", _since(part, "submissions"))
    notes = {"submissions": now.version}
    if touched is None or part.buckets != now.buckets:
        every = signals.timing_halves(tables.load(spark, base, "submissions", version=now.version), cfg)
        tables.replace(tables.conform(every, "learner_timing"), base, "learner_timing", now.buckets, notes)
        return None
    if touched:
        fresh = signals.timing_halves(tables.load(spark, base, "submissions", touched, now.version), cfg)
        tables.replace_buckets(tables.conform(fresh, "learner_timing"), base, "learner_timing", part, touched, notes)
    return touched


def refresh_courses(spark: SparkSession, base: str) -> set[int] | None:
    """Bring ``learner_courses`` up to the newest enrollments; returns the recomputed buckets (None: all).

    Enrollments are dealt by their own id, so a learner's may lie in any bucket. Merges never remove an enrollment nor give it
    to another learner; hence the lowest id of a learner is the stored one or in a changed bucket, and a changed copy of the
    stored one replaces it.
    """
    part, now = tables.commit(spark, base, "learner_courses"), tables.commit(spark, base, "enrollments")
    touched = tables.changed(spark, base, "enrollments", _since(part, "enrollments"))
    notes = {"enrollments": now.version}
    if touched is None:
        every = signals.primary_enrollment(tables.load(spark, base, "enrollments", version=now.version)).filter(F.col("user_id").isNotNull())
        tables.replace(tables.conform(every, "learner_courses"), base, "learner_courses", now.buckets, notes)
        return None
    if not touched:
        return touched
    fresh = signals.primary_enrollment(tables.load(spark, base, "enrollments", touched, now.version)).filter(F.col("user_id").isNotNull())
    learners = tables.buckets_of_keys(fresh, "learner_courses", part.buckets)
    stored = tables.load(spark, base, "learner_courses", learners, part.version)
    # both sides have one row per learner; the fresh copy wins a tie
    both = stored.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)).select(*stored.columns, "fresh"))
    order = F.col("enrollment_id").cast("decimal(20,0)") * 2 - F.col("fresh")
    picked = [F.min_by(c, order).alias(c) for c in stored.columns if c != "user_id"]
    merged = both.groupBy("user_id").agg(*picked)
    tables.replace_buckets(tables.conform(merged, "learner_courses"), base, "learner_courses", part, learners, notes)
    return learners


def refreshed_signals(spark: SparkSession, base: str, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """``risk_signals`` of the stored tables, from refreshed parts."""
    refresh_timing(spark, base, cfg)
    refresh_courses(spark, base)
    users, summaries, gates, timing, courses = (
        tables.load(spark, base, n) for n in ("users", "student_summaries", "gate_calendar", "learner_timing", "learner_courses")
    )
    return signals.signals_of_parts(users, signals.trend_of_halves(timing, cfg), courses, summaries, gates, as_of, cfg)
