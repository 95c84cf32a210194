"""Risk signals: one row per learner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.functions import days_since, moment, py_round
from studylantern.functions.numbers import hundredths


def _timed(submissions: DataFrame) -> DataFrame:
    """Rows that count as a submission: those with a distance to a deadline."""
    return submissions.filter(F.col("days_from_deadline").isNotNull()).select(
        "user_id", "submitted_at", hundredths(F.col("days_from_deadline")).alias("days")
    )


def _mean(total: Column, n: Column) -> Column:
    """Mean in days of a sum of hundredths."""
    return total / F.lit(100.0) / n


def timing_stats(submissions: DataFrame) -> DataFrame:
    """Per learner with timed submissions: average distance (two decimals) and count."""
    return (
        _timed(submissions)
        .groupBy("user_id")
        .agg(F.sum("days").alias("total"), F.count(F.lit(1)).alias("n"))
        .select(
            "user_id",
            py_round(_mean(F.col("total"), F.col("n")), 2).alias("avg_days_from_deadline"),
            F.col("n").cast("int").alias("total_submissions"),
        )
    )


def _halves_by_rank(rows: DataFrame) -> DataFrame:
    """n, total and first-half sum from one in-partition sort per learner.

    Cutting the rows in two from the newest backwards leaves the smaller part,
    ``n // 2`` rows, as the early one; one window function does it all.
    """
    backwards = Window.partitionBy("user_id").orderBy(F.col("submitted_at").desc_nulls_first(), F.col("days").desc())
    cut = rows.withColumn("part", F.ntile(2).over(backwards))
    return cut.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("days").alias("total"),
        F.sum(F.when(F.col("part") == 2, F.col("days"))).alias("first_total"),
    )


def _halves_by_refinement(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """n, total and first-half sum of learners too large for one task.

    The middle submission is located by minute, then by exact (time,
    distance). Both steps aggregate before the shuffle and then order only
    group counts: at most one group per minute of the covered period, then the
    distinct instants of a single minute. Rows equal in (time, distance) are
    interchangeable, so counts are enough.
    """
    rows = rows.withColumn("minute", F.floor(F.unix_micros("submitted_at") / F.lit(60_000_000)))
    learner = Window.partitionBy("user_id")

    def running(*order: Column):
        return learner.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    by_minute = running(F.col("minute").asc_nulls_last())
    c, s = F.col("c"), F.col("s")
    minutes = (
        rows.join(hot, "user_id", "left_semi")
        .groupBy("user_id", "minute")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("days").alias("s"))
        .select(
            F.col("user_id").alias("_learner"),
            F.col("minute").alias("_minute"),
            "c",
            F.sum("c").over(learner).alias("n"),
            F.sum("s").over(learner).alias("total"),
            (F.sum("c").over(by_minute) - c).alias("skipped"),
            (F.sum("s").over(by_minute) - s).alias("before"),
        )
    )
    # a single timed row has no halves but must not get lost
    need = F.greatest(F.floor(F.col("n") / 2), F.lit(1)) - F.col("skipped")
    middle = minutes.filter((need > 0) & (need <= c)).select(
        "_learner", "_minute", "n", "total", "before", need.alias("need")
    )
    # one row per hot learner, so as bounded as the list of hot learners
    inside = rows.join(
        F.broadcast(middle), (F.col("user_id") == F.col("_learner")) & F.col("minute").eqNullSafe(F.col("_minute"))
    )
    in_time = running(F.col("submitted_at").asc_nulls_last(), F.col("days").asc())
    instants = (
        inside.groupBy("user_id", "n", "total", "before", "need", "submitted_at", "days")
        .agg(F.count(F.lit(1)).alias("c"))
        .select(
            "user_id", "n", "total", "before", "days", "c",
            (F.col("need") - F.sum("c").over(in_time) + c).alias("rest"),
            (F.sum(c * F.col("days")).over(in_time) - c * F.col("days")).alias("earlier"),
        )
    )
    first_total = F.col("before") + F.col("earlier") + F.col("rest") * F.col("days")
    return instants.filter((F.col("rest") > 0) & (F.col("rest") <= c)).select(
        "user_id", "n", "total", first_total.alias("first_total")
    )


def hot_learners(submissions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Learners with more rows than one task should sort; at most ``rows / hot_learner_rows`` of them.

    Reads the id column only.
    """
    counts = submissions.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > cfg.hot_learner_rows).select("user_id")


def timing_halves(submissions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per learner: count, sum, and sum of the chronologically first ``n // 2`` distances.

    Both branches are exact for any learner; the split only decides where the
    ordering work is done. Without hot learners adaptive execution drops the
    refinement branch before it reads anything.
    """
    rows = _timed(submissions)
    hot = F.broadcast(hot_learners(submissions, cfg))
    usual = _halves_by_rank(rows.join(hot, "user_id", "left_anti"))
    large = _halves_by_refinement(rows, hot)
    return usual.unionByName(large)


def timing_trend(submissions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Average, count and trend label per learner with timed submissions."""
    return trend_of_halves(timing_halves(submissions, cfg), cfg)


def trend_of_halves(halves: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Average, count and trend label from the sums of ``timing_halves``.

    The average is rounded before any rule sees it; the trend compares the
    unrounded averages of the two halves.
    """
    n = F.col("n")
    half = F.floor(n / 2)
    first = _mean(F.col("first_total"), half)
    second = _mean(F.col("total") - F.col("first_total"), n - half)
    change = second - first
    label = (
        F.when(n < cfg.trend_min_submissions, "insufficient_data")
        .when(change > cfg.trend_step_days, "improving")
        .when(change < -cfg.trend_step_days, "worsening")
        .otherwise("stable")
    )
    return halves.select(
        "user_id",
        py_round(_mean(F.col("total"), n), 2).alias("avg_days_from_deadline"),
        n.cast("int").alias("total_submissions"),
        label.alias("timing_trend"),
    )


def course_max_views(summaries: DataFrame) -> DataFrame:
    """One row: the highest course-wide page view count, 1 when absent or zero."""
    top = F.max("max_page_views")
    return summaries.agg(F.coalesce(F.nullif(top, F.lit(0)), F.lit(1)).alias("course_max_views"))


def next_gate(gates: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """One row: the earliest gate 0..window days ahead, or the no-gate values."""
    today = F.to_date(moment(as_of))
    ahead = F.date_diff(F.col("gate_date"), today)
    near = gates.select("gate_name", ahead.alias("ahead")).filter(F.col("ahead").between(0, cfg.gate_window_days))
    first = F.min(F.struct("ahead", "gate_name"))
    return near.agg(first.alias("gate")).select(
        F.when(F.col("gate").isNotNull(), 1).otherwise(0).alias("gate_approaching"),
        F.col("gate.gate_name").alias("gate_name"),
        F.col("gate.ahead").alias("days_until_gate"),
    )


def primary_enrollment(enrollments: DataFrame) -> DataFrame:
    """One enrollment per learner: the lowest ``enrollment_id``.

    Fixed-width ``min_by`` buffers keep this a hash aggregate that combines
    before the shuffle.
    """
    order = F.col("enrollment_id")
    picked = [F.min_by(c, order).alias(c) for c in ("final_score", "current_score", "last_activity_at")]
    return enrollments.groupBy("user_id").agg(F.min(order).alias("enrollment_id"), *picked)


def risk_signals(
    users: DataFrame, submissions: DataFrame, enrollments: DataFrame, summaries: DataFrame, gates: DataFrame,
    as_of=None, cfg: Config = DEFAULT,
) -> DataFrame:
    """Signals for every row of ``users``; absent pieces take their defaults."""
    return signals_of_parts(users, timing_trend(submissions, cfg), primary_enrollment(enrollments), summaries, gates, as_of, cfg)


def signals_of_parts(
    users: DataFrame, timing: DataFrame, courses: DataFrame, summaries: DataFrame, gates: DataFrame,
    as_of=None, cfg: Config = DEFAULT,
) -> DataFrame:
    """Signals from frames with one row per learner (``timing_trend``, ``primary_enrollment``).

    The joins are balanced and share the ``user_id`` partitioning; the
    course-wide values are one row each.
    """
    now = moment(as_of)
    joined = (
        users.select("user_id")
        .join(timing, "user_id", "left")
        .join(courses, "user_id", "left")
        .join(summaries.select("user_id", "page_views"), "user_id", "left")
        .crossJoin(F.broadcast(course_max_views(summaries)))
        .crossJoin(F.broadcast(next_gate(gates, as_of, cfg)))
    )
    n = F.coalesce("total_submissions", F.lit(0))
    trend = F.when(F.col("final_score") == cfg.complete_score, "completed").otherwise(
        F.coalesce("timing_trend", F.lit("no_data"))
    )
    return joined.select(
        "user_id",
        "avg_days_from_deadline",
        trend.alias("timing_trend"),
        days_since(F.col("last_activity_at"), now).alias("days_since_last_login"),
        n.alias("total_submissions"),
        F.when(n == 0, 1).otherwise(0).alias("zero_submissions"),
        py_round(F.coalesce("page_views", F.lit(0)) / F.col("course_max_views"), 3).alias("engagement_ratio"),
        "gate_approaching",
        "gate_name",
        "days_until_gate",
        now.alias("computed_at"),
    )
