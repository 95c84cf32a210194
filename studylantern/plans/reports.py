"""Report datasets.

Each function returns one frame for the whole cohort. ``ordered`` adds the
display order as a range sort with a unique tie-break, so equal leading values
(one learner, one batch time) still spread over partitions; writers of large
outputs pass ``ordered=False`` and save that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.functions import fixed, hours, local_display, py_round, strip
from studylantern.functions import labels
from studylantern.operators.flags import latest_open_flag, open_flags, worst_open_flag
from studylantern.operators.lifecycle import pending_drafts
from studylantern.operators.skew import join_facts


def _sorted(df: DataFrame, ordered: bool, *order) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def _only(df: DataFrame, user_id: int | None) -> DataFrame:
    return df if user_id is None else df.filter(F.col("user_id") == F.lit(user_id))


def cohort_base(
    users: DataFrame, signals: DataFrame, enrollments: DataFrame, summaries: DataFrame, worst: DataFrame | None = None
) -> DataFrame:
    """users ⟕ signals ⟕ summaries (⟕ gravest flag) ⟕ enrollments, one row per enrollment.

    The one-row-per-learner frames are combined first. Enrollments can be
    many per learner, so they lead an inner join, whose hot partitions Spark
    can split, and the learners without any are added.
    """
    learners = (
        users.select("user_id")
        .join(signals.drop("computed_at"), "user_id", "left")
        .join(summaries.select("user_id", "page_views"), "user_id", "left")
    )
    if worst is not None:
        learners = learners.join(worst, "user_id", "left")
    courses = enrollments.select("user_id", "enrollment_id", "final_score", "last_activity_at", "total_activity_time")
    enrolled = join_facts(courses, learners, ["user_id"])
    others = learners.join(courses.select("user_id").distinct(), "user_id", "left_anti")
    return enrolled.unionByName(others, allowMissingColumns=True).withColumn(
        "hrs_in_canvas", hours(F.col("total_activity_time"))
    )


def cohort_overview(
    users: DataFrame, signals: DataFrame, enrollments: DataFrame, summaries: DataFrame, flag_events: DataFrame,
    ordered: bool = True, cfg: Config = DEFAULT,
) -> DataFrame:
    """The eleven display columns per learner; a finished course shows green whatever the flags."""
    worst = worst_open_flag(flag_events)
    rows = cohort_base(users, signals, enrollments, summaries, worst)
    finished = F.coalesce(F.col("final_score") == cfg.complete_score, F.lit(False))
    severity = F.when(finished, "green").otherwise(F.coalesce("flag_type", F.lit("green")))
    none_open = F.when(F.col("flag_type").isNull(), "No issues detected").otherwise(F.col("reason"))
    reason = F.when(finished, "Course completed").otherwise(none_open)
    report = rows.select(
        labels.severity_icon(severity).alias("status"),
        F.col("user_id").alias("student_id"),
        F.coalesce("total_submissions", F.lit(0)).alias("submitted"),
        labels.timing_label(F.col("avg_days_from_deadline")).alias("avg_timing"),
        labels.trend_label(F.col("timing_trend")).alias("trend"),
        labels.silence_label(F.col("days_since_last_login")).alias("last_login"),
        F.coalesce("page_views", F.lit(0)).alias("page_views"),
        labels.score_label(F.col("final_score")).alias("final_score"),
        F.coalesce("hrs_in_canvas", F.lit(0.0)).alias("hrs_canvas"),
        labels.gate_label(F.col("gate_approaching"), F.col("gate_name"), F.col("days_until_gate")).alias("gate_alert"),
        reason.alias("flag_reason"),
        "enrollment_id",
    )
    return _sorted(report, ordered, "student_id", "enrollment_id").drop("enrollment_id")


def cohort_kpis(users: DataFrame, enrollments: DataFrame, flag_events: DataFrame) -> DataFrame:
    """One row: cohort rows, learners whose gravest open flag is red / yellow, and the rest.

    The total counts the rows of the cohort table (one per enrollment); the
    finished-course override of that table does not apply here.
    """
    per_learner = enrollments.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = users.select("user_id").join(per_learner, "user_id", "left").agg(
        F.coalesce(F.sum(F.coalesce("n", F.lit(1))), F.lit(0)).alias("total")
    )
    # the gravest flag is red if any is red, so no ordering is needed to count
    grave = open_flags(flag_events).groupBy("user_id").agg(F.min(labels.severity_rank(F.col("flag_type"))).alias("rank"))
    counts = grave.agg(F.count_if(F.col("rank") == 0).alias("red"), F.count_if(F.col("rank") == 1).alias("yellow"))
    return total.crossJoin(F.broadcast(counts)).select(
        "total", "red", "yellow", (F.col("total") - F.col("red") - F.col("yellow")).alias("green")
    )


def engagement_scatter(users: DataFrame, summaries: DataFrame, signals: DataFrame) -> DataFrame:
    return (
        users.select("user_id")
        .join(summaries.select("user_id", "page_views"), "user_id", "left")
        .join(signals.select("user_id", "total_submissions"), "user_id", "left")
        .select(
            F.col("user_id").cast("string").alias("user_id"),
            F.coalesce("page_views", F.lit(0)).alias("page_views"),
            F.coalesce("total_submissions", F.lit(0)).alias("total_submissions"),
        )
    )


def learner_list(users: DataFrame, ordered: bool = True) -> DataFrame:
    return _sorted(users.select(F.col("user_id").cast("string").alias("student"), "user_id"), ordered, "user_id").select("student")


def submission_timeline(
    submissions: DataFrame, assignments: DataFrame, user_id: int | None = None, ordered: bool = True
) -> DataFrame:
    """Submitted work by planned deadline with an early/late label."""
    done = _only(submissions, user_id).filter(F.col("submitted_at").isNotNull())
    named = done.select("user_id", "assignment_id", "submitted_at", "days_from_deadline", "score", "workflow_state").join(
        assignments.select("assignment_id", "name", "due_at_roadmap"), "assignment_id"
    )
    report = named.select(
        "user_id",
        "assignment_id",
        "name",
        F.date_format("submitted_at", "yyyy-MM-dd").alias("submitted_at"),
        py_round(F.col("days_from_deadline"), 2).alias("days_from_deadline"),
        "score",
        "workflow_state",
        labels.early_late_label(F.col("days_from_deadline")).alias("timing"),
        "due_at_roadmap",
    )
    return _sorted(report, ordered, "user_id", F.asc_nulls_last("due_at_roadmap"), "assignment_id").drop("due_at_roadmap")


def quiz_history(quiz_submissions: DataFrame, quizzes: DataFrame, user_id: int | None = None, ordered: bool = True) -> DataFrame:
    tries = _only(quiz_submissions, user_id).select(
        "user_id", "quiz_id", "quiz_submission_id", "score", "kept_score", "attempt", "workflow_state", "started_at"
    )
    report = tries.join(quizzes.select("quiz_id", "title"), "quiz_id").select(
        "user_id", "title", "score", "kept_score", "attempt", "workflow_state",
        F.date_format("started_at", "yyyy-MM-dd").alias("date"), "started_at", "quiz_submission_id",
    )
    return _sorted(report, ordered, "user_id", F.asc_nulls_last("started_at"), "quiz_submission_id").drop(
        "started_at", "quiz_submission_id"
    )


def enrollment_detail(enrollments: DataFrame, user_id: int | None = None) -> DataFrame:
    return _only(enrollments, user_id).select(
        "user_id",
        "enrollment_state",
        F.coalesce(hours(F.col("total_activity_time")), F.lit(0.0)).alias("hours_in_canvas"),
        labels.detail_score_label(F.col("current_score"), 1).alias("current_score"),
        F.coalesce(F.date_format("last_activity_at", "yyyy-MM-dd"), F.lit("Never")).alias("last_login"),
        labels.detail_score_label(F.col("final_score"), 2).alias("final_score"),
    )


# --- fixed values: report headings of the signal columns ---------------------
SIGNAL_HEADINGS = {
    "avg_days_from_deadline": "Avg Days from Deadline",
    "timing_trend": "Trend",
    "days_since_last_login": "Days Since Login",
    "total_submissions": "Submitted",
    "zero_submissions": "Zero Submissions",
    "engagement_ratio": "Engagement Ratio",
    "gate_approaching": "Gate Approaching",
    "gate_name": "Gate Name",
    "days_until_gate": "Days Until Gate",
    "computed_at": "Computed At",
}


def signal_detail(signals: DataFrame, user_id: int | None = None) -> DataFrame:
    return _only(signals, user_id).select("user_id", *[F.col(c).alias(h) for c, h in SIGNAL_HEADINGS.items()])


def flag_detail(flag_events: DataFrame, user_id: int | None = None, ordered: bool = True) -> DataFrame:
    """All flags of a learner, resolved ones included, newest first."""
    icon = F.when(F.col("flag_type") == "red", labels.SEVERITY_ICONS["red"]).otherwise(labels.SEVERITY_ICONS["yellow"])
    report = _only(flag_events, user_id).select(
        "user_id", "flag_id", "flagged_at", icon.alias("icon"), F.upper("flag_type").alias("severity"), "reason", "resolved"
    )
    return _sorted(report, ordered, "user_id", F.desc("flagged_at"), "flag_id")


def flag_log(
    flag_events: DataFrame, types: tuple[str, ...] = ("red", "yellow"), id_pattern: str = "", ordered: bool = True
) -> DataFrame:
    """Flags newest first. No types means no type filter; the pattern is a regular expression on the learner id."""
    kept = flag_events
    if types:
        kept = kept.filter(F.col("flag_type").isin(*types))
    if id_pattern.strip():
        kept = kept.filter(F.col("user_id").cast("string").rlike(id_pattern.strip()))
    icon = F.when(F.col("flag_type") == "red", labels.SEVERITY_ICONS["red"]).otherwise(labels.SEVERITY_ICONS["yellow"])
    report = kept.select(
        "flag_id", "user_id", "flag_type", icon.alias("icon"), "reason", "flagged_at",
        F.date_format("flagged_at", "yyyy-MM-dd HH:mm").alias("flagged"),
        labels.resolved_label(F.col("resolved")).alias("state"),
    )
    return _sorted(report, ordered, F.desc("flagged_at"), "flag_id")


def _severity_kpis(df: DataFrame, total: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias(total),
        F.count_if(F.col("flag_type") == "red").alias("red"),
        F.count_if(F.col("flag_type") == "yellow").alias("yellow"),
    )


def flag_log_kpis(log: DataFrame) -> DataFrame:
    return _severity_kpis(log, "total")


def approval_queue(nudge_events: DataFrame, flag_events: DataFrame, signals: DataFrame, ordered: bool = True) -> DataFrame:
    """Drafts awaiting review with their newest open flag and the learner's signals, red first, then newest.

    The queue is the left side of both joins and the other sides have one row
    per key, so a learner with very many drafts is split by Spark.
    """
    waiting = pending_drafts(nudge_events).select(
        "draft_id", "nudge_id", "user_id", "flag_code", "nudge_type", "subject", "html_body", "created_at"
    )
    risk = signals.select("user_id", "days_since_last_login", "total_submissions", "avg_days_from_deadline")
    queue = join_facts(waiting, latest_open_flag(flag_events), ["user_id", "flag_code"], "left")
    queue = join_facts(queue, risk, ["user_id"], "left")
    report = queue.select(
        "draft_id", "nudge_id", "user_id", "flag_code", "nudge_type", "subject", "html_body", "created_at",
        "flag_reason", "flag_type", "days_since_last_login", "total_submissions", "avg_days_from_deadline",
    )
    urgent = F.when(F.col("flag_type") == "red", 0).otherwise(1)
    return _sorted(report, ordered, urgent, F.desc("created_at"), F.desc("nudge_id"))


def queue_kpis(queue: DataFrame) -> DataFrame:
    return _severity_kpis(queue, "awaiting")


def audit_log(nudge_events: DataFrame, status: str | None = None, limit: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Newest rows of the event log, optionally of one status.

    The row limit is the report's own paging and has fixed bounds; Spark runs
    it as a top-n per partition, not as a full sort.
    """
    lowest, usual, highest = cfg.audit_rows
    limit = usual if limit is None else limit
    if not lowest <= limit <= highest:
        raise ValueError(f"audit rows must be between {lowest} and {highest}")
    rows = nudge_events if status is None else nudge_events.filter(F.col("delivery_status") == status)
    dash = F.lit("—")

    def text(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), dash)

    return (
        rows.orderBy(F.desc("nudge_id"))
        .limit(limit)
        .select(
            "nudge_id",
            labels.status_icon(F.col("delivery_status")).alias("icon"),
            labels.spaced(F.col("delivery_status")).alias("status"),
            "user_id",
            labels.spaced(F.col("nudge_type")).alias("nudge_type"),
            text("flag_code").alias("flag_code"),
            local_display(F.col("created_at"), cfg.display_zone).alias("created"),
            F.concat(F.substring("draft_id", 1, 8), F.lit("…")).alias("draft"),
            text("reviewer_id").alias("reviewer"),
            "provider_message_id",
            local_display(F.col("delivered_at"), cfg.display_zone).alias("delivered"),
            "review_notes",
            "langsmith_run_id",
        )
    )


def signals_report(signals: DataFrame, ordered: bool = True) -> DataFrame:
    """Signals, most late first, learners without an average last."""
    return _sorted(signals.drop("computed_at"), ordered, F.asc_nulls_last("avg_days_from_deadline"), "user_id")
