"""Feed records built from the driver tables: written as JSON text and parsed with the feed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylantern.catalog.inputs import Inputs
from studylantern.schemas import FEEDS


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _parsed(records: DataFrame, feed: str) -> DataFrame:
    text = F.to_json(F.struct(*records.columns))
    return records.select(F.from_json(text, FEEDS[feed]).alias("r")).select("r.*")


def _slot(p: Inputs) -> DataFrame:
    return p.events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def users(p: Inputs) -> DataFrame:
    key = F.col("c_custkey")
    return _parsed(
        p.customer.select(
            key.alias("id"),
            F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("c"), key, F.lit("@example.org"))).alias("email"),
            F.when(key % 2 == 0, "").otherwise(F.col("c_name")).alias("sis_user_id"),
            F.concat(F.lit("login"), key).alias("login_id"),
        ),
        "users",
    )


def assignments(p: Inputs) -> DataFrame:
    return _parsed(
        p.part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("2026-07-01T10:00:00Z").alias("due_at"),
            F.col("p_retailprice").alias("points_possible"),
        ),
        "assignments",
    )


def enrollments(p: Inputs) -> DataFrame:
    key = F.col("o_orderkey")
    return _parsed(
        p.orders.select(
            key.alias("id"),
            F.when(key % 10 != 0, F.struct(F.col("o_custkey").alias("id"))).alias("user"),
            F.lit("StudentEnrollment").alias("type"),
            F.col("o_orderpriority").alias("role"),
            F.col("o_orderstatus").alias("enrollment_state"),
            F.when(key % 5 == 0, "").otherwise(_iso(F.col("o_orderdate"))).alias("last_activity_at"),
            (key % 100000).cast("int").alias("total_activity_time"),
            F.when(
                key % 7 != 0, F.struct(F.col("o_totalprice").alias("current_score"), (F.col("o_totalprice") / 2).alias("final_score"))
            ).alias("grades"),
            _iso(F.col("o_orderdate")).alias("created_at"),
            _iso(F.col("o_orderdate")).alias("updated_at"),
        ),
        "enrollments",
    )


def summaries(p: Inputs) -> DataFrame:
    key = F.col("user_id")
    n = F.col("page_views")
    return _parsed(
        p.in_summaries.select(
            key.alias("id"), n, "max_page_views", "participations", F.lit(9).alias("max_participations"),
            F.when(
                key % 4 != 0,
                F.struct(
                    n.alias("on_time"), (n + 1).alias("late"), (n + 2).alias("missing"), (n + 3).alias("floating"),
                    (n + 4).alias("total"),
                ),
            ).alias("tardiness_breakdown"),
        ),
        "student_summaries",
    )


def submissions(p: Inputs) -> DataFrame:
    """Every purchase; slot 0 and missing learners are invalid keys."""
    key = F.col("event_id")
    return _parsed(
        _slot(p).filter(F.col("event_type") == "purchase").select(
            key.alias("id"),
            (F.col("k") % 20).alias("assignment_id"),
            F.when(key % 9 != 0, F.col("user_id")).alias("user_id"),
            F.col("value").alias("score"),
            F.lit("pass").alias("grade"),
            F.when(key % 8 == 0, "").otherwise(_iso(F.col("ts"))).alias("submitted_at"),
            F.lit(None).cast("string").alias("graded_at"),
            F.lit("graded").alias("workflow_state"),
            F.when(key % 2 == 0, F.col("value") > 50).alias("late"),
            F.lit(None).cast("boolean").alias("missing"),
        ),
        "submissions",
    )


def quizzes(p: Inputs) -> DataFrame:
    return _parsed(
        p.part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("quiz_type"),
            F.col("p_retailprice").alias("points_possible"), F.lit("").alias("due_at"),
            F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 2 == 0).alias("published"),
            F.col("p_size").alias("question_count"),
        ),
        "quizzes",
    )


def quiz_submissions(p: Inputs) -> DataFrame:
    """Even quizzes arrive as wrapped pages of at most 100 records, odd ones as bare records."""
    quiz = F.col("event_id") % 50
    record = [
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"),
        F.col("value").alias("score"), F.col("value").alias("kept_score"), F.lit(1).alias("attempt"),
        F.lit("complete").alias("workflow_state"), _iso(F.col("ts")).alias("started_at"), F.lit("").alias("finished_at"),
    ]
    rows = p.events.filter(F.col("event_type") == "signup").withColumn("quiz_id", quiz)
    bare = rows.filter(F.col("quiz_id") % 2 == 1).select("quiz_id", *record)
    page = F.floor(F.col("event_id") / 5000)  # a page holds at most 100 of the ids of one quiz
    wrapped = rows.filter(F.col("quiz_id") % 2 == 0).groupBy("quiz_id", page.alias("page")).agg(
        F.collect_list(F.struct(*record)).alias("quiz_submissions")
    )
    both = bare.unionByName(wrapped.drop("page"), allowMissingColumns=True)
    return _parsed(both, "quiz_submissions")


def activity(p: Inputs) -> DataFrame:
    """Hourly records; the ones without a date are invalid."""
    hourly = p.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).cast("int").alias("views"))
    return _parsed(
        hourly.select(
            F.when(F.hour("hour") % 6 != 0, F.date_format("hour", "yyyy-MM-dd")).alias("date"), "views", (F.col("views") * 2).alias("participations")
        ),
        "course_activity",
    )
