"""Run log: one row per run and row counts per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.schemas import TABLES

COUNTERS = ("courses", "users", "enrollments", "assignments", "submissions", "quizzes", "quiz_submissions", "student_summaries")


def run_metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for every named frame, counted on the executors."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def run_row(
    spark: SparkSession, run_id: int, started_at, finished_at, status: str, error: str | None = None,
    counts: dict[str, int] | None = None, cfg: Config = DEFAULT, attempt: int = 0,
) -> DataFrame:
    """One ``sync_runs`` row: an attempt at a run."""
    counts = counts or {}
    values = (run_id, cfg.course_id, started_at, finished_at, status, error, *[counts.get(c, 0) for c in COUNTERS], attempt)
    return spark.createDataFrame([values], TABLES["sync_runs"])


def run_states(runs: DataFrame) -> DataFrame:
    """The newest attempt of every run: a failed run that is repeated counts as what it came to."""
    cols = [c for c in runs.columns if c != "run_id"]
    newest = runs.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.coalesce("attempt", F.lit(0))).alias("row"))
    return newest.select("run_id", *[F.col(f"row.{c}").alias(c) for c in cols])


def last_run(runs: DataFrame) -> DataFrame:
    """Start (to the minute) and status of the newest attempt of the newest run."""
    return (
        runs.orderBy(F.col("run_id").desc(), F.col("attempt").desc_nulls_last())
        .limit(1)
        .select(F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("last_sync"), "status")
    )
