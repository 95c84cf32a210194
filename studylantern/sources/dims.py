"""Constant dimensions. All have a fixed size of at most a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.config import DEADLINES, GATES, ROUTES


def deadline_dim(spark: SparkSession, deadlines: dict[int, str] | None = None) -> DataFrame:
    rows = list((DEADLINES if deadlines is None else deadlines).items())
    return spark.createDataFrame(rows, "assignment_id long, due_text string").select(
        "assignment_id", F.col("due_text").cast("timestamp").alias("due_at_roadmap")
    )


def gate_dim(spark: SparkSession, gates=GATES) -> DataFrame:
    return spark.createDataFrame(list(gates), "week_number int, gate_name string, day string, description string").select(
        "gate_name", "week_number", F.col("day").cast("date").alias("gate_date"), "description"
    )


def route_dim(spark: SparkSession) -> DataFrame:
    rows = [(code, *route) for code, route in ROUTES.items()]
    return spark.createDataFrame(rows, "flag_code string, template_id string, nudge_type string, severity string")
