"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Correctness: timestamps are UTC everywhere.
# Scale: run-time re-planning, with skewed join partitions split even when
# that costs one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session owned by the caller."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all nodes share; on one machine without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="studylantern-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
