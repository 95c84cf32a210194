"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the table folder and
BENCH_CPUS (default 8) the local cores. Results go to the no-op sink, so the
whole plan runs and nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from studylantern.catalog.queries import REGISTRY, runner  # noqa: E402

HEADLINE = (
    "timing_stats", "timing_trend", "timing_trend_orders", "timing_trend_hot_orders", "risk_signals", "run_flags", "dedupe_new_flags",
    "upsert_submissions", "upsert_submissions_small_batch", "upsert_student_demographics", "enrollments_from_feed",
    "submissions_from_feed", "quiz_submissions_from_feed", "match_demographics", "flags_without_drafts", "render_drafts",
    "latest_state", "apply_decisions", "decision_rejects", "ta_briefings", "assign_variant", "late_notices", "cohort_overview",
    "cohort_kpis", "submission_timeline", "quiz_history", "flag_log", "approval_queue", "audit_log", "check_unique", "check_fk",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        runner(REGISTRY[name])(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("course_max_views")  # starts the session and its catalog
    times = {name: run(name) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
