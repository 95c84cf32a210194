import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from studylantern.config import DEFAULT
from studylantern.plans import nightly, reports
from studylantern.sources import runlog, tables

AS_OF = "2026-07-12 12:00:00"
CFG = replace(DEFAULT, ta_recipients="ta@example.org")


def land(folder, name, records, part=""):
    target = folder / name / part
    target.mkdir(parents=True, exist_ok=True)
    (target / "page-0001.json").write_text(json.dumps(records), encoding="utf-8")


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    land(folder, "users", [{"id": u, "email": f"u{u}@x"} for u in (1, 2, 3, 4)])
    land(folder, "assignments", [{"id": a, "name": f"A{a}"} for a in (3320, 3317, 3313, 3309)])
    last = {1: "2026-07-11T00:00:00Z", 2: "2026-06-20T00:00:00Z", 3: "2026-07-12T00:00:00Z", 4: None}
    land(folder, "enrollments", [
        {"id": 10 + u, "user": {"id": u}, "last_activity_at": at, "total_activity_time": 7200,
         "grades": {"current_score": 60.0, "final_score": 60.0}} for u, at in last.items()
    ])
    land(folder, "student_summaries", [{"id": u, "page_views": 5 * u, "max_page_views": 20} for u in (1, 2, 3, 4)])
    work = [(3320, "2026-07-01T23:59:00Z"), (3317, "2026-07-12T00:59:00Z"), (3313, "2026-07-13T23:59:00Z")]
    land(folder, "submissions", [
        {"id": i, "assignment_id": a, "user_id": 1, "submitted_at": at, "score": 5.0} for i, (a, at) in enumerate(work)
    ])
    land(folder, "quizzes", [{"id": 40, "title": "Q", "published": True}])
    land(folder, "quiz_submissions", {"quiz_submissions": [{"id": 1, "user_id": 1, "attempt": 1, "started_at": "2026-07-01T00:00:00Z"}]}, "quiz_id=40")
    land(folder, "course_activity", [{"date": "2026-07-01", "views": 3, "participations": 1}])
    return folder


def test_night_and_review(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    counts = nightly.run_nightly(spark, str(landing), base, 1, AS_OF, CFG)
    assert counts["users"] == 4 and counts["submissions"] == 3 and counts["gate_calendar"] == 5 and counts["quiz_submissions"] == 1

    flags = tables.load_log(spark, base, "flag_events")
    raised = {(r.user_id, r.reason.split(":")[0]) for r in flags.collect()}
    # learner 1: average -6.01 over three, falling; a gate (Module 1 Lab) is one day ahead
    assert raised == {(1, "R3"), (1, "Y2"), (1, "Y3"), (1, "Y4"), (2, "R1"), (3, "Y1b")}
    assert counts["flag_events"] == 6 and counts["nudge_events"] == 6
    assert flags.select("flag_id").distinct().count() == 6

    # repeating the same run keeps its batches; the next run finds nothing new
    again = nightly.run_nightly(spark, str(landing), base, 1, AS_OF, CFG)
    assert again == counts and tables.load_log(spark, base, "flag_events").count() == 6
    assert tables.load_log(spark, base, "nudge_events").count() == 6
    later = nightly.run_nightly(spark, str(landing), base, 2, AS_OF, CFG)
    assert (later["flag_events"], later["nudge_events"]) == (0, 0)
    assert tables.load(spark, base, "course_activity").first().activity_id == 1
    runs = tables.load_log(spark, base, "sync_runs")
    assert sorted((r.run_id, r.attempt, r.status) for r in runs.collect()) == [(1, 0, "success"), (1, 1, "success"), (2, 0, "success")]

    pii = spark.createDataFrame([(1, "Ann", "ann@x")], "user_id long, full_name string, email string")
    tables.replace(tables.conform(pii, "student_pii"), base, "student_pii")
    drafts = {(r.user_id, r.flag_code): r.draft_id for r in tables.load_log(spark, base, "nudge_events").collect()}
    decisions = spark.createDataFrame(
        [(1, drafts[1, "R3"], "approve", "rev", None), (2, drafts[2, "R1"], "approve", "rev", None),
         (3, drafts[3, "Y1b"], "escalate", "rev", None), (4, drafts[1, "Y2"], "reject", "rev", "not needed any more"),
         (5, drafts[1, "Y2"], "approve", "rev", None)],
        "decision_id long, draft_id string, action string, reviewer_id string, notes string",
    ).withColumn("decided_at", F.lit(AS_OF).cast("timestamp"))
    outcomes = spark.createDataFrame(
        [(drafts[1, "R3"], True, "m1", None), (drafts[2, "R1"], True, "m2", None), (drafts[3, "Y1b"], True, "m3", None)],
        "draft_id string, ok boolean, message_id string, error string",
    )
    rejects = nightly.record_reviews(spark, base, decisions, outcomes, "review-1", AS_OF, CFG)
    assert [r.decision_id for r in rejects.collect()] == [5]
    log = tables.load_log(spark, base, "nudge_events")
    assert log.count() == 6 + 2 + 2 + 1 + 1 + 3 and log.select("nudge_id").distinct().count() == log.count()
    history = [r.delivery_status for r in log.filter(F.col("draft_id") == drafts[1, "R3"]).orderBy("nudge_id").collect()]
    assert history == ["pending_review", "approved", "sent"]
    briefing = [r.delivery_status for r in log.filter("nudge_type = 'escalation_alert'").orderBy("nudge_id").collect()]
    assert briefing == ["pending_review", "approved", "sent"]
    flags = tables.load_log(spark, base, "flag_events")
    queue = reports.approval_queue(log, flags, tables.load(spark, base, "student_risk_signals"))
    assert {r.draft_id for r in queue.collect()} == {drafts[1, "Y3"], drafts[1, "Y4"]}


def test_a_repeated_batch_keeps_the_log_and_its_ids(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    nightly.run_nightly(spark, str(landing), base, 1, AS_OF, CFG)
    first = tables.load_log(spark, base, "nudge_events").orderBy("nudge_id").collect()
    decisions = spark.createDataFrame(
        [(1, first[0].draft_id, "reject", "rev", "not needed any more")],
        "decision_id long, draft_id string, action string, reviewer_id string, notes string",
    ).withColumn("decided_at", F.lit(AS_OF).cast("timestamp"))
    none = spark.createDataFrame([], "draft_id string, ok boolean, message_id string, error string")
    nightly.record_reviews(spark, base, decisions, none, "review-1", AS_OF, CFG)
    nightly.write_drafts(spark, base, "run-000000001", AS_OF, CFG)
    nightly.raise_flags(spark, base, "run-000000001", AS_OF, CFG)
    log = tables.load_log(spark, base, "nudge_events").orderBy("nudge_id").collect()
    assert log[: len(first)] == first and [r.delivery_status for r in log if r.draft_id == first[0].draft_id] == ["pending_review", "rejected"]


def test_unreadable_pages_and_keyless_records_are_reported(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    (landing / "users" / "page-0002.json").write_text('[{"id": 5, "email": "u5@x"}, {"id": 6,', encoding="utf-8")
    land(landing, "quizzes", [{"id": None, "title": "none"}, {"id": 40, "title": "Q"}])
    for run in (1, 2):
        counts = nightly.run_nightly(spark, str(landing), base, run, AS_OF, CFG)
        assert counts["feed_rejects"] == 2 and counts["users"] == 4 and counts["quizzes"] == 1
        assert tables.load(spark, base, "quizzes").count() == 1 and tables.load(spark, base, "users").count() == 4
    rejects = tables.load_log(spark, base, "feed_rejects").collect()
    assert len(rejects) == 4 and {(r.feed, r.reason) for r in rejects} == {("users", "unreadable page"), ("quizzes", "no key")}
    assert any('{"id": 6,' in r.record for r in rejects)


def test_direct_calls_of_ingest_feed_keep_all_rejects(spark, landing, tmp_path):
    base, page = str(tmp_path / "store"), landing / "users" / "page-0002.json"
    assert nightly.ingest_feed(spark, str(landing), base, "users", AS_OF, CFG) == (4, 0)
    for text, n in (('[{"id": 7, "ema', 1), ('[{"email": "nobody@x"}, {"email": "none@x"}]', 2)):
        page.write_text(text, encoding="utf-8")
        assert nightly.ingest_feed(spark, str(landing), base, "users", AS_OF, CFG)[1] == n
    reasons = [r.reason for r in tables.load_log(spark, base, "feed_rejects").collect()]
    assert sorted(reasons) == ["no key", "no key", "unreadable page"]


def test_a_log_batch_without_marker_does_not_count(spark, tmp_path):
    base = str(tmp_path / "store")
    row = tables.conform(spark.createDataFrame([(1,)], "flag_id long"), "flag_events")
    tables.append(row, base, "flag_events", "a")
    tables.append(row, base, "flag_events", "b")
    (tmp_path / "store" / "flag_events" / "batch=b" / "_SUCCESS").unlink()
    assert tables.batches(spark, base, "flag_events") == ["a"] and tables.load_log(spark, base, "flag_events").count() == 1
    tables.append(row, base, "flag_events", "b")
    tables.append(row.union(row), base, "flag_events", "b")
    assert tables.load_log(spark, base, "flag_events").count() == 2


def test_failed_run_is_logged_and_keeps_committed_steps(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    (landing / "submissions" / "page-0001.json").rename(landing / "elsewhere.json")
    (landing / "submissions").rmdir()
    with pytest.raises(Exception):
        nightly.run_nightly(spark, str(landing), base, 1, AS_OF, CFG)
    (run,) = tables.load_log(spark, base, "sync_runs").collect()
    assert run.status == "failed" and run.error_message and run.users_synced == 4
    assert tables.load(spark, base, "users").count() == 4 and tables.load(spark, base, "submissions").count() == 0
    # the same run, repeated with the missing feed
    (landing / "submissions").mkdir()
    (landing / "elsewhere.json").rename(landing / "submissions" / "page-0001.json")
    nightly.run_nightly(spark, str(landing), base, 1, AS_OF, CFG)
    runs = tables.load_log(spark, base, "sync_runs")
    assert runs.count() == 2 and [r.status for r in runlog.run_states(runs).collect()] == ["success"]
    assert runlog.last_run(runs).first().status == "success"


def test_records_without_keys_are_logged_and_counted(spark, landing, tmp_path):
    base = str(tmp_path / "store")
    land(landing, "assignments", [{"id": 3320}])
    land(landing, "submissions", [{"id": 1, "assignment_id": 3320, "user_id": 1}, {"id": 2, "assignment_id": 0, "user_id": 1}, {"id": 3, "assignment_id": 3320}, {"id": "?"}])
    land(landing, "quiz_submissions", {"quiz_submissions": [{"id": 1, "user_id": None}, {"id": 2, "user_id": 4}]}, "quiz_id=40")
    land(landing, "course_activity", [{"views": 1}, {"date": "2026-07-01"}])
    found = {name: nightly.ingest_feed(spark, str(landing), base, name, AS_OF, CFG) for name in ("assignments", "submissions", "quiz_submissions", "course_activity")}
    assert found == {"assignments": (1, 0), "submissions": (1, 3), "quiz_submissions": (1, 1), "course_activity": (1, 1)}
    logged = tables.load_log(spark, base, "feed_rejects").collect()
    assert sorted((r.feed, r.reason) for r in logged) == [
        ("course_activity", "no key"), ("quiz_submissions", "no key"), ("submissions", "no key"), ("submissions", "no key"), ("submissions", "unreadable page")]
    assert not (tmp_path / "store" / "landed").exists() or not list((tmp_path / "store" / "landed").iterdir())
