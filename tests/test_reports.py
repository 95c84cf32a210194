import pytest
from pyspark.sql import functions as F

from studylantern.plans import reports


def signal(user_id, **more):
    base = dict(user_id=user_id, total_submissions=0, zero_submissions=1, gate_approaching=0, timing_trend="no_data")
    return {**base, **more}


def flag(flag_id, user_id, kind, reason, at="2024-01-01", resolved=0):
    return dict(flag_id=flag_id, user_id=user_id, flagged_at=at, flag_type=kind, reason=reason, resolved=resolved)


@pytest.fixture
def cohort(table):
    return dict(
        users=table("users", *[dict(user_id=u) for u in (3, 1, 2)]),
        signals=table(
            "student_risk_signals",
            signal(1, avg_days_from_deadline=-2.25, total_submissions=4, timing_trend="worsening", days_since_last_login=0,
                   gate_approaching=1, gate_name="SVD", days_until_gate=2),
            signal(2, days_since_last_login=5),
        ),
        enrollments=table(
            "enrollments", dict(enrollment_id=1, user_id=1, final_score=71.25, total_activity_time=5400),
            dict(enrollment_id=2, user_id=2, final_score=100), dict(enrollment_id=3, user_id=2, final_score=0),
        ),
        summaries=table("student_summaries", dict(user_id=1, page_views=9)),
        flag_events=table(
            "flag_events", flag(1, 1, "yellow", "Y3: a"), flag(2, 1, "red", "R3: b"), flag(3, 2, "red", "R1: c"),
            flag(4, 3, "red", "R1: closed", resolved=1),
        ),
    )


def test_cohort_overview(cohort):
    rows = [tuple(r) for r in reports.cohort_overview(**cohort).collect()]
    assert rows == [
        ("🔴 ", 1, 4, "-2.2d", "Worsening", "today", 9, "71.2%", 1.5, "⚠️ SVD in 2d", "R3: b"),
        # a finished course is green, the second enrollment of the learner is not
        ("🟢 ", 2, 0, "no data", "No submissions", "5d ago", 0, "100.0%", 0.0, "", "Course completed"),
        ("🔴 ", 2, 0, "no data", "No submissions", "5d ago", 0, "N/A", 0.0, "", "R1: c"),
        ("🟢 ", 3, 0, "no data", "No submissions", "never", 0, "N/A", 0.0, "", "No issues detected"),
    ]


def test_kpis_ignore_the_finished_override_and_count_rows(cohort):
    got = reports.cohort_kpis(cohort["users"], cohort["enrollments"], cohort["flag_events"]).first()
    assert tuple(got) == (4, 2, 0, 2)


def test_engagement_scatter(cohort):
    got = {tuple(r) for r in reports.engagement_scatter(cohort["users"], cohort["summaries"], cohort["signals"]).collect()}
    assert got == {("1", 9, 4), ("2", 0, 0), ("3", 0, 0)}
    assert [r.student for r in reports.learner_list(cohort["users"]).collect()] == ["1", "2", "3"]


def test_drill_downs(table, cohort):
    assert [tuple(r) for r in reports.enrollment_detail(cohort["enrollments"], 1).collect()] == [
        (1, None, 1.5, "N/A", "Never", "71.25%")
    ]
    assert reports.signal_detail(cohort["signals"], 1).columns[1:3] == ["Avg Days from Deadline", "Trend"]
    flags = table("flag_events", flag(1, 1, "yellow", "a"), flag(2, 1, "red", "b", "2024-01-02", 1), flag(3, 2, "red", "c"))
    assert [(r.icon, r.severity) for r in reports.flag_detail(flags, 1).collect()] == [("🔴 ", "RED"), ("🟡 ", "YELLOW")]


def test_timeline_and_quiz_history(table):
    work = table(
        "submissions", dict(submission_id=1, assignment_id=1, user_id=1, submitted_at="2024-01-03", days_from_deadline=-1),
        dict(submission_id=2, assignment_id=2, user_id=1, submitted_at="2024-01-02", days_from_deadline=0),
        dict(submission_id=3, assignment_id=3, user_id=1), dict(submission_id=4, assignment_id=9, user_id=1, submitted_at="2024-01-02"),
        dict(submission_id=5, assignment_id=3, user_id=1, submitted_at="2024-01-09"),
    )
    tasks = table(
        "assignments", dict(assignment_id=1, name="late", due_at_roadmap="2024-01-02"),
        dict(assignment_id=2, name="early", due_at_roadmap="2024-01-01"), dict(assignment_id=3, name="open"),
    )
    got = [(r.name, r.timing, r.submitted_at) for r in reports.submission_timeline(work, tasks, 1).collect()]
    assert got == [("early", "Early", "2024-01-02"), ("late", "Late", "2024-01-03"), ("open", "Late", "2024-01-09")]
    tries = table(
        "quiz_submissions", dict(quiz_submission_id=1, quiz_id=1, user_id=1, attempt=2, started_at="2024-01-02"),
        dict(quiz_submission_id=2, quiz_id=1, user_id=1, attempt=1, started_at="2024-01-01"), dict(quiz_submission_id=3, quiz_id=7, user_id=1),
    )
    quizzes = table("quizzes", dict(quiz_id=1, title="q"))
    assert [(r.title, r.attempt, r.date) for r in reports.quiz_history(tries, quizzes, 1).collect()] == [("q", 1, "2024-01-01"), ("q", 2, "2024-01-02")]


def test_flag_log_filters(table):
    flags = table("flag_events", flag(1, 12, "red", "a"), flag(2, 23, "yellow", "b", "2024-01-02"), flag(3, 31, "red", "c", resolved=1))
    assert [r.flag_id for r in reports.flag_log(flags).collect()] == [2, 1, 3]
    assert [r.flag_id for r in reports.flag_log(flags, ("red",), " ^1|3 ").collect()] == [1, 3]
    assert tuple(reports.flag_log_kpis(reports.flag_log(flags, ())).first()) == (3, 2, 1)
    assert [r.state for r in reports.flag_log(flags, ("red",)).collect()] == ["⏳ Open", "✅ Resolved"]


def nudge(nudge_id, draft_id, status="pending_review", code="R1", **more):
    base = dict(nudge_id=nudge_id, draft_id=draft_id, user_id=1, flag_code=code, nudge_type="late_submission", delivery_status=status,
                created_at=f"2024-01-{nudge_id:02d} 22:30:00")
    return {**base, **more}


def test_approval_queue(table):
    nudges = table(
        "nudge_events", nudge(1, "a"), nudge(2, "b", code="Y3"), nudge(3, "c"), nudge(4, "c", "approved"), nudge(5, "d", code="Y9"),
        nudge(6, "e", nudge_type="escalation_alert"), nudge(7, "f", code=None),
    )
    flags = table(
        "flag_events", flag(1, 1, "red", "R1: old"), flag(2, 1, "red", "R1: new", "2024-01-05"), flag(3, 1, "yellow", "Y3: x"),
        flag(4, 1, "yellow", "Y9: closed", resolved=1),
    )
    queue = reports.approval_queue(nudges, flags, table("student_risk_signals", signal(1, days_since_last_login=3)))
    got = [(r.draft_id, r.flag_reason, r.days_since_last_login) for r in queue.collect()]
    assert got == [("a", "R1: new", 3), ("f", None, 3), ("d", None, 3), ("b", "Y3: x", 3)]
    assert tuple(reports.queue_kpis(queue).first()) == (4, 1, 1)


def test_audit_log(table):
    nudges = table("nudge_events", *[nudge(i, f"draft-{i:04d}", "sent" if i % 2 else "failed") for i in range(1, 29)])
    got = reports.audit_log(nudges, "sent", 10).collect()
    assert [r.nudge_id for r in got] == list(range(27, 7, -2))
    assert (got[0].icon, got[0].status, got[0].nudge_type, got[0].created, got[0].draft, got[0].reviewer) == (
        "🟢", "sent", "late submission", "Jan 28, 00:30", "draft-00…", "—",
    )
    for limit in (9, 501):
        with pytest.raises(ValueError):
            reports.audit_log(nudges, limit=limit)


def test_signals_report_puts_unknown_averages_last(table):
    rows = table("student_risk_signals", signal(1), signal(2, avg_days_from_deadline=3), signal(3, avg_days_from_deadline=-3))
    assert [r.user_id for r in reports.signals_report(rows).collect()] == [3, 2, 1]


def test_no_report_exposes_pii(cohort):
    private = {"full_name", "email", "person_reference_id", "most_recent_employer"}
    for frame in (reports.cohort_overview(**cohort), reports.learner_list(cohort["users"]), reports.cohort_base(
            *[cohort[n] for n in ("users", "signals", "enrollments", "summaries")])):
        assert not private & set(frame.columns)


def test_skewed_enrollments_keep_all_rows(spark, table):
    users = table("users", dict(user_id=1), dict(user_id=2))
    many = spark.range(500).select(
        F.col("id").alias("enrollment_id"), F.lit(1).cast("long").alias("user_id"), F.lit(50.0).alias("final_score"),
        F.lit(None).cast("timestamp").alias("last_activity_at"), F.lit(3600).alias("total_activity_time"),
    )
    base = reports.cohort_base(users, table("student_risk_signals"), many, table("student_summaries"))
    assert base.count() == 501
    assert reports.cohort_kpis(users, many, table("flag_events")).first().total == 501
