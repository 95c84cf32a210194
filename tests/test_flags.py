import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from studylantern.operators import flags

AS_OF = "2024-01-31 00:00:00"
SIGNAL = dict(
    user_id=1, avg_days_from_deadline=None, timing_trend="stable", days_since_last_login=None, total_submissions=0,
    zero_submissions=1, engagement_ratio=0.5, gate_approaching=0, gate_name=None, days_until_gate=None,
)


def signal(**changes):
    row = {**SIGNAL, **changes}
    row["zero_submissions"] = 1 if row["total_submissions"] == 0 else 0
    return row


def expected_codes(row, scores):
    n, avg, silent = row["total_submissions"], row["avg_days_from_deadline"], row["days_since_last_login"]
    hits = set()
    if n == 0 and silent is not None:
        hits.add("R1" if silent > 14 else "Y1" if silent > 7 else "Y1b")
    if avg is not None:
        if avg < -10 and n < 3:
            hits.add("R2")
        if row["gate_approaching"] and avg < -5:
            hits.add("R3")
        if -10 <= avg < -5 and n >= 3:
            hits.add("Y2")
        if row["timing_trend"] == "worsening" and avg < 0:
            hits.add("Y3")
    if n > 0 and any(s is not None and 0 < s < 70 for s in scores):
        hits.add("Y4")
    return hits


def run(table, signals, enrollments=(), events=()):
    return flags.run_flags(
        table("student_risk_signals", *signals), table("enrollments", *enrollments), table("flag_events", *events), AS_OF
    )


def test_every_boundary_combination(spark, table):
    grid = itertools.product(
        (None, -1, 7, 8, 14, 15), (None, -10.01, -10.0, -5.01, -5.0, -0.01, 0.0), (0, 2, 3), ("worsening", "stable"), (0, 1),
        (None, 0.0, 69.9, 70.0, 100.0),
    )
    rows, enrollments, expected = [], [], set()
    for i, (silent, avg, n, trend, gate, score) in enumerate(grid):
        row = signal(
            user_id=i, days_since_last_login=silent, avg_days_from_deadline=avg, total_submissions=n, timing_trend=trend,
            gate_approaching=gate, gate_name="SVD" if gate else None, days_until_gate=3 if gate else None,
        )
        rows.append(row)
        enrollments.append(dict(enrollment_id=i, user_id=i, final_score=score))
        expected |= {(i, code) for code in expected_codes(row, [score])}
    got = run(table, rows, enrollments).collect()
    assert {(r.user_id, r.flag_code) for r in got} == expected
    assert len(got) == len(expected)
    assert all(r.flag_type == ("red" if r.flag_code[0] == "R" else "yellow") and r.resolved == 0 for r in got)


@pytest.mark.parametrize(
    "changes, score, reason, inputs",
    [
        (dict(days_since_last_login=20), None, "R1: No submissions and silent for 20 days",
         {"zero_submissions": 1, "days_since_last_login": 20, "total_submissions": 0}),
        (dict(avg_days_from_deadline=-10.35, total_submissions=2), None, "R2: Average -10.3 days late with only 2 submissions",
         {"avg_days_from_deadline": -10.35, "total_submissions": 2}),
        (dict(avg_days_from_deadline=-5.5, total_submissions=2, gate_approaching=1, gate_name="SVD", days_until_gate=3), None,
         "R3: SVD gate in 3 days, already averaging -5.5d late",
         {"gate_name": "SVD", "days_until_gate": 3, "avg_days_from_deadline": -5.5}),
        (dict(days_since_last_login=9), None, "Y1: No submissions but logged in 9 days ago",
         {"zero_submissions": 1, "days_since_last_login": 9, "engagement_ratio": 0.5}),
        (dict(days_since_last_login=2, engagement_ratio=None), None,
         "Y1b: No formal submissions but logged in 2 days ago — engaging but not submitting",
         {"zero_submissions": 1, "days_since_last_login": 2, "engagement_ratio": None}),
        (dict(avg_days_from_deadline=-7.0, total_submissions=3), None, "Y2: Averaging -7.0 days late across 3 submissions",
         {"avg_days_from_deadline": -7.0, "total_submissions": 3, "timing_trend": "stable"}),
        (dict(avg_days_from_deadline=-1.0, total_submissions=3, timing_trend="worsening"), None,
         "Y3: Submission timing is worsening, currently averaging -1.0d from deadline",
         {"timing_trend": "worsening", "avg_days_from_deadline": -1.0}),
        (dict(avg_days_from_deadline=1.0, total_submissions=3), 60.0, "Y4: Has 3 submissions but final score is 60.0%",
         {"total_submissions": 3, "current_score": 60.0}),
    ],
)
def test_reason_and_inputs(spark, table, changes, score, reason, inputs):
    (row,) = run(table, [signal(**changes)], [dict(enrollment_id=1, user_id=1, final_score=score)]).collect()
    assert row.reason == reason and json.loads(row.inputs) == inputs


def test_severe_lateness_with_three_submissions_is_a_gap(spark, table):
    assert run(table, [signal(avg_days_from_deadline=-12.0, total_submissions=3)]).count() == 0


@pytest.mark.parametrize(
    "silent, reason, resolved, raised",
    [
        (9, "Y1b: old", 0, []),          # an open Y1b starts with Y1
        (3, "Y1: old", 0, ["Y1b"]),
        (20, "R1: old", 0, []),
        (20, "R1: old", 1, ["R1"]),
        (20, "R1 without colon", 0, []),
        (20, None, 0, ["R1"]),
    ],
)
def test_open_flags_suppress_by_prefix(spark, table, silent, reason, resolved, raised):
    event = dict(flag_id=1, user_id=1, flagged_at="2024-01-01", flag_type="red", reason=reason, resolved=resolved)
    assert [r.flag_code for r in run(table, [signal(days_since_last_login=silent)], events=[event]).collect()] == raised


def test_two_enrollments_give_one_low_score_flag(spark, table):
    rows = [dict(enrollment_id=5, user_id=1, final_score=60), dict(enrollment_id=2, user_id=1, final_score=90),
            dict(enrollment_id=7, user_id=1, final_score=10)]
    (row,) = run(table, [signal(avg_days_from_deadline=1.0, total_submissions=1)], rows).collect()
    assert row.flag_code == "Y4" and "60.0%" in row.reason


def test_second_run_adds_nothing(spark, table):
    rng = random.Random(4)
    rows = [
        signal(user_id=i, days_since_last_login=rng.choice([None, 3, 9, 20]), total_submissions=rng.choice([0, 2, 4]),
               avg_days_from_deadline=rng.choice([-12.0, -7.0, -1.0]), timing_trend=rng.choice(["worsening", "stable"]))
        for i in range(80)
    ]
    signals, none = table("student_risk_signals", *rows), table("enrollments")
    first = flags.run_flags(signals, none, table("flag_events"), AS_OF)
    stored = first.withColumn("flag_id", F.monotonically_increasing_id()).select(*table("flag_events").columns)
    assert stored.count() > 20
    assert flags.run_flags(signals, none, stored, AS_OF).count() == 0


def test_worst_and_latest_open_flag(spark, table):
    base = dict(user_id=1, resolved=0)
    events = table(
        "flag_events",
        dict(base, flag_id=1, flagged_at="2024-01-01", flag_type="yellow", reason="Y1: a"),
        dict(base, flag_id=2, flagged_at="2024-01-02", flag_type="red", reason="R1: a"),
        dict(base, flag_id=3, flagged_at="2024-01-03", flag_type="red", reason="R1: b"),
        dict(base, flag_id=4, flagged_at="2024-01-09", flag_type="red", reason="R1: closed", resolved=1),
    )
    assert tuple(flags.worst_open_flag(events).first()) == (1, "red", "R1: b")
    latest = {r.flag_code: r.flag_reason for r in flags.latest_open_flag(events).collect()}
    assert latest == {"Y1": "Y1: a", "R1": "R1: b"}
