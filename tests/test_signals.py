import random
from collections import defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from studylantern.config import DEFAULT
from studylantern.operators import signals

AS_OF = "2024-01-31 00:00:00"
BASE = datetime(2024, 1, 1)


def submissions(spark, rows):
    return spark.createDataFrame(rows, "user_id long, submitted_at timestamp, days_from_deadline double")


def total(days):
    """Sum of two-decimal values without float drift."""
    return sum(round(d * 100) for d in days) / 100


def brute_trend(rows):
    grouped = defaultdict(list)
    for user, at, days in rows:
        if days is not None:
            grouped[user].append((at, days))
    out = {}
    for user, items in grouped.items():
        days = [d for _, d in sorted(items)]
        n = len(days)
        label = "insufficient_data"
        if n >= 3:
            first, second = days[: n // 2], days[n // 2 :]
            change = total(second) / len(second) - total(first) / len(first)
            label = "improving" if change > 1 else "worsening" if change < -1 else "stable"
        out[user] = (round(total(days) / n, 2), n, label)
    return out


def skewed_rows(seed, hot=900, others=60):
    rng = random.Random(seed)
    rows = []
    for i in range(hot):  # one learner holds most rows, many at one instant
        at = BASE + timedelta(seconds=rng.choice([5, 5, 5, 61, 3600 * 30, rng.randrange(10**6)]))
        rows.append((1, at, round(rng.uniform(-9, 9), 2)))
    for i in range(others):
        rows.append((2 + i % 17, BASE + timedelta(hours=rng.randrange(99)), rng.choice([None, round(rng.uniform(-9, 9), 2)])))
    return rows


@pytest.mark.parametrize("limit", [2_000_000, 100, 2, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_trend_equals_brute_force_for_any_hot_limit(spark, seed, limit):
    rows = skewed_rows(seed)
    got = signals.timing_trend(submissions(spark, rows), replace(DEFAULT, hot_learner_rows=limit)).collect()
    assert {r.user_id: (r.avg_days_from_deadline, r.total_submissions, r.timing_trend) for r in got} == brute_trend(rows)


def test_order_of_rows_and_partitions_do_not_matter(spark):
    rows = skewed_rows(5, hot=200)
    results = []
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        frame = submissions(spark, rows).repartition(parts)
        results.append(sorted(tuple(r) for r in signals.timing_trend(frame).collect()))
    assert results[0] == results[1]


def test_two_and_three_submissions(spark):
    at = [BASE + timedelta(days=i) for i in range(3)]
    rows = [(1, at[0], -1.0), (1, at[1], -9.0), (2, at[0], 5.0), (2, at[1], 0.0), (2, at[2], -4.0)]
    got = {r.user_id: r.timing_trend for r in signals.timing_trend(submissions(spark, rows)).collect()}
    assert got == {1: "insufficient_data", 2: "worsening"}  # halves 5 and -2


def test_change_of_exactly_one_day_is_stable(spark):
    at = [BASE + timedelta(days=i) for i in range(4)]
    rows = [(1, t, d) for t, d in zip(at, (0.0, 0.0, 1.0, 1.0))] + [(2, t, d) for t, d in zip(at, (1.0, 1.0, 0.0, 0.0))]
    assert {r.timing_trend for r in signals.timing_trend(submissions(spark, rows)).collect()} == {"stable"}


@pytest.mark.parametrize("ahead, expected", [(-1, (0, None, None)), (0, (1, "g", 0)), (7, (1, "g", 7)), (8, (0, None, None))])
def test_gate_window(spark, table, ahead, expected):
    day = (datetime(2024, 1, 31) + timedelta(days=ahead)).date().isoformat()
    gates = table("gate_calendar", dict(gate_id=1, gate_name="g", gate_date=day))
    assert tuple(signals.next_gate(gates, AS_OF).first()) == expected


def test_earliest_gate_wins(spark, table):
    gates = table(
        "gate_calendar", dict(gate_id=1, gate_name="b", gate_date="2024-02-05"), dict(gate_id=2, gate_name="a", gate_date="2024-02-03")
    )
    assert tuple(signals.next_gate(gates, AS_OF).first()) == (1, "a", 3)


@pytest.fixture
def one_signal(spark, table):
    def run(enrollments=(), work=(), summaries=(), gates=(), users=(1,)):
        got = signals.risk_signals(
            table("users", *[dict(user_id=u) for u in users]),
            table("submissions", *work),
            table("enrollments", *enrollments),
            table("student_summaries", *summaries),
            table("gate_calendar", *gates),
            AS_OF,
        )
        return {r.user_id: r for r in got.collect()}

    return run


def test_learner_without_anything(one_signal):
    row = one_signal()[1]
    assert row.timing_trend == "no_data" and row.days_since_last_login is None and row.avg_days_from_deadline is None
    assert (row.total_submissions, row.zero_submissions, row.engagement_ratio, row.gate_approaching) == (0, 1, 0.0, 0)


def test_work_without_deadline_does_not_count(one_signal):
    row = one_signal(work=[dict(submission_id=1, assignment_id=1, user_id=1, submitted_at="2024-01-05")])[1]
    assert (row.total_submissions, row.zero_submissions) == (0, 1)


def test_completed_overrides_no_data(one_signal):
    assert one_signal(enrollments=[dict(enrollment_id=1, user_id=1, final_score=100)])[1].timing_trend == "completed"
    assert one_signal(enrollments=[dict(enrollment_id=1, user_id=1, final_score=99.9)])[1].timing_trend == "no_data"


def test_lowest_enrollment_is_used(one_signal):
    row = one_signal(
        enrollments=[
            dict(enrollment_id=9, user_id=1, final_score=100, last_activity_at="2024-01-30"),
            dict(enrollment_id=3, user_id=1, final_score=50, last_activity_at="2024-01-21"),
        ]
    )[1]
    assert row.timing_trend == "no_data" and row.days_since_last_login == 10


def test_future_activity_is_negative_silence(one_signal):
    assert one_signal(enrollments=[dict(enrollment_id=1, user_id=1, last_activity_at="2024-01-31 05:00:00")])[1].days_since_last_login == -1


def test_engagement_ratio(one_signal):
    rows = [dict(user_id=1, page_views=2, max_page_views=3), dict(user_id=2, page_views=5, max_page_views=3)]
    got = one_signal(summaries=rows, users=(1, 2, 3))
    # a stale course maximum lets the ratio exceed 1
    assert [got[u].engagement_ratio for u in (1, 2, 3)] == [0.667, 1.667, 0.0]
    assert one_signal(summaries=[dict(user_id=1, page_views=4, max_page_views=0)])[1].engagement_ratio == 4.0
