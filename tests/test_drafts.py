from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, ROUTES
from studylantern.operators import drafts

AS_OF = "2024-01-31 00:00:00"


def flag(flag_id, reason, user_id=1, resolved=0):
    return dict(flag_id=flag_id, user_id=user_id, flagged_at="2024-01-01", flag_type="red", reason=reason, resolved=resolved)


def nudge(user_id, code, status="rejected"):
    return dict(nudge_id=1, draft_id="d", user_id=user_id, flag_code=code, delivery_status=status, created_at="2024-01-01")


def test_candidates(table):
    flags = table(
        "flag_events", flag(1, "R1: a"), flag(2, "Y1: a", resolved=1), flag(3, None), flag(4, "manual note"), flag(5, " Y2 : padded"),
        flag(6, "Y3: has a rejected draft"), flag(7, "Y1b: draft of Y1 does not count"),
    )
    nudges = table("nudge_events", nudge(1, "Y3"), nudge(1, "Y1"), nudge(2, "R1"), nudge(1, None))
    got = {(r.flag_id, r.flag_code) for r in drafts.flags_without_drafts(flags, nudges).collect()}
    assert got == {(1, "R1"), (5, "Y2"), (7, "Y1b")}


def test_unknown_codes_are_set_aside(spark):
    good, bad = drafts.route_flags(spark.createDataFrame([(1, "R1"), (2, "Z9")], "flag_id int, flag_code string"))
    assert [r.template_id for r in good.collect()] == ["reengagement"] and [r.flag_id for r in bad.collect()] == [2]


@pytest.fixture
def generate(table):
    def run(flags, nudges=(), signals=(), enrollments=(), users=(1,), cfg=DEFAULT):
        return drafts.generate_drafts(
            table("flag_events", *flags), table("nudge_events", *nudges), table("users", *[dict(user_id=u) for u in users]),
            table("student_risk_signals", *signals), table("enrollments", *enrollments), AS_OF, cfg,
        )

    return run


def test_context_defaults_and_signs(spark, table):
    cands = spark.createDataFrame([(1, 1, "R1"), (2, 2, "R1"), (3, 3, "R1")], "flag_id int, user_id long, flag_code string")
    got = drafts.nudge_context(
        cands, table("users", dict(user_id=1), dict(user_id=2)),
        table("student_risk_signals", dict(user_id=2, avg_days_from_deadline=6.25, total_submissions=4, gate_name="SVD", days_until_gate=2,
                                           days_since_last_login=8, timing_trend="stable")),
        table("enrollments", dict(enrollment_id=1, user_id=2, current_score=71.25)),
    )
    rows = {r.user_id: r.specific.asDict() for r in got.collect()}
    assert rows[1] == dict(
        days_inactive=0, days_since_login=0, avg_days_late=0.0, submission_count=0, current_score=0.0,
        gate_name="your next gate", days_to_gate=0, timing_trend="unknown", avg_days_late_text="0", current_score_text="0",
    )
    assert (rows[2]["avg_days_late"], rows[2]["avg_days_late_text"], rows[2]["current_score_text"]) == (6.2, "6.2", "71.2")
    assert 3 not in rows  # no user row


def test_every_route_renders(generate):
    flags = [flag(i, f"{code}: x") for i, code in enumerate(ROUTES)]
    rows = {r.flag_code: r for r in generate(flags).collect()}
    assert set(rows) == set(ROUTES)
    for code, row in rows.items():
        assert (row.template_id, row.nudge_type) == ROUTES[code][:2]
        assert row.delivery_status == "pending_review" and row.channel == "email"
        assert "{{" not in row.rendered_template and "___LEARNER_NAME___" in row.html_body and row.html_body.startswith("<p>")
        assert row.subject and "{{" not in row.subject
    assert rows["R1"].rendered_template != rows["Y1"].rendered_template  # wording follows severity


def test_own_wording_and_its_validation(generate):
    cfg = replace(DEFAULT, templates={("reengagement", None): "{{ severity }} {{ specific.days_inactive }}"}, subjects={})
    row = generate([flag(1, "R1: x")], cfg=cfg).first()
    assert (row.rendered_template, row.subject) == ("red 0", "[Math Foundations] News (reengagement)")
    with pytest.raises(ValueError, match="missing"):
        generate([flag(1, "R1: x")], cfg=replace(DEFAULT, templates={("reengagement", None): "{{ specific.missing }}"}))


def test_second_run_adds_nothing(generate, table):
    flags = [flag(1, "R1: x"), flag(2, "Y1b: x", user_id=2)]
    first = generate(flags, users=(1, 2)).withColumn("nudge_id", F.monotonically_increasing_id())
    stored = [r.asDict() for r in first.select("nudge_id", "draft_id", "user_id", "flag_code", "delivery_status").collect()]
    assert len(stored) == 2 and generate(flags, stored, users=(1, 2)).count() == 0


def test_draft_ids_are_repeatable(generate):
    one, two = (sorted(r.draft_id for r in generate([flag(1, "R1: x"), flag(2, "R1: again")]).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 2


def test_create_drafts(spark):
    messages = spark.createDataFrame([("d1", 1, "gate_ahead", "t", "S", "<p>x</p>")],
                                     "draft_id string, user_id long, nudge_type string, template_id string, subject string, html_body string")
    row = drafts.create_drafts(messages, AS_OF).first()
    assert (row.draft_id, row.delivery_status, row.channel, row.flag_code) == ("d1", "pending_review", "email", None)
