import csv
import json
import random

import pytest

from studylantern.config import TEST_LEARNER_ID
from studylantern.operators.merge import rule_for, upsert
from studylantern.schemas import DEMOGRAPHIC_HEADERS, FEEDS, PII_HEADERS
from studylantern.sources import demographics, dims, feeds, runlog, tables

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def landed(spark, tmp_path):
    def run(name, *pages, folder=""):
        target = tmp_path / name / folder
        target.mkdir(parents=True, exist_ok=True)
        for i, page in enumerate(pages):
            (target / f"page-{i:04d}.json").write_text(json.dumps(page, indent=1), encoding="utf-8")
        return feeds.read_feed(spark, str(tmp_path / name), FEEDS[name])

    return run


def test_pages_are_lists_or_single_records_and_keep_their_order(landed, table):
    feed = landed("users", [{"id": 1, "email": "old"}, {"id": 2, "login_id": "two"}], {"id": 1, "email": "new"})
    rows = feeds.users_from_feed(feed, AS_OF)
    assert rows.count() == 3
    merged = upsert(table("users"), rows, rule_for("users"), "ordinal")
    assert {r.user_id: r.email for r in merged.collect()} == {1: "new", 2: "two"}


def test_one_page_per_line(spark, tmp_path, table):
    (tmp_path / "users.json").write_text('[{"id": 1, "email": "old"}, {"id": 2}]\n{"id": 1, "email": "new"}\n', encoding="utf-8")
    rows = feeds.users_from_feed(feeds.read_feed(spark, str(tmp_path), FEEDS["users"], page_per_line=True))
    merged = upsert(table("users"), rows, rule_for("users"), "ordinal")
    assert {r.user_id: r.email for r in merged.collect()} == {1: "new", 2: None}


def test_user_address_falls_back_and_test_learner_is_dropped(landed):
    feed = landed("users", [{"id": 1, "email": "", "sis_user_id": None, "login_id": "x@y"}, {"id": TEST_LEARNER_ID}])
    assert [(r.user_id, r.email) for r in feeds.users_from_feed(feed).collect()] == [(1, "x@y")]


def test_assignments_take_the_planned_deadline(spark, landed):
    feed = landed("assignments", [{"id": 3320, "name": "a", "due_at": "2026-01-01T00:00:00Z"}, {"id": 1, "name": "b"}])
    rows = {r.assignment_id: r for r in feeds.assignments_from_feed(feed, dims.deadline_dim(spark)).collect()}
    assert str(rows[3320].due_at_roadmap) == "2026-06-28 23:59:00" and rows[1].due_at_roadmap is None
    assert rows[3320].course_id == 829 and rows[1].due_at is None


def test_enrollments_tolerate_missing_objects(landed):
    feed = landed("enrollments", [{"id": 1, "user": {"id": 5}, "grades": {"current_score": 1.5, "final_score": 2}}, {"id": 2}])
    rows = {r.enrollment_id: r for r in feeds.enrollments_from_feed(feed).collect()}
    assert (rows[1].user_id, rows[1].final_score) == (5, 2.0) and rows[2].user_id is None and rows[2].final_score is None


def test_summaries_flatten_and_drop_the_test_learner(landed):
    feed = landed("student_summaries", [{"id": 1, "page_views": 3, "tardiness_breakdown": {"late": 2}}, {"id": TEST_LEARNER_ID}, {"id": 2}])
    rows = {r.user_id: r for r in feeds.summaries_from_feed(feed).collect()}
    assert set(rows) == {1, 2} and rows[1].tardiness_late == 2 and rows[2].tardiness_late is None


def test_submissions(landed, table):
    tasks = table("assignments", dict(assignment_id=7, due_at_roadmap="2024-01-10 23:59:00"), dict(assignment_id=8))
    record = {"id": 1, "assignment_id": 7, "user_id": 1, "submitted_at": "2024-01-09T23:59:00Z", "late": True}
    feed = landed(
        "submissions",
        [record, {**record, "id": 2, "assignment_id": 8, "late": None}, {**record, "id": 3, "assignment_id": 99}, {**record, "id": 4, "submitted_at": None},
         {**record, "id": 5, "assignment_id": 0}, {**record, "id": 6, "user_id": None}, {**record, "id": 7, "user_id": TEST_LEARNER_ID}],
    )
    rows = {r.submission_id: r for r in feeds.submissions_from_feed(feed, tasks).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert [rows[i].days_from_deadline for i in (1, 2, 3, 4)] == [1.0, None, None, None]
    assert (rows[1].late, rows[2].late, rows[1].missing) == (1, 0, 0)


def test_quiz_pages_wrapped_or_bare(landed):
    record = {"id": 1, "user_id": 5, "attempt": 1, "score": 3.0, "started_at": "2024-01-01T00:00:00Z"}
    wrapped = {"quiz_submissions": [record, {**record, "id": 2, "user_id": 6}, {**record, "id": 9, "user_id": TEST_LEARNER_ID}]}
    landed("quiz_submissions", wrapped, {"quiz_submissions": []}, folder="quiz_id=40")
    feed = landed("quiz_submissions", {**record, "id": 3}, {"id": 4}, folder="quiz_id=41")
    rows = {r.quiz_submission_id: r.quiz_id for r in feeds.quiz_submissions_from_feed(feed).collect()}
    assert rows == {1: 40, 2: 40, 3: 41}


def test_pages_rank_by_number(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"page_{n}.json").write_text(json.dumps([{"id": 1, "email": f"from{n}@x"}]), encoding="utf-8")
    rows = feeds.users_from_feed(feeds.read_feed(spark, str(tmp_path), FEEDS["users"]))
    assert [r.email for r in rows.orderBy(feeds.ORDINAL).collect()] == ["from2@x", "from10@x"]


def test_a_malformed_field_costs_its_record_only(spark, tmp_path):
    (tmp_path / "page 1.json").write_text('[{"id": 1, "email": "a"}, {"id": "x", "email": "b"}, null, 7, {"id": 3, "email": "c"}]', encoding="utf-8")
    (tmp_path / "page 2.json").write_text('\ufeff \n{"id": 4, "email": "{[d"}', encoding="utf-8")
    (tmp_path / "page 3.json").write_text('[{"id": 5}, {"id": 6,', encoding="utf-8")
    (tmp_path / "page 4.json").write_text("[]", encoding="utf-8")
    (tmp_path / "page 5.json").write_text("", encoding="utf-8")
    (tmp_path / "page 6.json").write_text("no page", encoding="utf-8")
    records, rejects = feeds.read_pages(spark, str(tmp_path), FEEDS["users"])
    assert records.count() == 3 and rejects.count() == 5
    assert [(r.id, r.email) for r in records.orderBy(feeds.ORDINAL).collect()] == [(1, "a"), (3, "c"), (4, "{[d")]
    assert {r.record for r in rejects.collect()} == {'{"id":"x","email":"b"}', "null", "7", '[{"id": 5}, {"id": 6,', "no page"}
    assert [r.parsed for r in rejects.filter("record like '%x%'").collect()] == ['{"email":"b"}']
    assert all("page" in r.page for r in rejects.collect())


def test_a_wrapped_page_is_cut_into_its_records(spark, tmp_path):
    record = {"user_id": 5, "attempt": 1}
    pages = [{"quiz_submissions": [{**record, "id": 1}, {**record, "id": 2, "attempt": "first"}, {**record, "id": 3}]}, {"quiz_submissions": []}, {**record, "id": 4}]
    (tmp_path / "quiz_id=4").mkdir()
    for n, page in enumerate(pages):
        (tmp_path / "quiz_id=4" / f"page-{n}.json").write_text(json.dumps(page), encoding="utf-8")
    parsed = feeds.parse_pages(spark, str(tmp_path), FEEDS["quiz_submissions"], wrapper=feeds.WRAPPERS["quiz_submissions"])
    rows = feeds.quiz_submissions_from_feed(feeds.records_of(parsed)).orderBy(feeds.ORDINAL).collect()
    assert [(r.quiz_submission_id, r.quiz_id) for r in rows] == [(1, 4), (3, 4), (4, 4)]
    assert [json.loads(r.record)["id"] for r in feeds.rejects_of(parsed).collect()] == [2]


def test_flags_may_be_numbers(landed, table):
    record = {"assignment_id": 7, "user_id": 1}
    feed = landed("submissions", [{**record, "id": i, "late": v} for i, v in enumerate((1, 0, True, False, None))])
    rows = feeds.submissions_from_feed(feed, table("assignments")).orderBy("submission_id").collect()
    assert [r.late for r in rows] == [1, 0, 1, 0, 0]


def test_ordinals_rank_lines_records_and_wrapped_records(spark, tmp_path):
    record = {"user_id": 5, "attempt": 1}
    lines = [json.dumps({"quiz_submissions": [{**record, "id": 10 * n + k} for k in range(3)]}) for n in range(4)]
    (tmp_path / "quiz_id=4").mkdir()
    (tmp_path / "quiz_id=4" / "bulk.json").write_text("\n".join(lines), encoding="utf-8")
    for per_line in (True, False):
        feed = feeds.read_feed(spark, str(tmp_path), FEEDS["quiz_submissions"], page_per_line=per_line)
        rows = feeds.quiz_submissions_from_feed(feed)
        ids = [r.quiz_submission_id for r in rows.orderBy(feeds.ORDINAL).collect()]
        assert ids == ([10 * n + k for n in range(4) for k in range(3)] if per_line else [0, 1, 2])
        assert rows.select(feeds.ORDINAL).distinct().count() == len(ids)


def test_dates_that_are_no_plain_dates_have_no_key(landed):
    feed = landed("course_activity", [{"date": "2024-01-03T05:00:00Z", "views": 4}, {"date": "soon", "views": 1}])
    assert [r.activity_date for r in feeds.activity_from_feed(feed).collect()] == [None, None]


def test_activity_skips_rows_without_date(landed):
    feed = landed("course_activity", [{"date": "2024-01-03", "views": 4, "participations": 1}, {"views": 1}, {"date": "", "views": 1}])
    assert [(str(r.activity_date), r.views) for r in feeds.activity_from_feed(feed).collect()] == [("2024-01-03", 4)]


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.csv"
    header = ",".join(f'"{h}"' for h in [*DEMOGRAPHIC_HEADERS, *PII_HEADERS])
    def line(email, name, cohort="c", rest=""):
        demo = [cohort, *([rest] * (len(DEMOGRAPHIC_HEADERS) - 1))]
        return ",".join(['"' + v.replace('"', '""') + '"' for v in [*demo, name, email, "", "", "", ""]])
    lines = [header, line(" ANN@x ", " Ann "), line("ann@x", "Ann Again", 'two\nlines, "quoted"'), line("", "Blank"), line("who@x", "Who")]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode("utf-8"))
    return str(path)


def test_demographics_export(spark, table, export):
    rows = demographics.read_demographics(spark, export)
    assert set(rows.columns) == {*DEMOGRAPHIC_HEADERS, *PII_HEADERS, "ordinal"}
    matched, skipped = demographics.match_demographics(rows, table("users", dict(user_id=3, email="Ann@X "), dict(user_id=4)))
    assert sorted(r.skip_reason for r in skipped.collect()) == ["no email", "no matching user"]
    pii, rest = demographics.split_pii(matched, AS_OF)
    stored = upsert(table("student_pii"), pii, rule_for("student_pii"), "ordinal").collect()
    assert [(r.user_id, r.full_name, r.email, r.prefix) for r in stored] == [(3, "Ann Again", "ann@x", "")]
    (row,) = upsert(table("student_demographics"), rest, rule_for("student_demographics"), "ordinal").collect()
    assert row.cohort == 'two\nlines, "quoted"' and row.age_group == ""
    assert not {"full_name", "email"} & set(rest.columns)


def test_quoted_line_breaks_over_many_splits(spark, tmp_path):
    """Small splits: records begin in one and end in another, some splits hold no record's beginning."""
    rng = random.Random(2)
    pieces = ["plain", "two\nlines", 'a "quoted" word', "x" * 300, "\n\n\n", "comma, comma", "", "\r\nodd", "end\n"]
    written = []
    for n in range(3):
        rows = [[f"u{n}-{k}@x", "".join(rng.choices(pieces, k=rng.randrange(1, 4)))] for k in range(80)]
        with open(tmp_path / f"part-{n}.csv", "w", encoding="utf-8", newline="") as file:
            file.write("\ufeff" if n == 0 else "")
            csv.writer(file, lineterminator="\r\n" if n == 1 else "\n").writerows([["Email", "Note\nof two lines"], *rows])
        written += rows
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = demographics.read_demographics(spark, str(tmp_path))
        got = frame.orderBy("ordinal").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert frame.columns == ["Email", "Note\nof two lines", "ordinal"]
    assert [[r[0], r[1]] for r in got] == written


def test_an_export_without_files_or_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    assert demographics.read_demographics(spark, str(tmp_path)).count() == 0
    (tmp_path / "head.csv").write_text("Email,Name\n", encoding="utf-8")
    assert demographics.read_demographics(spark, str(tmp_path)).columns[:2] == ["Email", "Name"]


def test_shared_address_takes_the_highest_learner(spark, table, export):
    users = table("users", dict(user_id=3, email="ann@x"), dict(user_id=8, email="ANN@x"))
    matched, _ = demographics.match_demographics(demographics.read_demographics(spark, export), users)
    assert {r.user_id for r in matched.collect()} == {8}


def test_ids_are_unique_and_above_the_log(spark):
    frame = tables.with_ids(spark.range(100).repartition(5), "new_id", 41)
    ids = [r.new_id for r in frame.collect()]
    assert len(set(ids)) == 100 and min(ids) == 42


def test_run_log(spark, table):
    from datetime import datetime

    rows = runlog.run_row(spark, 2, datetime(2024, 1, 2, 3, 4, 5), None, "success", None, {"users": 7})
    runs = table("sync_runs", dict(run_id=1, started_at="2024-01-01", status="failed")).unionByName(rows)
    again = runlog.run_row(spark, 2, datetime(2024, 1, 2, 9, 0), None, "failed", "no", None, attempt=1)
    states = runlog.run_states(runs.unionByName(again))
    assert {(r.run_id, r.status, r.attempt) for r in states.collect()} == {(1, "failed", None), (2, "failed", 1)}
    assert tuple(runlog.last_run(runs.unionByName(again)).first()) == ("2024-01-02 09:00", "failed")
    assert tuple(runlog.last_run(runs).first()) == ("2024-01-02 03:04", "success") and rows.first().users_synced == 7
    counts = runlog.run_metrics({"a": spark.range(3), "b": spark.range(0)})
    assert {r.table_name: r.n_rows for r in counts.collect()} == {"a": 3, "b": 0}
