"""Bucketed commits, incremental signals, compacted logs."""

import random

import pytest
from pyspark.sql import functions as F

from studylantern.config import DEFAULT
from studylantern.operators import signals
from studylantern.operators.merge import rule_for, upsert
from studylantern.plans import incremental
from studylantern.sources import tables
from studylantern.sources.files import CommitConflict, Folder

AS_OF = "2024-01-31 00:00:00"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def files(frame):
    return set(frame.inputFiles())


def users(spark, ids, email="u"):
    return tables.conform(spark.createDataFrame([(i, f"{email}{i}@x") for i in ids], "user_id long, email string"), "users")


def test_an_unwritten_table_is_empty_and_versions_follow(spark, tmp_path):
    base = str(tmp_path)
    assert tables.load(spark, base, "users").count() == 0 and tables.commit(spark, base, "users").version == 0
    tables.replace(users(spark, [1]), base, "users")
    # reading the table while writing its next version
    tables.replace(tables.load(spark, base, "users").unionByName(users(spark, [2])), base, "users")
    assert tables.load(spark, base, "users").count() == 2
    assert tables.load(spark, base, "users", version=1).count() == 1
    # files that no commit names are not seen
    users(spark, [9]).write.parquet(f"{base}/users/data/lost/bucket=0")
    assert tables.load(spark, base, "users").count() == 2
    tables.replace(users(spark, []), base, "users")
    assert tables.load(spark, base, "users").count() == 0


def test_a_small_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    base = str(tmp_path)
    tables.replace(users(spark, range(4000)), base, "users", buckets=100)
    before = tables.load(spark, base, "users")
    first, old = files(before), tables.commit(spark, base, "users")
    tables.merge(users(spark, [17, 18, 5000], "new"), base, "users")
    now = tables.commit(spark, base, "users")
    moved = {b for b in range(100) if old.folders.get(b) != now.folders.get(b)}
    assert len(moved) <= 3 and moved == tables.changed(spark, base, "users", old.version)
    after = tables.load(spark, base, "users")
    kept = files(after) & first
    assert len(kept) >= len(first) - 3
    got = {r.user_id: r.email for r in after.collect()}
    assert len(got) == 4001 and got[17] == "new17@x" and got[5000] == "new5000@x" and got[16] == "u16@x"
    assert not Folder(spark, f"{base}/users").names("staged")


def test_a_table_may_be_created_with_its_number_of_buckets(spark, tmp_path):
    base = str(tmp_path)
    tables.create(spark, base, "users", 64)
    tables.merge(users(spark, range(200)), base, "users")
    at = tables.commit(spark, base, "users")
    assert at.buckets == 64 and len(at.folders) > 32 and tables.load(spark, base, "users").count() == 200
    with pytest.raises(CommitConflict):
        tables.create(spark, base, "users", 8)


def test_a_batch_that_touches_nothing_commits_nothing(spark, tmp_path):
    base = str(tmp_path)
    tables.merge(users(spark, []), base, "users")
    assert tables.commit(spark, base, "users").version == 0
    tables.replace(users(spark, [1]), base, "users")
    tables.merge(users(spark, []), base, "users")
    assert tables.commit(spark, base, "users").version == 1


def test_a_concurrent_commit_is_refused(spark, tmp_path):
    base = str(tmp_path)
    tables.replace(users(spark, [1]), base, "users")
    seen = tables.commit(spark, base, "users")
    tables.replace_buckets(users(spark, [2]), base, "users", seen, range(seen.buckets))
    with pytest.raises(CommitConflict):
        tables.replace_buckets(users(spark, [3]), base, "users", seen, range(seen.buckets))
    assert [r.user_id for r in tables.load(spark, base, "users").collect()] == [2]
    assert not [n for n in Folder(spark, f"{base}/users").names() if n.endswith(".draft")]


def test_merges_equal_upserts(spark, tmp_path):
    """Random batches with repeated keys and null attempts, against the operator over the whole table."""
    base, rule, ddl = str(tmp_path), rule_for("quiz_submissions"), "quiz_id long, user_id long, attempt int, quiz_submission_id long, score double, ordinal long"
    rng, plain = random.Random(1), tables.load(spark, base, "quiz_submissions")
    for night in range(3):
        batch = [(rng.randrange(3), rng.randrange(6), rng.choice([1, 2, None]), night * 100 + n, float(n), n) for n in range(40)]
        frame = spark.createDataFrame(batch, ddl)
        for c in rule.update:
            if c not in frame.columns:
                frame = frame.withColumn(c, F.lit(None).cast(tables.table_schema("quiz_submissions")[c].dataType))
        plain = spark.createDataFrame(upsert(plain, frame, rule, "ordinal").collect(), tables.TABLES["quiz_submissions"])
        tables.merge(frame, base, "quiz_submissions", ordinal="ordinal")
        assert rows(tables.load(spark, base, "quiz_submissions")) == rows(plain)


def test_old_versions_expire(spark, tmp_path):
    base = str(tmp_path)
    tables.replace(users(spark, range(50)), base, "users", buckets=8)
    for i in range(5):
        tables.merge(users(spark, [i], f"v{i}-"), base, "users")
    whole = rows(tables.load(spark, base, "users"))
    fourth = rows(tables.load(spark, base, "users", version=5))
    users(spark, [1]).write.parquet(f"{base}/users/data/running/bucket=0")
    assert tables.expire(spark, base, "users", keep=2) > 0
    assert rows(tables.load(spark, base, "users")) == whole and rows(tables.load(spark, base, "users", version=5)) == fourth
    folder = Folder(spark, f"{base}/users")
    assert folder.names("commits") == ["5.json", "6.json"] and folder.exists("data/running")
    assert tables.expire(spark, base, "users", keep=2, orphan_seconds=-1) == 1 and not folder.exists("data/running")
    assert rows(tables.load(spark, base, "users")) == whole
    assert tables.changed(spark, base, "users", 1) is None  # a forgotten version: everything counts as changed


def test_lookup_opens_one_bucket_and_pushes_the_filter(spark, tmp_path):
    base = str(tmp_path)
    tables.replace(users(spark, range(1000)), base, "users", buckets=16)
    found = tables.lookup(spark, base, "users", 77)
    assert [r.email for r in found.collect()] == ["u77@x"]
    assert len(files(found)) <= 2 < len(files(tables.load(spark, base, "users")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,77)" in plan


def flag_rows(spark, lows):
    return tables.conform(spark.createDataFrame([(low + n, n % 40) for low in lows for n in range(200)], "flag_id long, user_id long"), "flag_events")


def test_compacted_logs_keep_rows_and_batches(spark, tmp_path):
    base = str(tmp_path)
    for k in range(4):
        tables.append(flag_rows(spark, [1000 * k]), base, "flag_events", f"b{k}")
    before = rows(tables.load_log(spark, base, "flag_events"))
    tables.compact(spark, base, "flag_events")
    assert rows(tables.load_log(spark, base, "flag_events")) == before
    assert tables.batches(spark, base, "flag_events") == ["b0", "b1", "b2", "b3"]
    tables.append(flag_rows(spark, [0]), base, "flag_events", "b2")  # a committed batch stays as it is
    tables.append(flag_rows(spark, [9000]), base, "flag_events", "b9")
    assert tables.load_log(spark, base, "flag_events").count() == 1000
    assert tables.load_log(spark, base, "flag_events", except_batch="b1").count() == 800
    assert tables.load_log(spark, base, "flag_events", except_batch="b9").count() == 800
    assert tables.load_log(spark, base, "flag_events", only_batch="b1").agg(F.min("flag_id")).first()[0] == 1000
    assert tables.load_log(spark, base, "flag_events", only_batch="b9").count() == 200
    one = tables.load_log(spark, base, "flag_events", key=7)
    folded = [f for f in files(one) if "/data/" in f]
    assert one.count() == 25 and len(folded) <= 4 and len({f.split("/bucket=")[1].split("/")[0] for f in folded}) == 1
    tables.compact(spark, base, "flag_events", least=1)
    assert tables.expire_batches(spark, base, "flag_events") == 0
    assert tables.expire_batches(spark, base, "flag_events", older_than=-1) == 5
    assert tables.load_log(spark, base, "flag_events").count() == 1000 and len(tables.batches(spark, base, "flag_events")) == 5
    tables.expire(spark, base, "flag_events", keep=1)
    assert tables.load_log(spark, base, "flag_events").count() == 1000


def signal_rows(frame):
    return rows(frame.drop("computed_at"))


def test_incremental_signals_equal_a_full_run(spark, table, tmp_path):
    base, rng = str(tmp_path), random.Random(3)
    tables.replace(users(spark, range(30)), base, "users")
    tables.replace(table("gate_calendar", dict(gate_id=1, gate_name="g", gate_date=None)), base, "gate_calendar")
    tables.replace(table("student_summaries", *[dict(user_id=u, page_views=u, max_page_views=40) for u in range(25)]), base, "student_summaries")

    def full():
        names = ("users", "submissions", "enrollments", "student_summaries", "gate_calendar")
        return signals.risk_signals(*[tables.load(spark, base, n) for n in names], AS_OF)

    counter = 0
    for night in range(4):
        work = []
        for _ in range(60 if night == 0 else 4):
            counter += 1
            day = rng.randrange(1, 28)
            work.append(dict(submission_id=counter, assignment_id=rng.randrange(20), user_id=rng.randrange(30),
                             submitted_at=f"2024-01-{day:02d} 10:00:00", days_from_deadline=rng.choice([None, round(rng.uniform(-9, 9), 2)])))
        seen = {}
        for r in work:
            seen[r["assignment_id"], r["user_id"]] = r
        tables.merge(table("submissions", *seen.values()), base, "submissions")
        courses = {rng.randrange(60): None for _ in range(40 if night == 0 else 3)}
        tables.merge(
            table("enrollments", *[dict(enrollment_id=e, user_id=e % 28, final_score=float(rng.randrange(101)), last_activity_at=f"2024-01-{rng.randrange(1, 28):02d} 00:00:00") for e in courses]),
            base, "enrollments")
        timing_before = tables.commit(spark, base, "learner_timing")
        got = incremental.refreshed_signals(spark, base, AS_OF)
        assert signal_rows(got) == signal_rows(full())
        if night:
            timing = tables.commit(spark, base, "learner_timing")
            assert sum(timing_before.folders.get(b) != f for b, f in timing.folders.items()) <= 4
    again = tables.commit(spark, base, "learner_timing").version
    incremental.refreshed_signals(spark, base, AS_OF)
    assert tables.commit(spark, base, "learner_timing").version == again  # nothing changed, nothing written
    for _ in range(4):
        tables.merge(table("submissions", dict(submission_id=1, assignment_id=1, user_id=1)), base, "submissions")
    tables.expire(spark, base, "submissions", keep=1)
    assert signal_rows(incremental.refreshed_signals(spark, base, AS_OF)) == signal_rows(full())


def test_a_refresh_reads_only_touched_buckets(spark, table, tmp_path, monkeypatch):
    base, read = str(tmp_path), []
    many = [dict(submission_id=u, assignment_id=1, user_id=u, submitted_at="2024-01-02 10:00:00", days_from_deadline=1.0) for u in range(300)]
    tables.replace(table("submissions", *many), base, "submissions")
    incremental.refresh_timing(spark, base)
    tables.merge(table("submissions", dict(submission_id=1, assignment_id=2, user_id=5, days_from_deadline=2.0)), base, "submissions")
    kept = signals.timing_halves
    monkeypatch.setattr(signals, "timing_halves", lambda df, cfg=DEFAULT: (read.append(len(df.inputFiles())), kept(df, cfg))[1])
    assert len(incremental.refresh_timing(spark, base)) == 1
    assert read == [len(tables.load(spark, base, "submissions", [tables._bucket_of_value(spark, "submissions", 8, 5)]).inputFiles())] and tables.load(spark, base, "learner_timing").count() == 300
