"""Shape of the physical plans: what is shuffled, what is broadcast, what reaches the scan."""

import re

import pytest
from pyspark.sql import functions as F

from studylantern.catalog.inputs import Inputs
from studylantern.operators import drafts, flags, lifecycle, signals
from studylantern.plans import reports
from studylantern.sources import feeds, tables


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, data_dir, tmp_path_factory):
    """Inputs written out as tables, so that plans start at plain scans."""
    base = tmp_path_factory.mktemp("tables")
    inputs = Inputs(spark, data_dir)
    names = ("in_users", "in_submissions", "in_enrollments", "in_summaries", "in_gates", "in_flags", "in_nudges", "in_assignments")
    for name in names:
        inputs[name].write.parquet(str(base / name))
    return {name: spark.read.parquet(str(base / name)) for name in names}


@pytest.fixture
def no_broadcast(spark):
    """Plan as if every table were large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_one_row_sides_are_cross_joined(stored, no_broadcast):
    frame = signals.risk_signals(
        stored["in_users"], stored["in_submissions"], stored["in_enrollments"], stored["in_summaries"], stored["in_gates"], "2024-01-31"
    )
    text = plan(frame)
    assert text.count("BroadcastNestedLoopJoin") == 2
    # besides the two one-row values only the bounded lists of hot learners are broadcast
    assert text.count("BroadcastExchange IdentityBroadcastMode") == 2
    tables = len(re.findall(r"SortMergeJoin \[user_id", text))
    assert tables >= 3


def test_ranked_submissions_are_shuffled_once(spark, stored, no_broadcast):
    text = plan(signals._halves_by_rank(signals._timed(stored["in_submissions"])))
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<user_id:bigint,submitted_at:timestamp,days_from_deadline:double>" in text
    assert "IsNotNull(days_from_deadline)" in text


def test_hot_list_reads_one_column(stored):
    text = plan(signals.hot_learners(stored["in_submissions"]))
    assert "ReadSchema: struct<user_id:bigint>" in text and "partial_count" in text


def test_rules_are_one_pass(stored, no_broadcast):
    columns = "user_id long, avg_days_from_deadline double, timing_trend string, days_since_last_login int, total_submissions int, " \
              "zero_submissions int, engagement_ratio double, gate_approaching int, gate_name string, days_until_gate int"
    empty = stored["in_users"].sparkSession.createDataFrame([], columns)
    text = plan(flags.evaluate_rules(flags.rule_input(empty, stored["in_enrollments"])))
    assert len(re.findall(r"Generate inline", text)) == 1 and "Union" not in text
    assert "PushedFilters" in text and "GreaterThan(final_score,0.0)" in text


def test_suppression_is_an_equi_anti_join(stored, no_broadcast):
    new = stored["in_nudges"].select("user_id", "flag_code")
    text = plan(flags.dedupe_new_flags(new, stored["in_flags"]))
    assert re.search(r"SortMergeJoin \[user_id#\d+L?, flag_code#\d+\], \[user_id#\d+L?, flag_code#\d+\], LeftAnti", text)


def test_drill_down_filter_reaches_the_scan(stored):
    text = plan(reports.submission_timeline(stored["in_submissions"], stored["in_assignments"], 7))
    assert "EqualTo(user_id,7)" in text
    assert "workflow_state" in text and "graded_at" not in text


def test_queue_moves_wide_columns_for_pending_rows_only(stored, no_broadcast):
    from studylantern.operators.lifecycle import pending_drafts

    text = plan(pending_drafts(stored["in_nudges"]))
    scans = re.findall(r"ReadSchema: (struct<.*?>)", text)
    assert "struct<nudge_id:bigint,draft_id:string>" in scans
    assert "EqualTo(delivery_status,pending_review)" in text


def test_first_per_key_is_cut_before_the_exchange(stored, no_broadcast):
    from studylantern.operators.merge import dedupe_keep_first

    text = plan(dedupe_keep_first(stored["in_gates"], ["gate_name"], "gate_id"))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


@pytest.fixture
def tiny_skew_limits(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
        # tiny map outputs would be merged into one, which leaves nothing to split
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def skewed(spark):
    """A third of 30,000 rows share one key."""
    def build(*columns):
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).cast("long")
        return spark.range(0, 30_000, 1, 8).select(F.col("id"), hot.alias("key")).selectExpr(*columns)

    return build


def split_by_spark(frame):
    rows = frame.count()
    frame.collect()
    assert "skew=true" in plan(frame)
    return rows


def test_skewed_assignment_is_split(spark, skewed, tiny_skew_limits):
    feed = skewed(
        "id", "key as assignment_id", "id as user_id", "1.0D as score", "'g' as grade", "'2024-01-01T00:00:00Z' as submitted_at",
        "cast(null as string) as graded_at", "'w' as workflow_state", "true as late", "false as missing",
    )
    due = spark.range(2000).selectExpr("id as assignment_id", "timestamp '2024-01-02' as due_at_roadmap")
    # id 0 is the excluded zero key
    assert split_by_spark(feeds.submissions_from_feed(feed, due, "2024-01-31")) == feed.filter("assignment_id <> 0 and user_id <> 0 and user_id <> 27815").count()


def test_skewed_enrollments_are_split(spark, table, skewed, tiny_skew_limits):
    courses = skewed(
        "id as enrollment_id", "key as user_id", "50.0D as final_score", "timestamp '2024-01-01' as last_activity_at", "60 as total_activity_time"
    )
    users = spark.range(2500).selectExpr("id as user_id")
    frame = reports.cohort_base(users, table("student_risk_signals"), courses, table("student_summaries"))
    assert split_by_spark(frame) == 30_000 + 500


def test_skewed_candidates_are_split(spark, table, skewed, tiny_skew_limits):
    candidates = skewed("id as flag_id", "key as user_id", "'R1' as flag_code", "concat('R1: ', repeat('x', 40), id) as reason")
    users = spark.range(2000).selectExpr("id as user_id")
    frame = drafts.nudge_context(candidates, users, table("student_risk_signals"), table("enrollments"))
    assert split_by_spark(frame) == 30_000


def test_skewed_decisions_are_split_and_one_wins(spark, table, skewed, tiny_skew_limits):
    decisions = skewed(
        "id as decision_id", "cast(key as string) as draft_id", "'approve' as action", "concat('rev', repeat('x', 20), id) as reviewer_id",
        "cast(null as string) as notes", "timestamp '2024-01-30' as decided_at",
    )
    events = spark.range(2000).selectExpr(
        "id as nudge_id", "cast(id as string) as draft_id", "id as user_id", "'pending_review' as delivery_status",
        "timestamp '2024-01-01' as created_at",
    )
    log = tables.conform(events, "nudge_events")
    none = spark.createDataFrame([], "draft_id string, ok boolean, message_id string, error string")
    pii = spark.range(2000).selectExpr("id as user_id")
    rows, rejects = lifecycle.apply_decisions(log, decisions, none, pii, "2024-01-31")
    drafts_named = decisions.select("draft_id").distinct().count()
    assert rows.count() == drafts_named
    assert split_by_spark(rejects) == 30_000 - drafts_named


def test_skewed_queue_is_split(spark, table, skewed, tiny_skew_limits):
    nudges = tables.conform(
        skewed("id as nudge_id", "cast(id as string) as draft_id", "key as user_id", "'R1' as flag_code", "'pending_review' as delivery_status",
               "'late_submission' as nudge_type", "md5(cast(id as string)) as html_body", "timestamp '2024-01-01' as created_at"),
        "nudge_events",
    )
    events = tables.conform(
        spark.range(2000).selectExpr("id as flag_id", "id as user_id", "'red' as flag_type", "'R1: x' as reason", "0 as resolved",
                                     "timestamp '2024-01-01' as flagged_at"),
        "flag_events",
    )
    assert split_by_spark(reports.approval_queue(nudges, events, table("student_risk_signals"), ordered=False)) == 30_000


def test_skewed_open_flags_are_split(spark, table, skewed, tiny_skew_limits):
    events = tables.conform(
        skewed("id as flag_id", "key as user_id", "'red' as flag_type", "concat('R1: ', repeat('x', 40), id) as reason", "0 as resolved"), "flag_events"
    )
    nudges = tables.conform(spark.range(1000, 3000).selectExpr("id as nudge_id", "id as user_id", "'R1' as flag_code"), "nudge_events")
    frame = drafts.flags_without_drafts(events, nudges)
    assert split_by_spark(frame) == events.filter("user_id < 1000").count()


def test_latest_state_aggregates_keys_only(spark):
    """The winners come from fixed-width buffers; message columns meet them in one semi-join."""
    from studylantern.operators import lifecycle

    log = tables.conform(spark.range(100).selectExpr("id as nudge_id", "cast(id % 9 as string) as draft_id"), "nudge_events")
    for frame in (lifecycle.latest_state(log), lifecycle.latest_by_id(log)):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "LeftSemi" in text
        assert all("html_body" not in line for line in text.splitlines() if "Aggregate" in line)


def test_numbered_batches_settle_in_hash_aggregates(spark):
    from studylantern.operators import merge

    rule = merge.rule_for("submissions")
    batch = tables.conform(spark.range(100).selectExpr("id as submission_id", "id % 7 as assignment_id", "id % 3 as user_id"), "submissions")
    for kind in ("long", "decimal(38,0)"):
        settled = merge.settle_batch(batch.withColumn("ordinal", F.col("submission_id").cast(kind)), rule, "ordinal")
        text = settled._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and text.count("LeftSemi") == 2
        assert all("workflow_state" not in line for line in text.splitlines() if "Aggregate" in line)
    assert settled.count() == 21
