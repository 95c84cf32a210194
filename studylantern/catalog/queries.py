"""The registered queries: name -> DataFrame over one scale folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from studylantern.catalog import feed_frames as feed
from studylantern.catalog.inputs import AS_OF, MERGE_TABLES, Inputs
from studylantern.config import DEFAULT, DELIVERY_STATUSES, CHANNELS, FLAG_CODES, NUDGE_TYPES
from studylantern.operators import checks, delivery, drafts, flags, lifecycle, merge, signals
from studylantern.plans import incremental, nightly, reports
from studylantern.session import prepare, scratch
from studylantern.sources import demographics, dims, feeds, runlog, tables

Query = Callable[[Inputs], DataFrame]
CFG = replace(DEFAULT, ta_recipients="first@example.org, ,second@example.org", test_learner_id=13)
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _signals(p: Inputs) -> DataFrame:
    return signals.risk_signals(p.in_users, p.in_submissions, p.in_enrollments, p.in_summaries, p.in_gates, AS_OF)


def _routed(p: Inputs) -> DataFrame:
    return drafts.route_flags(drafts.flags_without_drafts(p.in_flags, p.in_nudges))[0]


def _context(p: Inputs) -> DataFrame:
    return drafts.nudge_context(_routed(p), p.in_users, _signals(p), p.in_enrollments)


def _decided(p: Inputs) -> tuple[DataFrame, DataFrame]:
    return lifecycle.apply_decisions(p.in_nudges, p.in_decisions, p.in_outcomes, p.in_pii, AS_OF, CFG)


# --- signals ------------------------------------------------------------------
@query
def timing_stats(p):
    return signals.timing_stats(p.in_submissions)


@query
def timing_trend(p):
    return signals.timing_trend(p.in_submissions)


@query
def timing_trend_orders(p):
    return signals.timing_trend(p.in_line_timing)


@query
def timing_trend_hot_orders(p):
    # a low limit sends every larger customer through the refinement branch
    return signals.timing_trend(p.in_line_timing, replace(CFG, hot_learner_rows=40))


@query
def course_max_views(p):
    return signals.course_max_views(p.in_summaries)


@query
def next_gate(p):
    return signals.next_gate(p.in_gates, AS_OF)


@query
def primary_enrollment(p):
    return signals.primary_enrollment(p.in_enrollments)


@query
def risk_signals(p):
    return _signals(p)


# --- flags ----------------------------------------------------------------------
def _single_rule(code: str) -> Query:
    def run(p: Inputs) -> DataFrame:
        return flags.evaluate_rules(flags.rule_input(_signals(p), p.in_enrollments), codes=(code,))

    return run


for _code in FLAG_CODES:
    REGISTRY[f"flag_{_code.lower()}"] = _single_rule(_code)


@query
def run_flags(p):
    return flags.run_flags(_signals(p), p.in_enrollments, p.in_flags, AS_OF)


@query
def flag_counts(p):
    return flags.flag_counts(flags.run_flags(_signals(p), p.in_enrollments, p.in_flags, AS_OF))


@query
def dedupe_new_flags(p):
    # every learner against every code, so that each suppression shows
    codes = F.array(*[F.lit(c) for c in FLAG_CODES])
    return flags.dedupe_new_flags(p.in_users.select("user_id", F.explode(codes).alias("flag_code")), p.in_flags)


@query
def worst_open_flag(p):
    return flags.worst_open_flag(p.in_flags)


@query
def latest_open_flag(p):
    return flags.latest_open_flag(p.in_flags).filter(F.col("flag_code").isNotNull())


# --- merges ---------------------------------------------------------------------
def _merge(table: str, small_batch: bool = False) -> Query:
    def run(p: Inputs) -> DataFrame:
        return merge.upsert(
            p[f"stored_{table}"], p[f"batch_{table}"], merge.rule_for(table), "ordinal", small_batch=small_batch
        )

    return run


for _table in MERGE_TABLES:
    REGISTRY[f"upsert_{_table}"] = _merge(_table)
REGISTRY["upsert_submissions_small_batch"] = _merge("submissions", small_batch=True)


@query
def upsert_gate_calendar(p):
    stored = p.in_gates.filter(F.col("gate_date") < F.lit("2024-01-16").cast("date"))
    return merge.insert_missing(stored, p.in_gate_rows.withColumn("ordinal", F.col("gate_id")), ["gate_name"], "ordinal")


@query
def dedupe_keep_first(p):
    return merge.dedupe_keep_first(p.in_gate_rows, ["gate_name"], "gate_id")


# --- feeds ----------------------------------------------------------------------
@query
def users_from_feed(p):
    return feeds.users_from_feed(feed.users(p), AS_OF, CFG)


@query
def assignments_from_feed(p):
    shifted = {k - 3300: v for k, v in dims.DEADLINES.items()}
    return feeds.assignments_from_feed(feed.assignments(p), dims.deadline_dim(p.spark, shifted), AS_OF, CFG)


@query
def enrollments_from_feed(p):
    return feeds.enrollments_from_feed(feed.enrollments(p), CFG)


@query
def summaries_from_feed(p):
    return feeds.summaries_from_feed(feed.summaries(p), AS_OF, CFG)


@query
def submissions_from_feed(p):
    return feeds.submissions_from_feed(feed.submissions(p), p.in_assignments, AS_OF, CFG)


@query
def quizzes_from_feed(p):
    return feeds.quizzes_from_feed(feed.quizzes(p), AS_OF, CFG)


@query
def quiz_submissions_from_feed(p):
    return feeds.quiz_submissions_from_feed(feed.quiz_submissions(p), AS_OF, CFG)


@query
def activity_from_feed(p):
    return feeds.activity_from_feed(feed.activity(p))


def _export(p: Inputs) -> DataFrame:
    renamed = {"field_of_study": "Field of Study", "country": "Person Country of origin"}
    return p.in_demographics.withColumnsRenamed(renamed)


@query
def match_demographics(p):
    matched, _ = demographics.match_demographics(_export(p), p.in_users)
    return matched.select("user_id", F.col("Name").alias("name"), "ordinal")


@query
def skipped_demographics(p):
    _, skipped = demographics.match_demographics(_export(p), p.in_users)
    return skipped.select("ordinal", "skip_reason")


@query
def student_pii_rows(p):
    matched, _ = demographics.match_demographics(_export(p), p.in_users)
    return demographics.split_pii(matched, AS_OF)[0]


@query
def student_demographics_rows(p):
    matched, _ = demographics.match_demographics(_export(p), p.in_users)
    return demographics.split_pii(matched, AS_OF)[1]


@query
def run_metrics(p):
    matched, skipped = demographics.match_demographics(_export(p), p.in_users)
    return runlog.run_metrics(
        {
            "users": p.in_users, "submissions": p.in_submissions, "enrollments": p.in_enrollments,
            "demographics_loaded": matched, "demographics_skipped": skipped,
        }
    )


@query
def last_run(p):
    return runlog.last_run(p.in_runs)


@query
def run_states(p):
    return runlog.run_states(p.in_runs)


# --- stored tables: written to the shared folder and read back ----------------------
LEARNER = 7
_LOG = ("nudge_id", "draft_id", "user_id", "flag_code", "delivery_status", "subject", "created_at")


def _pages(p: Inputs) -> DataFrame:
    """Events landed as JSON pages, one a line; every tenth record has a text where a number belongs."""
    base = scratch(p.spark)
    number = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no. "), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    record = F.regexp_replace(F.to_json(F.struct(F.col("event_id").alias("id"), number.alias("user_id"), "value")), '"([0-9]+)"', "$1")
    page = F.concat(F.lit("["), F.concat_ws(",", F.collect_list(record)), F.lit("]"))
    p.events.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(page.alias("value")).select("value").write.text(base)
    return feeds.parse_pages(p.spark, base, "id long, user_id long, value double", page_per_line=True)


@query
def page_records(p):
    return feeds.records_of(_pages(p)).drop(feeds.ORDINAL)


@query
def page_rejects(p):
    record = F.from_json("record", "id long, user_id string, value double")
    rows = feeds.rejects_of(_pages(p)).select(record.alias("r")).select("r.*")
    return rows.select("id", F.regexp_extract("user_id", "([0-9]+)", 1).cast("long").alias("user_id"), "value")


def _merged(p: Inputs) -> str:
    base = scratch(p.spark)
    tables.replace(tables.conform(p.stored_submissions, "submissions"), base, "submissions")
    tables.merge(p.batch_submissions, base, "submissions", ordinal="ordinal")
    return base


@query
def stored_merge(p):
    return tables.load(p.spark, _merged(p), "submissions")


@query
def stored_learner(p):
    return tables.lookup(p.spark, _merged(p), "submissions", LEARNER)


@query
def stored_signals(p):
    """Two nights: the parts are built from some of the facts and brought up to date with the rest."""
    base = scratch(p.spark)
    for name, rows in (("users", p.in_users), ("student_summaries", p.in_summaries), ("gate_calendar", p.in_gates)):
        tables.replace(tables.conform(rows, name), base, name)
    night = None
    for late in (False, True):
        for name, rows in (("submissions", p.in_submissions), ("enrollments", p.in_enrollments)):
            tables.merge(rows.filter((F.col("user_id") % 5 == 0) == late), base, name)
        night = incremental.refreshed_signals(p.spark, base, AS_OF, CFG)
    return night.drop("computed_at")


def _compacted(p: Inputs) -> str:
    base, log = scratch(p.spark), tables.conform(p.in_nudges, "nudge_events")
    for part in range(4):
        if part == 3:
            tables.compact(p.spark, base, "nudge_events")
        tables.append(log.filter(F.col("nudge_id") % 4 == part), base, "nudge_events", f"batch-{part}")
    return base


@query
def stored_log(p):
    return tables.load_log(p.spark, _compacted(p), "nudge_events").select(*_LOG)


@query
def stored_log_learner(p):
    return tables.load_log(p.spark, _compacted(p), "nudge_events", key=LEARNER).select(*_LOG)


@query
def seeded_gates(p):
    base = scratch(p.spark)
    for rows in (p.in_gates.filter("gate_id % 2 = 0"), p.in_gates):
        nightly.seed_gates(p.spark, base, rows.select("gate_name", "week_number", "gate_date", "description"))
    return tables.load(p.spark, base, "gate_calendar").drop("gate_id")


# --- drafts ---------------------------------------------------------------------
@query
def flags_without_drafts(p):
    return drafts.flags_without_drafts(p.in_flags, p.in_nudges)


@query
def route_flags(p):
    return _routed(p)


@query
def unrouted_flags(p):
    # order status letters are codes without a route
    rows = p.orders.select("o_orderkey", F.col("o_orderstatus").alias("flag_code"))
    return drafts.route_flags(rows)[1].groupBy("flag_code").agg(F.count(F.lit(1)).alias("n_flags"))


@query
def nudge_context(p):
    return _context(p).select(
        "flag_id", "user_id", "flag_code", *[F.col(f"specific.{n}").alias(n) for n in drafts.SPECIFIC]
    )


@query
def render_drafts(p):
    return drafts.render_drafts(_context(p)).select("flag_id", "user_id", "rendered_template", "html_body", "subject")


@query
def generate_drafts(p):
    rows = drafts.generate_drafts(p.in_flags, p.in_nudges, p.in_users, _signals(p), p.in_enrollments, AS_OF)
    return rows.select("draft_id", "user_id", "nudge_type", "flag_code", "template_id", "channel", "delivery_status", "created_at")


# --- lifecycle --------------------------------------------------------------------
_STATE = ("draft_id", "nudge_id", "user_id", "flag_code", "delivery_status", "created_at")


@query
def latest_state(p):
    return lifecycle.latest_state(p.in_nudges).select(*_STATE)


@query
def latest_by_id(p):
    return lifecycle.latest_by_id(p.in_nudges).select(*_STATE)


@query
def status_counts(p):
    return lifecycle.status_counts(p.in_nudges)


@query
def apply_decisions(p):
    return _decided(p)[0].select(
        "draft_id", "user_id", "flag_code", "delivery_status", "subject", "reviewer_id", "review_notes",
        "provider_message_id", "delivered_at", "created_at", "step",
    )


@query
def decision_rejects(p):
    return _decided(p)[1]


@query
def ta_briefings(p):
    handed_over = p.in_nudges.filter(F.col("delivery_status") == "escalated")
    latest = lifecycle.latest_by_id(handed_over)
    rows, _ = delivery.ta_briefings(latest, p.in_users, _signals(p), p.in_enrollments, p.in_outcomes, AS_OF, CFG)
    return rows.select(
        "draft_id", "user_id", "nudge_type", "flag_code", "delivery_status", "subject", "html_body", "reviewer_id",
        "review_notes", "provider_message_id", "step",
    )


@query
def record_outcomes(p):
    return lifecycle.record_outcomes(p.in_nudges, p.in_outcomes, AS_OF).select(
        "draft_id", "user_id", "flag_code", "delivery_status", "subject", "reviewer_id", "review_notes",
        "provider_message_id", "delivered_at", "created_at",
    )


@query
def briefing_failures(p):
    """Learners without contact details stand for those without a user row."""
    latest = lifecycle.latest_by_id(p.in_nudges.filter(F.col("delivery_status") == "escalated"))
    return delivery.ta_briefings(latest, p.in_pii, _signals(p), p.in_enrollments, p.in_outcomes, AS_OF, CFG)[1]


@query
def outbox(p):
    return delivery.outbox(p.in_nudges.filter(F.col("delivery_status") == "approved"), p.in_pii)


def _variant_wishes(p: Inputs) -> DataFrame:
    """One message per order; some ask for a letter, some for an unknown letter or kind."""
    key = F.col("o_orderkey")
    return p.orders.select(
        key,
        F.when(key % 10 == 9, "unknown_kind").otherwise("late_sub").alias("flag_type"),
        F.when(key % 4 == 0, "a").when(key % 4 == 1, "z").alias("wanted"),
    )


@query
def assign_variant(p):
    return delivery.assign_variant(_variant_wishes(p), "o_orderkey", requested="wanted")[0]


@query
def variant_rejects(p):
    return delivery.assign_variant(_variant_wishes(p), "o_orderkey", requested="wanted")[1]


@query
def late_notices(p):
    return delivery.late_notices(p.in_submissions, p.in_assignments, variant=None)


# --- reports ----------------------------------------------------------------------
@query
def cohort_base(p):
    return reports.cohort_base(p.in_users, _signals(p), p.in_enrollments, p.in_summaries)


@query
def cohort_overview(p):
    return reports.cohort_overview(p.in_users, _signals(p), p.in_enrollments, p.in_summaries, p.in_flags)


@query
def cohort_kpis(p):
    return reports.cohort_kpis(p.in_users, p.in_enrollments, p.in_flags)


@query
def engagement_scatter(p):
    return reports.engagement_scatter(p.in_users, p.in_summaries, _signals(p))


@query
def learner_list(p):
    return reports.learner_list(p.in_users)


@query
def submission_timeline(p):
    return reports.submission_timeline(p.in_submissions, p.in_assignments)


@query
def quiz_history(p):
    return reports.quiz_history(p.in_quiz_submissions, p.in_quizzes)


@query
def enrollment_detail(p):
    return reports.enrollment_detail(p.in_enrollments)


@query
def signal_detail(p):
    return reports.signal_detail(_signals(p))


@query
def flag_detail(p):
    return reports.flag_detail(p.in_flags)


@query
def flag_detail_of_learner(p):
    base = scratch(p.spark)
    for part in range(2):
        rows = p.in_flags.filter(F.col("flag_id") % 2 == part)
        tables.append(tables.conform(rows, "flag_events"), base, "flag_events", f"batch-{part}")
    tables.compact(p.spark, base, "flag_events")
    return reports.flag_detail(tables.load_log(p.spark, base, "flag_events", key=LEARNER), LEARNER)


@query
def flag_log(p):
    return reports.flag_log(p.in_flags, ("red", "yellow"), " [13579]$ ")


@query
def flag_log_kpis(p):
    return reports.flag_log_kpis(reports.flag_log(p.in_flags, (), "", ordered=False))


@query
def approval_queue(p):
    return reports.approval_queue(p.in_nudges, p.in_flags, _signals(p))


@query
def queue_kpis(p):
    return reports.queue_kpis(reports.approval_queue(p.in_nudges, p.in_flags, _signals(p), ordered=False))


@query
def audit_log(p):
    return reports.audit_log(p.in_nudges)


@query
def audit_log_sent(p):
    return reports.audit_log(p.in_nudges, "sent", 50)


@query
def signals_report(p):
    return reports.signals_report(_signals(p))


# --- integrity checks ---------------------------------------------------------------
@query
def check_unique(p):
    return checks.check_unique(p.lineitem, ["l_orderkey", "l_linenumber"])


@query
def check_fk(p):
    return checks.check_fk(p.in_quiz_submissions, "quiz_id", p.in_quizzes, "quiz_id")


@query
def check_domain(p):
    bad = [
        checks.check_domain(p.in_nudges, col, values).select("nudge_id", F.lit(col).alias("column_name"), F.col(col).alias("value"))
        for col, values in (("channel", CHANNELS), ("nudge_type", NUDGE_TYPES), ("delivery_status", DELIVERY_STATUSES))
    ]
    return bad[0].unionByName(bad[1]).unionByName(bad[2])


@query
def check_not_null(p):
    return checks.check_not_null(p.in_nudges, ["nudge_id", "draft_id", "reviewer_id", "delivered_at", "review_notes"])


def plain(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and text dates, so that results compare as they read."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, TimestampType):
            changed[field.name] = F.col(f"`{field.name}`").cast("timestamp_ntz")
        elif isinstance(field.dataType, DateType):
            changed[field.name] = F.col(f"`{field.name}`").cast("string")
    return df.withColumns(changed) if changed else df


def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(fn(Inputs(prepare(spark), folder)))

    return run
