"""Learning-platform shaped inputs derived from the driver tables.

Each input is one SELECT in the common subset of Spark SQL and DuckDB, with
``{name}`` for a driver table or another input; :class:`Dialect` covers the few
differences. Spark gets them as DataFrames, the reference SQL as CTEs, so both
sides start from the same rows. All inputs grow with the tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from studylantern.schemas import TABLES

AS_OF = "2024-01-31 00:00:00"
TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
_REF = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Dialect:
    name: str

    def rnd(self, expr: str, digits: int) -> str:
        if self.name == "spark":
            # the same two ways as functions.py_round
            unit = f"{10**digits}D"
            scaled = f"({expr}) * {unit}"
            return (
                f"case when abs({scaled}) < 1e9D and abs({scaled} - rint({scaled})) < 0.499999D "
                f"then rint({scaled}) / {unit} else cast(format_number({expr}, '0.{'0' * digits}') as double) end"
            )
        return f"cast(printf('%.{digits}f', {expr}) as double)"

    def iso(self, expr: str) -> str:
        if self.name == "spark":
            return f"date_format({expr}, 'yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'')"
        return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")
_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
_NULL_TS = "cast(null as timestamp)"
_NULL_S = "cast(null as string)"


def definitions(d: Dialect) -> dict[str, str]:
    """Name -> SELECT text."""
    code_slot = "cast(floor(event_id / 7) as bigint) % 10"
    code = (
        f"case {code_slot} when 0 then 'R1' when 1 then 'R2' when 2 then 'R3' when 3 then 'Y1' when 4 then 'Y1b' "
        "when 5 then 'Y2' when 6 then 'Y3' when 7 then 'Y4' end"
    )
    nudge_code = (
        "case event_id % 8 when 0 then 'R1' when 1 then 'R2' when 2 then 'R3' when 3 then 'Y1' when 4 then 'Y1b' "
        "when 5 then 'Y2' when 6 then 'Y3' else 'Y4' end"
    )
    # two of the eight drafts of a learner carry no code, so flags of these codes still lack a draft
    drafted_code = f"case when (user_id + event_id) % 4 <> 0 then {nudge_code} end"
    nudge_kind = (
        "case event_id % 8 when 0 then 'reengagement' when 1 then 'late_submission' when 2 then 'gate_ahead' "
        "when 3 then 'reengagement' when 4 then 'activity_no_work' when 7 then 'score_dropping' "
        "else 'late_submission' end"
    )
    return {
        "in_users": f"""
            select distinct user_id, 'user' || user_id || '@example.org' as email, {_NULL_S} as sis_user_id,
                   {_NULL_S} as login_id, {_NULL_TS} as updated_at
            from {{events}}""",
        "in_assignments": f"""
            select cast(k as bigint) as assignment_id, cast(829 as bigint) as course_id,
                   'Assignment ' || k as name, {_NULL_TS} as due_at, cast(100 as double) as points_possible,
                   timestamp '2024-01-02 23:59:00' + interval '1' day * ((k * 3) % 28) as due_at_roadmap,
                   {_NULL_TS} as updated_at
            from (select distinct {_K} % 20 as k from {{events}}) x
            where k < 19""",
        # purchases are submissions; assignment 19 has no deadline, higher user_id % 5 leaves more of them unsubmitted
        "in_submitted": f"""
            select min(event_id) as submission_id, cast({_K} % 20 as bigint) as assignment_id, user_id,
                   min(case when value > 40 * (user_id % 5) then ts end) as submitted_at,
                   {d.rnd('max(least(value, 100.0))', 1)} as score
            from {{events}}
            where event_type = 'purchase'
            group by {_K} % 20, user_id""",
        "in_submissions": f"""
            select s.submission_id, s.assignment_id, s.user_id, s.score, {_NULL_S} as grade, s.submitted_at,
                   {_NULL_TS} as graded_at,
                   case when s.submitted_at is null then 'unsubmitted' else 'submitted' end as workflow_state,
                   case when a.due_at_roadmap < s.submitted_at then 1 else 0 end as late, 0 as missing,
                   {d.rnd(_days(d, 'a.due_at_roadmap', 's.submitted_at'), 2)} as days_from_deadline,
                   {_NULL_TS} as updated_at
            from {{in_submitted}} s left join {{in_assignments}} a on a.assignment_id = s.assignment_id""",
        "in_course_rows": f"""
            select user_id,
                   max(ts) filter (where event_type = 'error' and value > 90) as last_activity_at,
                   cast(count(*) * 1234 as int) as total_activity_time,
                   max(case when event_type = 'signup' then case when value > 150 then 100.0
                       else {d.rnd('value', 1)} end end) as final_score,
                   {d.rnd("min(case when event_type = 'signup' then value end)", 1)} as low_mark
            from {{events}} group by user_id""",
        # every seventh learner is enrolled twice
        "in_enrollments": """
            select user_id as enrollment_id, cast(829 as bigint) as course_id, user_id, 'active' as enrollment_state,
                   last_activity_at, total_activity_time, low_mark as current_score, cast(final_score as double) as final_score
            from {in_course_rows}
            union all
            select user_id + 100000000 as enrollment_id, cast(829 as bigint) as course_id, user_id, 'active' as enrollment_state,
                   last_activity_at, total_activity_time, low_mark as current_score, low_mark as final_score
            from {in_course_rows} where user_id % 7 = 0""",
        "in_summaries": """
            select user_id, cast(count(*) filter (where event_type = 'view') as int) as page_views,
                   cast(count(*) filter (where event_type = 'view') as int) as max_page_views,
                   cast(count(*) filter (where event_type = 'click') as int) as participations
            from {events} where user_id % 11 <> 3 group by user_id""",
        "in_activity": """
            select cast(ts as date) as activity_date, cast(count(*) filter (where event_type = 'view') as int) as views,
                   cast(count(*) filter (where event_type = 'click') as int) as participations
            from {events} group by cast(ts as date)""",
        "in_quizzes": "select p_partkey as quiz_id, p_name as title, p_size as question_count from {part}",
        # some attempts name a quiz that is in no table
        "in_quiz_attempts": """
            select event_id, case when event_id % 17 = 0 then 1000000000 + event_id % 5 else event_id % 50 end as quiz_id, user_id, value, ts
            from {events} where event_type = 'signup'""",
        "in_quiz_submissions": """
            select event_id as quiz_submission_id, quiz_id, user_id, value as score, value as kept_score,
                   cast(row_number() over (partition by quiz_id, user_id order by ts) as int) as attempt,
                   'complete' as workflow_state, ts as started_at
            from {in_quiz_attempts}""",
        # a gate three days after each error event; every third is entered twice
        "in_gate_rows": """
            select event_id as gate_id, 'Gate ' || event_id as gate_name, cast(1 + event_id % 9 as int) as week_number,
                   cast(cast(ts as date) + interval '3' day as date) as gate_date, 'hard week' as description
            from {events} where event_type = 'error'
            union all
            select event_id + 100000000 as gate_id, 'Gate ' || event_id as gate_name, cast(0 as int) as week_number,
                   cast(cast(ts as date) + interval '4' day as date) as gate_date, 'entered twice' as description
            from {events} where event_type = 'error' and event_id % 3 = 0""",
        "in_gates": "select gate_id, gate_name, week_number, gate_date, description from {in_gate_rows} where gate_id < 100000000",
        "in_flags": f"""
            select event_id as flag_id, user_id, ts as flagged_at,
                   case when {code_slot} < 3 then 'red' else 'yellow' end as flag_type,
                   case when {code_slot} = 8 then null when {code_slot} = 9 then 'manual note'
                        else {code} || ': earlier finding ' || event_id end as reason,
                   'none' as inputs, case when event_id % 3 = 0 or value <= 100 then 1 else 0 end as resolved
            from {{events}} where event_type = 'error'""",
        "in_nudges": f"""
            select event_id as nudge_id, cast(user_id * 8 + event_id % 8 as string) as draft_id, user_id,
                   cast(null as bigint) as computation_id,
                   case when event_id % 31 = 0 then 'escalation_alert' else {nudge_kind} end as nudge_type,
                   {drafted_code} as flag_code, {nudge_kind} as template_id, {_NULL_S} as variant_id,
                   case when event_id % 37 = 0 then 'sms' else 'email' end as channel,
                   case event_type when 'view' then 'pending_review' when 'click' then 'approved'
                        when 'purchase' then 'sent' when 'error' then 'rejected' else 'escalated' end as delivery_status,
                   'About ' || {nudge_code} as subject, '<p>Dear ___LEARNER_NAME___, ' || event_id || '</p>' as html_body,
                   'Dear ___LEARNER_NAME___, ' || event_id as rendered_template, {_NULL_S} as langsmith_run_id,
                   case when event_type <> 'view' then 'reviewer' || user_id % 5 end as reviewer_id,
                   case when event_type = 'error' then 'wording' end as review_notes,
                   case when event_type = 'purchase' then 'm' || event_id end as provider_message_id,
                   case when event_type = 'purchase' then ts end as delivered_at, ts as created_at
            from {{events}}""",
        "in_decisions": """
            select event_id as decision_id, cast(user_id * 8 + event_id % 8 as string) as draft_id,
                   case when event_id % 10 < 4 then 'approve' when event_id % 10 < 7 then 'reject'
                        when event_id % 10 < 9 then 'escalate' else 'archive' end as action,
                   'reviewer' || event_id % 5 as reviewer_id,
                   case when event_id % 3 = 0 then ' too short ' when event_id % 3 = 1 then null
                        else '  please change the tone ' || event_id end as notes,
                   ts as decided_at
            from {events} where event_type = 'click'""",
        "in_outcomes": """
            select draft_id, cast(draft_id as bigint) % 3 <> 0 as ok, 'msg-' || draft_id as message_id,
                   'mailbox full' as error
            from (select distinct draft_id from {in_decisions}) x
            where cast(draft_id as bigint) % 5 <> 0
            union all
            select draft_id, false as ok, 'again-' || draft_id as message_id, 'reported twice' as error
            from (select distinct draft_id from {in_decisions}) y
            where cast(draft_id as bigint) % 4 = 0""",
        "in_pii": """
            select user_id, 'Learner ' || user_id as full_name, email from {in_users} where user_id % 6 <> 5""",
        "in_demographics": """
            select case when c_custkey % 13 = 0 then '  ' else '  USER' || c_custkey || '@Example.org ' end as Email,
                   ' ' || c_name || ' ' as Name, c_mktsegment as field_of_study,
                   cast(c_nationkey as string) as country, c_custkey as ordinal
            from {customer}""",
        "in_runs": """
            select cast(floor(event_id / 100) as bigint) as run_id, cast(event_id % 3 as int) as attempt, min(ts) as started_at,
                   max(ts) as finished_at,
                   case when count(*) filter (where event_type = 'error' and value > 50) > 0 then 'failed'
                        else 'success' end as status
            from {events} group by floor(event_id / 100), event_id % 3""",
        **_merge_inputs(),
        # one "submission" per line item; a unit of 16 days keeps the distances in range
        "in_line_timing": f"""
            select o.o_custkey as user_id, l.l_orderkey * 8 + l.l_linenumber as assignment_id,
                   l.l_shipdate as submitted_at,
                   {d.rnd(f"({_micros(d, 'o.o_orderdate')} - {_micros(d, 'l.l_shipdate')}) / 1e6 / 86400.0 / 16.0", 2)}
                       as days_from_deadline
            from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey""",
    }


# Merge inputs: the stored table is the state before this moment, the batch is
# the whole period as re-sent records (several per key, ranked by ``ordinal``).
CUTOFF = "2024-01-16 00:00:00"
# merge source -> (key columns as SQL, rows it reads, extra grouping of the batch)
MERGE_SOURCES = {
    "learner": ({"user_id": "user_id"}, "true", "cast(ts as date)"),
    "item": ({"item_id": f"cast({_K} as bigint)"}, "true", "cast(ts as date)"),
    "work": ({"assignment_id": f"cast({_K} as bigint)", "user_id": "user_id"}, "event_type = 'purchase'", "event_id"),
    "trial": (
        {"quiz_id": f"cast({_K} as bigint)", "user_id": "user_id",
         "attempt": "case when value < 10 then null else cast(floor(value / 50) as int) end"},
        "event_type = 'signup'", "event_id",
    ),
    "day": ({"activity_date": "cast(ts as date)"}, "true", "extract(hour from ts)"),
}
# table -> (merge source, key of the table -> key of the source)
MERGE_TABLES = {
    "users": ("learner", {"user_id": "user_id"}),
    "assignments": ("item", {"assignment_id": "item_id"}),
    "enrollments": ("learner", {"enrollment_id": "user_id"}),
    "student_summaries": ("learner", {"user_id": "user_id"}),
    "submissions": ("work", {"assignment_id": "assignment_id", "user_id": "user_id"}),
    "quizzes": ("item", {"quiz_id": "item_id"}),
    "quiz_submissions": ("trial", {"quiz_id": "quiz_id", "user_id": "user_id", "attempt": "attempt"}),
    "course_activity": ("day", {"activity_date": "activity_date"}),
    "student_pii": ("learner", {"user_id": "user_id"}),
    "student_demographics": ("learner", {"user_id": "user_id"}),
    "student_risk_signals": ("learner", {"user_id": "user_id"}),
}


def table_columns(table: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a flat table."""
    return [tuple(part.split(" ")) for part in TABLES[table].split(", ")]


def _merge_inputs() -> dict[str, str]:
    texts = {}
    measures = "count(*) as n, max(value) as v, max(ts) as last_ts, max(event_id) as ordinal"
    for source, (keys, rows, grouping) in MERGE_SOURCES.items():
        named = ", ".join(f"{sql} as {name}" for name, sql in keys.items())
        group = ", ".join(keys.values())
        texts[f"src_{source}_stored"] = (
            f"select {named}, {measures} from {{events}} where {rows} and ts < timestamp '{CUTOFF}' group by {group}"
        )
        texts[f"src_{source}_batch"] = (
            f"select {named}, {measures} from {{events}} where {rows} group by {group}, {grouping}"
        )
    for table, (source, keys) in MERGE_TABLES.items():
        for part, extra in (("stored", ""), ("batch", ", ordinal")):
            cols = []
            for name, kind in table_columns(table):
                value = keys.get(name) or {
                    # a null every few records shows that a re-sent null overwrites
                    "string": f"case when n % 4 <> 3 then '{part} {name} ' || n end",
                    "int": "cast(n as int)", "long": "n + 1000", "double": "v", "timestamp": "last_ts",
                }[kind]
                cols.append(f"{value} as {name}")
            texts[f"{part}_{table}"] = f"select {', '.join(cols)}{extra} from {{src_{source}_{part}}}"
    return texts


def _micros(d: Dialect, expr: str) -> str:
    return f"unix_micros({expr})" if d is SPARK else f"epoch_us({expr})"


def _days(d: Dialect, due: str, done: str) -> str:
    # the 1e6 and 86400 steps are separate divisions, as in the operator
    one, day = ("1e6D", "86400.0D") if d is SPARK else ("1e6", "86400.0::double")
    return f"({_micros(d, due)} - {_micros(d, done)}) / {one} / {day}"


class Inputs:
    """Driver tables and derived inputs of one scale folder as DataFrames (attribute access)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    @cached_property
    def _texts(self) -> dict[str, str]:
        return definitions(SPARK)

    def table(self, name: str) -> DataFrame:
        raw = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoned = {
            f.name: F.col(f.name).cast("timestamp") for f in raw.schema.fields if isinstance(f.dataType, TimestampNTZType)
        }
        return raw.withColumns(zoned) if zoned else raw

    def sql(self, text: str) -> DataFrame:
        refs = set(_REF.findall(text))
        return self.spark.sql(text, **{r: self[r] for r in refs})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.table(name) if name in TABLE_NAMES else self.sql(self._texts[name])
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def with_ctes(text: str, views: dict[str, str]) -> str:
    """DuckDB statement: ``text`` preceded by the CTEs it (transitively) refers to."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLE_NAMES or name in ordered:
            return
        for ref in _REF.findall(views[name]):
            visit(ref)
        ordered.append(name)

    for ref in _REF.findall(text):
        visit(ref)
    plain = lambda s: _REF.sub(r"\1", s)
    ctes = ",\n".join(f"{n} as ({plain(views[n])})" for n in ordered)
    return (f"with {ctes}\n" if ctes else "") + plain(text)
