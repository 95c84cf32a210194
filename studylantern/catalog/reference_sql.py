"""Reference SQL (DuckDB) of the registered queries, written independently of the operators.

``VIEWS`` are shared intermediate results; a query text refers to them and to
the inputs as ``{name}``.
"""

from __future__ import annotations

import re

from studylantern.catalog.inputs import AS_OF, DUCK, MERGE_TABLES, definitions, table_columns, with_ctes
from studylantern.config import (
    CHANNELS, DEADLINES, DEFAULT, DELIVERY_STATUSES, FLAG_CODES, NAME_PLACEHOLDER, NUDGE_TYPES, ROUTES,
)
from studylantern.operators.merge import rule_for
from studylantern.schemas import DEMOGRAPHIC_HEADERS

NOW = f"timestamp '{AS_OF}'"
R2, R1 = "printf('%.2f', {0})::double", "printf('%.1f', {0})::double"
K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
NULL_S, NULL_TS = "cast(null as varchar)", "cast(null as timestamp)"


def _halves(source: str) -> str:
    return f"""
        select user_id, n, sum(d) as total, sum(d) filter (where place <= n // 2) as first_total
        from (select user_id, days_from_deadline::decimal(18,2) as d, count(*) over (partition by user_id) as n,
                     row_number() over (partition by user_id order by submitted_at, days_from_deadline) as place
              from {source} where days_from_deadline is not null) t
        group by user_id, n"""


def _trend(source: str) -> str:
    return f"""
        select user_id, {R2.format('total::double / n')} as avg_days_from_deadline, n::int as total_submissions,
               case when n < 3 then 'insufficient_data'
                    when (total - first_total)::double / (n - n // 2) - first_total::double / (n // 2) > 1 then 'improving'
                    when (total - first_total)::double / (n - n // 2) - first_total::double / (n // 2) < -1 then 'worsening'
                    else 'stable' end as timing_trend
        from ({_halves(source)}) h"""


def _tag(slot: str) -> str:
    routes = " ".join(f"when '{code}' then '{route[slot_index[slot]]}'" for code, route in ROUTES.items())
    return f"case flag_code {routes} end"


LOG_COLUMNS = ("nudge_id", "draft_id", "user_id", "flag_code", "delivery_status", "subject", "created_at")
slot_index = {"template_id": 0, "nudge_type": 1, "severity": 2}

# rule -> (condition, reason, inputs as a struct)
_AVG, _N, _SILENT = "avg_days_from_deadline", "total_submissions", "days_since_last_login"
_AVG1 = f"printf('%.1f', {_AVG})"
_RULES = {
    "R1": (
        f"zero_submissions = 1 and {_SILENT} > 14", f"'R1: No submissions and silent for ' || {_SILENT} || ' days'",
        "zero_submissions := zero_submissions, days_since_last_login := days_since_last_login, total_submissions := total_submissions",
    ),
    "R2": (
        f"{_AVG} < -10 and {_N} < 3", f"'R2: Average ' || {_AVG1} || ' days late with only ' || {_N} || ' submissions'",
        "avg_days_from_deadline := avg_days_from_deadline, total_submissions := total_submissions",
    ),
    "R3": (
        f"gate_approaching = 1 and {_AVG} < -5",
        f"'R3: ' || gate_name || ' gate in ' || days_until_gate || ' days, already averaging ' || {_AVG1} || 'd late'",
        "gate_name := gate_name, days_until_gate := days_until_gate, avg_days_from_deadline := avg_days_from_deadline",
    ),
    "Y1": (
        f"zero_submissions = 1 and {_SILENT} > 7 and {_SILENT} <= 14",
        f"'Y1: No submissions but logged in ' || {_SILENT} || ' days ago'",
        "zero_submissions := zero_submissions, days_since_last_login := days_since_last_login, engagement_ratio := engagement_ratio",
    ),
    "Y1b": (
        f"zero_submissions = 1 and {_SILENT} <= 7",
        f"'Y1b: No formal submissions but logged in ' || {_SILENT} || ' days ago — engaging but not submitting'",
        "zero_submissions := zero_submissions, days_since_last_login := days_since_last_login, engagement_ratio := engagement_ratio",
    ),
    "Y2": (
        f"{_AVG} >= -10 and {_AVG} < -5 and {_N} >= 3",
        f"'Y2: Averaging ' || {_AVG1} || ' days late across ' || {_N} || ' submissions'",
        "avg_days_from_deadline := avg_days_from_deadline, total_submissions := total_submissions, timing_trend := timing_trend",
    ),
    "Y3": (
        f"timing_trend = 'worsening' and {_AVG} < 0",
        f"'Y3: Submission timing is worsening, currently averaging ' || {_AVG1} || 'd from deadline'",
        "timing_trend := timing_trend, avg_days_from_deadline := avg_days_from_deadline",
    ),
    "Y4": (
        f"{_N} > 0 and final_score > 0 and final_score < 70",
        f"'Y4: Has ' || {_N} || ' submissions but final score is ' || printf('%.1f', final_score) || '%'",
        "total_submissions := total_submissions, current_score := final_score",
    ),
}


def _rule(code: str) -> str:
    condition, reason, inputs = _RULES[code]
    severity = "red" if code.startswith("R") else "yellow"
    # every enrollment is looked at; the lowest firing one is kept per learner and code
    return f"""
        select user_id, '{code}' as flag_code, '{severity}' as flag_type, {reason} as reason,
               to_json(struct_pack({inputs}))::varchar as inputs
        from (select s.*, e.final_score, e.enrollment_id from {{o_signals}} s
              left join {{in_enrollments}} e on e.user_id = s.user_id) x
        where {condition}
        qualify row_number() over (partition by user_id order by enrollment_id) = 1"""


def _uuid(expr: str) -> str:
    h = f"md5({expr})"
    return (
        f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12)"
    )


def _fill(template: str, fields: dict[str, str]) -> str:
    """Nested literal replacements of the ``{{ name }}`` tokens."""
    quoted = template.replace("'", "''")
    # protect the token braces from the CTE reference syntax
    expr = "'" + re.sub(r"\{\{\s*([\w.]+)\s*\}\}", r"<<\1>>", quoted) + "'"
    for name, value in fields.items():
        if f"<<{name}>>" in expr or "<<" in expr:
            expr = f"replace({expr}, '<<{name}>>', {value})"
    return expr


def _html(text: str) -> str:
    marked = f"regexp_replace({text}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"
    marked = f"regexp_replace({marked}, '\\*([^*\\n]+)\\*', '<em>\\1</em>', 'g')"
    return (
        f"array_to_string(list_transform(list_filter(list_transform(string_split({marked}, chr(10) || chr(10)), "
        "lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13))), lambda b: b <> ''), "
        "lambda b: '<p>' || b || '</p>'), chr(10))"
    )


_SPECIFIC = {
    f"specific.{n}": f"{n}::varchar"
    for n in ("days_inactive", "days_since_login", "submission_count", "gate_name", "days_to_gate", "timing_trend")
} | {"specific.avg_days_late": "avg_days_late_text", "specific.current_score": "current_score_text"}
_COURSE = {"course_name": f"'{DEFAULT.course_name}'"}


def _draft_text() -> str:
    arms = []
    for (name, severity), wording in DEFAULT.templates.items():
        test = f"template_id = '{name}'" + (f" and severity = '{severity}'" if severity else "")
        arms.append(f"when {test} then {_fill(wording, _SPECIFIC | _COURSE)}")
    return "case " + " ".join(arms) + " end"


def _subject_text() -> str:
    arms = " ".join(f"when '{kind}' then {_fill(w, _COURSE)}" for kind, w in DEFAULT.subjects.items())
    return f"case nudge_type {arms} end"


_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_NOTE_OK = f"length({_STRIP.format('coalesce(notes, chr(32))')}) >= 10"
_PROBLEM = (
    "case when action not in ('approve', 'reject', 'escalate') then 'unknown action' "
    f"when action = 'reject' and not {_NOTE_OK} then 'note needs at least 10 characters' end"
)
_NO_PII = "'no contact details stored for learner ' || {0}"

VIEWS = {
    "o_trend": _trend("{in_submissions}"),
    "o_first_enrollment": """
        select user_id, enrollment_id, final_score, current_score, last_activity_at from {in_enrollments}
        qualify row_number() over (partition by user_id order by enrollment_id) = 1""",
    "o_gate_first": f"""
        select gate_name, date_diff('day', date '{AS_OF[:10]}', gate_date)::int as ahead from {{in_gates}}
        where date_diff('day', date '{AS_OF[:10]}', gate_date) between 0 and 7 order by ahead, gate_name limit 1""",
    "o_signals": f"""
        select u.user_id, t.avg_days_from_deadline,
               case when e.final_score = 100 then 'completed' else coalesce(t.timing_trend, 'no_data') end as timing_trend,
               floor((epoch_us({NOW}) - epoch_us(e.last_activity_at)) / 86400e6)::int as days_since_last_login,
               coalesce(t.total_submissions, 0) as total_submissions,
               case when t.total_submissions is null then 1 else 0 end as zero_submissions,
               printf('%.3f', coalesce(s.page_views, 0)::double
                      / coalesce(nullif((select max(max_page_views) from {{in_summaries}}), 0), 1))::double as engagement_ratio,
               (select count(*) from {{o_gate_first}})::int as gate_approaching,
               (select gate_name from {{o_gate_first}}) as gate_name,
               (select ahead from {{o_gate_first}}) as days_until_gate,
               {NOW} as computed_at
        from {{in_users}} u left join {{o_trend}} t on t.user_id = u.user_id
        left join {{o_first_enrollment}} e on e.user_id = u.user_id
        left join {{in_summaries}} s on s.user_id = u.user_id""",
    "o_fired": " union all ".join(f"select * from ({_rule(code)}) {code.lower()}" for code in FLAG_CODES),
    "o_new_flags": f"""
        select f.user_id, {NOW} as flagged_at, f.flag_type, f.reason, f.inputs, 0 as resolved, f.flag_code
        from {{o_fired}} f where not exists (
            select 1 from {{in_flags}} o
            where o.user_id = f.user_id and o.resolved = 0 and o.reason like f.flag_code || '%')""",
    "o_worst": """
        select user_id, flag_type, reason from {in_flags} where resolved = 0
        qualify row_number() over (partition by user_id order by case flag_type when 'red' then 0 when 'yellow' then 1 else 2 end,
                                   flagged_at desc, flag_id) = 1""",
    "o_latest_open": """
        select user_id, split_part(reason, ':', 1) as flag_code, reason as flag_reason, flag_type from {in_flags}
        where resolved = 0 and reason is not null
        qualify row_number() over (partition by user_id, split_part(reason, ':', 1) order by flagged_at desc, flag_id desc) = 1""",
    "o_candidates": """
        select flag_id, user_id, trim(split_part(reason, ':', 1)) as flag_code, reason from {in_flags} f
        where resolved = 0 and reason like '%:%' and not exists (
            select 1 from {in_nudges} n where n.user_id = f.user_id and n.flag_code = split_part(f.reason, ':', 1))""",
    "o_routed": f"""
        select c.*, {_tag('template_id')} as template_id, {_tag('nudge_type')} as nudge_type, {_tag('severity')} as severity
        from {{o_candidates}} c where flag_code in {tuple(FLAG_CODES)}""",
    "o_learner": f"""
        select u.user_id, coalesce(s.days_since_last_login, 0) as days_inactive, coalesce(s.days_since_last_login, 0) as days_since_login,
               coalesce({R1.format('abs(s.avg_days_from_deadline)')}, 0.0)::double as avg_days_late,
               coalesce(s.total_submissions, 0) as submission_count,
               coalesce({R1.format('e.current_score')}, 0.0)::double as current_score,
               coalesce(nullif(s.gate_name, ''), 'your next gate') as gate_name,
               coalesce(s.days_until_gate, 0) as days_to_gate, coalesce(nullif(s.timing_trend, ''), 'unknown') as timing_trend,
               coalesce(printf('%.1f', abs(s.avg_days_from_deadline)), '0') as avg_days_late_text,
               coalesce(printf('%.1f', e.current_score), '0') as current_score_text
        from {{in_users}} u left join {{o_signals}} s on s.user_id = u.user_id
        left join {{o_first_enrollment}} e on e.user_id = u.user_id""",
    "o_context": "select r.*, l.* exclude (user_id) from {o_routed} r join {o_learner} l on l.user_id = r.user_id",
    "o_rendered": f"select *, {_draft_text()} as rendered_template, {_subject_text()} as subject from {{o_context}}",
    "o_state": """
        select * from {in_nudges}
        qualify row_number() over (partition by draft_id order by created_at desc, nudge_id desc) = 1""",
    "o_first_decision": f"""
        select * from {{in_decisions}} where {_PROBLEM} is null
        qualify row_number() over (partition by draft_id order by decided_at, decision_id) = 1""",
    "o_accepted": f"""
        select s.draft_id, s.user_id, s.flag_code, s.subject, d.decision_id, d.action, d.reviewer_id, d.notes, o.message_id,
               case when d.action <> 'approve' then null when p.user_id is null then 'failed' when o.ok then 'sent'
                    when not o.ok then 'failed' end as send_status,
               case when p.user_id is null then {_NO_PII.format('s.user_id')} else o.error end as send_error
        from {{o_state}} s join {{o_first_decision}} d on d.draft_id = s.draft_id
        left join {{o_outcome}} o on o.draft_id = s.draft_id left join {{in_pii}} p on p.user_id = s.user_id
        where s.delivery_status = 'pending_review'""",
    "o_cohort": """
        select u.user_id, s.* exclude (user_id, computed_at), m.page_views, e.enrollment_id, e.final_score, e.last_activity_at,
               e.total_activity_time, round(e.total_activity_time::decimal(20,4) / 3600, 1)::double as hrs_in_canvas
        from {in_users} u left join {o_signals} s on s.user_id = u.user_id
        left join {in_enrollments} e on e.user_id = u.user_id left join {in_summaries} m on m.user_id = u.user_id""",
    "o_queue": """
        select n.draft_id, n.nudge_id, n.user_id, n.flag_code, n.nudge_type, n.subject, n.html_body, n.created_at,
               f.flag_reason, f.flag_type, r.days_since_last_login, r.total_submissions, r.avg_days_from_deadline
        from {in_nudges} n left join {o_latest_open} f on f.user_id = n.user_id and f.flag_code = n.flag_code
        left join {o_signals} r on r.user_id = n.user_id
        where n.delivery_status = 'pending_review' and n.nudge_type <> 'escalation_alert'
          and n.nudge_id = (select max(nudge_id) from {in_nudges} n2 where n2.draft_id = n.draft_id)""",
    "o_handed_over": """
        select n.draft_id, n.user_id, n.flag_code, n.reviewer_id, n.review_notes, o.ok, o.message_id, o.error,
               l.* exclude (user_id)
        from (select * from {in_nudges} where delivery_status = 'escalated'
              qualify row_number() over (partition by draft_id order by nudge_id desc) = 1) n
        join {o_learner} l on l.user_id = n.user_id left join {o_outcome} o on o.draft_id = n.draft_id""",
    "o_outcome": """
        select * from {in_outcomes} qualify row_number() over (partition by draft_id order by not ok, message_id, error) = 1""",
    "o_owner": """
        select lower(trim(email)) as address, max(user_id) as user_id from {in_users} where trim(email) <> '' group by 1""",
    "o_loaded": """
        select o.user_id, d.* from {in_demographics} d join {o_owner} o on o.address = lower(trim(d.email))""",
    "o_wishes": """
        select o_orderkey, case when o_orderkey % 10 = 9 then 'unknown_kind' else 'late_sub' end as flag_type,
               case when o_orderkey % 4 = 0 then 'a' when o_orderkey % 4 = 1 then 'z' end as wanted from {orders}""",
}


def _upsert(table: str) -> str:
    rule = rule_for(table)
    keys = ", ".join(rule.keys)
    same = " and ".join(f"b.{k} = i.{k}" for k in rule.keys)
    loose = "".join(f" or {k} is null" for k in rule.nullable_keys)
    pick = "(select *, row_number() over (partition by {0} order by ordinal {1}) as place from {{batch_{2}}}) x where place = 1{3}"
    join_keys = " and ".join(f"l.{k} = f.{k}" for k in rule.keys)
    if rule.nullable_keys:  # a null key stands for itself: match the record with itself
        join_keys = " and ".join(f"l.{k} is not distinct from f.{k}" for k in rule.keys)
        join_keys += f" and (l.ordinal = f.ordinal or {' and '.join(f'l.{k} is not null' for k in rule.nullable_keys)})"
    updates = "".join(f", l.{c}" for c in rule.update)
    firsts = "".join(f", f.{c}" for c in rule.insert_only)
    cols = []
    for name, kind in table_columns(table):
        if name in rule.keys:
            expr = f"coalesce(b.{name}, i.{name})"
        elif name in rule.update:
            expr = f"case when i.sent then i.{name} else b.{name} end"
        elif name in rule.insert_only:
            expr = f"case when b.stored then b.{name} else i.{name} end"
        else:
            expr = f"b.{name}"
        cols.append(f"{expr}{'::varchar' if kind == 'date' else ''} as {name}")
    return f"""
        select {', '.join(cols)}
        from (select *, true as stored from {{stored_{table}}}) b
        full join (select {', '.join('l.' + k for k in rule.keys)}{updates}{firsts}, true as sent
                   from (select * from {pick.format(keys, 'desc', table, loose)}) l
                   join (select * from {pick.format(keys, 'asc', table, loose)}) f on {join_keys}) i
        on {same}"""


def _labels() -> dict[str, str]:
    return {
        "icon": "case flag_type when 'red' then '🔴 ' when 'yellow' then '🟡 ' else '🟢 ' end",
        "flag_icon": "case when flag_type = 'red' then '🔴 ' else '🟡 ' end",
        "state": "case when resolved <> 0 then '✅ Resolved' else '⏳ Open' end",
    }


L = _labels()
_HALF_UP_HOURS = "round(total_activity_time::decimal(20,4) / 3600, 1)::double"


def _audit(where: str, limit: int) -> str:
    shown = "strftime({0} + interval '2' hour, '%b %d, %H:%M')"  # a fixed +2 h zone
    return f"""
        select nudge_id, case delivery_status when 'pending_review' then '🟡' when 'approved' then '🔵' when 'sent' then '🟢'
               when 'rejected' then '⚪' when 'failed' then '🔴' when 'escalated' then '⬆️' else '·' end as icon,
               replace(delivery_status, '_', ' ') as status, user_id, replace(nudge_type, '_', ' ') as nudge_type,
               coalesce(nullif(flag_code, ''), '—') as flag_code, {shown.format('created_at')} as created,
               left(draft_id, 8) || '…' as draft, coalesce(nullif(reviewer_id, ''), '—') as reviewer, provider_message_id,
               {shown.format('delivered_at')} as delivered, review_notes, langsmith_run_id
        from {{in_nudges}} {where} order by nudge_id desc limit {limit}"""


def _ta_rows() -> str:
    fields = _SPECIFIC | _COURSE | {
        "learner_name": "'Student ' || user_id",
        "escalation.student_user_id": "user_id::varchar",
        "escalation.flag_code": "coalesce(nullif(flag_code, ''), 'unknown')",
        "escalation.reviewer_id": "coalesce(reviewer_id, 'None')",
        "escalation.reviewer_notes": "coalesce(nullif(review_notes, ''), 'none given')",
    }
    subject = "'[hand-over] learner ' || user_id || ', rule ' || coalesce(nullif(flag_code, ''), '—')"
    return f"""
        select {_uuid("'briefing|' || draft_id")} as draft_id, user_id, 'escalation_alert' as nudge_type, flag_code,
               case step when 0 then 'pending_review' when 1 then 'approved' else case when ok then 'sent' else 'failed' end
               end as delivery_status,
               {subject} as subject, {_html('body')} as html_body, case when step > 0 then reviewer_id end as reviewer_id,
               case when step = 2 and not ok then error end as review_notes,
               case when step = 2 and ok then message_id end as provider_message_id, step::int as step
        from (select *, {_fill(DEFAULT.ta_template, fields)} as body from {{o_handed_over}}) text cross join range(3) s(step) where step < 2 or ok is not null"""


def _late_text() -> str:
    fields = {
        "learner_name": f"'{NAME_PLACEHOLDER}'", "specific.assignment_name": "coalesce(name, '')",
        "specific.original_deadline": "strftime(due_at_roadmap, '%Y-%m-%d')",
        "specific.days_late": "printf('%.1f', abs(days_from_deadline))",
    } | _COURSE
    arms = " ".join(
        f"when '{letter}' then {_fill(w, fields)}" for (kind, letter), w in DEFAULT.variants.items() if kind == "late_sub"
    )
    return f"case variant_id {arms} end"


_PICK = "case when ('0x' || substr(md5({0}), 1, 8))::bigint % 2 = 0 then 'a' else 'b' end"
_TREND_LABEL = (
    "case timing_trend when 'improving' then 'Improving' when 'worsening' then 'Worsening' when 'stable' then 'Stable' "
    "when 'insufficient_data' then 'Insufficient data' when 'no_data' then 'No submissions' when 'completed' then 'Completed ✅' "
    "else coalesce(timing_trend, 'No submissions') end"
)


def _queries() -> dict[str, str]:
    deadlines = ", ".join(f"({k - 3300}, timestamp '{v[:10]} {v[11:19]}')" for k, v in DEADLINES.items())
    q: dict[str, str] = {
        "timing_stats": "select user_id, avg_days_from_deadline, total_submissions from {o_trend}",
        "timing_trend": "select * from {o_trend}",
        "timing_trend_orders": _trend("{in_line_timing}"),
        "timing_trend_hot_orders": _trend("{in_line_timing}"),
        "course_max_views": "select coalesce(nullif(max(max_page_views), 0), 1) as course_max_views from {in_summaries}",
        "next_gate": """
            select count(g.ahead)::int as gate_approaching, min(g.gate_name) as gate_name, min(g.ahead) as days_until_gate
            from {o_gate_first} g""",
        "primary_enrollment": "select * from {o_first_enrollment}",
        "risk_signals": "select * from {o_signals}",
        "run_flags": "select * from {o_new_flags}",
        "flag_counts": "select flag_code, flag_type, count(*) as n_flags from {o_new_flags} group by all",
        "dedupe_new_flags": f"""
            select u.user_id, c.code as flag_code from {{in_users}} u
            cross join (values {', '.join(f"('{c}')" for c in FLAG_CODES)}) c(code)
            where not exists (select 1 from {{in_flags}} o where o.user_id = u.user_id and o.resolved = 0
                              and o.reason like c.code || '%')""",
        "worst_open_flag": "select * from {o_worst}",
        "latest_open_flag": "select * from {o_latest_open}",
        "upsert_gate_calendar": """
            select gate_id, gate_name, week_number, gate_date::varchar as gate_date, description from {in_gate_rows} g
            qualify row_number() over (partition by gate_name order by gate_id) = 1""",
        "dedupe_keep_first": """
            select gate_id, gate_name, week_number, gate_date::varchar as gate_date, description from {in_gate_rows}
            where gate_id in (select min(gate_id) from {in_gate_rows} group by gate_name)""",
        "users_from_feed": f"""
            select c_custkey as user_id,
                   coalesce(case when c_custkey % 3 = 1 then 'c' || c_custkey || '@example.org' end,
                            case when c_custkey % 2 <> 0 then nullif(c_name, '') end, 'login' || c_custkey) as email,
                   case when c_custkey % 2 = 0 then '' else c_name end as sis_user_id, 'login' || c_custkey as login_id,
                   {NOW} as updated_at
            from {{customer}} where c_custkey <> 13""",
        "assignments_from_feed": f"""
            select p_partkey as assignment_id, 829::bigint as course_id, p_name as name,
                   timestamp '2026-07-01 10:00:00' as due_at, p_retailprice as points_possible, d.due as due_at_roadmap,
                   {NOW} as updated_at
            from {{part}} left join (values {deadlines}) d(id, due) on d.id = p_partkey""",
        "enrollments_from_feed": """
            select o_orderkey as enrollment_id, 829::bigint as course_id,
                   case when o_orderkey % 10 <> 0 then o_custkey end as user_id, 'StudentEnrollment' as type,
                   o_orderpriority as role, o_orderstatus as enrollment_state,
                   case when o_orderkey % 5 <> 0 then date_trunc('second', o_orderdate) end as last_activity_at,
                   (o_orderkey % 100000)::int as total_activity_time,
                   case when o_orderkey % 7 <> 0 then o_totalprice end as current_score,
                   case when o_orderkey % 7 <> 0 then o_totalprice / 2 end as final_score,
                   date_trunc('second', o_orderdate) as created_at, date_trunc('second', o_orderdate) as updated_at
            from {orders}""",
        "summaries_from_feed": f"""
            select user_id, page_views, max_page_views, participations, 9 as max_participations,
                   case when user_id % 4 <> 0 then page_views end as tardiness_on_time,
                   case when user_id % 4 <> 0 then page_views + 1 end as tardiness_late,
                   case when user_id % 4 <> 0 then page_views + 2 end as tardiness_missing,
                   case when user_id % 4 <> 0 then page_views + 3 end as tardiness_floating,
                   case when user_id % 4 <> 0 then page_views + 4 end as tardiness_total, {NOW} as pulled_at
            from {{in_summaries}} where user_id <> 13""",
        "submissions_from_feed": f"""
            select e.event_id as submission_id, (e.k % 20)::bigint as assignment_id, e.user_id, e.value as score, 'pass' as grade,
                   e.done as submitted_at, {NULL_TS} as graded_at, 'graded' as workflow_state,
                   coalesce((case when e.event_id % 2 = 0 then e.value > 50 end)::int, 0) as late, 0 as missing,
                   {R2.format("(epoch_us(a.due_at_roadmap) - epoch_us(e.done)) / 1e6 / 86400.0::double")} as days_from_deadline,
                   {NOW} as updated_at
            from (select *, {K} as k, case when event_id % 8 <> 0 then date_trunc('second', ts) end as done
                  from {{events}} where event_type = 'purchase') e
            left join {{in_assignments}} a on a.assignment_id = e.k % 20
            where e.k % 20 <> 0 and e.event_id % 9 <> 0 and e.user_id <> 0 and e.user_id <> 13""",
        "quizzes_from_feed": f"""
            select p_partkey as quiz_id, 829::bigint as course_id, p_name as title, p_type as quiz_type,
                   p_retailprice as points_possible, {NULL_TS} as due_at,
                   case when p_partkey % 3 <> 0 and p_partkey % 2 = 0 then 1 else 0 end as published,
                   p_size as question_count, {NOW} as updated_at
            from {{part}}""",
        "quiz_submissions_from_feed": f"""
            select event_id as quiz_submission_id, event_id % 50 as quiz_id, user_id, 1 as attempt, value as score,
                   value as kept_score, 'complete' as workflow_state, date_trunc('second', ts) as started_at,
                   {NULL_TS} as finished_at, {NOW} as updated_at
            from {{events}} where event_type = 'signup' and event_id % 11 <> 0 and user_id <> 0 and user_id <> 13""",
        "activity_from_feed": """
            select cast(hour as date)::varchar as activity_date, n::int as views, (n * 2)::int as participations
            from (select date_trunc('hour', ts) as hour, count(*) as n from {events} group by 1) h
            where extract(hour from hour) % 6 <> 0""",
        "match_demographics": "select user_id, name as name, ordinal from {o_loaded}",
        "skipped_demographics": """
            select d.ordinal, case when trim(d.email) = '' then 'no email' else 'no matching user' end as skip_reason
            from {in_demographics} d left join {o_owner} o on o.address = lower(trim(d.email)) where o.user_id is null""",
        "student_pii_rows": f"""
            select user_id, trim(name) as full_name, trim(email) as email, {NULL_S} as person_reference_id, {NULL_S} as prefix,
                   {NULL_S} as most_recent_role, {NULL_S} as most_recent_employer, {NOW} as loaded_at, ordinal
            from {{o_loaded}}""",
        "student_demographics_rows": "select user_id, "
        + ", ".join(
            {"country_of_origin": "country as country_of_origin", "field_of_study": "field_of_study"}.get(c, f"{NULL_S} as {c}")
            for c in DEMOGRAPHIC_HEADERS.values()
        )
        + f", {NOW} as loaded_at, ordinal from {{o_loaded}}",
        "run_metrics": """
            select 'users' as table_name, count(*) as n_rows from {in_users}
            union all select 'submissions', count(*) from {in_submissions}
            union all select 'enrollments', count(*) from {in_enrollments}
            union all select 'demographics_loaded', count(*) from {o_loaded}
            union all select 'demographics_skipped', (select count(*) from {in_demographics}) - (select count(*) from {o_loaded})""",
        "last_run": "select strftime(started_at, '%Y-%m-%d %H:%M') as last_sync, status from {in_runs} order by run_id desc, attempt desc limit 1",
        "run_states": """
            select run_id, attempt, started_at, finished_at, status from {in_runs}
            qualify row_number() over (partition by run_id order by attempt desc) = 1""",
        "page_records": "select event_id as id, user_id, value from {events} where event_id % 10 <> 0",
        "page_rejects": "select event_id as id, user_id, value from {events} where event_id % 10 = 0",
        "stored_merge": _upsert("submissions"),
        "stored_learner": f"select * from ({_upsert('submissions')}) u where user_id = 7",
        "stored_signals": "select * exclude (computed_at) from {o_signals}",
        "stored_log": f"select {', '.join(LOG_COLUMNS)} from {{in_nudges}}",
        "stored_log_learner": f"select {', '.join(LOG_COLUMNS)} from {{in_nudges}} where user_id = 7",
        "seeded_gates": "select gate_name, week_number, gate_date::varchar as gate_date, description from {in_gates}",
        "flag_detail_of_learner": f"""
            select user_id, flag_id, flagged_at, {L['flag_icon']} as icon, upper(flag_type) as severity, reason, resolved
            from {{in_flags}} where user_id = 7""",
        "flags_without_drafts": "select * from {o_candidates}",
        "route_flags": "select * from {o_routed}",
        "unrouted_flags": f"""
            select o_orderstatus as flag_code, count(*) as n_flags from {{orders}}
            where o_orderstatus not in {tuple(FLAG_CODES)} group by 1""",
        "nudge_context": """
            select flag_id, user_id, flag_code, days_inactive, days_since_login, avg_days_late, submission_count, current_score,
                   gate_name, days_to_gate, timing_trend, avg_days_late_text, current_score_text from {o_context}""",
        "render_drafts": f"""
            select flag_id, user_id, rendered_template, {_html('rendered_template')} as html_body, subject from {{o_rendered}}""",
        "generate_drafts": f"""
            select {_uuid("user_id || '|' || flag_code || '|' || flag_id")} as draft_id, user_id, nudge_type, flag_code,
                   template_id, 'email' as channel, 'pending_review' as delivery_status, {NOW} as created_at
            from {{o_context}}""",
        "latest_state": "select draft_id, nudge_id, user_id, flag_code, delivery_status, created_at from {o_state}",
        "latest_by_id": """
            select draft_id, nudge_id, user_id, flag_code, delivery_status, created_at from {in_nudges} n
            where nudge_id = (select max(nudge_id) from {in_nudges} m where m.draft_id = n.draft_id)""",
        "status_counts": "select delivery_status, count(*) as n_drafts from {o_state} group by 1",
        "apply_decisions": f"""
            select draft_id, user_id, flag_code,
                   case action when 'approve' then 'approved' when 'reject' then 'rejected' else 'escalated' end as delivery_status,
                   subject, reviewer_id,
                   case when action <> 'approve' then nullif({_STRIP.format('notes')}, '') end as review_notes,
                   {NULL_S} as provider_message_id, {NULL_TS} as delivered_at, {NOW} as created_at, 0 as step
            from {{o_accepted}}
            union all
            select draft_id, user_id, flag_code, send_status, subject, reviewer_id,
                   case when send_status = 'failed' then send_error end, case when send_status = 'sent' then message_id end,
                   case when send_status = 'sent' then {NOW} end, {NOW}, 1
            from {{o_accepted}} where send_status is not null""",
        "decision_rejects": f"""
            select * from (
                select d.decision_id, d.draft_id, d.action, d.reviewer_id,
                       case when d.problem is not null then d.problem
                            when s.draft_id is null then 'the log holds no draft ' || d.draft_id
                            when a.decision_id is null or a.decision_id <> d.decision_id
                            then d.action || ' needs a pending draft, but ' || d.draft_id || ' is ' ||
                                 case when a.decision_id is null then s.delivery_status
                                      when a.send_status is not null then a.send_status
                                      when a.action = 'approve' then 'approved' when a.action = 'reject' then 'rejected'
                                      else 'escalated' end
                       end as reject_reason
                from (select *, {_PROBLEM} as problem from {{in_decisions}}) d
                left join {{o_state}} s on s.draft_id = d.draft_id
                left join {{o_accepted}} a on a.draft_id = d.draft_id) r
            where reject_reason is not null""",
        "record_outcomes": f"""
            select s.draft_id, s.user_id, s.flag_code, case when o.ok then 'sent' else 'failed' end as delivery_status, s.subject,
                   s.reviewer_id, case when not o.ok then o.error end as review_notes,
                   case when o.ok then o.message_id end as provider_message_id, case when o.ok then {NOW} end as delivered_at,
                   {NOW} as created_at
            from (select * from {{in_nudges}} qualify row_number() over (partition by draft_id order by created_at desc, nudge_id desc) = 1) s
            join {{o_outcome}} o on o.draft_id = s.draft_id where s.delivery_status = 'approved'""",
        "briefing_failures": """
            select n.draft_id, n.user_id, 'no user row for learner ' || n.user_id as failure_reason
            from (select * from {in_nudges} where delivery_status = 'escalated'
                  qualify row_number() over (partition by draft_id order by nudge_id desc) = 1) n
            where n.user_id not in (select user_id from {in_pii})""",
        "ta_briefings": _ta_rows(),
        "outbox": f"""
            select n.draft_id, n.user_id, n.subject, p.email as to_address,
                   case when p.user_id is not null then replace(n.html_body, '{NAME_PLACEHOLDER}', p.full_name) end as html,
                   case when p.user_id is null then {_NO_PII.format('n.user_id')} end as failure_reason
            from {{in_nudges}} n left join {{in_pii}} p on p.user_id = n.user_id where n.delivery_status = 'approved'""",
        "assign_variant": f"""
            select o_orderkey, flag_type, wanted, coalesce(wanted, {_PICK.format('o_orderkey::varchar')}) as variant_id
            from {{o_wishes}} where flag_type = 'late_sub' and coalesce(wanted, 'a') <> 'z'""",
        "variant_rejects": """
            select o_orderkey, flag_type, wanted,
                   case when flag_type = 'unknown_kind' then 'no variants of kind unknown_kind'
                        else 'kind late_sub has no variant z' end as reject_reason
            from {o_wishes} where flag_type = 'unknown_kind' or wanted = 'z'""",
        "late_notices": f"""
            select user_id, assignment_id, variant_id, {_late_text()} as rendered_template
            from (select s.user_id, s.assignment_id, s.days_from_deadline, a.name, a.due_at_roadmap,
                         {_PICK.format("s.user_id || '|' || s.assignment_id")} as variant_id
                  from {{in_submissions}} s join {{in_assignments}} a on a.assignment_id = s.assignment_id
                  where s.days_from_deadline < 0) t""",
        "cohort_base": "select * from {o_cohort}",
        "cohort_overview": f"""
            select {L['icon']} as status, user_id as student_id, coalesce(total_submissions, 0) as submitted,
                   case when avg_days_from_deadline is null then 'no data'
                        else printf('%+.1f', avg_days_from_deadline) || 'd' end as avg_timing,
                   {_TREND_LABEL} as trend,
                   case when days_since_last_login is null then 'never' when days_since_last_login = 0 then 'today'
                        else days_since_last_login || 'd ago' end as last_login,
                   coalesce(page_views, 0) as page_views,
                   case when final_score > 0 then printf('%.1f', final_score) || '%' else 'N/A' end as final_score,
                   coalesce(hrs_in_canvas, 0) as hrs_canvas,
                   case when gate_approaching = 1 then '⚠️ ' || gate_name || case when days_until_gate = 0 then ' TODAY'
                        else ' in ' || days_until_gate || 'd' end else '' end as gate_alert,
                   flag_reason
            from (select c.*, case when c.final_score = 100 then 'green' else coalesce(w.flag_type, 'green') end as flag_type,
                         case when c.final_score = 100 then 'Course completed'
                              when w.user_id is null then 'No issues detected' else w.reason end as flag_reason
                  from {{o_cohort}} c left join {{o_worst}} w on w.user_id = c.user_id) t""",
        "cohort_kpis": """
            select total, red, yellow, total - red - yellow as green
            from (select (select count(*) from {o_cohort}) as total,
                         (select count(*) from {o_worst} where flag_type = 'red') as red,
                         (select count(*) from {o_worst} where flag_type = 'yellow') as yellow) t""",
        "engagement_scatter": """
            select u.user_id::varchar as user_id, coalesce(m.page_views, 0) as page_views,
                   coalesce(s.total_submissions, 0) as total_submissions
            from {in_users} u left join {in_summaries} m on m.user_id = u.user_id left join {o_signals} s on s.user_id = u.user_id""",
        "learner_list": "select user_id::varchar as student from {in_users} order by user_id",
        "submission_timeline": f"""
            select s.user_id, s.assignment_id, a.name, strftime(s.submitted_at, '%Y-%m-%d') as submitted_at,
                   {R2.format('s.days_from_deadline')} as days_from_deadline, s.score, s.workflow_state,
                   case when s.days_from_deadline >= 0 then 'Early' else 'Late' end as timing
            from {{in_submissions}} s join {{in_assignments}} a on a.assignment_id = s.assignment_id
            where s.submitted_at is not null""",
        "quiz_history": """
            select s.user_id, q.title, s.score, s.kept_score, s.attempt, s.workflow_state,
                   strftime(s.started_at, '%Y-%m-%d') as date
            from {in_quiz_submissions} s join {in_quizzes} q on q.quiz_id = s.quiz_id""",
        "enrollment_detail": f"""
            select user_id, enrollment_state, coalesce({_HALF_UP_HOURS}, 0) as hours_in_canvas,
                   case when current_score <> 0 then printf('%.1f', current_score) || '%' else 'N/A' end as current_score,
                   coalesce(strftime(last_activity_at, '%Y-%m-%d'), 'Never') as last_login,
                   case when final_score <> 0 then printf('%.2f', final_score) || '%' else 'N/A' end as final_score
            from {{in_enrollments}}""",
        "signal_detail": """
            select user_id, avg_days_from_deadline as "Avg Days from Deadline", timing_trend as "Trend",
                   days_since_last_login as "Days Since Login", total_submissions as "Submitted",
                   zero_submissions as "Zero Submissions", engagement_ratio as "Engagement Ratio",
                   gate_approaching as "Gate Approaching", gate_name as "Gate Name", days_until_gate as "Days Until Gate",
                   computed_at as "Computed At" from {o_signals}""",
        "flag_detail": f"""
            select user_id, flag_id, flagged_at, {L['flag_icon']} as icon, upper(flag_type) as severity, reason, resolved
            from {{in_flags}}""",
        "flag_log": f"""
            select flag_id, user_id, flag_type, {L['flag_icon']} as icon, reason, flagged_at,
                   strftime(flagged_at, '%Y-%m-%d %H:%M') as flagged, {L['state']} as state
            from {{in_flags}} where flag_type in ('red', 'yellow') and user_id % 2 = 1""",
        "flag_log_kpis": """
            select count(*) as total, count(*) filter (where flag_type = 'red') as red,
                   count(*) filter (where flag_type = 'yellow') as yellow from {in_flags}""",
        "approval_queue": "select * from {o_queue}",
        "queue_kpis": """
            select count(*) as awaiting, count(*) filter (where flag_type = 'red') as red,
                   count(*) filter (where flag_type = 'yellow') as yellow from {o_queue}""",
        "audit_log": _audit("", 100),
        "audit_log_sent": _audit("where delivery_status = 'sent'", 50),
        "signals_report": "select * exclude (computed_at) from {o_signals}",
        "check_unique": """
            select l_orderkey, l_linenumber, count(*) as n_rows from {lineitem} group by 1, 2 having count(*) > 1""",
        "check_fk": """
            select s.quiz_id, count(*) as n_rows from {in_quiz_submissions} s
            where s.quiz_id not in (select quiz_id from {in_quizzes}) group by 1""",
        "check_domain": " union all ".join(
            f"select nudge_id, '{col}' as column_name, {col} as value from {{in_nudges}} where {col} not in {values}"
            for col, values in (("channel", CHANNELS), ("nudge_type", NUDGE_TYPES), ("delivery_status", DELIVERY_STATUSES))
        ),
        "check_not_null": "select * from ("
        + " union all ".join(
            f"select '{c}' as column_name, count(*) - count({c}) as n_rows from {{in_nudges}}"
            for c in ("nudge_id", "draft_id", "reviewer_id", "delivered_at", "review_notes")
        )
        + ") t where n_rows > 0",
    }
    for code in FLAG_CODES:
        q[f"flag_{code.lower()}"] = f"select * from {{o_fired}} where flag_code = '{code}'"
    for table in MERGE_TABLES:
        q[f"upsert_{table}"] = _upsert(table)
    q["upsert_submissions_small_batch"] = _upsert("submissions")
    return q


def statements() -> dict[str, str]:
    """Name -> complete DuckDB statement over the driver tables."""
    views = {**definitions(DUCK), **VIEWS}
    return {name: with_ctes(text, views) for name, text in _queries().items()}
