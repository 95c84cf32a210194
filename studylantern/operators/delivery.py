"""Outgoing messages: outbox, hand-over briefings, message variants and late-work notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylantern.config import ALERT_TYPE, DEFAULT, NAME_PLACEHOLDER, TA_TEMPLATE, Config
from studylantern.functions import digest_uuid, fill, fixed, moment, stable_bucket, text_to_html
from studylantern.operators.lifecycle import one_outcome
from studylantern.operators.drafts import EVENT_COLUMNS, SPECIFIC, event_row, learner_context, message_fields
from studylantern.operators.skew import join_facts


def outbox(approved: DataFrame, pii: DataFrame, override: str | None = None) -> DataFrame:
    """Address and personalise approved drafts.

    With an override the text goes to that address unchanged. Without one the
    recipient comes from the PII table and the name placeholder is replaced; a
    learner without PII gets a ``failure_reason``.
    """
    if override:
        return approved.select(
            "draft_id", "user_id", "subject", F.lit(override).alias("to_address"), F.col("html_body").alias("html"),
            F.lit(None).cast("string").alias("failure_reason"),
        )
    people = pii.select("user_id", "email", "full_name", F.lit(True).alias("on_file"))
    absent = F.col("on_file").isNull()
    reason = F.concat(F.lit("no contact details stored for learner "), F.col("user_id").cast("string"))
    return approved.join(people, "user_id", "left").select(
        "draft_id",
        "user_id",
        "subject",
        F.col("email").alias("to_address"),
        F.when(~absent, F.replace(F.col("html_body"), F.lit(NAME_PLACEHOLDER), F.col("full_name"))).alias("html"),
        F.when(absent, reason).alias("failure_reason"),
    )


def recipient_list(addresses: str) -> str:
    """Comma separated addresses, stripped, blanks dropped."""
    return ", ".join(a.strip() for a in addresses.split(",") if a.strip())


def ta_briefings(
    escalated: DataFrame, users: DataFrame, signals: DataFrame, enrollments: DataFrame, outcomes: DataFrame,
    as_of=None, cfg: Config = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(briefing event rows, escalations that could not be briefed).

    ``escalated`` holds the ``escalated`` event rows of this batch and
    ``outcomes`` the send results by original ``draft_id``. Each briefing is a
    new draft that passes pending_review and approved, then sent or failed. An
    escalation whose learner has no user row is returned among the failures.
    """
    ids = ("draft_id", "user_id", "flag_code", "reviewer_id", "review_notes")
    named = escalated.select(*ids)
    ready = bool(recipient_list(cfg.ta_recipients))
    unknown = F.concat(F.lit("no user row for learner "), F.coalesce(F.col("user_id").cast("string"), F.lit("(no id)")))
    reason = unknown if ready else F.lit("Config.ta_recipients is empty")
    lost = named.join(users.select("user_id"), "user_id", "left_anti") if ready else named
    failure = lost.select("draft_id", "user_id", reason.alias("failure_reason"))
    if not ready:
        named = named.limit(0)

    context = learner_context(users, signals, enrollments, named).select("user_id", F.struct(*SPECIFIC).alias("specific"))
    briefed = join_facts(named.join(one_outcome(outcomes), "draft_id", "left"), context, ["user_id"])
    learner = F.col("user_id").cast("string")
    fields = {
        **message_fields(cfg),
        "learner_name": F.concat(F.lit("Student "), learner),
        "escalation.student_user_id": learner,
        "escalation.flag_code": F.coalesce(F.nullif(F.col("flag_code"), F.lit("")), F.lit("unknown")),
        "escalation.reviewer_id": F.coalesce("reviewer_id", F.lit("None")),
        "escalation.reviewer_notes": F.coalesce(F.nullif(F.col("review_notes"), F.lit("")), F.lit("none given")),
    }
    flag = F.coalesce(F.nullif(F.col("flag_code"), F.lit("")), F.lit("—"))
    briefed = (
        briefed.withColumn("rendered_template", fill(cfg.ta_template, fields))
        .withColumn("html_body", text_to_html(F.col("rendered_template")))
        .withColumn("subject", fill(cfg.ta_subject, {"user_id": learner, "flag": flag}))
        .withColumn("send_status", F.when(F.col("ok"), "sent").when(~F.col("ok"), "failed"))
    )
    now = moment(as_of)
    shared = dict(
        draft_id=digest_uuid(F.lit("briefing"), F.col("draft_id")),
        user_id=F.col("user_id"), nudge_type=ALERT_TYPE, template_id=TA_TEMPLATE, subject=F.col("subject"),
        html_body=F.col("html_body"), flag_code=F.col("flag_code"), rendered_template=F.col("rendered_template"),
        created_at=now,
    )
    sent = F.col("send_status") == "sent"
    by_reviewer = dict(shared, reviewer_id=F.col("reviewer_id"))
    steps = [
        F.struct(*event_row(**shared, delivery_status="pending_review", step=F.lit(0))),
        F.struct(*event_row(**by_reviewer, delivery_status="approved", step=F.lit(1))),
        F.when(
            F.col("send_status").isNotNull(),
            F.struct(
                *event_row(
                    **by_reviewer, delivery_status=F.col("send_status"), review_notes=F.when(~sent, F.col("error")),
                    provider_message_id=F.when(sent, F.col("message_id")), delivered_at=F.when(sent, now), step=F.lit(2),
                )
            ),
        ),
    ]
    rows = briefed.select(F.inline(F.array_compact(F.array(*steps)))).select(*EVENT_COLUMNS)
    return rows, failure


def variant_letters(cfg: Config = DEFAULT) -> dict[str, list[str]]:
    """Sorted variant letters per message kind."""
    kinds: dict[str, list[str]] = {}
    for kind, letter in sorted(cfg.variants):
        kinds.setdefault(kind, []).append(letter)
    return kinds


def assign_variant(
    df: DataFrame, key: str, kind: str = "flag_type", requested: str | None = None, cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``variant_id``, rows whose kind or requested letter is unknown).

    The letter is the requested one or a pick by the hash of ``key``, so it is
    stable across re-runs. The letters come from the configuration as a
    constant map, so this is a projection.
    """
    known = F.create_map(
        *[part for k, ls in variant_letters(cfg).items() for part in (F.lit(k), F.array(*[F.lit(x) for x in ls]))]
    )
    letters = F.try_element_at(known, F.col(kind))
    wanted = F.nullif(F.col(requested), F.lit("")) if requested else F.lit(None).cast("string")
    # the size of an absent list is null, and so is the pick
    picked = F.get(letters, stable_bucket(F.col(key).cast("string"), F.array_size(letters)))
    problem = F.when(
        letters.isNull(), F.concat(F.lit("no variants of kind "), F.coalesce(F.col(kind), F.lit("(none)")))
    ).when(
        ~F.array_contains(letters, F.col("variant_id")),
        F.concat(F.lit("kind "), F.col(kind), F.lit(" has no variant "), F.col("variant_id")),
    )
    judged = df.withColumn("variant_id", F.coalesce(wanted, picked)).withColumn("reject_reason", problem)
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()).drop("variant_id"),
    )


def late_notices(submissions: DataFrame, assignments: DataFrame, cfg: Config = DEFAULT, variant: str | None = "a") -> DataFrame:
    """One notice per late (learner, assignment). ``variant=None`` spreads the letters by a stable hash."""
    late = submissions.filter(F.col("days_from_deadline") < 0).select("user_id", "assignment_id", "days_from_deadline")
    facts = late.join(assignments.select("assignment_id", "name", "due_at_roadmap"), "assignment_id").withColumn(
        "flag_type", F.lit("late_sub")
    )
    facts = facts.withColumn("notice_key", F.concat_ws("|", "user_id", "assignment_id"))
    if variant is None:
        facts, _ = assign_variant(facts, "notice_key", cfg=cfg)
    else:
        facts = facts.withColumn("variant_id", F.lit(variant))
    fields = {
        "learner_name": F.lit(NAME_PLACEHOLDER),
        "course_name": F.lit(cfg.course_name),
        "specific.assignment_name": F.coalesce("name", F.lit("")),
        "specific.original_deadline": F.date_format("due_at_roadmap", "yyyy-MM-dd"),
        "specific.days_late": fixed(F.abs("days_from_deadline"), 1),
    }
    text = F.lit(None).cast("string")
    for (kind, letter), wording in cfg.variants.items():
        if kind == "late_sub":
            text = F.when(F.col("variant_id") == letter, fill(wording, fields)).otherwise(text)
    return facts.select("user_id", "assignment_id", "variant_id", text.alias("rendered_template"))
