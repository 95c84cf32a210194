"""Message drafts for open flags that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, NAME_PLACEHOLDER, Config
from studylantern.functions import digest_uuid, fill, fixed, flag_code, moment, py_round, text_to_html
from studylantern.operators.flags import open_flags
from studylantern.operators.signals import primary_enrollment
from studylantern.operators.skew import join_facts
from studylantern.sources.dims import route_dim

# what one lifecycle row carries besides its id; ``step`` orders the rows of
# one draft within a batch
EVENT_COLUMNS = (
    "draft_id", "user_id", "computation_id", "nudge_type", "flag_code", "template_id", "variant_id", "channel",
    "delivery_status", "subject", "html_body", "rendered_template", "langsmith_run_id", "reviewer_id", "review_notes",
    "provider_message_id", "delivered_at", "created_at", "step",
)
DRAFT_FIELDS = (
    "user_id", "computation_id", "nudge_type", "flag_code", "template_id", "variant_id", "subject", "html_body",
    "rendered_template", "langsmith_run_id",
)


def flags_without_drafts(flag_events: DataFrame, nudge_events: DataFrame) -> DataFrame:
    """Open flags with a parseable code and no draft of that learner and code, whatever its state."""
    drafted = (
        nudge_events.filter(F.col("flag_code").isNotNull()).select("user_id", F.col("flag_code").alias("raw_code")).distinct()
    )
    readable = open_flags(flag_events).select(
        "flag_id", "user_id", "reason",
        F.substring_index("reason", ":", 1).alias("raw_code"),
        flag_code(F.col("reason")).alias("flag_code"),
    ).filter(F.col("flag_code").isNotNull())
    return join_facts(readable, drafted, ["user_id", "raw_code"], "left_anti").select("flag_id", "user_id", "flag_code", "reason")


def route_flags(candidates: DataFrame, routes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates with template, type and severity; candidates whose code has no route)."""
    table = F.broadcast(route_dim(candidates.sparkSession)) if routes is None else routes  # only the constant has a known size
    return candidates.join(table, "flag_code"), candidates.join(table, "flag_code", "left_anti")


def learner_context(users: DataFrame, signals: DataFrame, enrollments: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row per learner with everything a message may mention, defaults filled in.

    With ``only`` the three frames are cut to the learners named there before
    they are aggregated and joined.

    ``avg_days_late`` is unsigned even for early learners. The two ``_text``
    columns are the printed numbers: an absent value prints as a bare 0.
    """
    if only is not None:
        named = only.select("user_id").distinct()
        users, signals, enrollments = (df.join(named, "user_id", "left_semi") for df in (users, signals, enrollments))
    avg = F.abs("avg_days_from_deadline")
    score = F.col("current_score")

    def printed(value: Column) -> Column:
        return F.when(value.isNull(), "0").otherwise(fixed(value, 1))

    silent = F.coalesce("days_since_last_login", F.lit(0))
    return (
        users.select("user_id")
        .join(signals.drop("computed_at"), "user_id", "left")
        .join(primary_enrollment(enrollments).select("user_id", "current_score"), "user_id", "left")
        .select(
            "user_id",
            silent.alias("days_inactive"),
            silent.alias("days_since_login"),
            F.coalesce(py_round(avg, 1), F.lit(0.0)).alias("avg_days_late"),
            F.coalesce("total_submissions", F.lit(0)).alias("submission_count"),
            F.coalesce(py_round(score, 1), F.lit(0.0)).alias("current_score"),
            F.coalesce(F.nullif(F.col("gate_name"), F.lit("")), F.lit("your next gate")).alias("gate_name"),
            F.coalesce("days_until_gate", F.lit(0)).alias("days_to_gate"),
            F.coalesce(F.nullif(F.col("timing_trend"), F.lit("")), F.lit("unknown")).alias("timing_trend"),
            printed(avg).alias("avg_days_late_text"),
            printed(score).alias("current_score_text"),
        )
    )


SPECIFIC = (
    "days_inactive", "days_since_login", "avg_days_late", "submission_count", "current_score", "gate_name",
    "days_to_gate", "timing_trend", "avg_days_late_text", "current_score_text",
)


def nudge_context(candidates: DataFrame, users: DataFrame, signals: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Candidates with the message context as a ``specific`` struct; a learner without a user row is skipped.

    The learner side is complete before the join, so the candidates take part
    in exactly one join, one whose hot partitions Spark can split.
    """
    context = learner_context(users, signals, enrollments, candidates).select("user_id", F.struct(*SPECIFIC).alias("specific"))
    return join_facts(candidates, context, ["user_id"])


def message_fields(cfg: Config) -> dict[str, Column]:
    """Names a template may use, as columns over ``nudge_context``."""
    fields = {f"specific.{n}": F.col(f"specific.{n}") for n in SPECIFIC if not n.endswith("_text")}
    fields["specific.avg_days_late"] = F.col("specific.avg_days_late_text")
    fields["specific.current_score"] = F.col("specific.current_score_text")
    fields["course_name"] = F.lit(cfg.course_name)
    fields["learner_name"] = F.lit(NAME_PLACEHOLDER)
    return fields


def _by_template(cfg: Config) -> Column:
    fields = {**message_fields(cfg), "severity": F.col("severity")}
    text = F.lit(None).cast("string")
    # severity-specific wording is tested before the general one
    for (name, severity), wording in sorted(cfg.templates.items(), key=lambda kv: kv[0][1] is not None):
        applies = F.col("template_id") == name
        if severity is not None:
            applies = applies & (F.col("severity") == severity)
        text = F.when(applies, fill(wording, fields)).otherwise(text)
    return text


def _subject(cfg: Config) -> Column:
    fields = {"course_name": F.lit(cfg.course_name), "nudge_type": F.col("nudge_type")}
    text = fill(cfg.fallback_subject, fields)
    for kind, wording in cfg.subjects.items():
        text = F.when(F.col("nudge_type") == kind, fill(wording, fields)).otherwise(text)
    return text


def render_drafts(context: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Routed candidates with context -> text, HTML and subject."""
    return (
        context.withColumn("rendered_template", _by_template(cfg))
        .withColumn("html_body", text_to_html(F.col("rendered_template")))
        .withColumn("subject", _subject(cfg))
    )


def event_row(**values: Column | str | None) -> list[Column]:
    """Projection of one lifecycle row. The channel is always e-mail; unset columns are null."""
    row: dict[str, Column] = {}
    types = {"user_id": "long", "computation_id": "long", "delivered_at": "timestamp", "created_at": "timestamp", "step": "int"}
    for name in EVENT_COLUMNS:
        value = values.get(name)
        if name == "channel":
            value = "email"
        column = value if isinstance(value, Column) else F.lit(value)
        row[name] = column.cast(types.get(name, "string")).alias(name)
    return list(row.values())


def generate_drafts(
    flag_events: DataFrame, nudge_events: DataFrame, users: DataFrame, signals: DataFrame, enrollments: DataFrame,
    as_of=None, cfg: Config = DEFAULT,
) -> DataFrame:
    """``pending_review`` rows for open flags without a draft; a second run over its own output adds none.

    The draft id is derived from learner, code and flag, so a repeated task or
    job produces the same draft.
    """
    routed, _ = route_flags(flags_without_drafts(flag_events, nudge_events))
    drafts = render_drafts(nudge_context(routed, users, signals, enrollments), cfg)
    return drafts.select(
        *event_row(
            draft_id=digest_uuid(F.col("user_id"), F.col("flag_code"), F.col("flag_id")),
            user_id=F.col("user_id"),
            nudge_type=F.col("nudge_type"),
            flag_code=F.col("flag_code"),
            template_id=F.col("template_id"),
            delivery_status="pending_review",
            subject=F.col("subject"),
            html_body=F.col("html_body"),
            rendered_template=F.col("rendered_template"),
            created_at=moment(as_of),
            step=F.lit(0),
        )
    )


def create_drafts(messages: DataFrame, as_of=None) -> DataFrame:
    """Register ready-made messages (columns of ``DRAFT_FIELDS`` plus ``draft_id``) as pending drafts."""
    have = set(messages.columns)
    values = {n: F.col(n) for n in ("draft_id", *DRAFT_FIELDS) if n in have}
    return messages.select(*event_row(**values, delivery_status="pending_review", created_at=moment(as_of), step=F.lit(0)))
