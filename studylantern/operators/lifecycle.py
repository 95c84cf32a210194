"""Review lifecycle over the append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, Config
from studylantern.functions import moment, strip
from studylantern.operators.drafts import DRAFT_FIELDS, EVENT_COLUMNS, event_row
from studylantern.operators.skew import join_facts

# --- fixed values: state a decision needs, and the states it leads to --------
PENDING = "pending_review"
ACTIONS = {"approve": "approved", "reject": "rejected", "escalate": "escalated"}


def latest_state(nudge_events: DataFrame) -> DataFrame:
    """Newest row of every draft by (created_at, nudge_id)."""
    return _newest(nudge_events, _order_key())


def latest_by_id(nudge_events: DataFrame) -> DataFrame:
    """Newest row of every draft by ``nudge_id`` alone."""
    return _newest(nudge_events, F.col("nudge_id"))


def _order_key() -> Column:
    """(created_at, nudge_id) as one number, a missing time first: it fits the fixed-width buffer of a hash aggregate."""
    micros = F.coalesce(F.unix_micros("created_at"), F.lit(-(2**61))).cast("decimal(20,0)")
    return micros * F.lit(str(2**64)).cast("decimal(20,0)") + F.col("nudge_id").cast("decimal(20,0)")


def _newest(events: DataFrame, order: Column) -> DataFrame:
    """Late materialisation: the winners are found from (draft, order) alone, then their rows are taken by a semi-join.

    A ``nudge_id`` is given once, so each draft gets one row. Message columns are in no aggregate; where the winners are few
    Spark broadcasts them and no message is moved.
    """
    keyed = events.withColumn("_order", order)
    newest = keyed.groupBy("draft_id").agg(F.max("_order").alias("_newest")).withColumnRenamed("draft_id", "_draft")
    same = F.col("draft_id").eqNullSafe(F.col("_draft")) & (F.col("_order") == F.col("_newest"))
    return keyed.join(newest, same, "left_semi").select("draft_id", *[c for c in events.columns if c != "draft_id"])


def pending_drafts(nudge_events: DataFrame) -> DataFrame:
    """Rows awaiting review that are the highest id of their draft.

    Only (draft_id, nudge_id) of the whole log is aggregated; the wide message
    columns are read and moved for pending rows only.
    """
    last = nudge_events.groupBy("draft_id").agg(F.max("nudge_id").alias("nudge_id"))
    waiting = nudge_events.filter((F.col("delivery_status") == PENDING) & (F.col("nudge_type") != "escalation_alert"))
    return waiting.join(last, ["draft_id", "nudge_id"], "left_semi")


def status_counts(nudge_events: DataFrame) -> DataFrame:
    """Drafts per current state."""
    return latest_state(nudge_events).groupBy("delivery_status").agg(F.count(F.lit(1)).alias("n_drafts"))


def _input_problem(cfg: Config) -> Column:
    """What is wrong with a decision by itself, regardless of the draft."""
    note = F.length(strip(F.coalesce("notes", F.lit(""))))
    return (
        F.when(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS), "unknown action")
        .when((F.col("action") == "reject") & (note < cfg.min_note_chars), f"note needs at least {cfg.min_note_chars} characters")
    )


def _draft_verdicts(nudge_events: DataFrame, decisions: DataFrame, cfg: Config) -> DataFrame:
    """One row per draft named in the batch: its state and its first usable decision.

    Both sides are reduced to one row per draft before they meet, so many
    decisions on one draft stay cheap. Only the log rows of named drafts are
    reduced to their newest state.
    """
    named = decisions.filter(F.col("draft_id").isNotNull())
    usable = named.filter(_input_problem(cfg).isNull())
    order = F.struct("decided_at", "decision_id")
    first = usable.groupBy("draft_id").agg(
        F.min_by(F.struct("decision_id", "action", "reviewer_id", "notes"), order).alias("first")
    )
    relevant = nudge_events.join(named.select("draft_id").distinct(), "draft_id", "left_semi")
    state = latest_state(relevant.select("draft_id", "nudge_id", "created_at", "delivery_status", *DRAFT_FIELDS))
    verdict = state.join(first, "draft_id", "left")
    accepted = (F.col("delivery_status") == PENDING) & F.col("first").isNotNull()
    return verdict.withColumn("accepted_id", F.when(accepted, F.col("first.decision_id")))


def one_outcome(outcomes: DataFrame) -> DataFrame:
    """One send result per draft, however often it was reported: a success before a failure, then by message id and error."""
    order = F.struct((~F.coalesce("ok", F.lit(False))).alias("worse"), "message_id", "error", "ok")
    best = outcomes.filter(F.col("draft_id").isNotNull()).groupBy("draft_id").agg(F.min(order).alias("best"))
    return best.select("draft_id", *[F.col(f"best.{c}").alias(c) for c in ("ok", "message_id", "error")])


def _reviewed(nudge_events: DataFrame, decisions: DataFrame, outcomes: DataFrame, pii: DataFrame, cfg: Config) -> DataFrame:
    """One row per draft named in the batch: verdict, send result and the state it is in afterwards.

    Events and rejects both come from this frame, so state, outcome and contact meet once. ``send_status`` of an
    accepted approval is ``sent``, ``failed``, or null while no result is known.
    """
    verdicts = _draft_verdicts(nudge_events, decisions, cfg)
    on_file = pii.select("user_id", F.lit(True).alias("has_pii"))
    joined = verdicts.join(one_outcome(outcomes), "draft_id", "left").join(on_file, "user_id", "left")
    accepted, action = F.col("accepted_id").isNotNull(), F.col("first.action")
    approving = accepted & (action == "approve")
    unknown_recipient = F.concat(F.lit("no contact details stored for learner "), F.col("user_id").cast("string"))
    sent = joined.withColumn(
        "send_status",
        F.when(approving & F.col("has_pii").isNull(), "failed").when(approving & F.col("ok"), "sent").when(
            approving & ~F.col("ok"), "failed"
        ),
    ).withColumn("send_error", F.when(F.col("has_pii").isNull(), unknown_recipient).otherwise(F.col("error")))
    led_to = F.when(action == "approve", "approved").when(action == "reject", "rejected").otherwise("escalated")
    return sent.withColumn("state_after", F.coalesce("send_status", F.when(accepted, led_to), "delivery_status"))


def _decision_rows(sent: DataFrame, as_of) -> DataFrame:
    now = moment(as_of)
    copied = {n: F.col(n) for n in DRAFT_FIELDS}
    action = F.col("first.action")
    status = F.when(action == "approve", "approved").when(action == "reject", "rejected").otherwise("escalated")
    note = F.nullif(strip(F.col("first.notes")), F.lit(""))
    decided = event_row(
        draft_id=F.col("draft_id"), **copied, delivery_status=status, reviewer_id=F.col("first.reviewer_id"),
        review_notes=F.when(action != "approve", note), created_at=now, step=F.lit(0),
    )
    is_sent = F.col("send_status") == "sent"
    finished = event_row(
        draft_id=F.col("draft_id"), **copied, delivery_status=F.col("send_status"), reviewer_id=F.col("first.reviewer_id"),
        review_notes=F.when(~is_sent, F.col("send_error")), provider_message_id=F.when(is_sent, F.col("message_id")),
        delivered_at=F.when(is_sent, now), created_at=now, step=F.lit(1),
    )
    second = F.when(F.col("send_status").isNotNull(), F.struct(*finished))
    return sent.select(F.inline(F.array_compact(F.array(F.struct(*decided), second)))).select(*EVENT_COLUMNS)


def apply_decisions(
    nudge_events: DataFrame, decisions: DataFrame, outcomes: DataFrame, pii: DataFrame, as_of=None, cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(event rows to append, rejected decisions with a reason).

    Per draft the first usable decision by (decided_at, decision_id) is taken
    if the draft is pending. Approval writes ``approved`` and then ``sent`` or
    ``failed``; without a reported outcome the draft stays ``approved`` until
    ``record_outcomes`` gets one.
    """
    reviewed = _reviewed(nudge_events, decisions, outcomes, pii, cfg)
    return _decision_rows(reviewed.filter(F.col("accepted_id").isNotNull()), as_of), _rejects(reviewed, decisions, cfg)


def record_outcomes(nudge_events: DataFrame, outcomes: DataFrame, as_of=None) -> DataFrame:
    """Event rows ``sent`` or ``failed`` for the drafts and briefings whose newest state is ``approved``.

    Mail leaves after the approval, so results usually arrive in a later batch.
    Drafts in another state, and results without ``ok``, are passed over, so a
    result reported twice is recorded once.
    """
    known = one_outcome(outcomes.filter(F.col("ok").isNotNull()))
    narrow = nudge_events.select("draft_id", "nudge_id", "created_at", "delivery_status", "reviewer_id", *DRAFT_FIELDS)
    state = latest_state(narrow.join(known.select("draft_id"), "draft_id", "left_semi"))
    now, is_sent = moment(as_of), F.col("ok")
    finished = event_row(
        draft_id=F.col("draft_id"), **{n: F.col(n) for n in DRAFT_FIELDS}, delivery_status=F.when(is_sent, "sent").otherwise("failed"),
        reviewer_id=F.col("reviewer_id"), review_notes=F.when(~is_sent, F.col("error")),
        provider_message_id=F.when(is_sent, F.col("message_id")), delivered_at=F.when(is_sent, now), created_at=now, step=F.lit(0),
    )
    waiting = state.filter(F.col("delivery_status") == "approved").join(known, "draft_id")
    return waiting.select(F.struct(*finished).alias("row")).select("row.*").select(*EVENT_COLUMNS)


def _rejects(reviewed: DataFrame, decisions: DataFrame, cfg: Config) -> DataFrame:
    per_draft = reviewed.select("draft_id", "accepted_id", F.col("state_after").alias("state"), F.lit(True).alias("known"))
    wrong_state = F.concat(
        F.col("action"), F.lit(" needs a pending draft, but "), F.col("draft_id"), F.lit(" is "), F.col("state"),
    )
    missing = F.concat(F.lit("the log holds no draft "), F.coalesce("draft_id", F.lit("(no id)")))
    problem = (
        F.when(_input_problem(cfg).isNotNull(), _input_problem(cfg))
        .when(F.col("known").isNull(), missing)
        .when(F.col("accepted_id").isNull() | (F.col("accepted_id") != F.col("decision_id")), wrong_state)
    )
    return (
        join_facts(decisions, per_draft, ["draft_id"], "left")
        .select("decision_id", "draft_id", "action", "reviewer_id", problem.alias("reject_reason"))
        .filter(F.col("reject_reason").isNotNull())
    )
