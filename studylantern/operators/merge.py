"""Keyed merge of an incoming batch into a current-state table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class MergeRule:
    """Which columns a re-sent key overwrites and which it leaves alone."""

    keys: tuple[str, ...]
    update: tuple[str, ...] = ()
    insert_only: tuple[str, ...] = ()
    nullable_keys: tuple[str, ...] = ()


# --- fixed values: merge rule of every table ---------------------------------
MERGE_RULES = {
    "users": MergeRule(("user_id",), ("email", "sis_user_id", "login_id", "updated_at")),
    "assignments": MergeRule(
        ("assignment_id",), ("name", "due_at_roadmap", "updated_at"), ("course_id", "due_at", "points_possible")
    ),
    "enrollments": MergeRule(
        ("enrollment_id",),
        ("type", "role", "enrollment_state", "last_activity_at", "total_activity_time", "current_score",
         "final_score", "updated_at"),
        ("course_id", "user_id", "created_at"),
    ),
    "student_summaries": MergeRule(
        ("user_id",),
        ("page_views", "participations", "tardiness_on_time", "tardiness_late", "tardiness_missing",
         "tardiness_floating", "tardiness_total", "pulled_at"),
        ("max_page_views", "max_participations"),
    ),
    "submissions": MergeRule(
        ("assignment_id", "user_id"),
        ("score", "submitted_at", "workflow_state", "late", "missing", "days_from_deadline", "updated_at"),
        ("submission_id", "grade", "graded_at"),
    ),
    "quizzes": MergeRule(
        ("quiz_id",),
        ("title", "quiz_type", "points_possible", "due_at", "published", "question_count", "updated_at"),
        ("course_id",),
    ),
    "quiz_submissions": MergeRule(
        ("quiz_id", "user_id", "attempt"),
        ("score", "kept_score", "workflow_state", "started_at", "finished_at", "updated_at"),
        ("quiz_submission_id",),
        nullable_keys=("attempt",),
    ),
    "course_activity": MergeRule(("activity_date",), ("views", "participations"), ("activity_id",)),
    "student_pii": MergeRule(
        ("user_id",),
        ("full_name", "email", "person_reference_id", "prefix", "most_recent_role", "most_recent_employer", "loaded_at"),
    ),
    "student_risk_signals": MergeRule(
        ("user_id",),
        ("avg_days_from_deadline", "timing_trend", "days_since_last_login", "total_submissions", "zero_submissions",
         "engagement_ratio", "gate_approaching", "gate_name", "days_until_gate", "computed_at"),
    ),
}


def rule_for(table: str) -> MergeRule:
    """Merge rule of a table; the demographics rule follows from its header map."""
    if table == "student_demographics":
        from studylantern.schemas import DEMOGRAPHIC_HEADERS

        return MergeRule(("user_id",), (*DEMOGRAPHIC_HEADERS.values(), "loaded_at"))
    return MERGE_RULES[table]


def split_keyless(incoming: DataFrame, rule: MergeRule) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, rows that lack a key). Keys that the rule calls nullable may be absent."""
    lacking = _any_null(tuple(k for k in rule.keys if k not in rule.nullable_keys))
    return incoming.filter(~lacking), incoming.filter(lacking)


def settle_batch(incoming: DataFrame, rule: MergeRule, ordinal: str) -> DataFrame:
    """One row per key: updated columns from the last arrival, insert-only columns from the first.

    ``ordinal`` ranks the arrivals of a key, without ties. Where it is a number, only keys and ordinals are aggregated, in
    fixed-width buffers that combine before the shuffle, and the records are picked by semi-joins on (key, ordinal), which
    deal the copies of a hot key over all tasks. Any other ordinal goes through ``max_by``/``min_by`` of whole records.
    """
    if not isinstance(incoming.schema[ordinal].dataType, NumericType):
        return _settle_by_records(incoming, rule, ordinal)
    keys, at = list(rule.keys), F.col(ordinal)
    ends = incoming.groupBy(*keys).agg(F.max(at).alias("_last"), F.min(at).alias("_first"))

    def picked(end: str, columns: tuple[str, ...]) -> DataFrame:
        chosen = ends.select(*keys, F.col(end).alias(ordinal))
        return incoming.select(*keys, ordinal, *columns).join(chosen, [*keys, ordinal], "left_semi").drop(ordinal)

    last = picked("_last", rule.update)
    return last.join(picked("_first", rule.insert_only), keys) if rule.insert_only else last


def _settle_by_records(incoming: DataFrame, rule: MergeRule, ordinal: str) -> DataFrame:
    merged = []
    if rule.update:
        merged.append(F.max_by(F.struct(*rule.update), F.col(ordinal)).alias("_last"))
    if rule.insert_only:
        merged.append(F.min_by(F.struct(*rule.insert_only), F.col(ordinal)).alias("_first"))
    return incoming.groupBy(*rule.keys).agg(*merged).select(
        *rule.keys,
        *[F.col(f"_last.{c}").alias(c) for c in rule.update],
        *[F.col(f"_first.{c}").alias(c) for c in rule.insert_only],
    )


def settled(incoming: DataFrame, rule: MergeRule, ordinal: str | None = None) -> DataFrame:
    """A batch ready for ``upsert`` without ordinal: one row per key, and all rows that lack a nullable key."""
    if ordinal is None:
        return incoming
    missing = _any_null(rule.nullable_keys)
    one = settle_batch(incoming.filter(~missing) if rule.nullable_keys else incoming, rule, ordinal)
    return one.unionByName(incoming.filter(missing).select(*one.columns)) if rule.nullable_keys else one


def _any_null(names: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNull()
    return found


def upsert(
    base: DataFrame, incoming: DataFrame, rule: MergeRule, ordinal: str | None = None, small_batch: bool = False
) -> DataFrame:
    """Merged table with the columns of ``base``.

    A re-sent key takes the incoming ``update`` columns (a null overwrites)
    and keeps its ``insert_only`` columns. ``base`` columns outside the rule
    stay, and are null on new rows. Keys with a null never conflict: such rows
    bypass the join and are all kept.

    The default is one full outer join, right for feeds that re-send the whole
    table. With ``small_batch`` the table is only streamed past the batch
    (left join, plus a keys-only scan to find the new ones), which Spark runs
    as broadcast joins while the batch is below its threshold and as sorted
    joins beyond it; either way the result is the same.
    """
    loose_base = loose_new = None
    if rule.nullable_keys:
        missing = _any_null(rule.nullable_keys)
        loose_base, base = base.filter(missing), base.filter(~missing)
        loose_new, incoming = incoming.filter(missing), incoming.filter(~missing)
    if ordinal is not None:
        incoming = settle_batch(incoming, rule, ordinal)

    columns = base.columns
    carried = [c for c in (*rule.update, *rule.insert_only) if c in incoming.columns]
    batch = incoming.select(*rule.keys, *[F.col(c).alias(f"_new_{c}") for c in carried], F.lit(True).alias("_sent"))
    stored = base.withColumn("_stored", F.lit(True))

    def resolved(name: str) -> Column:
        if name in rule.keys or name not in carried:
            return F.col(name)
        new = F.col(f"_new_{name}")
        if name in rule.update:
            return F.when(F.col("_sent"), new).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_stored"), F.col(name)).otherwise(new).alias(name)

    keys = list(rule.keys)
    if small_batch:
        kept = stored.join(batch, keys, "left").select(*[resolved(c) for c in columns])
        known = base.select(*keys).join(batch.select(*keys), keys, "left_semi")
        fresh = batch.join(known, keys, "left_anti").select(
            *keys, *[F.col(f"_new_{c}").alias(c) for c in carried]
        )
        merged = kept.unionByName(fresh, allowMissingColumns=True)
    else:
        merged = stored.join(batch, keys, "full_outer").select(*[resolved(c) for c in columns])

    if rule.nullable_keys:
        merged = merged.unionByName(loose_base)
        merged = merged.unionByName(loose_new.select(*rule.keys, *carried), allowMissingColumns=True)
    return merged.select(*columns)


def _first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    # a rank filter of this form is cut to one row per key in each map task,
    # before the exchange, so a key holding most rows stays cheap
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def insert_missing(base: DataFrame, incoming: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """Add the rows whose key is absent; existing rows are untouched, the first arrival of a new key wins."""
    if ordinal is not None:
        incoming = _first_per_key(incoming, keys, ordinal).drop(ordinal)
    fresh = incoming.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def dedupe_keep_first(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Keep the row with the smallest id of every key; null keys form one group."""
    return _first_per_key(df, keys, id_col)
