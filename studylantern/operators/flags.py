"""Flag rules over the risk signals, and their deduplication against open flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylantern.config import DEFAULT, FLAG_CODES, FLAG_SEVERITY, REASONS, Config
from studylantern.functions import fill, fixed, moment
from studylantern.functions.labels import severity_rank


@dataclass(frozen=True)
class Rule:
    code: str
    fires: Column
    inputs: tuple[str, ...]

    @property
    def severity(self) -> str:
        return FLAG_SEVERITY[self.code]


def rule_table(cfg: Config = DEFAULT) -> list[Rule]:
    """The eight rules as column conditions over ``rule_input``. Rules are independent of each other.

    A null operand makes a comparison null, hence not firing, which is what
    the rules want for an unknown silence, average or score.
    """
    none_yet = F.col("zero_submissions") != 0
    silent = F.col("days_since_last_login")
    avg = F.col("avg_days_from_deadline")
    n = F.col("total_submissions")
    few = n < cfg.min_submissions
    return [
        Rule("R1", none_yet & (silent > cfg.silent_red_days),
             ("zero_submissions", "days_since_last_login", "total_submissions")),
        Rule("R2", (avg < cfg.late_severe_days) & few, ("avg_days_from_deadline", "total_submissions")),
        Rule("R3", (F.col("gate_approaching") != 0) & (avg < cfg.late_days),
             ("gate_name", "days_until_gate", "avg_days_from_deadline")),
        Rule("Y1", none_yet & (silent > cfg.silent_yellow_days) & (silent <= cfg.silent_red_days),
             ("zero_submissions", "days_since_last_login", "engagement_ratio")),
        Rule("Y1b", none_yet & (silent <= cfg.silent_yellow_days),
             ("zero_submissions", "days_since_last_login", "engagement_ratio")),
        Rule("Y2", (avg >= cfg.late_severe_days) & (avg < cfg.late_days) & (n >= cfg.min_submissions),
             ("avg_days_from_deadline", "total_submissions", "timing_trend")),
        Rule("Y3", (F.col("timing_trend") == "worsening") & (avg < 0), ("timing_trend", "avg_days_from_deadline")),
        Rule("Y4", (n > 0) & F.col("low_score").isNotNull(), ("total_submissions", "current_score")),
    ]


def low_scores(enrollments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per learner the score that makes rule Y4 fire: of the enrollments with a low score, the lowest id's.

    Reducing enrollments before the join keeps one row per learner; the other
    seven rules do not look at enrollments at all.
    """
    low = enrollments.filter((F.col("final_score") > 0) & (F.col("final_score") < cfg.low_score))
    return low.groupBy("user_id").agg(F.min_by("final_score", "enrollment_id").alias("low_score"))


def rule_input(signals: DataFrame, enrollments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return signals.join(low_scores(enrollments, cfg), "user_id", "left")


def _reason(code: str) -> Column:
    avg = fixed(F.col("avg_days_from_deadline"), 1)
    return fill(
        REASONS[code],
        {
            "silent": F.col("days_since_last_login"),
            "avg": avg,
            "subs": F.col("total_submissions"),
            "gate": F.coalesce("gate_name", F.lit("None")),
            "gate_days": F.coalesce(F.col("days_until_gate").cast("string"), F.lit("None")),
            "score": fixed(F.col("low_score"), 1),
        },
    )


def _inputs(names: tuple[str, ...]) -> Column:
    cols = [F.col("low_score" if n == "current_score" else n).alias(n) for n in names]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def evaluate_rules(inputs: DataFrame, cfg: Config = DEFAULT, codes: tuple[str, ...] = FLAG_CODES) -> DataFrame:
    """Every firing (learner, rule) in one pass over the signals."""
    hits = [
        F.when(
            rule.fires,
            F.struct(
                F.lit(rule.code).alias("flag_code"),
                F.lit(rule.severity).alias("flag_type"),
                _reason(rule.code).alias("reason"),
                _inputs(rule.inputs).alias("inputs"),
            ),
        )
        for rule in rule_table(cfg)
        if rule.code in codes
    ]
    return inputs.select("user_id", F.inline(F.array_compact(F.array(*hits))))


def open_flags(flag_events: DataFrame) -> DataFrame:
    return flag_events.filter(F.col("resolved") == 0)


def suppressed_codes(flag_events: DataFrame) -> DataFrame:
    """Distinct (user_id, flag_code) that an open flag's reason text starts with.

    A ``Y1b`` reason also starts with ``Y1`` and so suppresses both. At most
    eight rows per learner leave the map side.
    """
    codes = F.array(*[F.lit(c) for c in FLAG_CODES])
    held = F.filter(codes, lambda code: F.startswith(F.col("reason"), code))
    return open_flags(flag_events).select("user_id", F.explode(held).alias("flag_code")).distinct()


def dedupe_new_flags(new: DataFrame, flag_events: DataFrame) -> DataFrame:
    """Drop new flags whose code is already open for the learner (plain equi anti join)."""
    return new.join(suppressed_codes(flag_events), ["user_id", "flag_code"], "left_anti")


def run_flags(
    signals: DataFrame, enrollments: DataFrame, flag_events: DataFrame, as_of=None, cfg: Config = DEFAULT
) -> DataFrame:
    """New flag rows to append (without ``flag_id``); a second run over its own output adds none."""
    fired = evaluate_rules(rule_input(signals, enrollments, cfg), cfg)
    return dedupe_new_flags(fired, flag_events).select(
        "user_id", moment(as_of).alias("flagged_at"), "flag_type", "reason", "inputs", F.lit(0).alias("resolved"), "flag_code"
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_code", "flag_type").agg(F.count(F.lit(1)).alias("n_flags"))


def worst_open_flag(flag_events: DataFrame) -> DataFrame:
    """Per learner the gravest open flag; newest first, then lowest id, among equals."""
    rank = F.struct(severity_rank(F.col("flag_type")), -F.unix_micros("flagged_at"), F.col("flag_id"))
    return (
        open_flags(flag_events)
        .groupBy("user_id")
        .agg(F.min_by(F.struct("flag_type", "reason"), rank).alias("worst"))
        .select("user_id", "worst.flag_type", "worst.reason")
    )


def latest_open_flag(flag_events: DataFrame) -> DataFrame:
    """Per (learner, code) the newest open flag. The code is the raw text before the first colon."""
    newest = F.struct("flagged_at", "flag_id")
    return (
        open_flags(flag_events)
        .select("user_id", F.substring_index("reason", ":", 1).alias("flag_code"), "reason", "flag_type", "flagged_at", "flag_id")
        .groupBy("user_id", "flag_code")
        .agg(F.max_by(F.struct("reason", "flag_type"), newest).alias("flag"))
        .select("user_id", "flag_code", F.col("flag.reason").alias("flag_reason"), "flag.flag_type")
    )
