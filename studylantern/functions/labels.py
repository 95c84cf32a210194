"""Display labels of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylantern.functions.numbers import fixed

# --- fixed values: icons and label texts -------------------------------------
SEVERITY_ICONS = {"red": "🔴 ", "yellow": "🟡 "}
OTHER_SEVERITY_ICON = "🟢 "
STATUS_ICONS = {
    "pending_review": "🟡",
    "approved": "🔵",
    "sent": "🟢",
    "rejected": "⚪",
    "failed": "🔴",
    "escalated": "⬆️",
}
OTHER_STATUS_ICON = "·"
TREND_LABELS = {
    "improving": "Improving",
    "worsening": "Worsening",
    "stable": "Stable",
    "insufficient_data": "Insufficient data",
    "no_data": "No submissions",
    "completed": "Completed ✅",
}


def _lookup(c: Column, values: dict[str, str], otherwise: Column) -> Column:
    (first_key, first_value), *rest = values.items()
    chain = F.when(c == first_key, first_value)
    for key, value in rest:
        chain = chain.when(c == key, value)
    return chain.otherwise(otherwise)


def severity_rank(flag_type: Column) -> Column:
    return F.when(flag_type == "red", 0).when(flag_type == "yellow", 1).otherwise(2)


def severity_icon(flag_type: Column) -> Column:
    return _lookup(flag_type, SEVERITY_ICONS, F.lit(OTHER_SEVERITY_ICON))


def status_icon(status: Column) -> Column:
    return _lookup(status, STATUS_ICONS, F.lit(OTHER_STATUS_ICON))


def timing_label(avg_days: Column) -> Column:
    signed = F.call_function("format_number", avg_days.cast("double"), F.lit("+0.0;-0.0"))
    return F.when(avg_days.isNull(), "no data").otherwise(F.concat(signed, F.lit("d")))


def silence_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "never").when(days == 0, "today").otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def gate_label(approaching: Column, name: Column, days: Column) -> Column:
    left = F.coalesce(days, F.lit(0))
    when_text = F.when(left == 0, "TODAY").otherwise(F.concat(F.lit("in "), left.cast("string"), F.lit("d")))
    return F.when(
        F.coalesce(approaching, F.lit(0)) != 0, F.concat(F.lit("⚠️ "), F.coalesce(name, F.lit("None")), F.lit(" "), when_text)
    ).otherwise("")


def trend_label(trend: Column) -> Column:
    known = _lookup(trend, TREND_LABELS, F.when(trend == "", "none yet").otherwise(trend))
    return F.when(trend.isNull(), "No submissions").otherwise(known)


def score_label(score: Column, digits: int = 1) -> Column:
    return F.when(score > 0, F.concat(fixed(score, digits), F.lit("%"))).otherwise("N/A")


def detail_score_label(score: Column, digits: int) -> Column:
    """Drill-down variant: only null and zero are unavailable."""
    return F.when(score != 0, F.concat(fixed(score, digits), F.lit("%"))).otherwise("N/A")


def early_late_label(days: Column) -> Column:
    return F.when(days >= 0, "Early").otherwise("Late")


def resolved_label(resolved: Column) -> Column:
    return F.when(resolved != 0, "✅ Resolved").otherwise("⏳ Open")


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))
