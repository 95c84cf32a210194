"""Time expressions. The session time zone is UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylantern.functions.numbers import py_round

DAY_MICROS = 86_400_000_000


def moment(as_of: Column | datetime | str | None) -> Column:
    """Evaluation time as a column; ``None`` is now, naive values are UTC."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        aware = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        as_of = aware.astimezone(timezone.utc).isoformat()
    return F.lit(as_of).cast("timestamp")


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text (``Z`` or offset) to timestamp; empty or malformed text is null."""
    return F.nullif(c.cast("string"), F.lit("")).try_cast("timestamp")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def days_between(due: Column, done: Column) -> Column:
    """Days from ``done`` to ``due``, two decimals, positive when early; null if either is null."""
    return py_round((_micros(due) - _micros(done)) / F.lit(1e6) / F.lit(86400.0), 2)


def days_since(ts: Column, now: Column) -> Column:
    """Whole 24-hour periods elapsed (floor), negative for a future ``ts``."""
    gap = _micros(now) - _micros(ts)
    return ((gap - F.pmod(gap, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int")


def local_display(ts: Column, zone: str) -> Column:
    """``Mon dd, HH:MM`` in the given zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "MMM dd, HH:mm")
