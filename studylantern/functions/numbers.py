"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value half to even."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def py_round(c: Column, digits: int) -> Column:
    """Round the exact binary value half to even.

    ``round``/``bround`` decide on the shortest decimal form of the double
    instead, so they differ on values such as 2.675. Away from a tie the
    nearest multiple is beyond doubt and plain arithmetic gives it; only values
    next to a tie (or huge ones) go through the slower exact text form.
    """
    unit = F.lit(float(10**digits))
    scaled = c.cast("double") * unit
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.499999)
    return F.when(clear, whole / unit).otherwise(fixed(c, digits).cast("double"))


def bool_int(c: Column) -> Column:
    """0/1 from a nullable boolean-like column; null is 0."""
    return F.coalesce(c.cast("boolean").cast("int"), F.lit(0))


def hours(seconds: Column) -> Column:
    """Seconds as hours with one decimal, half away from zero (decimal arithmetic)."""
    return F.round(seconds.cast("decimal(20,4)") / F.lit(3600).cast("decimal(20,4)"), 1).cast("double")


def hundredths(c: Column) -> Column:
    """A two-decimal double as a whole number of hundredths.

    Integer sums do not depend on row order, and stay in fixed-width
    aggregation buffers, unlike wide decimals.
    """
    return F.rint(c.cast("double") * F.lit(100.0)).cast("long")
