"""Column expressions: everything here stays inside the JVM."""

from studylantern.functions.numbers import bool_int, fixed, hours, py_round
from studylantern.functions.text import digest_uuid, fill, first_truthy, flag_code, stable_bucket, strip, text_to_html
from studylantern.functions.times import days_between, days_since, iso_timestamp, local_display, moment

__all__ = [
    "bool_int", "fixed", "hours", "py_round", "digest_uuid", "fill", "first_truthy", "flag_code", "stable_bucket",
    "strip", "text_to_html", "days_between", "days_since", "iso_timestamp", "local_display", "moment",
]
