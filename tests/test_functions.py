import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studylantern import functions as fn
from studylantern.functions import labels


def values(spark, column, rows, ddl="x string"):
    frame = spark.createDataFrame([(r,) for r in rows], ddl)
    return [r[0] for r in frame.select(column).collect()]


def test_rounding_equals_binary_half_even(spark):
    random.seed(7)
    xs = [2.675, -10.35, 1.005, 0.125, -0.001, 0.0, 1e13 + 0.126] + [random.uniform(-80, 80) for _ in range(3000)]
    xs += [k / 200 for k in range(-2000, 2000)]
    for digits in (1, 2, 3):
        got = values(spark, fn.py_round(F.col("x"), digits), xs, "x double")
        assert [repr(v) for v in got] == [repr(round(x, digits)) for x in xs]
    assert values(spark, fn.fixed(F.col("x"), 1), xs, "x double") == [f"{x:.1f}" for x in xs]


def test_rounding_keeps_null(spark):
    assert values(spark, fn.py_round(F.col("x"), 2), [None], "x double") == [None]


def test_hours_round_half_away_from_zero(spark):
    # 180 s = 0.05 h and 540 s = 0.15 h are ties in decimal arithmetic
    assert values(spark, fn.hours(F.col("x")), [180, 540, 3600, None], "x int") == [0.1, 0.2, 1.0, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\rab  x", max_size=8), min_size=1, max_size=20))
def test_strip_is_unicode_aware(spark, texts):
    assert values(spark, fn.strip(F.col("x")), texts) == [t.strip() for t in texts]


def test_first_truthy_skips_empty_text(spark):
    frame = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("a", "b", "c"), ("", "", "")], "a string, b string, c string")
    assert [r[0] for r in frame.select(fn.first_truthy(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", "b", "a", None]


def test_bool_int(spark):
    assert values(spark, fn.bool_int(F.col("x")), [True, False, None], "x boolean") == [1, 0, 0]


def test_flag_code(spark):
    assert values(spark, fn.flag_code(F.col("x")), ["R1: text: more", " Y1b : t", "manual note", "", None]) == [
        "R1", "Y1b", None, None, None,
    ]


def test_fill_rejects_unknown_fields(spark):
    with pytest.raises(ValueError, match="nope"):
        fn.fill("a {{ nope }}", {"x": F.lit(1)})
    assert values(spark, fn.fill("{{x}}-{{ x }}!", {"x": F.col("x")}), ["a"]) == ["a-a!"]


def test_text_to_html(spark):
    text = "**bold** and *it*\nline\n\n  \n\nlast **a** *b* "
    assert values(spark, fn.text_to_html(F.col("x")), [text]) == [
        "<p><strong>bold</strong> and <em>it</em>\nline</p>\n<p>last <strong>a</strong> <em>b</em></p>"
    ]


def test_silence_is_elapsed_periods_not_calendar_days(spark):
    now = fn.moment("2024-01-31 12:00:00")
    rows = ["2024-01-30 13:00:00", "2024-01-30 12:00:00", "2024-01-31 17:00:00", None]
    assert values(spark, fn.days_since(F.col("x").cast("timestamp"), now), rows) == [0, 1, -1, None]


def test_days_between_is_positive_when_early(spark):
    due = F.lit("2024-01-10T23:59:00Z")
    rows = ["2024-01-09T23:59:00Z", "2024-01-12T11:59:00Z", "", None, "not a time"]
    got = values(spark, fn.days_between(fn.iso_timestamp(due), fn.iso_timestamp(F.col("x"))), rows)
    assert got == [1.0, -1.5, None, None, None]


def test_digest_uuid_is_stable_and_shaped(spark):
    (one, two) = values(spark, fn.digest_uuid(F.col("x"), F.lit(1)), ["a", "a"])
    assert one == two and [len(p) for p in one.split("-")] == [8, 4, 4, 4, 12]


def test_labels(spark):
    assert values(spark, labels.timing_label(F.col("x")), [1.25, -3.0, 0.0, None], "x double") == ["+1.2d", "-3.0d", "+0.0d", "no data"]
    assert values(spark, labels.silence_label(F.col("x")), [None, 0, 3, -1], "x int") == ["never", "today", "3d ago", "-1d ago"]
    assert values(spark, labels.score_label(F.col("x")), [71.25, 0.0, None], "x double") == ["71.2%", "N/A", "N/A"]
    assert values(spark, labels.trend_label(F.col("x")), [None, "completed", "", "odd"]) == [
        "No submissions", "Completed ✅", "none yet", "odd",
    ]
    assert values(spark, labels.early_late_label(F.col("x")), [0.0, -0.01, None], "x double") == ["Early", "Late", "Late"]
    assert values(spark, labels.status_icon(F.col("x")), ["sent", "odd"]) == ["🟢", "·"]
    assert values(spark, fn.local_display(F.col("x").cast("timestamp"), "Africa/Kigali"), ["2024-01-31 23:30:00"]) == ["Feb 01, 01:30"]


def test_gate_label(spark):
    frame = spark.createDataFrame([(1, "SVD", 0), (1, "SVD", 3), (1, "SVD", None), (0, None, None), (None, None, None)], "a int, n string, d int")
    got = [r[0] for r in frame.select(labels.gate_label(F.col("a"), F.col("n"), F.col("d"))).collect()]
    assert got == ["⚠️ SVD TODAY", "⚠️ SVD in 3d", "⚠️ SVD TODAY", "", ""]
