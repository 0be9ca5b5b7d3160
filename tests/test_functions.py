"""Null, zero, rounding and calendar rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import day
from pulseplan.functions import (
    default_window,
    floored_days,
    guarded_percent,
    half_even,
    period_end,
    period_label,
    period_start,
    ratio,
)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("n", "d", "expected"),
    [
        (1, 4, 0.25),
        (0, 0, None),
        (3, 0, math.inf),
        (-3, 0, -math.inf),
        (None, 2, None),
        (2, None, None),
        (None, 0, None),
    ],
)
def test_ratio_has_no_zero_division(spark, n, d, expected):
    n, d = ("NULL" if v is None else f"{v}L" for v in (n, d))
    assert one(spark, ratio(n, d)) == (expected,)


def test_guarded_percent_is_zero_without_denominator(spark):
    assert one(
        spark,
        guarded_percent("0", "0"),
        guarded_percent("1", "8"),
    ) == (0.0, 12.5)


def test_rounding_is_half_even(spark):
    values = [66.25, 12.35, 0.25, 0.75, 2.5]
    assert one(spark, *[half_even(f"{v}D", 1) for v in values]) == (
        66.2,
        12.4,
        0.2,
        0.8,
        2.5,
    )


def test_rounding_agrees_with_numpy(spark):
    import numpy as np

    pairs = [(n, d) for d in range(1, 90) for n in range(d + 1)]
    df = spark.createDataFrame(pairs, "n int, d int").select(
        "n", "d", half_even("CAST(n AS double) / d * 100", 1).alias("r")
    )
    for n, d, r in df.collect():
        assert r == np.round(n / d * 100, 1), (n, d)


@pytest.mark.parametrize(
    ("text", "weeks", "start", "end"),
    [
        ("2025-12-01", 1, "2025-11-25", "2025-12-01"),  # a Monday ends a period
        ("2025-12-02", 1, "2025-12-02", "2025-12-08"),  # a Tuesday starts one
        ("1969-12-29", 1, "1969-12-23", "1969-12-29"),
        ("1969-12-30", 2, "1969-12-30", "1970-01-12"),
        ("2024-01-15", 2, "2024-01-02", "2024-01-15"),
        ("2024-01-16", 2, "2024-01-16", "2024-01-29"),
    ],
)
def test_periods_run_tuesday_to_monday(spark, text, weeks, start, end):
    first = period_start(F.lit(day(text)), weeks)
    assert one(spark, first, period_end(first, weeks), period_label(first, weeks)) == (
        day(start),
        day(end),
        f"{start}/{end}",
    )


def test_every_day_is_in_its_period(spark):
    days = spark.range(-400, 21000).select(
        F.date_from_unix_date(F.col("id").cast("int")).alias("d")
    )
    for weeks in (1, 2):
        start = period_start(F.col("d"), weeks)
        wrong = days.filter(
            (F.col("d") < start)
            | (F.col("d") > period_end(start, weeks))
            | (F.dayofweek(start) != 3)
        )
        assert wrong.count() == 0


@pytest.mark.parametrize(
    ("later", "earlier", "expected"),
    [
        ("2024-01-01 18:00:00", "2024-01-02 00:00:00", -1),
        ("2024-01-02 18:00:00", "2024-01-02 00:00:00", 0),
        ("2024-01-03 00:00:00", "2024-01-02 00:00:00", 1),
        ("2024-01-02 23:59:59.999999", "2024-01-01 00:00:00", 1),
        ("2023-12-31 00:00:00", "2024-01-02 00:00:00", -2),
    ],
)
def test_day_offsets_of_timestamps_are_floored(spark, later, earlier, expected):
    stamps = [F.lit(t).cast("timestamp_ntz") for t in (later, earlier)]
    assert one(spark, floored_days(*stamps)) == (expected,)


def test_default_window_is_thirty_days_before_yesterday():
    assert default_window("2026-01-08") == (dt.date(2025, 12, 8), dt.date(2026, 1, 7))
