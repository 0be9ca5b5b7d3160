"""The daily fact as one small row per patient, clinic and month, to report from.

A row holds its month as bits, one for each day: days with a row (``seen``), with a flag
(``flagged``) and with an active row (``active``). What repeated rows of a day add to its bits
is listed in ``repeats``, which is empty for a fact with one row per patient and day;
``scores`` lists each day's highest fall-risk score. Any window of whole days is then a mask
and a count of bits, and rows of different months add up: a month can be replaced without
reading the others. Against the fact, joins with the patients meet about a thirtieth of the rows.

``is_active_day`` is 0, 1 or NULL and ``date`` a date; anything else is an error. Rows without
a date are in no window and are left out. NULL patients and clinics have rows of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, has_dates, months_after, period_start
from ..functions.calendar import DateLike
from ..settings import CURVE_DAYS, FIRST_MONTH_DAYS, MONTH_PARTITION

#: Counts that a row keeps as bits.
COUNTS = ("seen", "flagged", "active")
_LAST_BIT = 30


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def _checked_flag() -> Column:
    flag = F.col("is_active_day")
    message = F.concat(F.lit("is_active_day is neither 0 nor 1: "), flag.cast("string"))
    return F.when(flag.isNull() | flag.isin(0, 1), flag).otherwise(F.raise_error(message))


def month_states(fact: DataFrame) -> DataFrame:
    """patient_id, clinic_id, date_month, the bits of `COUNTS`, repeats and scores.

    Rows are counted per patient, clinic and day in each task first, so that a patient with
    very many rows is one row per day and task when they are shuffled.
    """
    if not has_dates(fact, "date"):
        raise ValueError("column date holds times; the states of a month count whole days")
    score = F.col("fall_risk_score").cast("double")
    days = (
        fact.filter(F.col("date").isNotNull())
        .withColumn("is_active_day", _checked_flag())
        .groupBy("patient_id", "clinic_id", "date")
        .agg(
            F.count(F.lit(1)).alias("seen"),
            F.count("is_active_day").alias("flagged"),
            F.count_if(F.col("is_active_day") == 1).alias("active"),
            F.max(F.nanvl(score, F.lit(None).cast("double"))).alias("score"),
        )
    )
    place = F.dayofmonth("date") - 1
    bits = [
        F.bit_or(F.when(F.col(c) > 0, _bit(place)).otherwise(F.lit(0).cast("long"))).alias(c)
        for c in COUNTS
    ]
    more = [F.greatest(F.col(c) - 1, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    repeated = F.when(F.col("seen") > 1, F.struct(place.alias("place"), *more))
    scored = F.when(F.col("score").isNotNull(), F.struct(place.alias("place"), "score"))
    return days.groupBy(
        "patient_id", "clinic_id", F.trunc("date", "MM").alias(MONTH_PARTITION)
    ).agg(
        *bits,
        F.collect_list(repeated).alias("repeats"),
        F.collect_list(scored).alias("scores"),
    )


def _place(day: Column) -> Column:
    """Bit of ``day`` in the row's month, or just outside of it."""
    days = F.datediff(day, F.col(MONTH_PARTITION))
    return F.least(F.greatest(days, F.lit(0)), F.lit(_LAST_BIT + 1))


def days_in(count: str, start: Column, end: Column) -> Column:
    """What the row counts under ``count`` on the days ``[start, end)``."""
    first, last = _place(start), _place(end)
    mask = _bit(F.greatest(first, last)) - _bit(first)
    zero = F.lit(0).cast("long")
    more = F.aggregate(
        "repeats",
        zero,
        lambda total, r: total
        + F.when((r["place"] >= first) & (r["place"] < last), r[count]).otherwise(zero),
    )
    return F.bit_count(F.col(count).bitwiseAND(mask)).cast("long") + more


def high_score_days(start: Column, end: Column, threshold: float) -> Column:
    """Days of the row in ``[start, end)`` with a score of ``threshold`` or more."""
    first, last = _place(start), _place(end)
    high = F.filter(
        "scores",
        lambda s: (s["place"] >= first) & (s["place"] < last) & (s["score"] >= threshold),
    )
    return F.size(high).cast("long")


def states_within(states: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Rows of the months that ``[start, end)`` touches."""
    month = F.col(MONTH_PARTITION)
    first = as_date(start).replace(day=1)
    last = as_date(end) - dt.timedelta(days=1)
    return states.filter((month >= F.lit(first)) & (month <= F.lit(last)))


def clinic_days(states: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """(clinic_id, total_days, active_days) of clinics with a row on the days ``[start, end)``."""
    window = F.lit(as_date(start)), F.lit(as_date(end))
    return (
        states_within(states, start, end)
        .select("clinic_id", *[days_in(c, *window).alias(c) for c in COUNTS])
        .filter(F.col("seen") > 0)
        .groupBy("clinic_id")
        .agg(F.sum("flagged").alias("total_days"), F.sum("active").alias("active_days"))
    )


def period_days(states: DataFrame, weeks: int = 1) -> DataFrame:
    """(patient_id, period_start, active_days) of each patient's periods with an active day.

    A month meets at most six periods; a period in two months adds up from both.
    """
    month = F.col(MONTH_PARTITION)
    periods = F.sequence(
        period_start(month, weeks), F.last_day(month), F.expr(f"INTERVAL '{7 * weeks}' DAY")
    )
    start = F.col("period_start")
    return (
        states.filter((F.col("active") != 0) & F.col("patient_id").isNotNull())
        .withColumn("period_start", F.explode(periods))
        .select(
            "patient_id",
            "period_start",
            days_in("active", start, F.date_add(start, 7 * weeks)).alias("active"),
        )
        .filter(F.col("active") > 0)
        .groupBy("patient_id", "period_start")
        .agg(F.sum("active").alias("active_days"))
    )


def _anchored(patients: DataFrame, states: DataFrame, anchor: str, last_day: int) -> DataFrame:
    """Rows of patients with an ``anchor`` beside it, of the months that can matter."""
    if not has_dates(patients, anchor):
        raise ValueError(f"column {anchor} holds times; the states of a month count whole days")
    anchors = patients.filter(F.col(anchor).isNotNull()).select("patient_id", anchor)
    return months_after(states, anchors, anchor, last_day).join(anchors, "patient_id")


def days_after(
    patients: DataFrame, states: DataFrame, anchor: str, last_day: int = CURVE_DAYS
) -> DataFrame:
    """(day, patient, active): each patient's days ``0..last_day`` after ``anchor`` with a row.

    ``patient`` is the id in a struct, ``active`` the active rows of that day.
    """
    shift = F.datediff(F.col(anchor), F.col(MONTH_PARTITION))
    places = F.filter(
        F.sequence(F.lit(0), F.lit(_LAST_BIT)),
        lambda p: (F.col("seen").bitwiseAND(_bit(p)) != 0)
        & (p - shift).between(0, last_day),
    )
    day = F.date_add(F.col(MONTH_PARTITION), F.col("place"))
    return (
        _anchored(patients, states, anchor, last_day)
        .withColumn("place", F.explode(places))
        .select(
            (F.col("place") - shift).alias("day"),
            F.struct("patient_id").alias("patient"),
            days_in("active", day, F.date_add(day, 1)).alias("active"),
        )
        .groupBy("day", "patient")
        .agg(F.sum("active").alias("active"))
    )


def activity_after(
    patients: DataFrame,
    states: DataFrame,
    anchor: str,
    keep: list[str],
    days: int = FIRST_MONTH_DAYS,
) -> DataFrame:
    """Every patient with ``keep`` and the active rows on days ``[0, days)`` after ``anchor``.

    active_rows and active_sum are equal, as flags are 0 or 1, and NULL without an active row.
    """
    start = F.col(anchor)
    counts = (
        _anchored(patients, states, anchor, days - 1)
        .select("patient_id", days_in("active", start, F.date_add(start, days)).alias("active"))
        .filter(F.col("active") > 0)
        .groupBy("patient_id")
        .agg(F.sum("active").alias("active_rows"))
        .withColumn("active_sum", F.col("active_rows"))
    )
    return patients.select("patient_id", *keep).join(counts, "patient_id", "left")
