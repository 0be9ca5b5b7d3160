"""Patient and operations KPIs: rolling activity, compliance, drop-off, tasks, alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_date, as_moment, guarded_percent, until, within
from ..functions.calendar import DateLike
from ..settings import (
    BILLING_THRESHOLD,
    DROPOFF_MIN_DAYS,
    FIRST_MONTH_DAYS,
    ROLLING_WINDOWS,
)
from .activity import activity_since, daily_activity, is_active
from .order_statistics import exact_median, median_in_cells, top_cells

ASSESSMENT_DIMENSIONS = ("week_start", "clinic_id", "assessment_type")
_MICROS_PER_HOUR = 3_600_000_000


def rolling_active_days(
    fact_patient_day: DataFrame,
    windows: Sequence[int] = ROLLING_WINDOWS,
    one_row_per_day: bool = False,
) -> DataFrame:
    """Per patient and day, the active days of the last N calendar days.

    The frames are ranges over the day number, so missing days count as days.
    A patient's window must not hold more than a row per calendar day, so the
    fact is reduced to that first. ``one_row_per_day=True`` leaves the reduction
    and its shuffle out, for a table that is known to have that grain.
    """
    if one_row_per_day:
        daily = fact_patient_day.withColumnRenamed("is_active_day", "active_sum")
    else:
        daily = daily_activity(fact_patient_day)
    by_day = Window.partitionBy("patient_id").orderBy(F.unix_date("date"))
    return daily.select(
        "patient_id",
        "date",
        F.col("active_sum").cast("bigint").alias("is_active_day"),
        *[
            F.sum("active_sum").over(by_day.rangeBetween(1 - n, 0)).alias(f"active_{n}")
            for n in windows
        ],
    )


def _due(start: Column, days: int, as_of: DateLike) -> Column:
    """Whether ``days`` days counted from ``start`` are complete on ``as_of``."""
    complete = F.lit(as_date(as_of)) >= F.date_add(start, days - 1)
    return F.coalesce(complete, F.lit(False))


def active_days_snapshot(
    fact_patient_day: DataFrame,
    patients: DataFrame,
    as_of: DateLike,
    windows: Sequence[int] = ROLLING_WINDOWS,
) -> DataFrame:
    """Per patient on ``as_of``: active days of the last N days, and eligibility.

    ``eligible_N`` is false until N days have passed since first data.
    """
    day = as_date(as_of)
    recent = within(
        fact_patient_day,
        day - dt.timedelta(days=max(windows) - 1),
        day + dt.timedelta(days=1),
    )
    age = F.datediff(F.lit(day), F.col("date"))
    counts = recent.groupBy("patient_id").agg(
        *[
            F.sum(F.when(age < n, F.col("is_active_day"))).alias(f"active_{n}")
            for n in windows
        ]
    )
    people = patients.select("patient_id", "first_data_date")
    return people.join(counts, "patient_id", "left").select(
        "patient_id",
        *[F.coalesce(f"active_{n}", F.lit(0)).alias(f"active_{n}") for n in windows],
        *[_due(F.col("first_data_date"), n, day).alias(f"eligible_{n}") for n in windows],
    )


def compliance_16_30(
    fact_patient_day: DataFrame,
    patients: DataFrame,
    as_of: DateLike,
    threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """Per patient: active days in the first thirty days after first data.

    ``eligible`` once those thirty days are over on ``as_of``; ``compliant`` if
    eligible and at ``threshold`` or more.
    """
    month = activity_since(
        patients,
        until(fact_patient_day, as_of),
        "first_data_date",
        FIRST_MONTH_DAYS,
        ["first_data_date"],
    )
    days = F.coalesce("active_rows", F.lit(0))
    eligible = _due(F.col("first_data_date"), FIRST_MONTH_DAYS, as_of)
    return month.select(
        "patient_id",
        "first_data_date",
        days.alias("active_days_first_30"),
        eligible.alias("eligible"),
        (eligible & (days >= threshold)).alias("compliant"),
    )


def dropoff_risk(
    fact_patient_day: DataFrame,
    patients: DataFrame,
    as_of: DateLike,
    min_days: int = DROPOFF_MIN_DAYS,
) -> DataFrame:
    """Per patient: last active day, days since, and whether at risk.

    A patient who was never active has not started: not a drop-off.
    """
    last = (
        until(fact_patient_day, as_of)
        .filter(is_active())
        .groupBy("patient_id")
        .agg(F.max("date").cast("date").alias("last_active_date"))
    )
    since = F.datediff(F.lit(as_date(as_of)), F.col("last_active_date"))
    return (
        patients.select("patient_id")
        .join(last, "patient_id", "left")
        .withColumn("days_since_last_active", since)
        .withColumn(
            "status",
            F.when(since.isNull(), "pre_first_data")
            .when(since >= min_days, "at_risk")
            .otherwise("active"),
        )
        .withColumn("at_risk", F.col("status") == "at_risk")
    )


def _completion_counts(assignments: DataFrame, by: Sequence[str]) -> DataFrame:
    completed = F.col("status") == "completed"
    on_time = completed & (F.col("completed_ts").cast("date") <= F.col("due_date"))
    week = F.trunc(F.col("assigned_ts").cast("date"), "week")
    return (
        assignments.withColumn("week_start", week)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("assigned"),
            F.count_if(completed).alias("completed"),
            F.count_if(on_time).alias("completed_on_time"),
        )
    )


def _with_completion_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "completion_rate": guarded_percent("completed", "assigned"),
            "on_time_rate": guarded_percent("completed_on_time", "assigned"),
        }
    )


def _assigned_within(
    assignments: DataFrame, start: DateLike | None, end: DateLike | None
) -> DataFrame:
    """Rows assigned in ``[start, end)``; a bound that is not given is open."""
    rows, column = assignments, F.col("assigned_ts")
    if start is not None:
        rows = rows.filter(column >= F.lit(as_moment(start).isoformat(" ")).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(column < F.lit(as_moment(end).isoformat(" ")).cast("timestamp_ntz"))
    return rows


def assessment_completion(
    assignments: DataFrame,
    by: Sequence[str] = ASSESSMENT_DIMENSIONS,
    start: DateLike | None = None,
    end: DateLike | None = None,
) -> DataFrame:
    """Assigned, completed and completed by the due date, for each ``by`` group.

    Counts what was assigned in ``[start, end)``; without bounds, everything.
    ``week_start`` is the Monday of the week of assignment. Whether a late
    completion counts is left to the reader: both rates are there.
    """
    rows = _assigned_within(assignments, start, end)
    return _with_completion_rates(_completion_counts(rows, by))


def assessment_completion_sets(
    assignments: DataFrame,
    by: Sequence[str] = ASSESSMENT_DIMENSIONS,
    start: DateLike | None = None,
    end: DateLike | None = None,
) -> DataFrame:
    """The same, once per single dimension: ``dimension`` names the one a row is for.

    The assignments are counted down to one row per combination first; only
    those rows are expanded into the grouping sets.
    """
    cells = _completion_counts(_assigned_within(assignments, start, end), by)
    grouped = cells.groupingSets(
        [[F.col(c)] for c in by], *[F.col(c) for c in by]
    ).agg(
        *[
            F.when(F.grouping(c) == 0, F.lit(c)).alias(f"_{c}")
            for c in by
        ],
        F.sum("assigned").alias("assigned"),
        F.sum("completed").alias("completed"),
        F.sum("completed_on_time").alias("completed_on_time"),
    )
    named = grouped.select(
        F.coalesce(*[F.col(f"_{c}") for c in by]).alias("dimension"),
        *by,
        "assigned",
        "completed",
        "completed_on_time",
    )
    return _with_completion_rates(named)


def alert_ack(
    alerts: DataFrame, by: Sequence[str] = ("alert_type",), rescan: bool = False
) -> DataFrame:
    """Alerts, acknowledged alerts, rate and exact median hours to acknowledge.

    An alert without ``ack_ts`` lowers the rate and is not in the median.

    ``rescan``: for very many alerts. They are read three times, but no distinct wait is
    shuffled outside the cell that holds the median; the first of these passes also counts
    them. Counts of the first two are stored when this is called.
    """
    waits = alerts.withColumn(
        "wait", F.timestamp_diff("MICROSECOND", F.col("created_ts"), F.col("ack_ts"))
    )
    median = (F.col("median") / _MICROS_PER_HOUR).alias("median_hours_to_ack")
    if rescan:
        cells = top_cells(waits, by, "wait", F.count("ack_ts").alias("acked"))
        none = F.lit(0).cast("bigint")
        counts = cells.groupBy(*[F.col(f"_k{i + 1}").alias(c) for i, c in enumerate(by)]).agg(
            F.coalesce(F.sum("n"), none).alias("total"),
            F.coalesce(F.sum("acked"), none).alias("acked"),
        )
        medians = median_in_cells(waits, by, "wait", cells)
    else:
        counts = alerts.groupBy(*by).agg(
            F.count(F.lit(1)).alias("total"), F.count("ack_ts").alias("acked")
        )
        medians = exact_median(waits, by, "wait")
    counts = counts.withColumn("ack_rate", guarded_percent("acked", "total"))
    if not by:
        return counts.withColumn("median_hours_to_ack", medians.select(median).scalar())
    matches = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    medians = medians.select(*[F.col(c).alias(f"_{c}") for c in by], median)
    return counts.join(medians, matches, "left").drop(*[f"_{c}" for c in by])
