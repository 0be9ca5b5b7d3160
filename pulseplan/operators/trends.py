"""Active users and enrollments per period, and their change between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import period_end, period_label, period_start, ratio
from ..settings import ACTIVE_BIWEEK_THRESHOLD
from .activity import is_active


def _per_period(counts: DataFrame, weeks: int, value: str) -> DataFrame:
    start = F.col("period_start")
    return counts.select(
        start,
        period_end(start, weeks).alias("period_end"),
        period_label(start, weeks).alias("bi_week"),
        value,
    ).orderBy("period_start")


def get_active_users_biweekly(
    fact_patient_day: DataFrame,
    active_threshold: int = ACTIVE_BIWEEK_THRESHOLD,
    weeks: int = 1,
) -> DataFrame:
    """Patients with ``active_threshold`` or more active days in each period.

    ``weeks=1``, the default, gives the periods this metric is reported with:
    Tuesday to Monday, despite the name. ``weeks=2`` gives true 14-day periods.
    A period without such a patient is absent.
    """
    per_patient = (
        fact_patient_day.filter(
            is_active() & F.col("patient_id").isNotNull() & F.col("date").isNotNull()
        )
        .groupBy("patient_id", period_start(F.col("date"), weeks).alias("period_start"))
        .agg(F.count(F.lit(1)).alias("active_days"))
    )
    return users_per_period(per_patient, active_threshold, weeks)


def users_per_period(per_patient: DataFrame, active_threshold: int, weeks: int) -> DataFrame:
    """`get_active_users_biweekly` from (patient_id, period_start, active_days)."""
    counts = (
        per_patient.filter(F.col("active_days") >= active_threshold)
        .groupBy("period_start")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    return _per_period(counts, weeks, "active_users")


def get_enrollments_biweekly(patients: DataFrame, weeks: int = 1) -> DataFrame:
    """Newly enrolled patients in each period; see `get_active_users_biweekly`."""
    counts = (
        patients.filter(F.col("enrollment_date").isNotNull())
        .groupBy(period_start(F.col("enrollment_date"), weeks).alias("period_start"))
        .agg(F.count(F.lit(1)).alias("new_patients"))
    )
    return _per_period(counts, weeks, "new_patients")


def calculate_period_changes(
    df: DataFrame, value_col: str, order_col: str = "period_start"
) -> DataFrame:
    """Add change and pct_change against the previous row that is present.

    ``df`` is a table of one row per period, so the window over all of it is
    bounded by the calendar, not by the data.
    """
    value = f"`{value_col}`"
    before = F.lag(value_col).over(Window.orderBy(order_col))
    return (
        df.withColumn("_before", before)
        .withColumn("change", F.expr(f"{value} - _before"))
        .withColumn("pct_change", (ratio(value, "_before") - 1) * 100)
        .drop("_before")
    )


def period_change_rows(
    df: DataFrame, value_col: str, order_col: str = "period_start"
) -> DataFrame:
    """`calculate_period_changes` without the first row, which has no change."""
    changes = calculate_period_changes(df, value_col, order_col)
    return changes.filter(F.col("change").isNotNull())
