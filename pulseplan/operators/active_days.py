"""Active-day rate: in total, by clinic, per patient and since enrollment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_percent, percent, within
from ..functions.calendar import DateLike
from ..settings import CURVE_DAYS
from .activity import days_since, patient_activity


def get_total_active_rate(
    fact_patient_day: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
) -> DataFrame:
    """One row: total_patient_days, total_active_days, active_days_rate."""
    return (
        within(fact_patient_day, start_date, end_date)
        .agg(
            F.count(F.lit(1)).alias("total_patient_days"),
            F.coalesce(F.sum("is_active_day"), F.lit(0)).alias("total_active_days"),
        )
        .withColumn(
            "active_days_rate",
            guarded_percent("total_active_days", "total_patient_days"),
        )
    )


def get_active_rate_by_clinic(
    fact_patient_day: DataFrame,
    clinics: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
) -> DataFrame:
    """Days, active days and rate of each clinic, highest rate first.

    The rows are counted per clinic_id before the join, so a clinic with most
    of the rows is one row per task by then. Rows without a known clinic drop.
    """
    counted = (
        within(fact_patient_day, start_date, end_date)
        .groupBy("clinic_id")
        .agg(
            F.count("is_active_day").alias("total_days"),
            F.coalesce(F.sum("is_active_day"), F.lit(0)).alias("active_days"),
        )
    )
    return rate_by_clinic(counted, clinics)


def rate_by_clinic(counted: DataFrame, clinics: DataFrame) -> DataFrame:
    """`get_active_rate_by_clinic` from (clinic_id, total_days, active_days)."""
    named = clinics.select("clinic_id", "clinic_name").filter(
        F.col("clinic_name").isNotNull()
    )
    return (
        counted.join(named, "clinic_id")
        .select(
            "clinic_id",
            "clinic_name",
            "total_days",
            "active_days",
            percent("active_days", "total_days").alias("active_rate"),
        )
        .orderBy(F.desc("active_rate"), "clinic_id")
    )


def get_patient_active_distribution(
    fact_patient_day: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
) -> DataFrame:
    """(patient_id, active_days) of every patient seen in the window, 0 included."""
    return patient_activity(fact_patient_day, start_date, end_date)


def active_day_statistics(distribution: DataFrame) -> DataFrame:
    """One row: mean, median, min, max of active_days; NULLs for no patients.

    The exact median keeps a count per distinct value, and there are only as
    many values as days in the window.
    """
    days = F.col("active_days")
    return distribution.agg(
        F.avg(days).alias("mean"),
        F.median(days).alias("median"),
        F.min(days).alias("min"),
        F.max(days).alias("max"),
    )


def get_active_rate_by_day_since_enrollment(
    patients: DataFrame,
    fact_patient_day: DataFrame,
    days_after_enrollment: int = CURVE_DAYS,
) -> DataFrame:
    """Patients with data, active days and rate on each day 0..N after enrollment.

    Days without data are present with zeros.
    """
    # One row per patient and day first: the patients are then simply counted.
    per_patient = (
        days_since(patients, fact_patient_day, "enrollment_date", days_after_enrollment)
        .groupBy("day", "patient")
        .agg(F.coalesce(F.sum("is_active_day"), F.lit(0)).alias("active"))
    )
    return rate_by_day(per_patient, days_after_enrollment)


def rate_by_day(per_patient: DataFrame, days_after_enrollment: int = CURVE_DAYS) -> DataFrame:
    """`get_active_rate_by_day_since_enrollment` from (day, patient, active)."""
    by_day = per_patient.groupBy(F.col("day").alias("day_since_enrollment")).agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.sum("active").alias("active_patients"),
    )
    days = per_patient.sparkSession.range(0, days_after_enrollment + 1, 1, 1).select(
        F.col("id").cast("int").alias("day_since_enrollment")
    )
    total, active = F.col("total_patients"), F.col("active_patients")
    rate = percent("active_patients", "total_patients")
    # by_day has at most days_after_enrollment + 1 rows.
    return (
        days.join(F.broadcast(by_day), "day_since_enrollment", "left")
        .select(
            "day_since_enrollment",
            F.coalesce(total, F.lit(0)).alias("total_patients"),
            F.coalesce(active, F.lit(0)).alias("active_patients"),
            F.coalesce(rate, F.lit(0.0)).alias("active_rate"),
        )
        .orderBy("day_since_enrollment")
    )


def enrollment_curve_summary(curve: DataFrame) -> DataFrame:
    """One row: mean, median, min and max rate over the days of the curve."""
    rate = F.col("active_rate")
    return curve.agg(
        F.avg(rate).alias("mean_active_rate"),
        F.median(rate).alias("median_active_rate"),
        F.min(rate).alias("min_active_rate"),
        F.max(rate).alias("max_active_rate"),
    )
