"""Patient count, billable, active and high-fall-risk patients."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, guarded_percent, percent, within
from ..functions.calendar import DateLike
from ..settings import (
    ANALYSIS_DATE,
    BILLING_THRESHOLD,
    FALL_RISK_LOOKBACK_DAYS,
    FALL_RISK_THRESHOLD,
)
from .activity import patient_activity, row_count


def get_patient_count(patients: DataFrame) -> DataFrame:
    """Number of patient rows."""
    return patients.agg(row_count().alias("patient_count"))


def _reached(threshold: int) -> Column:
    # A patient without any active day never qualifies, whatever the threshold.
    return F.col("active_days") >= max(threshold, 1)


def _over_all_patients(
    summary: DataFrame, patients: DataFrame | None, count: str, rate: str
) -> DataFrame:
    """Add the rate over all patients, not only those seen in the window."""
    if patients is None:
        return summary
    everyone = get_patient_count(patients).scalar()
    return summary.withColumn("all_patients", everyone).withColumn(
        rate, percent(count, "all_patients")
    )


def get_billable_patients(
    fact_patient_day: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """Patients with at least ``threshold`` active days in ``[start, end)``.

    One row: billable_count, total_patients (seen in the window), billable_rate.
    """
    return (
        patient_activity(fact_patient_day, start_date, end_date)
        .agg(
            F.count_if(_reached(threshold)).alias("billable_count"),
            F.count(F.lit(1)).alias("total_patients"),
        )
        .withColumn(
            "billable_rate",
            guarded_percent("billable_count", "total_patients"),
        )
    )


def get_billable_patient_ids(
    fact_patient_day: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """patient_id of each patient `get_billable_patients` counts."""
    return (
        patient_activity(fact_patient_day, start_date, end_date)
        .filter(_reached(threshold))
        .select("patient_id")
    )


def get_active_patients(
    fact_patient_day: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    patients: DataFrame | None = None,
) -> DataFrame:
    """Patients with at least one active day in ``[start, end)``.

    One row: active_count, total_patients, active_rate; with ``patients`` also
    all_patients and active_rate_all, the rate over every patient on file.
    """
    summary = (
        patient_activity(fact_patient_day, start_date, end_date)
        .agg(
            F.count_if(_reached(1)).alias("active_count"),
            F.count(F.lit(1)).alias("total_patients"),
        )
        .withColumn(
            "active_rate",
            guarded_percent("active_count", "total_patients"),
        )
    )
    return _over_all_patients(summary, patients, "active_count", "active_rate_all")


def _recent(fact: DataFrame, analysis_date: DateLike, lookback_days: int) -> DataFrame:
    """Rows of the lookback, closed on both ends."""
    last = as_date(analysis_date)
    return within(
        fact, last - dt.timedelta(days=lookback_days), last + dt.timedelta(days=1)
    )


def at_risk(threshold: float) -> Column:
    """Whether a row's score counts; NaN means no score, it is not the largest."""
    score = F.col("fall_risk_score").cast("double")
    return F.nanvl(score, F.lit(None).cast("double")) >= threshold


def get_high_fall_risk_patients(
    fact_patient_day: DataFrame,
    analysis_date: DateLike = ANALYSIS_DATE,
    lookback_days: int = FALL_RISK_LOOKBACK_DAYS,
    threshold: float = FALL_RISK_THRESHOLD,
    patients: DataFrame | None = None,
) -> DataFrame:
    """Patients with any score of ``threshold`` or more in the lookback.

    One row: high_risk_count, total_patients, high_risk_rate; with ``patients``
    also all_patients and high_risk_rate_all.
    """
    summary = (
        _recent(fact_patient_day, analysis_date, lookback_days)
        .filter(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(F.count_if(at_risk(threshold)).alias("high_scores"))
        .agg(
            F.count_if(F.col("high_scores") > 0).alias("high_risk_count"),
            F.count(F.lit(1)).alias("total_patients"),
        )
        .withColumn(
            "high_risk_rate",
            guarded_percent("high_risk_count", "total_patients"),
        )
    )
    return _over_all_patients(
        summary, patients, "high_risk_count", "high_risk_rate_all"
    )


def get_high_fall_risk_patient_ids(
    fact_patient_day: DataFrame,
    analysis_date: DateLike = ANALYSIS_DATE,
    lookback_days: int = FALL_RISK_LOOKBACK_DAYS,
    threshold: float = FALL_RISK_THRESHOLD,
) -> DataFrame:
    """patient_id of each patient `get_high_fall_risk_patients` counts."""
    return (
        _recent(fact_patient_day, analysis_date, lookback_days)
        .filter(F.col("patient_id").isNotNull() & at_risk(threshold))
        .select("patient_id")
        .distinct()
    )
