"""Retention by active days in the first thirty days after enrollment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import percent_sql
from ..settings import (
    FIRST_MONTH_DAYS,
    RETENTION_MAX_DAYS,
    RETENTION_MILESTONES,
    TOP_DROPOFFS,
)
from .activity import FIRST_MONTH_COLUMN, activity_since


def get_active_days_in_first_30(
    patients: DataFrame, fact_patient_day: DataFrame
) -> DataFrame:
    """(patient_id, active_days_in_first_30) of every enrolled patient."""
    enrolled = patients.filter(F.col("enrollment_date").isNotNull())
    month = activity_since(
        enrolled,
        fact_patient_day,
        "enrollment_date",
        FIRST_MONTH_DAYS,
        ["enrollment_date"],
    )
    days = F.coalesce("active_sum", F.lit(0)).cast("int")
    return month.select("patient_id", days.alias(FIRST_MONTH_COLUMN))


def first_30_statistics(active_days: DataFrame) -> DataFrame:
    """One row: patients, mean and median of active_days_in_first_30."""
    return active_days.agg(
        F.count(F.lit(1)).alias("patients"),
        F.avg(FIRST_MONTH_COLUMN).alias("mean"),
        F.median(FIRST_MONTH_COLUMN).alias("median"),
    )


def retention_counts(days: str = FIRST_MONTH_COLUMN) -> list[Column]:
    """Aggregates over patients: all of them, and those with 0, 1, .. 30 days.

    ``days`` is a SQL expression; a patient for whom it is NULL is left out.
    """
    reached = ", ".join(
        f"count_if({days} >= {k})" for k in range(RETENTION_MAX_DAYS + 1)
    )
    return [
        F.expr(f"count({days}) AS patients"),
        F.expr(f"array({reached}) AS reached"),
    ]


def retention_rows(counts: DataFrame, *keep: str) -> DataFrame:
    """One row per threshold from the one row of `retention_counts`."""
    rows = counts.selectExpr(
        *keep,
        "patients",
        "reached",
        "posexplode(reached) AS (active_days_threshold, users_reached)",
    ).withColumn("before", F.expr("get(reached, active_days_threshold - 1)"))
    share = percent_sql("users_reached", "patients")
    lost = percent_sql("before - users_reached", "before")
    return rows.selectExpr(
        *keep,
        "active_days_threshold",
        "users_reached",
        f"coalesce({share}, 0.0D) AS pct_reached",
        "coalesce(before - users_reached, 0) AS drop_from_previous",
        f"coalesce({lost}, 0.0D) AS drop_pct",
    )


def get_retention_by_active_days(active_days: DataFrame) -> DataFrame:
    """How many patients reached 0, 1, .. 30 active days, and where they dropped.

    One conditional count per threshold, all in a single pass over the patients;
    the 31 rows are then laid out from that one row, so no join or window runs.
    """
    return retention_rows(active_days.agg(*retention_counts()))


def top_dropoffs(retention: DataFrame, n: int = TOP_DROPOFFS) -> DataFrame:
    """The ``n`` thresholds that lose most patients, the lower one on a tie."""
    return (
        retention.filter(F.col("active_days_threshold") > 0)
        .orderBy(F.desc("drop_from_previous"), "active_days_threshold")
        .limit(n)
    )


def retention_milestones(
    retention: DataFrame, thresholds: Sequence[int] = RETENTION_MILESTONES
) -> DataFrame:
    """The rows of the thresholds that are reported."""
    return retention.filter(F.col("active_days_threshold").isin(*thresholds))
