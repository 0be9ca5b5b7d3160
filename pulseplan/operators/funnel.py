"""The onboarding funnel: enrolled, installed, first data, 16/30 compliant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    floored_days,
    guarded_percent,
    half_even_sql,
    has_dates,
    percent_sql,
)
from ..settings import BILLING_THRESHOLD, FIRST_DATA_WITHIN_DAYS, FIRST_MONTH_DAYS
from .activity import FIRST_MONTH_COLUMN, activity_since

# --- fixed values: stage keys and the titles they are reported under ---
STAGES = (
    ("enrolled", "1. Enrolled"),
    ("installed", "2. Installed"),
    ("first_data", "3. First Data"),
    ("compliant", "4. 16/30 Compliant"),
)
# --- end of fixed values ---

STAGE_DATES = ["enrollment_date", "install_date", "first_data_date"]


def patient_stages(
    patients: DataFrame,
    fact_patient_day: DataFrame,
    billing_compliance_threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """Per patient, one flag for each stage, and the active days it rests on.

    The stages are independent sets: a patient can be installed, not enrolled. They
    count rows of ``patients``, which holds one row per patient.
    """
    month = activity_since(
        patients, fact_patient_day, "enrollment_date", FIRST_MONTH_DAYS, STAGE_DATES
    )
    return stages_of(month, billing_compliance_threshold)


def stages_of(
    month: DataFrame, billing_compliance_threshold: int = BILLING_THRESHOLD
) -> DataFrame:
    """`patient_stages` from patient_id, `STAGE_DATES` and the first month's activity."""
    if has_dates(month, "enrollment_date", "first_data_date"):
        wait = F.datediff("first_data_date", "enrollment_date")
    else:
        wait = floored_days(F.col("first_data_date"), F.col("enrollment_date"))
    compliant = F.col("active_rows") >= max(billing_compliance_threshold, 1)
    return month.select(
        "patient_id",
        F.col("enrollment_date").isNotNull().alias("enrolled"),
        F.col("install_date").isNotNull().alias("installed"),
        F.coalesce(wait.between(0, FIRST_DATA_WITHIN_DAYS), F.lit(False)).alias(
            "first_data"
        ),
        F.coalesce(compliant, F.lit(False)).alias("compliant"),
        F.coalesce("active_sum", F.lit(0)).cast("int").alias(FIRST_MONTH_COLUMN),
    )


def stage_counts() -> list[Column]:
    """Aggregates over `patient_stages`: patients per stage."""
    return [F.count_if(key).alias(key) for key, _ in STAGES]


def stage_figures() -> list[tuple[str, dict[str, str]]]:
    """Title of each stage, and its figures as SQL over `stage_counts`."""
    figures = []
    for position, (key, title) in enumerate(STAGES):
        previous = STAGES[position - 1][0]
        from_previous = half_even_sql(percent_sql(key, previous), 1)
        figures.append(
            (
                title,
                {
                    "count": key,
                    "rate_from_enrolled": half_even_sql(percent_sql(key, "enrolled"), 1),
                    "rate_from_previous": from_previous if position else "100.0D",
                },
            )
        )
    return figures


def funnel_rows(counts: DataFrame) -> DataFrame:
    """One row per stage from the one row of `stage_counts`."""
    rows = [
        f"struct('{title}' AS stage, "
        + ", ".join(f"{value} AS {name}" for name, value in figures.items())
        + ")"
        for title, figures in stage_figures()
    ]
    return counts.selectExpr(f"inline(array({', '.join(rows)}))")


def get_patient_funnel(
    patients: DataFrame,
    fact_patient_day: DataFrame,
    billing_compliance_threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """stage, count, rate_from_enrolled and rate_from_previous, four rows."""
    stages = patient_stages(patients, fact_patient_day, billing_compliance_threshold)
    return funnel_rows(stages.agg(*stage_counts()))


def get_stage_patients(
    patients: DataFrame,
    fact_patient_day: DataFrame,
    billing_compliance_threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """(stage, patient_id) of every patient in each stage."""
    return stage_members(
        patient_stages(patients, fact_patient_day, billing_compliance_threshold)
    )


def stage_members(stages: DataFrame) -> DataFrame:
    """(stage, patient_id) from `patient_stages`."""
    reached = F.array_compact(
        F.array(*[F.when(F.col(key), F.lit(key)) for key, _ in STAGES])
    )
    return stages.select(F.explode(reached).alias("stage"), "patient_id")


def funnel_conversion(
    patients: DataFrame,
    fact_patient_day: DataFrame,
    billing_compliance_threshold: int = BILLING_THRESHOLD,
) -> DataFrame:
    """One row: patients enrolled, patients compliant, and their percentage."""
    stages = patient_stages(patients, fact_patient_day, billing_compliance_threshold)
    return stages.agg(
        F.count_if("enrolled").alias("enrolled"),
        F.count_if("compliant").alias("compliant"),
    ).withColumn("rate", guarded_percent("compliant", "enrolled"))
