"""Roll-ups of the daily fact table that several metrics share.

None of them gathers a patient's raw rows in one task, however many of the rows
one patient holds: rows are counted up per task before they are shuffled, and
the join with the patients (`days_since`) can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_offset, months_after, within
from ..functions.calendar import DateLike

FIRST_MONTH_COLUMN = "active_days_in_first_30"


def is_active() -> Column:
    return F.col("is_active_day") == 1


def row_count() -> Column:
    """Rows of a table; 0, not NULL, where empty tables are counted by their footers."""
    return F.greatest(F.count(F.lit(1)), F.lit(0).cast("long"))


def patient_activity(
    fact: DataFrame, start: DateLike | None = None, end: DateLike | None = None
) -> DataFrame:
    """(patient_id, active_days) of every patient with a row in the window."""
    return (
        within(fact, start, end)
        .filter(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(F.count_if(is_active()).alias("active_days"))
    )


def daily_activity(fact: DataFrame) -> DataFrame:
    """One row per (patient_id, date): active_rows counts the rows flagged 1,
    active_sum adds the flags up. They differ only for flags other than 0 and 1.
    """
    return fact.groupBy("patient_id", "date").agg(
        F.count_if(is_active()).alias("active_rows"),
        F.coalesce(F.sum("is_active_day"), F.lit(0)).alias("active_sum"),
    )


def days_since(
    patients: DataFrame, fact: DataFrame, anchor: str, last_day: int
) -> DataFrame:
    """Fact rows of days ``0..last_day`` after the patient's ``anchor``.

    Adds ``day``, the offset, and ``patient``, a struct of the id to group by. A
    grouping by the plain id would reuse the partitions of the join, and then
    Spark's skew-join handling may not split the partition of a patient with
    very many rows. Grouping by the struct costs one more shuffle, but only of
    what is left after the partial aggregation: one row per patient and task.

    Of a fact partitioned by month, only months near some anchor are read.
    """
    anchors = patients.filter(F.col(anchor).isNotNull()).select("patient_id", anchor)
    return (
        months_after(fact, anchors, anchor, last_day)
        .select("patient_id", "date", "is_active_day")
        .join(anchors, "patient_id")
        .withColumn("day", day_offset(fact, patients, anchor))
        .filter(F.col("day").between(0, last_day))
        .withColumn("patient", F.struct("patient_id"))
    )


def activity_since(
    patients: DataFrame, fact: DataFrame, anchor: str, days: int, keep: list[str]
) -> DataFrame:
    """Every patient with the activity on days ``[0, days)`` after ``anchor``.

    Returns patient_id, ``keep``, active_rows and active_sum; the last two are
    NULL for a patient without an active row in those days.
    """
    active = fact.filter(F.col("is_active_day") != 0)
    counts = (
        days_since(patients, active, anchor, days - 1)
        .groupBy("patient")
        .agg(
            F.count_if(is_active()).alias("active_rows"),
            F.sum("is_active_day").alias("active_sum"),
        )
        .select("patient.patient_id", "active_rows", "active_sum")
    )
    return patients.select("patient_id", *keep).join(counts, "patient_id", "left")
