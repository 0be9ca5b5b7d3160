"""The numbers behind the charts; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import BILLING_THRESHOLD, HISTOGRAM_MAX_DAYS


def active_days_histogram(
    distribution: DataFrame, threshold: int = BILLING_THRESHOLD
) -> DataFrame:
    """Patients per bin of active_days: [0,1), [1,2), .. and a closed last bin.

    Values outside 0..32 are not shown. Empty bins are present with 0, and the
    bin of the billing threshold is marked.
    """
    last = HISTOGRAM_MAX_DAYS - 1
    days = F.col("active_days")
    binned = (
        distribution.filter(days.between(0, HISTOGRAM_MAX_DAYS))
        .groupBy(F.least(F.floor(days), F.lit(last)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("patients"))
    )
    bins = distribution.sparkSession.range(0, last + 1, 1, 1).select(
        F.col("id").cast("int").alias("bin")
    )
    # binned has at most 32 rows.
    return bins.join(F.broadcast(binned), "bin", "left").select(
        "bin",
        F.coalesce("patients", F.lit(0)).alias("patients"),
        (F.col("bin") == threshold).alias("is_threshold"),
    )


def enrollment_curve_chart(curve: DataFrame) -> DataFrame:
    """The curve of active rates with its mean beside every day (N + 1 rows)."""
    return curve.withColumn(
        "mean_rate", F.avg("active_rate").over(Window.partitionBy())
    )


def dropoff_chart(retention: DataFrame) -> DataFrame:
    """Drop at each threshold, its share of the largest, and the largest marked.

    The windows span the 30 rows of the retention table.
    """
    drop = F.col("drop_from_previous")
    ranked = Window.orderBy(F.desc("drop_from_previous"), "active_days_threshold")
    largest = F.max("drop_from_previous").over(Window.partitionBy())
    return (
        retention.filter(F.col("active_days_threshold") > 0)
        .withColumn("largest", largest)
        .withColumn("position", F.row_number().over(ranked))
        .select(
            F.col("active_days_threshold").alias("threshold"),
            drop.alias("drop"),
            F.when(F.col("largest") > 0, drop.cast("double") / F.col("largest"))
            .otherwise(F.lit(0.0))
            .alias("share_of_max"),
            (F.col("position") == 1).alias("is_max_drop"),
        )
    )
