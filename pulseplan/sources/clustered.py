"""The daily fact as a bucketed table: rows of a patient lie together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import MONTH_PARTITION


def cluster_fact(fact: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """``fact`` written to ``path`` as the catalog's table ``table``, in ``buckets`` by patient.

    Reading it, joins with the patients, counts per patient and rolling windows need no
    exchange of the fact: a task reads one bucket, of all months that a query does not
    prune. So ``buckets`` is the number of tasks of such a read; choose it for buckets of
    some hundred megabytes, and not below ``spark.sql.shuffle.partitions``, as a join may
    otherwise prefer to shuffle both sides. A bucket is never split: use it for a fact with
    one row per patient and day, where no patient can hold a large share of the rows.

    A table of that name, or files at ``path``, are an error, not replaced. Any session of
    the same catalog reads it by ``spark.table``; `load_tables` reads the same files
    without their buckets.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    if MONTH_PARTITION not in fact.columns:
        fact = fact.withColumn(MONTH_PARTITION, F.trunc("date", "MM"))
    (
        fact.repartition(buckets, "patient_id")
        .write.partitionBy(MONTH_PARTITION)
        .bucketBy(buckets, "patient_id")
        .sortBy("patient_id", "date")
        .format("parquet")
        .option("path", path)
        .mode("error")
        .saveAsTable(table)
    )
    return fact.sparkSession.table(table)
