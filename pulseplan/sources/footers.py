"""Stored tables whose sizes and date ranges come from the footers of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .csv_tables import list_tables


def footer_tables(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Every parquet table in ``data_dir``, keyed by file stem, to be counted.

    Counts of rows, and least and greatest whole numbers and dates, over a whole table are
    answered from the parquet footers, one of each file, without reading rows:
    `table_profile`, `date_range` and `get_patient_count` cost as much as there are files.
    Any other query on them reads rows, and may be slower than on `load_tables`. Spark's reader
    answers a count over no rows at all with NULL there; the operators give 0. The range of a
    column that a file holds only NULLs of is an error, but for the undated month of a fact.

    The tables belong to a session beside ``spark`` that has this reader switched on; the
    settings of ``spark`` do not change, and those made on it while running do not apply.
    """
    beside = spark.newSession()
    beside.conf.set("spark.sql.sources.useV1SourceList", "")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    found = list_tables(spark, data_dir, ".parquet")
    return {name: beside.read.parquet(path) for name, path in found.items()}
