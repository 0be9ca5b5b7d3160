"""The stored `month_states` of a stored fact table: only changed months are read again.

A folder holds the states, a partition for each month, and ``files``: for each month of the
fact what its files were when its states were made. `refresh_months` lists the fact's files,
and replaces the states of the months whose files are others now. If it dies on its way,
those months still differ from what is noted and are replaced by the next run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import has_dates
from ..operators.month_states import month_states
from ..settings import MONTH_PARTITION
from ..sources import write_tables
from ..sources.csv_tables import list_tables

_FILES = f"{MONTH_PARTITION} date, file_count long, file_bytes long, mark long, filled boolean"
_STATES = "month_states"


def month_files(spark: SparkSession, fact_path: str) -> DataFrame:
    """Per month of a fact stored by month: number, bytes and a mark of its parquet files.

    The mark changes with the name, size or time of any file. No file is opened: the listing
    is a table of Spark's, whose column of contents is not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(fact_path)
        .select(F.col(MONTH_PARTITION).cast("date"), "path", "length", "modificationTime")
    )
    tasks = 4 * spark.sparkContext.defaultParallelism
    name = F.substring_index("path", "/", -1)
    return (
        files.filter(F.col(MONTH_PARTITION).isNotNull())
        .coalesce(tasks)
        .groupBy(MONTH_PARTITION)
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("length").alias("file_bytes"),
            F.bit_xor(F.xxhash64(name, "length", "modificationTime")).alias("mark"),
        )
    )


def replace_months(table: DataFrame, path: str) -> None:
    """Writes the months that ``table`` holds to ``path``; other months there stay.

    Works for the fact as well: a month with a new day is written again, alone. ``table`` has
    the column date_month and does not read the files it replaces.
    """
    (
        table.hint("rebalance", MONTH_PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH_PARTITION)
        .parquet(path)
    )


def _noted(spark: SparkSession, folder: str) -> dict[dt.date, tuple]:
    """Month -> what is noted of its files; a row per month, bounded by the calendar."""
    rows = spark.read.schema(_FILES).parquet(f"{folder}/files.parquet").collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def _exists(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and "files" in list_tables(spark, folder, ".parquet")


def refresh_months(spark: SparkSession, fact_path: str, folder: str) -> list[dt.date]:
    """Brings the states in ``folder`` up to the fact at ``fact_path``; the months replaced.

    The fact is parquet, partitioned by date_month, as `write_tables` leaves it. Months that
    are gone, or hold no dated row any more, are no longer read from the states.
    """
    folder = folder.rstrip("/")
    known = _exists(spark, folder)
    before = _noted(spark, folder) if known else {}
    now = {r[0]: tuple(r[1:]) for r in month_files(spark, fact_path).collect()}
    changed = sorted(m for m, mark in now.items() if before.get(m, ())[:3] != mark)
    filled = {m for m, (*_, has) in before.items() if has and m in now} - set(changed)
    if changed:
        fact = spark.read.parquet(fact_path).filter(F.col(MONTH_PARTITION).isin(changed))
        if not has_dates(fact, MONTH_PARTITION):
            raise ValueError(f"{MONTH_PARTITION} of {fact_path} is not a date")
        # Replacing writes no partition for a month without rows, so such months are noted.
        dated = fact.filter(F.col("date").isNotNull()).select(MONTH_PARTITION).distinct()
        filled |= {r[0] for r in dated.collect()}
        replace_months(month_states(fact), f"{folder}/{_STATES}.parquet")
    if changed or before.keys() != now.keys() or not known:
        rows = [(m, *mark, m in filled) for m, mark in sorted(now.items())]
        write_tables({"files": spark.createDataFrame(rows, _FILES).coalesce(1)}, folder)
    return changed


def load_months(spark: SparkSession, fact_path: str, folder: str) -> DataFrame:
    """The `month_states` in ``folder`` of the months noted by the last `refresh_months`.

    If there are none, no rows; the fact then only gives the types.
    """
    folder = folder.rstrip("/")
    months = [m for m, (*_, filled) in _noted(spark, folder).items() if filled]
    if not months:
        return month_states(spark.read.parquet(fact_path).filter(F.lit(False)))
    states = spark.read.parquet(f"{folder}/{_STATES}.parquet")
    return states.filter(F.col(MONTH_PARTITION).isin(months))
