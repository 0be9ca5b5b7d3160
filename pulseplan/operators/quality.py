"""Data-quality tables: sizes, date parsing, null rates, ranges and orphans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import half_even
from ..settings import MONTH_PARTITION
from ..sources.schema import DATE_COLUMNS
from .activity import row_count
from .preparation import parsed_date


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, column_count) of each table."""
    return _stack(
        [
            table.agg(row_count().alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(table.columns)).alias("column_count"),
            )
            for name, table in tables.items()
        ]
    )


def date_conformance(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Mapping[str, str]] = DATE_COLUMNS,
) -> DataFrame:
    """Per date column: rows, non-null, parseable and unparseable values.

    One aggregation per table, whatever the number of its date columns.
    """
    parts = []
    for name, formats in columns.items():
        if name not in tables:
            continue
        table = tables[name]
        text = {
            f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)
        }
        counts = [F.count(F.lit(1)).alias("row_count")]
        rows = []
        for c, fmt in formats.items():
            value = parsed_date(name, c, fmt) if c in text else F.col(c)
            counts += [F.count(c).alias(f"{c}_set"), F.count(value).alias(f"{c}_ok")]
            rows.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"{c}_set").alias("non_null"),
                    F.col(f"{c}_ok").alias("parseable"),
                    (F.col(f"{c}_set") - F.col(f"{c}_ok")).alias("unparseable"),
                )
            )
        parts.append(
            table.agg(*counts).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.inline(F.array(*rows)),
            )
        )
    return _stack(parts)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_pct): percentage of NULLs, two digits, half to even."""
    rates = df.agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null") for c in columns]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            half_even(f"{c}_null * 100", 2).alias("null_pct"),
        )
        for c in columns
    ]
    return rates.select(F.inline(F.array(*rows)))


def date_range(df: DataFrame, column: str = "date") -> DataFrame:
    """One row: first and last day, and first minus last in days (so <= 0)."""
    if column == "date" and MONTH_PARTITION in df.columns:
        # Files without any date have no range in their footers either.
        df = df.filter(F.col(MONTH_PARTITION).isNotNull())
    return df.agg(
        F.min(column).alias("min_date"), F.max(column).alias("max_date")
    ).withColumn("day_difference", F.datediff("min_date", "max_date"))


def orphan_patients(patients: DataFrame, clinics: DataFrame) -> DataFrame:
    """One row: patients whose clinic is missing or unknown.

    Patients are counted per clinic_id first, so the join sees one row per clinic
    and a clinic with most of the patients costs nothing extra. An anti join
    would be moved below the aggregation again, an outer join stays above it.
    """
    per_clinic = patients.groupBy("clinic_id").agg(F.count(F.lit(1)).alias("patients"))
    known = clinics.select("clinic_id", F.lit(True).alias("known"))
    return (
        per_clinic.join(known, "clinic_id", "left")
        .filter(F.col("known").isNull())
        .agg(F.coalesce(F.sum("patients"), F.lit(0)).alias("orphan_patients"))
    )
