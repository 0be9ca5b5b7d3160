"""The three jobs: prepare the tables, write the report, analyse drop-off.

    spark-submit ... jobs.py prepare RAW_DIR CLEAN_DIR QUALITY_DIR
    spark-submit ... jobs.py report CLEAN_DIR OUT_DIR [--as-of DAY] [--months DIR]
    spark-submit ... jobs.py dropoff CLEAN_DIR OUT_DIR

or ``python -m pulseplan.plans.jobs ...`` for a local session. RAW_DIR holds CSV
files; everything written is parquet unless ``--format csv`` is given.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulseplan import settings
from pulseplan.functions import half_even
from pulseplan.operators import (
    charts,
    funnel,
    preparation,
    quality,
    retention,
    trends,
)
from pulseplan.plans.report import (
    ReportOptions,
    billable_ids,
    distribution,
    high_risk_ids,
    report_metrics,
    shared_results,
    shared_results_of_months,
)
from pulseplan.plans.month_store import load_months, refresh_months
from pulseplan.sources import load_tables, stored, write_tables

def _read(
    spark: SparkSession, data_dir: str, fmt: str, multiline: bool = False
) -> dict[str, DataFrame]:
    return preparation.coerce_dates(load_tables(spark, data_dir, fmt, multiline=multiline))


# Counts over one table, taken while it is written.
_Counts = dict[str, dict]


def _observed(
    name: str, raw: DataFrame, clean: DataFrame, formats: Mapping[str, str]
) -> tuple[DataFrame, Observation]:
    """``clean``, counting its rows, date texts and NULLs as it is written."""
    seen = Observation(name)
    texts = [c for c in formats if c in raw.columns]
    counts = [F.count(F.lit(1)).alias("rows")]
    for c in texts:
        counts += [F.count(f"_text_{c}").alias(f"{c}_set"), F.count(c).alias(f"{c}_ok")]
    if name == "fact_patient_day" and "date" in clean.columns:
        counts += [F.min("date").alias("min_date"), F.max("date").alias("max_date")]
    return clean.observe(seen, *counts).drop(*[f"_text_{c}" for c in texts]), seen


def _quality(
    spark: SparkSession, counts: _Counts, columns: Mapping[str, int], formats: Mapping
) -> dict[str, DataFrame]:
    """The quality tables, a few rows each, from the counts of the write."""
    dates = [
        (t, c, counts[t]["rows"], counts[t][f"{c}_set"], counts[t][f"{c}_ok"])
        for t in counts
        for c in formats.get(t, {})
        if f"{c}_set" in counts[t]
    ]
    profile = [(t, counts[t]["rows"], n) for t, n in columns.items()]
    found = spark.createDataFrame(
        dates, "table_name string, column_name string, row_count long, non_null long, parseable long"
    )
    share = "(row_count - parseable) / if(row_count = 0, NULL, row_count) * 100"
    checks = {
        "table_profile": spark.createDataFrame(
            profile, "table_name string, row_count long, column_count int"
        ),
        "date_conformance": found.withColumn("unparseable", F.expr("non_null - parseable")),
        "null_rates": found.select(
            "column_name", half_even(share, 2).alias("null_pct"), "table_name"
        ),
    }
    fact = counts.get("fact_patient_day", {})
    if "min_date" in fact:
        days = spark.createDataFrame(
            [(fact["min_date"], fact["max_date"])], "min_date date, max_date date"
        )
        checks["date_range"] = days.withColumn(
            "day_difference", F.datediff("min_date", "max_date")
        )
    return checks


def prepare(
    spark: SparkSession,
    raw_dir: str,
    clean_dir: str,
    quality_dir: str,
    fmt: str = "parquet",
    formats: Mapping[str, Mapping[str, str]] | None = None,
    multiline: bool = False,
) -> None:
    """Clean the CSV tables of ``raw_dir`` into ``clean_dir`` and check them.

    ``formats``: table -> column -> pattern of its dates. Of other date columns the form that
    reads most values is taken; that reads their texts once. The tables are read once more
    to be written, and what the checks count is counted meanwhile. A date column that has
    values, none of them readable, or that two forms read equally well, is an error. On any
    error before all tables are written, those that were there stay.
    """
    given = formats or {}
    raw = load_tables(spark, raw_dir, multiline=multiline)
    open_ = {
        t: {c: form for c, form in some.items() if c not in given.get(t, {})}
        for t, some in preparation.DECLARED_DATES.items()
    }
    inferred = preparation.infer_date_formats(raw, open_)
    declared = {
        t: {**preparation.DECLARED_DATES.get(t, {}), **inferred.get(t, {}), **given.get(t, {})}
        for t in {*preparation.DECLARED_DATES, *given}
    }
    texts = {
        t: table.withColumns(
            {f"_text_{c}": F.col(c) for c in declared.get(t, {}) if c in table.columns}
        )
        for t, table in raw.items()
    }
    clean = preparation.coerce_dates(texts, declared)
    if "clinics" in clean:
        clean["clinics"] = preparation.enrich_clinics(clean["clinics"])
    fact = clean.get("fact_patient_day")
    if fact is not None and "is_active_day" not in fact.columns:
        clean["fact_patient_day"] = preparation.with_active_day(fact)
    watched = {t: _observed(t, raw[t], clean[t], declared.get(t, {})) for t in clean}
    tables = {t: table for t, (table, _) in watched.items()}
    counts: _Counts = {}

    def refuse_unread() -> None:
        counts.update({t: seen.get for t, (_, seen) in watched.items()})
        unread = [
            f"{t}.{c}"
            for t, some in declared.items()
            for c in some
            if t in counts and counts[t].get(f"{c}_set") and not counts[t][f"{c}_ok"]
        ]
        if unread:
            names = ", ".join(sorted(unread))
            raise ValueError(f"no date could be read in {names}: give a format")

    write_tables(tables, clean_dir, fmt, check=refuse_unread)
    # A stored fact has its month beside its own columns.
    columns = {
        t: len(table.columns) + (t == "fact_patient_day" and fmt == "parquet")
        for t, table in tables.items()
    }
    checks = _quality(spark, counts, columns, preparation.DATE_COLUMNS)
    if "patients" in clean and "clinics" in clean:
        kept = load_tables(spark, clean_dir, fmt)
        checks["orphan_patients"] = quality.orphan_patients(kept["patients"], kept["clinics"])
    write_tables(checks, quality_dir, fmt)


def report_tables(
    tables: Mapping[str, DataFrame],
    options: ReportOptions,
    shared: Mapping[str, DataFrame],
) -> dict[str, DataFrame]:
    """The long table of all figures, and the tables and id lists behind them.

    Everything comes from ``shared`` and the small tables; none reads the fact table.
    """
    patients, stages = tables["patients"], shared["stages"]
    enrollments = trends.get_enrollments_biweekly(patients, options.weeks)
    seen = distribution(shared["roll_up"])
    curve = shared["curve"].orderBy("day_since_enrollment")
    return {
        "report_metrics": report_metrics(tables, options, shared),
        "billable_patient_ids": billable_ids(shared["roll_up"], options),
        "high_fall_risk_ids": high_risk_ids(shared["roll_up"]),
        "active_users": trends.calculate_period_changes(shared["users"], "active_users"),
        "enrollments": trends.calculate_period_changes(enrollments, "new_patients"),
        "active_rate_by_clinic": shared["by_clinic"].orderBy(F.desc("active_rate"), "clinic_id"),
        "active_day_distribution": seen,
        "active_days_histogram": charts.active_days_histogram(seen),
        "enrollment_curve": charts.enrollment_curve_chart(curve),
        "patient_funnel": funnel.funnel_rows(stages.agg(*funnel.stage_counts())),
        "stage_patients": funnel.stage_members(stages),
    }


def report(
    spark: SparkSession,
    clean_dir: str,
    out_dir: str,
    options: ReportOptions,
    fmt: str = "parquet",
    months_dir: str | None = None,
) -> None:
    """Write every table of the report.

    The fact table is read five times and joined with the patients twice, for the
    results that all others are derived from; those are stored in the shared folder.

    ``months_dir``: a folder that keeps the fact's states by month between reports. Then the
    fact is read once, of months whose files changed since, and all else comes from the states.
    """
    tables = _read(spark, clean_dir, fmt)
    if months_dir is None:
        shared = shared_results(tables, options)
    elif fmt != "parquet":
        raise ValueError("states by month need a fact stored as parquet")
    else:
        fact = f"{clean_dir.rstrip('/')}/fact_patient_day.parquet"
        refresh_months(spark, fact, months_dir)
        states = load_months(spark, fact, months_dir)
        shared = shared_results_of_months(tables, states, options)
    shared = {k: stored(v, f"report-{k}") for k, v in shared.items()}
    write_tables(report_tables(tables, options, shared), out_dir, fmt)


def dropoff(
    spark: SparkSession, clean_dir: str, out_dir: str, fmt: str = "parquet"
) -> None:
    """Write first-month activity per patient, and the retention tables from it."""
    tables = _read(spark, clean_dir, fmt)
    first = retention.get_active_days_in_first_30(
        tables["patients"], tables["fact_patient_day"]
    )
    write_tables({"first30_active_days": first}, out_dir, fmt)
    stored = load_tables(spark, out_dir, fmt)["first30_active_days"].withColumn(
        "active_days_in_first_30", F.col("active_days_in_first_30").cast("int")
    )
    curve = retention.get_retention_by_active_days(stored)
    write_tables(
        {
            "first30_statistics": retention.first_30_statistics(stored),
            "retention_curve": curve,
            "top_dropoffs": retention.top_dropoffs(curve),
            "retention_milestones": retention.retention_milestones(curve),
            "dropoff_chart": charts.dropoff_chart(curve),
        },
        out_dir,
        fmt,
    )


# Options of a report beside its day: name -> type.
_REPORT_OPTIONS = {
    "billing_start": str,
    "billing_end": str,
    "start": str,
    "end": str,
    "billing_threshold": int,
    "active_threshold": int,
    "weeks": int,
    "fall_risk_threshold": float,
    "lookback_days": int,
}


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pulseplan", description=__doc__.split("\n")[0])
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("prepare")
    for folder in ("raw_dir", "clean_dir", "quality_dir"):
        job.add_argument(folder)
    job.add_argument("--date-format", action="append", default=[], metavar="TABLE.COLUMN=PATTERN")
    job.add_argument("--multiline", action="store_true", help="fields may hold line breaks")
    job = jobs.add_parser("report")
    for folder in ("clean_dir", "out_dir"):
        job.add_argument(folder)
    job.add_argument("--as-of", default=settings.ANALYSIS_DATE)
    job.add_argument("--months", metavar="DIR", help="keeps the fact's states by month")
    for name, kind in _REPORT_OPTIONS.items():
        job.add_argument(f"--{name.replace('_', '-')}", type=kind)
    job = jobs.add_parser("dropoff")
    for folder in ("clean_dir", "out_dir"):
        job.add_argument(folder)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"pulseplan {args.job}").getOrCreate()
    if args.job == "prepare":
        formats: dict[str, dict[str, str]] = {}
        for text in args.date_format:
            column, _, pattern = text.partition("=")
            table, _, column = column.partition(".")
            formats.setdefault(table, {})[column] = pattern
        folders = (args.raw_dir, args.clean_dir, args.quality_dir)
        prepare(spark, *folders, args.format, formats, args.multiline)
    elif args.job == "report":
        given = {n: getattr(args, n) for n in _REPORT_OPTIONS if getattr(args, n) is not None}
        options = replace(ReportOptions.for_day(args.as_of), **given)
        report(spark, args.clean_dir, args.out_dir, options, args.format, args.months)
    else:
        dropoff(spark, args.clean_dir, args.out_dir, args.format)


if __name__ == "__main__":
    main()
