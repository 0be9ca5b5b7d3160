"""One registered query per operator, on the derived tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    active_days,
    charts,
    funnel,
    kpis,
    overall,
    preparation,
    quality,
    retention,
    trends,
)
from ..operators.month_states import month_states
from ..sources import (
    TABLE_SCHEMAS,
    footer_tables,
    load_tables,
    shared_folder,
    stored,
    write_tables,
)
from .report import ReportOptions, report_metrics, shared_results_of_months
from .star_schema import derive_raw_tables, derive_tables

Tables = Mapping[str, DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

# The derived events span January 2024.
START, END, AS_OF = "2024-01-01", "2024-01-31", "2024-01-30"
# The derived assignments span the years 1992 to 1998.
TASKS_START, TASKS_END = "1995-01-01", "1995-04-01 12:00:00"
# Seven days hold at most seven active days, so the weekly query asks for four.
WEEKLY_THRESHOLD = 4
STRICT_FALL_RISK = 75
LARGE_ORDER = 150_000

# Means over floating-point rates depend on the order of addition in the last
# digit; the queries that carry one round it to this many digits.
MEAN_DIGITS = 9


def report_options() -> ReportOptions:
    return ReportOptions(
        billing_start=START,
        billing_end=END,
        start=START,
        end=END,
        analysis_date=AS_OF,
        active_threshold=WEEKLY_THRESHOLD,
    )


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, MEAN_DIGITS))


def _distribution(t: Tables) -> DataFrame:
    return active_days.get_patient_active_distribution(t["fact_patient_day"], START, END)


def _curve(t: Tables) -> DataFrame:
    return active_days.get_active_rate_by_day_since_enrollment(
        t["patients"], t["fact_patient_day"]
    )


def _first_30(t: Tables) -> DataFrame:
    return retention.get_active_days_in_first_30(t["patients"], t["fact_patient_day"])


def _retention(t: Tables) -> DataFrame:
    return retention.get_retention_by_active_days(_first_30(t))


def _weekly_users(t: Tables) -> DataFrame:
    return trends.get_active_users_biweekly(t["fact_patient_day"], WEEKLY_THRESHOLD)


def _enrollments(t: Tables) -> DataFrame:
    return trends.get_enrollments_biweekly(t["patients"])


def _report(t: Tables) -> DataFrame:
    return _rounded(report_metrics(t, report_options()), "value")


# Query name -> result from the cleaned tables.
_METRICS: dict[str, Callable[[Tables], DataFrame]] = {
    "patient_count": lambda t: overall.get_patient_count(t["patients"]),
    "billable_patients": lambda t: overall.get_billable_patients(
        t["fact_patient_day"], START, END
    ),
    "billable_patient_ids": lambda t: overall.get_billable_patient_ids(
        t["fact_patient_day"], START, END
    ),
    "active_patients": lambda t: overall.get_active_patients(
        t["fact_patient_day"], START, END, t["patients"]
    ),
    "high_fall_risk": lambda t: overall.get_high_fall_risk_patients(
        t["fact_patient_day"], AS_OF, patients=t["patients"]
    ),
    "high_fall_risk_strict": lambda t: overall.get_high_fall_risk_patients(
        t["fact_patient_day"], AS_OF, threshold=STRICT_FALL_RISK, patients=t["patients"]
    ),
    "high_fall_risk_ids": lambda t: overall.get_high_fall_risk_patient_ids(
        t["fact_patient_day"], AS_OF
    ),
    "active_users_period": _weekly_users,
    "active_users_14d": lambda t: trends.get_active_users_biweekly(
        t["fact_patient_day"], weeks=2
    ),
    "enrollments_period": _enrollments,
    "enrollments_14d": lambda t: trends.get_enrollments_biweekly(
        t["patients"], weeks=2
    ),
    "active_users_changes": lambda t: trends.calculate_period_changes(
        _weekly_users(t), "active_users"
    ),
    "enrollment_changes": lambda t: trends.calculate_period_changes(
        _enrollments(t), "new_patients"
    ),
    "enrollment_change_rows": lambda t: trends.period_change_rows(
        _enrollments(t), "new_patients"
    ),
    "total_active_rate": lambda t: active_days.get_total_active_rate(
        t["fact_patient_day"], START, END
    ),
    "active_rate_by_clinic": lambda t: active_days.get_active_rate_by_clinic(
        t["fact_patient_day"], t["clinics"], START, END
    ),
    "active_day_distribution": _distribution,
    "active_day_stats": lambda t: active_days.active_day_statistics(_distribution(t)),
    "enrollment_curve": _curve,
    "enrollment_curve_summary": lambda t: _rounded(
        active_days.enrollment_curve_summary(_curve(t)), "mean_active_rate"
    ),
    "patient_funnel": lambda t: funnel.get_patient_funnel(
        t["patients"], t["fact_patient_day"]
    ),
    "funnel_members": lambda t: funnel.get_stage_patients(
        t["patients"], t["fact_patient_day"]
    ),
    "funnel_conversion": lambda t: funnel.funnel_conversion(
        t["patients"], t["fact_patient_day"]
    ),
    "first30_active_days": _first_30,
    "first30_stats": lambda t: retention.first_30_statistics(_first_30(t)),
    "retention_curve": _retention,
    "top_dropoffs": lambda t: retention.top_dropoffs(_retention(t)),
    "retention_milestones": lambda t: retention.retention_milestones(_retention(t)),
    "report_metrics": _report,
    "table_profile": quality.table_profile,
    "null_rates": lambda t: quality.null_rates(
        t["patients"], ["clinic_id", "enrollment_date", "install_date", "first_data_date"]
    ),
    "date_range": lambda t: quality.date_range(t["fact_patient_day"]),
    "orphan_patients": lambda t: quality.orphan_patients(t["patients"], t["clinics"]),
    "clinics_enriched": lambda t: preparation.enrich_clinics(t["clinics"]),
    "active_day_flag": lambda t: preparation.with_active_day(
        t["fact_patient_day"].drop("is_active_day")
    ).select(
        "patient_id", "date", "background_data_minutes", "steps_count", "is_active_day"
    ),
    # The derived fact is grouped by patient and day.
    "rolling_active_days": lambda t: kpis.rolling_active_days(
        t["fact_patient_day"], one_row_per_day=True
    ),
    "active_days_snapshot": lambda t: kpis.active_days_snapshot(
        t["fact_patient_day"], t["patients"], AS_OF
    ),
    "compliance_16_30": lambda t: kpis.compliance_16_30(
        t["fact_patient_day"], t["patients"], AS_OF
    ),
    "dropoff_risk": lambda t: kpis.dropoff_risk(
        t["fact_patient_day"], t["patients"], AS_OF
    ),
    "assessment_completion": lambda t: kpis.assessment_completion(
        t["assessment_assignments"]
    ),
    "assessment_completion_window": lambda t: kpis.assessment_completion(
        t["assessment_assignments"], start=TASKS_START, end=TASKS_END
    ),
    "assessment_completion_sets": lambda t: kpis.assessment_completion_sets(
        t["assessment_assignments"]
    ),
    "alert_ack": lambda t: kpis.alert_ack(t["alerts"]),
    "alert_ack_overall": lambda t: kpis.alert_ack(t["alerts"], by=()),
    "alert_ack_rescan": lambda t: kpis.alert_ack(t["alerts"], rescan=True),
    "hist_active_days": lambda t: charts.active_days_histogram(_distribution(t)),
    "curve_chart": lambda t: _rounded(
        charts.enrollment_curve_chart(_curve(t)), "mean_rate"
    ),
    "dropoff_chart": lambda t: charts.dropoff_chart(_retention(t)),
}

def _coerced(t: Tables, name: str) -> DataFrame:
    return preparation.coerce_dates({name: t[name]})[name]


# Other forms of the dates of patients, each column in its own.
_OTHER_FORMS = {
    "enrollment_date": "MM/dd/yyyy",
    "install_date": "dd.MM.yyyy",
    "first_data_date": "yyyy/MM/dd",
}


def _dates_inferred(t: Tables) -> DataFrame:
    """The patients, whose dates come in other forms that nobody declares."""
    people = t["patients"].withColumns(
        {
            c: F.coalesce(F.date_format(F.try_to_date(F.col(c), "yyyy-MM-dd"), form), F.col(c))
            for c, form in _OTHER_FORMS.items()
        }
    )
    tables = {"patients": people}
    formats = preparation.infer_date_formats(tables)
    return preparation.coerce_dates(tables, formats)["patients"]


# Query name -> result from the tables before cleaning.
_CLEANING: dict[str, Callable[[Tables], DataFrame]] = {
    "date_conformance": quality.date_conformance,
    "dates_coerced": lambda t: _coerced(t, "patients"),
    "dates_inferred": _dates_inferred,
    "dates_coerced_fact": lambda t: _coerced(t, "fact_patient_day").select(
        "patient_id", "date", "is_active_day"
    ),
    "dates_coerced_assignments": lambda t: _coerced(
        t, "assessment_assignments"
    ).select("assignment_id", "assigned_ts", "completed_ts"),
    "dates_coerced_alerts": lambda t: _coerced(t, "alerts").select(
        "alert_id", "created_ts", "ack_ts"
    ),
}


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patients table, written as CSV and read back."""
    patients = derive_tables(spark, sf_dir)["patients"]
    folder = shared_folder(spark, "csv")
    write_tables({"patients": patients}, folder, fmt="csv")
    schemas = {**TABLE_SCHEMAS, "patients": patients.schema}
    return preparation.coerce_dates(load_tables(spark, folder, schemas=schemas))["patients"]


def _report_from_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from stored states by month; the fact is read once, to make them."""
    tables, options = derive_tables(spark, sf_dir), report_options()
    states = stored(month_states(tables["fact_patient_day"]), "month-states")
    shared = shared_results_of_months(tables, states, options)
    return _rounded(report_metrics(tables, options, shared), "value")


# The stored tables that are profiled as they are.
_PROFILED = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def _stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the stored tables, from their files' footers."""
    found = footer_tables(spark, sf_dir)
    return quality.table_profile({t: found[t] for t in _PROFILED})


def _csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their line breaks, quotes and blanks, as CSV and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    folder = shared_folder(spark, "csv-texts")
    write_tables({"documents": docs}, folder, fmt="csv")
    schemas = {"documents": docs.schema}
    return load_tables(spark, folder, schemas=schemas, multiline=True)["documents"]


def _csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, a table that no schema names, as CSV and read back with inferred types."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns(
        {
            "o_large": F.col("o_totalprice") > LARGE_ORDER,
            "o_day": F.col("o_orderdate").cast("date"),
        }
    )
    folder = shared_folder(spark, "csv-inferred")
    write_tables({"orders": orders}, folder, fmt="csv")
    return load_tables(spark, folder, infer=True)["orders"]


def _on(build: Callable[[Tables], DataFrame], derive: Callable) -> Query:
    return lambda spark, sf_dir: build(derive(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    named = {name: _on(build, derive_tables) for name, build in _METRICS.items()}
    named |= {name: _on(build, derive_raw_tables) for name, build in _CLEANING.items()}
    named["csv_roundtrip"] = _csv_roundtrip
    named["csv_texts"] = _csv_texts
    named["stored_profile"] = _stored_profile
    named["report_from_months"] = _report_from_months
    named["csv_inferred"] = _csv_inferred
    return named
