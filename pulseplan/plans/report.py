"""Every number of the metrics report, as one long table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import settings
from ..functions import as_date, default_window, guarded_percent, percent, within
from ..functions.calendar import DateLike
from ..operators import active_days, funnel, month_states, overall, retention, trends
from ..operators.activity import FIRST_MONTH_COLUMN, is_active


@dataclass(frozen=True)
class ReportOptions:
    """Windows ``[start, end)``, the as-of day and the thresholds of a report."""

    billing_start: DateLike
    billing_end: DateLike
    start: DateLike
    end: DateLike
    analysis_date: DateLike = settings.ANALYSIS_DATE
    billing_threshold: int = settings.BILLING_THRESHOLD
    active_threshold: int = settings.ACTIVE_BIWEEK_THRESHOLD
    weeks: int = 1
    fall_risk_threshold: float = settings.FALL_RISK_THRESHOLD
    lookback_days: int = settings.FALL_RISK_LOOKBACK_DAYS

    @classmethod
    def for_day(cls, day: DateLike = settings.ANALYSIS_DATE) -> ReportOptions:
        """The report of ``day``: last whole month for billing, last 30 days else."""
        today = as_date(day)
        month = today.replace(day=1)
        before = (month - dt.timedelta(days=1)).replace(day=1)
        start, end = default_window(today)
        return cls(before, month, start, end, today)


def _cells(
    section: str, metrics: Mapping[str, str], label: str | None = None
) -> list[str]:
    """(section, metric, value) structs, as SQL: metric name -> its expression."""
    name = "'{}'" if label is None else f"concat('{{}}[', {label}, ']')"
    return [
        f"named_struct('section', '{section}', 'metric', {name.format(metric)}, "
        f"'value', CAST({value} AS double))"
        for metric, value in metrics.items()
    ]


def _same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


def _long(df: DataFrame, cells: list[str]) -> DataFrame:
    return df.selectExpr(f"inline(array_compact(array({', '.join(cells)})))")


def _between(start: dt.date, end: dt.date) -> Column:
    return (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end))


def patient_roll_up(fact: DataFrame, options: ReportOptions) -> DataFrame:
    """One row per patient seen in any of the windows, with what each window counts.

    Billing window, activity window and lookback are conditions inside one roll-up, so
    the three read and shuffle the fact table once.
    """
    spans = _spans(options)
    rows = within(fact, min(s for s, _ in spans), max(e for _, e in spans))
    billed, seen, recent = (_between(*span) for span in spans)
    return rows.groupBy("patient_id").agg(
        F.count_if(billed).alias("billing_rows"),
        F.count_if(billed & is_active()).alias("billing_days"),
        F.count_if(seen).alias("rows"),
        F.count_if(seen & is_active()).alias("days"),
        F.sum(F.when(seen, F.col("is_active_day"))).alias("flags"),
        F.count_if(recent & overall.at_risk(options.fall_risk_threshold)).alias(
            "high_scores"
        ),
    )


def _spans(options: ReportOptions) -> tuple[tuple[dt.date, dt.date], ...]:
    """The billing window, the activity window and the lookback, as ``[start, end)``."""
    today = as_date(options.analysis_date)
    lookback = today - dt.timedelta(days=options.lookback_days), today + dt.timedelta(days=1)
    billing = as_date(options.billing_start), as_date(options.billing_end)
    return billing, (as_date(options.start), as_date(options.end)), lookback


def roll_up_of_months(states: DataFrame, options: ReportOptions) -> DataFrame:
    """`patient_roll_up` from `month_states`.

    ``high_scores`` counts days, not rows, with a high score; they are zero together.
    """
    spans = _spans(options)
    whole = min(s for s, _ in spans), max(e for _, e in spans)
    billing, window, lookback = (tuple(map(F.lit, span)) for span in spans)
    days_in = month_states.days_in
    per_month = month_states.states_within(states, *whole).select(
        "patient_id",
        days_in("seen", *map(F.lit, whole)).alias("any_rows"),
        days_in("seen", *billing).alias("billing_rows"),
        days_in("active", *billing).alias("billing_days"),
        days_in("seen", *window).alias("rows"),
        days_in("active", *window).alias("days"),
        days_in("flagged", *window).alias("flagged"),
        month_states.high_score_days(*lookback, options.fall_risk_threshold).alias("high_scores"),
    )
    sums = ("billing_rows", "billing_days", "rows", "days")
    return (
        per_month.filter(F.col("any_rows") > 0)
        .groupBy("patient_id")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.when(F.sum("flagged") > 0, F.sum("days")).alias("flags"),
            F.sum("high_scores").alias("high_scores"),
        )
    )


def billable_ids(roll_up: DataFrame, options: ReportOptions) -> DataFrame:
    enough = F.col("billing_days") >= max(options.billing_threshold, 1)
    return roll_up.filter(F.col("patient_id").isNotNull() & enough).select("patient_id")


def high_risk_ids(roll_up: DataFrame) -> DataFrame:
    high = F.col("patient_id").isNotNull() & (F.col("high_scores") > 0)
    return roll_up.filter(high).select("patient_id")


def distribution(roll_up: DataFrame) -> DataFrame:
    """(patient_id, active_days) of every patient seen in the activity window."""
    seen = F.col("patient_id").isNotNull() & (F.col("rows") > 0)
    return roll_up.filter(seen).select("patient_id", F.col("days").alias("active_days"))


def patient_overview(per_patient: DataFrame, options: ReportOptions) -> DataFrame:
    """One row with the billable, active, fall-risk and active-day figures."""
    known = F.col("patient_id").isNotNull()
    days = F.when(known & (F.col("rows") > 0), F.col("days"))
    enough = F.col("billing_days") >= max(options.billing_threshold, 1)
    return per_patient.agg(
        F.count_if(known & enough).alias("billable_count"),
        F.count_if(known & (F.col("billing_rows") > 0)).alias("billable_total_patients"),
        F.count_if(known & (F.col("days") > 0)).alias("active_count"),
        F.count_if(known & (F.col("high_scores") > 0)).alias("high_risk_count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_patient_days"),
        F.coalesce(F.sum("flags"), F.lit(0)).alias("total_active_days"),
        F.avg(days).alias("mean_active_days"),
        F.median(days).alias("median_active_days"),
        F.min(days).alias("min_active_days"),
        F.max(days).alias("max_active_days"),
    )


def _overview(
    patients: DataFrame, roll_up: DataFrame, options: ReportOptions
) -> DataFrame:
    row = (
        patient_overview(roll_up, options)
        .withColumn("patient_count", overall.get_patient_count(patients).scalar())
        .withColumns(
            {
                "billable_rate": guarded_percent("billable_count", "billable_total_patients"),
                "active_rate_all": percent("active_count", "patient_count"),
                "high_risk_rate_all": percent("high_risk_count", "patient_count"),
                "active_days_rate": guarded_percent("total_active_days", "total_patient_days"),
            }
        )
    )
    cells = _cells(
        "overall",
        _same(
            "patient_count",
            "billable_count",
            "billable_total_patients",
            "billable_rate",
            "active_count",
            "active_rate_all",
            "high_risk_count",
            "high_risk_rate_all",
        ),
    ) + _cells(
        "active_days",
        _same(
            "total_patient_days",
            "total_active_days",
            "active_days_rate",
            "mean_active_days",
            "median_active_days",
            "min_active_days",
            "max_active_days",
        ),
    )
    return _long(row, cells)


def _trend(df: DataFrame, value: str) -> DataFrame:
    changes = trends.calculate_period_changes(df, value)
    metrics = {
        value: value,
        f"{value}_change": "change",
        f"{value}_pct_change": "pct_change",
    }
    # The first period has no change to report.
    return _long(changes, _cells("trends", metrics, "bi_week")).filter(
        F.col("value").isNotNull()
    )


def _clinics(by_clinic: DataFrame) -> DataFrame:
    metrics = _same("total_days", "active_days", "active_rate")
    return _long(by_clinic, _cells("clinics", metrics, "clinic_name"))


def _curve(curve: DataFrame) -> DataFrame:
    summary = active_days.enrollment_curve_summary(curve)
    return _long(summary, _cells("curve", _same(*summary.columns)))


def _first_month(stages: DataFrame) -> DataFrame:
    """Funnel, retention milestones and largest drop-offs.

    Both rest on the active days of each patient's first month: one aggregation gives a
    single row, and all figures are laid out from it.
    """
    enrolled_days = f"CASE WHEN enrolled THEN {FIRST_MONTH_COLUMN} END"
    counts = stages.agg(
        *funnel.stage_counts(),
        *retention.retention_counts(enrolled_days),
        F.expr(f"avg({enrolled_days}) AS mean_active_days"),
        F.expr(f"median({enrolled_days}) AS median_active_days"),
    )
    carried = ["mean_active_days", "median_active_days"]
    carried += [key for key, _ in funnel.STAGES]
    curve = retention.retention_rows(counts, "patients", *carried)
    # Position among the 30 drops, the lower threshold first on a tie.
    k = F.col("active_days_threshold")
    drops = Window.orderBy(k == 0, F.desc("drop_from_previous"), k)
    curve = curve.withColumns(
        {
            "position": F.row_number().over(drops),
            "conversion": guarded_percent("compliant", "enrolled"),
        }
    )
    once = _cells(
        "retention", _same("patients", "mean_active_days", "median_active_days")
    ) + _cells("funnel", _same("conversion"))
    for title, figures in funnel.stage_figures():
        once += _cells("funnel", figures, f"'{title}'")
    label = "CAST(active_days_threshold AS string)"
    top = _cells("retention", _same("drop_from_previous", "drop_pct"), label)
    milestone = _cells("retention", _same("users_reached", "pct_reached"), label)
    marked = ", ".join(map(str, settings.RETENTION_MILESTONES))
    conditions = [
        ("active_days_threshold = 0", once),
        (
            f"active_days_threshold > 0 AND position <= {settings.TOP_DROPOFFS}",
            top,
        ),
        (f"active_days_threshold IN ({marked})", milestone),
    ]
    return _long(
        curve,
        [f"CASE WHEN {test} THEN {cell} END" for test, cells in conditions for cell in cells],
    )


def shared_results(
    tables: Mapping[str, DataFrame], options: ReportOptions
) -> dict[str, DataFrame]:
    """The five results that everything in the report is derived from.

    Each reads the fact table once, two of them join it with the patients. All are small
    against the fact: a row per patient, period, clinic or day.
    """
    patients, fact = tables["patients"], tables["fact_patient_day"]
    return {
        "roll_up": patient_roll_up(fact, options),
        "users": trends.get_active_users_biweekly(
            fact, options.active_threshold, options.weeks
        ),
        "by_clinic": active_days.get_active_rate_by_clinic(
            fact, tables["clinics"], options.start, options.end
        ),
        "curve": active_days.get_active_rate_by_day_since_enrollment(patients, fact),
        "stages": funnel.patient_stages(patients, fact, options.billing_threshold),
    }


def shared_results_of_months(
    tables: Mapping[str, DataFrame], states: DataFrame, options: ReportOptions
) -> dict[str, DataFrame]:
    """`shared_results` from the `month_states` of the fact table, which is not read."""
    patients = tables["patients"]
    first_month = month_states.activity_after(
        patients, states, "enrollment_date", funnel.STAGE_DATES
    )
    return {
        "roll_up": roll_up_of_months(states, options),
        "users": trends.users_per_period(
            month_states.period_days(states, options.weeks),
            options.active_threshold,
            options.weeks,
        ),
        "by_clinic": active_days.rate_by_clinic(
            month_states.clinic_days(states, options.start, options.end), tables["clinics"]
        ),
        "curve": active_days.rate_by_day(
            month_states.days_after(patients, states, "enrollment_date")
        ),
        "stages": funnel.stages_of(first_month, options.billing_threshold),
    }


def report_metrics(
    tables: Mapping[str, DataFrame],
    options: ReportOptions,
    shared: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """(section, metric, value) of everything the report shows.

    ``shared``: the `shared_results`, if they are stored already; otherwise they are
    part of the plan, with five passes over the fact table.
    """
    shared = shared or shared_results(tables, options)
    patients = tables["patients"]
    parts = [
        _overview(patients, shared["roll_up"], options),
        _trend(shared["users"], "active_users"),
        _trend(
            trends.get_enrollments_biweekly(patients, options.weeks), "new_patients"
        ),
        _clinics(shared["by_clinic"]),
        _curve(shared["curve"]),
        _first_month(shared["stages"]),
    ]
    return reduce(DataFrame.unionByName, parts)
