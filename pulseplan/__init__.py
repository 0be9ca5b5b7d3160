"""Patient-engagement metrics as Spark jobs: DataFrames in, lazy DataFrames out."""

from .operators.active_days import (
    active_day_statistics,
    enrollment_curve_summary,
    get_active_rate_by_clinic,
    get_active_rate_by_day_since_enrollment,
    get_patient_active_distribution,
    get_total_active_rate,
)
from .operators.charts import (
    active_days_histogram,
    dropoff_chart,
    enrollment_curve_chart,
)
from .operators.funnel import funnel_conversion, get_patient_funnel, get_stage_patients
from .operators.kpis import (
    active_days_snapshot,
    alert_ack,
    assessment_completion,
    assessment_completion_sets,
    compliance_16_30,
    dropoff_risk,
    rolling_active_days,
)
from .operators.overall import (
    get_active_patients,
    get_billable_patient_ids,
    get_billable_patients,
    get_high_fall_risk_patient_ids,
    get_high_fall_risk_patients,
    get_patient_count,
)
from .operators.preparation import coerce_dates, enrich_clinics, infer_date_formats, with_active_day
from .operators.quality import (
    date_conformance,
    date_range,
    null_rates,
    orphan_patients,
    table_profile,
)
from .operators.retention import (
    first_30_statistics,
    get_active_days_in_first_30,
    get_retention_by_active_days,
    retention_milestones,
    top_dropoffs,
)
from .operators.trends import (
    calculate_period_changes,
    get_active_users_biweekly,
    get_enrollments_biweekly,
    period_change_rows,
)
from .plans.report import ReportOptions, report_metrics
from .sources import cluster_fact, load_tables, write_tables

# ruff: noqa: F401
