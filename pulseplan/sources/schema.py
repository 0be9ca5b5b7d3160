"""Schemas of the seven logical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _D, _TS = T.StringType(), T.DateType(), T.TimestampNTZType()

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "patients": _table(
        patient_id=_S,
        clinic_id=_S,
        enrollment_date=_D,
        install_date=_D,
        first_data_date=_D,
    ),
    "fact_patient_day": _table(
        patient_id=_S,
        date=_D,
        clinic_id=_S,
        background_data_minutes=T.DoubleType(),
        steps_count=T.DoubleType(),
        walk_score=T.DoubleType(),
        fall_risk_score=T.DoubleType(),
        is_active_day=T.IntegerType(),
    ),
    "clinics": _table(clinic_id=_S, clinic_name=_S, region=_S),
    "assessment_assignments": _table(
        assignment_id=_S,
        patient_id=_S,
        clinic_id=_S,
        assessment_type=_S,
        assigned_ts=_TS,
        completed_ts=_TS,
        due_date=_D,
        status=_S,
    ),
    "alerts": _table(
        alert_id=_S,
        patient_id=_S,
        alert_type=_S,
        created_ts=_TS,
        ack_ts=_TS,
    ),
    "providers": _table(provider_id=_S, clinic_id=_S),
    "rtm_monthly": _table(
        patient_id=_S, month_start=_D, active_days=T.LongType()
    ),
}

# The form of date columns unless a pattern is given: a day, with a time of day or not.
ISO = "ISO"
# What such a text looks like. Checking the look and casting is about twice as fast as
# parsing with a pattern, and refuses what a cast alone would take for a date.
ISO_TEXT = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$"
)

# Other usual forms: what such a text looks like -> the patterns that may read it. A time of
# day may follow the day after a blank.
_TIME_TEXT = "( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
_TIME = "[ H:mm[:ss]]"
DATE_FORMS: dict[str, tuple[str, ...]] = {
    f"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_TIME_TEXT}": (f"M/d/yyyy{_TIME}", f"d/M/yyyy{_TIME}"),
    f"^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}{_TIME_TEXT}": (f"M-d-yyyy{_TIME}", f"d-M-yyyy{_TIME}"),
    f"^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}{_TIME_TEXT}": (f"d.M.yyyy{_TIME}",),
    f"^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}{_TIME_TEXT}": (f"yyyy/M/d{_TIME}",),
    "^[0-9]{8}$": ("yyyyMMdd",),
    f"^[0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}}{_TIME_TEXT}": (f"d MMM yyyy{_TIME}",),
    f"^[A-Z][a-z]{{2}} [0-9]{{1,2}}, [0-9]{{4}}{_TIME_TEXT}": (f"MMM d, yyyy{_TIME}",),
}

# Every column that a schema declares as a date or timestamp.
DECLARED_DATES: dict[str, dict[str, str]] = {
    table: {
        f.name: ISO
        for f in schema.fields
        if isinstance(f.dataType, T.DateType | T.TimestampNTZType)
    }
    for table, schema in TABLE_SCHEMAS.items()
}
DECLARED_DATES = {table: columns for table, columns in DECLARED_DATES.items() if columns}

# The columns whose readability is reported: table -> column -> format.
DATE_COLUMNS: dict[str, dict[str, str]] = {
    "patients": {"enrollment_date": ISO, "install_date": ISO, "first_data_date": ISO},
    "fact_patient_day": {"date": ISO},
    "assessment_assignments": {"assigned_ts": ISO, "completed_ts": ISO},
    "alerts": {"created_ts": ISO, "ack_ts": ISO},
}
