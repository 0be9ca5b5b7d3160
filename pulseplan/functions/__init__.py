"""Column expressions and row filters shared by the operators."""

from .arithmetic import (
    guarded_percent,
    half_even,
    half_even_sql,
    percent,
    percent_sql,
    ratio,
    ratio_sql,
)
from .calendar import (
    as_date,
    as_moment,
    day_offset,
    default_window,
    floored_days,
    has_dates,
    months_after,
    period_end,
    period_label,
    period_start,
    until,
    within,
)

__all__ = [
    "as_date",
    "as_moment",
    "day_offset",
    "default_window",
    "floored_days",
    "guarded_percent",
    "half_even",
    "half_even_sql",
    "has_dates",
    "months_after",
    "percent",
    "percent_sql",
    "period_end",
    "period_label",
    "period_start",
    "ratio",
    "ratio_sql",
    "until",
    "within",
]
