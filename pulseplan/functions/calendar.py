"""Dates: windows, day offsets and reporting periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import MONTH_PARTITION

DateLike = str | dt.date

# Day number (days since 1970-01-01) of Tuesday 1969-12-30, where periods start.
_PERIOD_ORIGIN = -2
_MICROS_PER_DAY = 86_400_000_000


def as_moment(value: DateLike) -> dt.datetime:
    """A point in time from an ISO string, a date or a datetime, all of it read."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time.min)
    if value.tzinfo is not None:
        raise ValueError(f"a bound has no time zone: {value.isoformat()}")
    return value


def as_date(value: DateLike) -> dt.date:
    """A calendar day; a time of day other than midnight is an error."""
    moment = as_moment(value)
    if moment.time() != dt.time.min:
        raise ValueError(f"not a whole day: {value}")
    return moment.date()


def _bound(value: DateLike, fact: DataFrame) -> tuple[Column, dt.datetime]:
    """A bound as a literal that reaches the scan, and as a moment.

    A time of day is kept where ``date`` is a timestamp. Where it is a date, such a
    bound is an error instead of being cut to its day.
    """
    moment = as_moment(value)
    if moment.time() == dt.time.min:
        return F.lit(moment.date()), moment
    if has_dates(fact, "date"):
        raise ValueError(f"column date holds whole days, so {value} is no bound of it")
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz"), moment


def default_window(as_of: DateLike | None = None) -> tuple[dt.date, dt.date]:
    """The 30 days ``[as_of - 31, as_of - 1)``; ``as_of`` defaults to today.

    The only place that reads the wall clock: queries take their bounds as
    arguments.
    """
    day = as_date(as_of) if as_of is not None else dt.date.today()
    return day - dt.timedelta(days=31), day - dt.timedelta(days=1)


def within(
    fact: DataFrame, start: DateLike | None, end: DateLike | None
) -> DataFrame:
    """Rows with ``date`` in ``[start, end)``; without bounds, the default window.

    The bounds are literals, so they reach the parquet scan; on a table that is
    partitioned by month they prune partitions as well.
    """
    if start is None or end is None:
        fallback = default_window()
        start = fallback[0] if start is None else start
        end = fallback[1] if end is None else end
    (lower, first), (upper, last) = _bound(start, fact), _bound(end, fact)
    rows = fact.filter((F.col("date") >= lower) & (F.col("date") < upper))
    if MONTH_PARTITION in fact.columns:
        month = F.col(MONTH_PARTITION)
        # The last month begins before the bound, which may be its first midnight.
        until_day = (last - dt.timedelta(microseconds=1)).date()
        rows = rows.filter(
            (month >= F.lit(first.date().replace(day=1))) & (month <= F.lit(until_day))
        )
    return rows


def until(fact: DataFrame, as_of: DateLike) -> DataFrame:
    """Rows up to the end of the day ``as_of``: what was known by then."""
    day = as_date(as_of)
    rows = fact.filter(F.col("date") < F.lit(day + dt.timedelta(days=1)))
    if MONTH_PARTITION in fact.columns:
        rows = rows.filter(F.col(MONTH_PARTITION) <= F.lit(day))
    return rows


def months_after(fact: DataFrame, anchors: DataFrame, anchor: str, last_day: int) -> DataFrame:
    """``fact`` without the months that no day ``0..last_day`` after an ``anchor`` falls in.

    The bounds are scalar subqueries, known when the scan starts, and act on a table that
    is partitioned by month; on others nothing changes. They are a day wider than needed,
    so that times of day and zones do not matter.
    """
    if MONTH_PARTITION not in fact.columns:
        return fact
    day = F.col(anchor).cast("date")
    first = anchors.agg(F.trunc(F.date_sub(F.min(day), 1), "MM")).scalar()
    last = anchors.agg(F.date_add(F.max(day), last_day + 2)).scalar()
    month = F.col(MONTH_PARTITION)
    return fact.filter((month >= first) & (month <= last))


def floored_days(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, floored (minus six hours is -1)."""
    micros = F.timestamp_diff(
        "MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz")
    )
    day = F.lit(_MICROS_PER_DAY)
    return F.call_function("div", micros - F.pmod(micros, day), day).cast("int")


def has_dates(frame: DataFrame, *columns: str) -> bool:
    """Whether all ``columns`` are calendar days (not timestamps)."""
    return all(isinstance(frame.schema[c].dataType, T.DateType) for c in columns)


def day_offset(fact: DataFrame, patients: DataFrame, anchor: str) -> Column:
    """Days from a patient's ``anchor`` to the fact row's ``date``."""
    if has_dates(fact, "date") and has_dates(patients, anchor):
        return F.datediff("date", anchor)
    return floored_days(F.col("date"), F.col(anchor))


def period_start(day: Column, weeks: int = 1) -> Column:
    """First day (a Tuesday) of the ``weeks``-long period that holds ``day``."""
    day = day.cast("date")
    into = F.pmod(F.unix_date(day) - _PERIOD_ORIGIN, F.lit(7 * weeks))
    return F.date_sub(day, into)


def period_end(start: Column, weeks: int = 1) -> Column:
    """Last day of the period, inclusive."""
    return F.date_add(start, 7 * weeks - 1)


def period_label(start: Column, weeks: int = 1) -> Column:
    """``first day/last day``."""
    return F.concat_ws(
        "/", start.cast("string"), period_end(start, weeks).cast("string")
    )
