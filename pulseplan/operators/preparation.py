"""Cleaning: clinic names, date columns and the active-day flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import MIN_BACKGROUND_MINUTES, MIN_STEPS
from ..sources.schema import (
    DATE_COLUMNS,
    DATE_FORMS,
    DECLARED_DATES,
    ISO,
    ISO_TEXT,
    TABLE_SCHEMAS,
)

__all__ = ["DATE_COLUMNS", "DECLARED_DATES", "coerce_dates", "enrich_clinics", "infer_date_formats", "parsed_date", "with_active_day"]

# --- fixed values: names and regions of the clinics ---
CLINIC_NAMES = {
    "C001": "Sunrise Physical Therapy",
    "C002": "Evergreen Rehabilitation Center",
    "C003": "Summit Health Partners",
    "C004": "Coastal Wellness Clinic",
    "C005": "Maple Grove Medical",
    "C006": "Horizon Recovery Institute",
}
CLINIC_REGIONS = {
    "C001": "Florida",
    "C002": "Washington",
    "C003": "Colorado",
    "C004": "California",
    "C005": "Minnesota",
    "C006": "Arizona",
}
# --- end of fixed values ---


def _lookup(mapping: Mapping[str, str], key: str) -> Column:
    pairs = [F.lit(text) for item in mapping.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def enrich_clinics(
    clinics: DataFrame,
    names: Mapping[str, str] = CLINIC_NAMES,
    regions: Mapping[str, str] = CLINIC_REGIONS,
) -> DataFrame:
    """Overwrite clinic_name and region from the mappings; NULL if not in them."""
    return clinics.withColumns(
        {
            "clinic_name": _lookup(names, "clinic_id"),
            "region": _lookup(regions, "clinic_id"),
        }
    )


def _is_date(table: str, column: str) -> bool:
    schema = TABLE_SCHEMAS.get(table)
    fields = {f.name: f.dataType for f in schema.fields} if schema else {}
    return isinstance(fields.get(column), T.DateType)


def parsed_date(table: str, column: str, fmt: str = ISO) -> Column:
    """The text column as a date or timestamp; NULL where it does not parse.

    `ISO` reads any usual ISO form: a day, or a day and a time of day after a blank or
    a T. A date column takes the day of either; a timestamp column reads a bare day as
    its midnight, as such columns are written when all their times are midnight. Any
    other format is a pattern. A column outside the known schemas is a timestamp.
    """
    is_date = _is_date(table, column)
    text = F.col(column)
    if fmt == ISO:
        value = text.try_cast("timestamp_ntz")
        if is_date:
            value = F.coalesce(text.try_cast("date"), value.cast("date"))
        return F.when(text.rlike(ISO_TEXT), value)
    if is_date:
        return F.try_to_date(text, fmt)
    # Read as UTC and counted from the epoch, so that a wall-clock time which the
    # session's time zone skips in spring still comes out as written.
    instant = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(f"{fmt}X"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def _candidates(table: str, column: str) -> list[list[tuple[str, Column]]]:
    """For each look of a text: the forms that may read it, and the column read in each."""
    text = F.col(column)
    found = [[(ISO, parsed_date(table, column))]]
    for look, patterns in DATE_FORMS.items():
        read = [F.when(text.rlike(look), parsed_date(table, column, p)) for p in patterns]
        found.append(list(zip(patterns, read, strict=True)))
    return found


def infer_date_formats(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Mapping[str, str]] = DECLARED_DATES,
) -> dict[str, dict[str, str]]:
    """Table -> text column -> the form that reads most of its values, for `coerce_dates`.

    All values of all columns are read in every form of `DATE_FORMS` and in ISO form, by one
    aggregate per table, of which one row of counts comes back. Values in another form than
    the column's are NULL later. Two forms that read equally many values, most of all, are
    an error if there is a value which they read differently; it names both. A column
    without a readable value stays with the form that ``columns`` gives.
    """
    found: dict[str, dict[str, str]] = {}
    for table, formats in columns.items():
        if table not in tables:
            continue
        kinds = {f.name: f.dataType for f in tables[table].schema.fields}
        texts = [c for c in formats if isinstance(kinds.get(c), T.StringType)]
        if not texts:
            continue
        counts, told = [], {}
        for c in texts:
            for n, forms in enumerate(_candidates(table, c)):
                for i, (form, value) in enumerate(forms):
                    counts.append(F.count(value).alias(f"{c}_{n}_{i}"))
                    told[c, n, i] = form
                    # A text of this look may be two different days in two forms.
                    apart = [~value.eqNullSafe(other) for _, other in forms[:i]]
                    counts += [F.count_if(a).alias(f"{c}_{n}_{j}_{i}") for j, a in enumerate(apart)]
        seen = tables[table].agg(*counts).first()
        found[table] = {}
        for c in texts:
            forms = [(n, i) for column, n, i in told if column == c]
            most = max(seen[f"{c}_{n}_{i}"] for n, i in forms)
            (n, i), *others = [f for f in forms if seen[f"{c}_{f[0]}_{f[1]}"] == most]
            for m, j in others if most else []:
                if m != n or seen[f"{c}_{n}_{i}_{j}"]:
                    names = f"{told[c, n, i]} and as {told[c, m, j]}"
                    raise ValueError(f"{table}.{c} reads as {names}: give a format")
            found[table][c] = told[c, n, i] if most else formats[c]
    return found


def coerce_dates(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Mapping[str, str]] = DECLARED_DATES,
) -> dict[str, DataFrame]:
    """Turn the text date columns of each table into dates and timestamps.

    ``columns``: table -> column -> `ISO` or a pattern; by default every column that
    the schemas declare as a date or timestamp, in ISO form; `infer_date_formats` finds the
    forms of the data. A value in another form is NULL; the `prepare` job
    refuses columns of which nothing could be read. Columns that are typed already are left alone.
    """
    typed = dict(tables)
    for name, formats in columns.items():
        if name in typed:
            fields = {f.name: f.dataType for f in typed[name].schema.fields}
            typed[name] = typed[name].withColumns(
                {
                    c: parsed_date(name, c, fmt)
                    for c, fmt in formats.items()
                    if isinstance(fields.get(c), T.StringType)
                }
            )
    return typed


def _enough(column: str, least: float) -> Column:
    """Whether a measure reaches ``least``; a missing one (NULL or NaN) is zero."""
    value = F.col(column).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0)) >= F.lit(least)


def with_active_day(
    df: DataFrame,
    min_minutes: float = MIN_BACKGROUND_MINUTES,
    min_steps: float = MIN_STEPS,
) -> DataFrame:
    """Add is_active_day: 1 for enough background minutes or enough steps, else 0."""
    active = _enough("background_data_minutes", min_minutes) | _enough("steps_count", min_steps)
    return df.withColumn("is_active_day", active.cast("int"))
