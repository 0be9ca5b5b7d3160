"""Types of text columns, from what all of their values look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import ISO_TEXT

_WHOLE = "^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _as_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin("true", "false"), word == "true")


# From narrow to wide; a column takes the first type that reads all of its values. Casts
# alone read more than these looks allow, such as 1d or a year for a date.
_READERS = {
    T.BooleanType(): _as_boolean,
    T.LongType(): lambda text: F.when(text.rlike(_WHOLE), text.try_cast("bigint")),
    T.DoubleType(): lambda text: F.when(text.rlike(_NUMBER), text.try_cast("double")),
    T.DateType(): lambda text: F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date")),
    T.TimestampNTZType(): lambda text: F.when(text.rlike(ISO_TEXT), text.try_cast("timestamp_ntz")),
}


def typed_text(text: Column, kind: T.DataType) -> Column:
    """``text`` as an inferred type; text stays as it is."""
    return _READERS[kind](text) if kind in _READERS else text


def infer_types(texts: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """Column -> the narrowest type that every value has; text if there is none or no value.

    One aggregate over all rows, whatever the number of columns; what comes back is one
    row of counts.
    """
    if not columns:
        return {}
    kinds = list(_READERS)
    counts = []
    for n, name in enumerate(columns):
        text = F.col(f"`{name}`")
        counts.append(F.count(text).alias(f"{n}_set"))
        counts += [F.count(_READERS[k](text)).alias(f"{n}_{i}") for i, k in enumerate(kinds)]
    seen = texts.agg(*counts).first()
    found = {}
    for n, name in enumerate(columns):
        fits = [k for i, k in enumerate(kinds) if seen[f"{n}_set"] and seen[f"{n}_{i}"] == seen[f"{n}_set"]]
        found[name] = fits[0] if fits else T.StringType()
    return found
