"""A directory of tables: CSV and parquet in, CSV and parquet out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import MONTH_PARTITION
from .inference import infer_types, typed_text
from .schema import TABLE_SCHEMAS

# --- fixed values: the texts that stand for a missing value in a CSV field ---
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# --- end of fixed values ---

# Quotes inside a field are doubled, and blanks around a field belong to it.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def list_tables(spark: SparkSession, data_dir: str, suffix: str) -> dict[str, str]:
    """Table name -> path of the ``*.suffix`` entries directly in ``data_dir``.

    An entry is one file, or the directory of part files Spark writes. The
    listing goes through Hadoop's file system, so it works on any storage.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(suffix) and name != suffix:
            found[name[: -len(suffix)]] = status.getPath().toString()
    return dict(sorted(found.items()))


def _typed(name: str, kind: T.DataType) -> Column:
    """The text column ``name`` as ``kind``; dates stay text for `coerce_dates`."""
    text = F.when(~F.col(name).isin(*NA_TOKENS), F.col(name))
    if isinstance(kind, T.IntegralType):
        # 1, 1.0 and True all occur for a flag, depending on who wrote the file.
        flag = F.upper(text)
        whole = F.coalesce(
            text.try_cast("bigint"),
            F.when(flag == "TRUE", F.lit(1)).when(flag == "FALSE", F.lit(0)),
            F.when(~flag.isin("TRUE", "FALSE"), text.cast("double").cast("bigint")),
        )
        return whole.cast(kind).alias(name)
    if isinstance(kind, T.NumericType):
        return text.cast(kind).alias(name)
    return text.alias(name)


def _whole_lines(spark: SparkSession, path: str) -> Column:
    """True, or an error if a line of the file has an odd number of quotes.

    A record that spans lines has such a line wherever it is torn, as every quote in a field
    is doubled and every quoted field is closed.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    torn = spark.read.text(path).agg(F.count_if(quotes % 2 == 1)).scalar()
    message = f"{path} is malformed: records that span lines (to be read with multiline) or open quotes"
    return F.when(torn > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None,
    multiline: bool = False,
    infer: bool = False,
) -> DataFrame:
    """One CSV table: columns of ``schema`` typed, any other column as text.

    Without ``multiline`` a record is a line, so that Spark can split a large file
    between tasks; lines are checked for open quotes, and a record with a line break in a
    field fails the read instead of coming back in pieces. With it, fields may hold line
    breaks and a file is one task.

    ``infer``: other columns take the narrowest type that all their values have: boolean,
    whole number, double, day or time in ISO form, or text. That reads the file once when called.
    """
    options = {**_CSV, "mode": "FAILFAST", "multiLine": multiline}
    rows = spark.read.options(**options).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    if not multiline:
        rows = rows.filter(_whole_lines(spark, path))
    found = {}
    if infer:
        others = [c for c in rows.columns if c not in kinds]
        found = infer_types(rows.select(*[_typed(c, T.StringType()) for c in others]), others)
    return rows.select(
        *[
            typed_text(_typed(c, T.StringType()), found[c]).alias(c)
            if c in found
            else _typed(c, kinds.get(c, T.StringType()))
            for c in rows.columns
        ]
    )


def load_tables(
    spark: SparkSession,
    data_dir: str,
    fmt: str = "csv",
    schemas: Mapping[str, T.StructType] = TABLE_SCHEMAS,
    multiline: bool = False,
    infer: bool = False,
) -> dict[str, DataFrame]:
    """Every table in ``data_dir``, keyed by file stem.

    ``multiline``: CSV fields may hold line breaks. ``infer``: tables and columns that
    ``schemas`` do not name get types from their values (see `read_csv`).

    From CSV, the date columns of ``schemas`` are still text: `operators.preparation.coerce_dates`
    turns them into dates. Parquet keeps its own types.
    """
    found = list_tables(spark, data_dir, f".{fmt}")
    if fmt == "csv":
        return {t: read_csv(spark, p, schemas.get(t), multiline, infer) for t, p in found.items()}
    return {t: spark.read.format(fmt).load(p) for t, p in found.items()}


def _as_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, the form `load_tables` reads back."""
    dated = (T.DateType, T.TimestampNTZType, T.TimestampType)
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, dated)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _resolved(spark: SparkSession, path: str) -> str:
    """The full path, as Hadoop's file system names it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = given.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(given).toString().rstrip("/")


def _refuse_inputs(table: DataFrame, path: str) -> None:
    """An error if writing to ``path`` would replace files that ``table`` reads."""
    target = _resolved(table.sparkSession, path)
    for name in table.inputFiles():
        source = _resolved(table.sparkSession, name)
        if source == target or source.startswith(f"{target}/"):
            raise ValueError(f"{target} is read by the table that would replace it")


def _write(table: DataFrame, path: str, fmt: str, by_month: bool) -> None:
    if fmt == "csv":
        _as_text(table).write.options(**_CSV).csv(path)
    elif by_month:
        (
            table.withColumn(MONTH_PARTITION, F.trunc("date", "MM"))
            .hint("rebalance", MONTH_PARTITION)
            .write.partitionBy(MONTH_PARTITION)
            .format(fmt)
            .save(path)
        )
    else:
        table.write.format(fmt).save(path)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """``staged`` takes the place of ``path``, which comes back if that fails."""
    new, old, place = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, f"{staged}-old", path))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(place)
    if had and not files.rename(place, old):
        raise OSError(f"{path} cannot be replaced")
    if not files.rename(new, place):
        if had:
            files.rename(old, place)
        raise OSError(f"{path} cannot be written")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_tables(
    tables: Mapping[str, DataFrame],
    out_dir: str,
    fmt: str = "parquet",
    fact_by_month: bool = True,
    check: Callable[[], None] | None = None,
) -> None:
    """Write each table to ``out_dir/<name>.<fmt>``, replacing what is there.

    Tables are written to a new folder beside their places first. If one fails, or if
    ``check``, called when all are written, raises, what was there stays as it was. Only
    then each table is moved to its place, one after the other.

    Refuses to replace files that any of the tables reads, before it writes anything.
    Parquet output partitions ``fact_patient_day`` by month, so that date
    windows read only their months. The rebalance hint lets adaptive execution
    split a month that holds most of the rows and merge the small ones.
    """
    folder = out_dir.rstrip("/")
    paths = {name: f"{folder}/{name}.{fmt}" for name in tables}
    for table in tables.values():
        for path in paths.values():
            _refuse_inputs(table, path)
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    try:
        for name, table in tables.items():
            by_month = fact_by_month and name == "fact_patient_day" and fmt != "csv"
            _write(table, f"{staging}/{name}.{fmt}", fmt, by_month)
        if check:
            check()
        for name, path in paths.items():
            _swap(spark, f"{staging}/{name}.{fmt}", path)
    finally:
        _remove(spark, staging)
