"""The seven logical tables, derived from a star schema with an event log.

Customers play the patients, their events the daily activity and the alerts,
orders the assessments, nations the clinics and suppliers the providers. Every
table keeps all rows of its source. Modulo expressions only set column values:
they plant the nulls and the unknown clinics that the metrics have to handle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.preparation import with_active_day

# Column expressions, as SQL text: the clinic of a number, and of an active patient.
_CLINIC = "concat('C', lpad(CAST({} + 1 AS string), 3, '0'))"
_UNKNOWN = "'C099'"
_ACTIVITY_CLINIC = (
    f"CASE WHEN {{0}} % 23 = 0 THEN {_UNKNOWN} ELSE {_CLINIC.format('{0} % 25')} END"
)
_ORIGIN = "DATE'2023-12-22'"


def _clinics(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        f"{_CLINIC.format('n_nationkey')} AS clinic_id",
        "n_name AS clinic_name",
        "CAST(n_regionkey AS string) AS region",
    )


def _patients(customer: DataFrame, events: DataFrame) -> DataFrame:
    first = events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.expr("min(CAST(ts AS date)) AS first_data_date")
    )
    return customer.join(first, "c_custkey", "left").selectExpr(
        "c_custkey AS patient_id",
        f"CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN {_UNKNOWN} "
        f"ELSE {_CLINIC.format('c_nationkey')} END AS clinic_id",
        f"CASE WHEN c_custkey % 17 <> 0 THEN date_add({_ORIGIN}, "
        "CAST(c_custkey * 7 % 30 AS int)) END AS enrollment_date",
        f"CASE WHEN c_custkey % 5 <> 0 THEN date_add({_ORIGIN}, "
        "CAST(c_custkey * 7 % 30 + c_custkey % 4 AS int)) END AS install_date",
        "first_data_date",
    )


def _fact_patient_day(events: DataFrame) -> DataFrame:
    days = (
        events.selectExpr(
            "user_id AS patient_id",
            "CAST(ts AS date) AS date",
            "event_type",
            "value",
            "floor(value) AS whole",
        )
        .groupBy("patient_id", "date")
        .agg(
            F.expr(
                "coalesce(sum(CASE WHEN event_type IN ('view', 'click') THEN whole END), 0) "
                "AS background_data_minutes"
            ),
            F.expr(
                "coalesce(sum(CASE WHEN event_type = 'purchase' THEN whole * 5 END), 0) "
                "AS steps_count"
            ),
            F.expr(
                "max(CASE WHEN event_type = 'error' THEN least(value, 100.0D) END) "
                "AS fall_risk_score"
            ),
        )
    )
    clinic = F.expr(_ACTIVITY_CLINIC.format("patient_id"))
    return with_active_day(days.withColumn("clinic_id", clinic))


def _assignments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("last_ship")
    )
    return orders.join(shipped, "o_orderkey", "left").selectExpr(
        "o_orderkey AS assignment_id",
        "o_custkey AS patient_id",
        f"{_ACTIVITY_CLINIC.format('o_custkey')} AS clinic_id",
        "o_orderpriority AS assessment_type",
        "o_orderdate AS assigned_ts",
        "CASE WHEN o_orderstatus = 'F' THEN last_ship END AS completed_ts",
        "date_add(CAST(o_orderdate AS date), 30) AS due_date",
        "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'assigned' END AS status",
    )


def _alerts(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS alert_id",
        "user_id AS patient_id",
        "event_type AS alert_type",
        "ts AS created_ts",
        "CASE WHEN event_id % 3 <> 0 THEN ts + "
        "make_dt_interval(0, 0, CAST(floor(value) AS int), 0) END AS ack_ts",
    )


def _providers(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey AS provider_id",
        f"{_CLINIC.format('s_suppkey % 25')} AS clinic_id",
    )


def _rtm_monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(
        "patient_id", F.trunc("date", "MM").alias("month_start")
    ).agg(F.sum("is_active_day").alias("active_days"))


# Columns the tables are derived from. Declaring them saves reading the file
# footers for a schema before every query.
_SOURCES = {
    "customer": "c_custkey bigint, c_nationkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint",
}

# Table -> how it is derived, and from which sources.
_DERIVED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "patients": (_patients, ("customer", "events")),
    "fact_patient_day": (_fact_patient_day, ("events",)),
    "clinics": (_clinics, ("nation",)),
    "assessment_assignments": (_assignments, ("orders", "lineitem")),
    "alerts": (_alerts, ("events",)),
    "providers": (_providers, ("supplier",)),
    "rtm_monthly": (lambda e: _rtm_monthly(_fact_patient_day(e)), ("events",)),
}

# Table -> its key and the date columns that are made text, some unreadable.
_SPOILED: dict[str, tuple[str, tuple[str, ...]]] = {
    "patients": ("patient_id", ("enrollment_date", "install_date", "first_data_date")),
    "fact_patient_day": ("patient_id", ("date",)),
    "assessment_assignments": ("assignment_id", ("assigned_ts", "completed_ts")),
    "alerts": ("alert_id", ("created_ts", "ack_ts")),
}


class DerivedTables(Mapping[str, DataFrame]):
    """The seven tables by name; each is declared when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, raw: bool = False) -> None:
        self._spark, self._dir, self._raw = spark, sf_dir, raw
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            derive, sources = _DERIVED[name]
            table = derive(*[self._source(s) for s in sources])
            if self._raw and name in _SPOILED:
                table = self._spoil(table, *_SPOILED[name])
            self._cache[name] = table
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(_DERIVED)

    def __len__(self) -> int:
        return len(_DERIVED)

    def _source(self, name: str) -> DataFrame:
        path = f"{self._dir}/{name}.parquet"
        return self._spark.read.schema(_SOURCES[name]).parquet(path)

    @staticmethod
    def _spoil(table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
        return table.withColumns(
            {
                c: F.expr(
                    f"CASE WHEN {key} % 41 = 0 THEN 'not a date' "
                    f"WHEN {key} % 37 = 0 THEN '2024-13-45' "
                    f"ELSE CAST({c} AS string) END"
                )
                for c in columns
            }
        )


def derive_tables(spark: SparkSession, sf_dir: str) -> DerivedTables:
    """The tables, typed, from the parquet files in ``sf_dir``."""
    return DerivedTables(spark, sf_dir)


def derive_raw_tables(spark: SparkSession, sf_dir: str) -> DerivedTables:
    """The tables before cleaning: dates as text, some of them unreadable."""
    return DerivedTables(spark, sf_dir, raw=True)
