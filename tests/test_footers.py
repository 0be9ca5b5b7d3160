"""Sizes and ranges of stored tables from the footers of their files."""

from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from pulseplan import load_tables, write_tables
from pulseplan.operators import overall, quality
from pulseplan.plans.star_schema import derive_tables
from pulseplan.sources import footer_tables


def pushed(query):
    plan = query._jdf.queryExecution().executedPlan().toString()
    return plan.count("PushedAggregation: ["), plan


def test_counts_and_ranges_are_answered_by_footers(spark, tmp_path):
    tables = derive_tables(spark, str(TESTDATA / "sf0.001"))
    kept = {t: tables[t] for t in ("patients", "fact_patient_day", "clinics")}
    kept["fact_patient_day"] = kept["fact_patient_day"].union(
        kept["fact_patient_day"].limit(3).withColumn("date", F.lit(None).cast("date"))
    )
    kept["providers"] = tables["providers"].limit(0)
    write_tables(kept, str(tmp_path))
    plain, found = load_tables(spark, str(tmp_path), "parquet"), footer_tables(spark, str(tmp_path))
    assert sorted(found) == sorted(kept)
    for query, marks in (
        (lambda t: quality.table_profile(t), ["COUNT(*)"]),
        (lambda t: quality.date_range(t["fact_patient_day"]), ["MIN(date)", "MAX(date)"]),
        (lambda t: overall.get_patient_count(t["patients"]), ["COUNT(*)"]),
        (lambda t: overall.get_patient_count(t["providers"]), ["COUNT(*)"]),
    ):
        assert rows(query(plain)) == rows(query(found))
        count, plan = pushed(query(found))
        assert count and all(mark in plan for mark in marks)
        assert pushed(query(plain))[0] == 0


def test_the_session_keeps_its_settings(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    write_tables({"t": spark.range(5).toDF("a")}, str(tmp_path))
    table = footer_tables(spark, str(tmp_path))["t"]
    assert rows(table.filter("a > 2")) == [(3,), (4,)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
