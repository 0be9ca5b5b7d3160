"""Contracts at the edges: bounds, CSV texts, date forms, missing measures, timestamps."""

import datetime as dt
import re

import pytest
from conftest import TESTDATA, rows

from pulseplan import coerce_dates, load_tables, write_tables
from pulseplan.functions import as_date, as_moment, within
from pulseplan.operators import kpis, overall, preparation
from pulseplan.plans import jobs
from pulseplan.plans.report import ReportOptions, shared_results
from pulseplan.plans.star_schema import derive_tables

SF = str(TESTDATA / "sf0.001")


@pytest.fixture
def plan(spark):
    """The physical plan of a DataFrame as text, with long paths and filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def stamped(spark):
    """A fact table whose ``date`` is a timestamp."""

    def build(*found):
        full = [(p, dt.datetime.fromisoformat(t), a, s) for p, t, a, s in found]
        return spark.createDataFrame(
            full, "patient_id string, date timestamp_ntz, is_active_day int, fall_risk_score double"
        )

    return build


@pytest.mark.parametrize("value", ["2025-12-01garbage", "2025-12", "", "2025-12-01 25:00", "2025-12-01T00:00:00+01:00"])
def test_malformed_bounds_are_errors(value):
    with pytest.raises(ValueError):
        as_moment(value)


@pytest.mark.parametrize("value", ["2025-12-01 18:00", dt.datetime(2025, 12, 1, 18)])
def test_a_time_of_day_is_no_day(value):
    with pytest.raises(ValueError):
        as_date(value)
    assert as_moment(value) == dt.datetime(2025, 12, 1, 18)


def test_whole_days_in_any_form():
    forms = ["2025-12-01", "2025-12-01 00:00", "2025-12-01T00:00:00", dt.date(2025, 12, 1), dt.datetime(2025, 12, 1)]
    assert {as_date(f) for f in forms} == {dt.date(2025, 12, 1)}


def test_bounds_with_a_time_of_day(stamped, fact):
    table = stamped(("a", "2025-12-01 09:00", 1, None), ("b", "2025-12-01 18:00", 1, None), ("c", "2025-12-02 00:00", 1, None))
    got = within(table, "2025-12-01 10:00", "2025-12-02 00:00")
    assert rows(got, "patient_id") == [("b",)]
    with pytest.raises(ValueError):
        within(fact(("a", "2025-12-01", 1)), "2025-12-01 10:00", "2025-12-02")


def test_month_pruning_keeps_the_last_month_with_rows(spark, stamped):
    table = stamped(("a", "2025-11-30 23:00", 1, None), ("b", "2025-12-01 09:00", 1, None))
    table = table.selectExpr("*", "CAST(trunc(date, 'MM') AS date) AS date_month")
    assert rows(within(table, "2025-11-01", "2025-12-01"), "patient_id") == [("a",)]
    assert rows(within(table, "2025-11-01", "2025-12-01 10:00"), "patient_id") == [("a",), ("b",)]


def test_the_as_of_day_counts_whole_for_timestamps(stamped, spark):
    table = stamped(("p", "2025-12-05 08:00", 1, 80.0), ("p", "2025-12-10 09:00", 1, None))
    people = spark.createDataFrame([("p", dt.date(2025, 12, 1))], "patient_id string, first_data_date date")
    risk = kpis.dropoff_risk(table, people, "2025-12-10").first()
    assert (risk.last_active_date, risk.days_since_last_active, risk.status) == (dt.date(2025, 12, 10), 0, "active")
    assert kpis.compliance_16_30(table, people, "2025-12-10").first().active_days_first_30 == 2
    assert kpis.active_days_snapshot(table, people, "2025-12-10").first().active_30 == 2
    assert overall.get_billable_patients(table, "2025-12-01", "2025-12-11", 2).first().billable_count == 1
    assert overall.get_active_patients(table, "2025-12-10", "2025-12-11").first().active_count == 1
    assert overall.get_high_fall_risk_patients(table, "2025-12-10").first().high_risk_count == 1


TEXTS = [("a", " lead"), ("b", "trail "), ("c", 'line1\nline2'), ("d", 'quo"te, comma'), ("e", None), ("f", "\t")]


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    table = spark.createDataFrame(TEXTS, "id string, note string")
    write_tables({"notes": table}, str(tmp_path), fmt="csv")
    got = load_tables(spark, str(tmp_path), multiline=True)["notes"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(TEXTS, key=str)


def test_a_torn_csv_record_fails_the_read(spark, tmp_path):
    write_tables({"notes": spark.createDataFrame(TEXTS, "id string, note string")}, str(tmp_path), fmt="csv")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_tables(spark, str(tmp_path))["notes"].collect()


def test_writing_onto_an_input_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "clinics.csv").write_text("clinic_id,clinic_name,region\nC001,x,y\n")
    with pytest.raises(ValueError, match="is read by"):
        jobs.prepare(spark, folder, folder, str(tmp_path / "checks"), fmt="csv")
    assert (tmp_path / "clinics.csv").read_text().startswith("clinic_id")


def test_assessments_from_csv_with_unreadable_due_dates(spark, tmp_path):
    (tmp_path / "assessment_assignments.csv").write_text(
        "assignment_id,patient_id,clinic_id,assessment_type,assigned_ts,completed_ts,due_date,status\n"
        "1,p,C001,t,2024-01-02,2024-01-03 10:00:00,2024-01-05,completed\n"
        "2,p,C001,t,2024-01-02T08:00:00,2024-01-09 10:00:00,bad,completed\n"
    )
    tables = coerce_dates(load_tables(spark, str(tmp_path)))
    done = kpis.assessment_completion(tables["assessment_assignments"]).first()
    assert (done.week_start, done.assigned, done.completed, done.completed_on_time) == (dt.date(2024, 1, 1), 2, 2, 1)


def test_a_date_column_of_which_nothing_is_read_is_an_error(spark, tmp_path):
    raw, out, checks = (tmp_path / d for d in ("raw", "out", "checks"))
    raw.mkdir()
    (raw / "patients.csv").write_text(
        "patient_id,clinic_id,enrollment_date,install_date,first_data_date,other\np,C001,01/02/2024,,2024-01-05,x\n"
    )
    with pytest.raises(ValueError, match="patients.enrollment_date"):
        jobs.prepare(spark, str(raw), str(out), str(checks))
    given = {"patients": {"enrollment_date": "dd/MM/yyyy", "other": "yyyy"}}
    with pytest.raises(ValueError, match="patients.other"):
        jobs.prepare(spark, str(raw), str(out), str(checks), formats=given)
    jobs.prepare(spark, str(raw), str(out), str(checks), formats={"patients": {"enrollment_date": "dd/MM/yyyy"}})
    assert load_tables(spark, str(out), "parquet")["patients"].first().enrollment_date == dt.date(2024, 2, 1)


def test_a_missing_measure_is_zero(spark):
    nan = float("nan")
    table = spark.createDataFrame(
        [(nan, None), (None, nan), (nan, 300.0), (10.0, nan), (9.0, 299.0)],
        "background_data_minutes double, steps_count double",
    )
    assert [r[0] for r in preparation.with_active_day(table).select("is_active_day").collect()] == [0, 0, 1, 1, 0]


def test_rolling_days_have_one_type(spark, fact):
    table = fact(("a", "2025-12-01", 1))
    types = {kpis.rolling_active_days(table, one_row_per_day=flag).schema["is_active_day"].dataType for flag in (True, False)}
    assert len(types) == 1


def test_the_window_of_assessments_reaches_the_scan(spark, tmp_path, plan):
    derive_tables(spark, SF)["assessment_assignments"].write.parquet(str(tmp_path / "a"))
    table = spark.read.parquet(str(tmp_path / "a"))
    text = plan(kpis.assessment_completion(table, start="1995-01-01", end="1995-02-01"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert "GreaterThanOrEqual(assigned_ts" in pushed and "LessThan(assigned_ts" in pushed


def test_the_report_reads_pruned_facts_five_times(spark, tmp_path, plan):
    write_tables({t: derive_tables(spark, SF)[t] for t in ("patients", "clinics", "fact_patient_day")}, str(tmp_path))
    tables = load_tables(spark, str(tmp_path), "parquet")
    options = ReportOptions.for_day("2024-01-30")
    shared = shared_results(tables, options)
    plans = {name: plan(result) for name, result in shared.items()}
    scans = {n: p.count("fact_patient_day.parquet") for n, p in plans.items()}
    assert scans == {"roll_up": 1, "users": 1, "by_clinic": 1, "curve": 1, "stages": 1}
    assert sum("patients.parquet" in p for p in plans.values()) == 2
    for name in ("roll_up", "by_clinic"):
        assert "date_month" in re.search(r"PartitionFilters: \[(.*?)\]", plans[name])[1]
