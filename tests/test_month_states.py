"""States by month: the report's results from them, and which months a refresh reads."""

import datetime as dt
import random

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from pulseplan import load_tables, write_tables
from pulseplan.operators.month_states import month_states
from pulseplan.plans import jobs, month_store
from pulseplan.plans.report import (
    ReportOptions,
    shared_results,
    shared_results_of_months,
)
from pulseplan.plans.star_schema import derive_tables

FACT = "patient_id string, clinic_id string, date date, is_active_day int, fall_risk_score double"
PEOPLE = "patient_id string, clinic_id string, enrollment_date date, install_date date, first_data_date date"
OPTIONS = [
    ReportOptions("2024-02-01", "2024-03-01", "2024-01-20", "2024-03-05", "2024-03-01", 5, 2),
    ReportOptions("2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-02-29", 1, 1, 2, 50, 40),
    ReportOptions("2024-03-02", "2024-03-02", "2023-01-01", "2025-01-01", "2024-05-01", 3, 3, 5),
]


def random_tables(spark, seed, repeats):
    """People of a few clinics over half a year, with NULLs, gaps and repeated rows."""
    rng = random.Random(seed)
    start = dt.date(2023, 11, 20)
    fact, people = [], []
    for p in [*(f"p{i}" for i in range(25)), None]:
        for _ in range(rng.randint(0, 150)):
            on = start + dt.timedelta(days=rng.randint(0, 170)) if rng.random() > 0.03 else None
            score = rng.choice([None, float("nan"), 10.0, 70.0, 95.5])
            row = (p, rng.choice(["a", "b", "c", None]), on, rng.choice([0, 1, 1, None]), score)
            fact += [row] * rng.choice(repeats)
        if p:
            dates = [
                start + dt.timedelta(days=rng.randint(0, 150)) if rng.random() > 0.2 else None
                for _ in range(3)
            ]
            people.append((p, "a", *dates))
    return {
        "fact_patient_day": spark.createDataFrame(fact, FACT),
        "patients": spark.createDataFrame(people, PEOPLE),
        "clinics": spark.createDataFrame(
            [("a", "A"), ("b", "B"), ("d", "D")], "clinic_id string, clinic_name string"
        ),
    }


def assert_same(expected, got):
    for name, table in expected.items():
        other = got[name]
        assert table.dtypes == other.dtypes, name
        if name == "roll_up":  # days instead of rows; only zero or not is read
            table, other = (
                t.withColumn("high_scores", F.col("high_scores") > 0) for t in (table, other)
            )
        assert rows(table) == rows(other), name


@pytest.mark.parametrize("repeats", [(1,), (1, 1, 2, 5)])
@pytest.mark.parametrize("options", OPTIONS)
def test_all_results_equal_those_of_the_fact(spark, options, repeats):
    tables = random_tables(spark, 7 + len(repeats), repeats)
    states = month_states(tables["fact_patient_day"])
    expected = shared_results(tables, options)
    assert_same(expected, shared_results_of_months(tables, states, options))


def test_results_of_a_table(spark):
    tables = derive_tables(spark, str(TESTDATA / "sf0.001"))
    options = ReportOptions.for_day("2024-01-30")
    states = month_states(tables["fact_patient_day"])
    expected = shared_results(tables, options)
    assert_same(expected, shared_results_of_months(tables, states, options))


def test_one_row_per_patient_clinic_and_month(spark, fact):
    days = [("a", f"2024-01-{d:02d}", d % 2, None, "c") for d in range(1, 32)]
    states = month_states(fact(*days, ("a", "2024-02-29", 1, 80.0, "c"), ("a", None, 1, None, "c")))
    january, february = sorted(states.collect(), key=lambda r: r.date_month)
    assert (january.seen, january.flagged) == (2**31 - 1, 2**31 - 1)
    assert january.active == sum(1 << d for d in range(0, 31, 2))
    assert (january.repeats, january.scores) == ([], [])
    assert february.seen == february.active == 1 << 28
    assert [tuple(s) for s in february.scores] == [(28, 80.0)]


def test_other_flags_and_times_are_errors(spark, fact):
    with pytest.raises(Exception, match="neither 0 nor 1"):
        month_states(fact(("a", "2024-01-01", 2))).collect()
    with pytest.raises(ValueError, match="holds times"):
        month_states(fact(("a", "2024-01-01", 1)).withColumn("date", F.col("date").cast("timestamp")))


def test_nothing(spark, fact, patients):
    tables = {
        "fact_patient_day": fact(),
        "patients": patients(("a", "2024-01-01")),
        "clinics": spark.createDataFrame([], "clinic_id string, clinic_name string"),
    }
    states = month_states(tables["fact_patient_day"])
    assert rows(states) == []
    expected = shared_results(tables, OPTIONS[0])
    assert_same(expected, shared_results_of_months(tables, states, OPTIONS[0]))


def month(fact, first):
    return fact.filter(F.trunc("date", "MM") == F.lit(first)).withColumn(
        "date_month", F.trunc("date", "MM")
    )


def test_a_refresh_reads_changed_months_alone(spark, tmp_path, monkeypatch):
    tables = random_tables(spark, 3, (1, 2))
    clean, kept = str(tmp_path / "clean"), str(tmp_path / "months")
    write_tables(tables, clean)
    path = f"{clean}/fact_patient_day.parquet"
    read = []

    def watched(fact):
        read.append(sorted(r[0] for r in fact.select("date_month").distinct().collect()))
        return month_states(fact)

    monkeypatch.setattr(month_store, "month_states", watched)

    def agree():
        stored = load_tables(spark, clean, "parquet")
        states = month_store.load_months(spark, path, kept)
        for options in OPTIONS[::2]:
            expected = shared_results(stored, options)
            assert_same(expected, shared_results_of_months(stored, states, options))

    months = month_store.refresh_months(spark, path, kept)
    assert len(months) == 7 and read == [months]
    agree()
    assert month_store.refresh_months(spark, path, kept) == [] and len(read) == 1

    # A new day: its month is written again, and read alone.
    new = spark.createDataFrame([("p1", "a", dt.date(2024, 2, 29), 1, 99.0)] * 3, FACT)
    february = dt.date(2024, 2, 1)
    month_store.replace_months(month(tables["fact_patient_day"].union(new), february), path)
    assert month_store.refresh_months(spark, path, kept) == [february]
    assert read[1:] == [[february]]
    agree()

    # A new month, in another file each time.
    late = spark.createDataFrame([("p2", "b", dt.date(2024, 7, 4), 0, None)], FACT)
    july = dt.date(2024, 7, 1)
    for n in (1, 2):
        month(late, july).write.mode("append").partitionBy("date_month").parquet(path)
        assert month_store.refresh_months(spark, path, kept) == [july]
        agree()
        assert len(read) == 2 + n

    # Months that are gone from the fact are gone from the states.
    write_tables({"fact_patient_day": tables["fact_patient_day"].filter("date < DATE'2024-01-01'")}, clean)
    assert month_store.refresh_months(spark, path, kept) == [dt.date(2023, 11, 1), dt.date(2023, 12, 1)]
    agree()


def test_a_refresh_that_died_is_done_again(spark, tmp_path, monkeypatch):
    tables = random_tables(spark, 5, (1,))
    clean, kept = str(tmp_path / "clean"), str(tmp_path / "months")
    write_tables(tables, clean)
    path = f"{clean}/fact_patient_day.parquet"

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(month_store, "write_tables", dies)
        with pytest.raises(OSError, match="gone"):
            month_store.refresh_months(spark, path, kept)
    months = month_store.refresh_months(spark, path, kept)
    assert len(months) == 7
    assert month_store.load_months(spark, path, kept).count() == month_states(tables["fact_patient_day"]).count()


def test_a_fact_without_dated_rows(spark, tmp_path):
    tables = random_tables(spark, 6, (1,))
    tables["fact_patient_day"] = tables["fact_patient_day"].withColumn("date", F.lit(None).cast("date"))
    clean, kept = str(tmp_path / "clean"), str(tmp_path / "months")
    write_tables(tables, clean)
    path = f"{clean}/fact_patient_day.parquet"
    for _ in range(2):
        assert month_store.refresh_months(spark, path, kept) == []
        states = month_store.load_months(spark, path, kept)
        assert rows(states) == [] and dict(states.dtypes)["patient_id"] == "string"


def test_the_report_job_from_months(spark, tmp_path):
    tables = random_tables(spark, 9, (1, 1, 3))
    clean, kept = str(tmp_path / "clean"), str(tmp_path / "months")
    write_tables(tables, clean)
    common = ["report", clean]
    options = ["--as-of", "2024-03-01", "--weeks", "2", "--active-threshold", "3"]
    jobs.main([*common, str(tmp_path / "plain"), *options])
    jobs.main([*common, str(tmp_path / "by_month"), *options, "--months", kept])
    plain, by_month = (load_tables(spark, str(tmp_path / d), "parquet") for d in ("plain", "by_month"))
    assert sorted(plain) == sorted(by_month)
    for name in plain:
        assert rows(plain[name]) == rows(by_month[name]), name
    with pytest.raises(ValueError, match="parquet"):
        jobs.report(spark, clean, str(tmp_path / "out"), OPTIONS[0], "csv", kept)


def test_the_fact_is_not_read_by_the_report(spark, tmp_path):
    tables = random_tables(spark, 11, (1,))
    clean, kept = str(tmp_path / "clean"), str(tmp_path / "months")
    write_tables(tables, clean)
    path = f"{clean}/fact_patient_day.parquet"
    month_store.refresh_months(spark, path, kept)
    states = month_store.load_months(spark, path, kept)
    options = OPTIONS[1]
    for name, table in shared_results_of_months(tables, states, options).items():
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "fact_patient_day" not in plan, name
    roll_up = shared_results_of_months(tables, states, options)["roll_up"]
    scan = roll_up._jdf.queryExecution().executedPlan().toString()
    assert "date_month" in scan.split("PartitionFilters:")[1].split("]")[0]
