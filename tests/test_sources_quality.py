"""CSV and parquet directories, cleaning and data-quality tables."""

import datetime as dt

import pytest

from conftest import day, rows
from pulseplan import (
    coerce_dates,
    date_conformance,
    date_range,
    enrich_clinics,
    get_billable_patients,
    infer_date_formats,
    load_tables,
    null_rates,
    orphan_patients,
    table_profile,
    write_tables,
)
from pulseplan.sources import shared_folder
from pulseplan.sources.inference import infer_types


@pytest.fixture
def csv_dir(tmp_path):
    (tmp_path / "patients.csv").write_text(
        "patient_id,clinic_id,enrollment_date,install_date,first_data_date,note\n"
        'P1,C001,2025-12-01,bad,,"said ""hi"", twice"\n'
        "P2,NA,,2025-12-02,2025-13-01,null\n"
    )
    (tmp_path / "fact_patient_day.csv").write_text(
        "patient_id,date,clinic_id,is_active_day,fall_risk_score\n"
        "P1,2025-12-01,C001,1,NaN\n"
        "P1,2025-12-02,C001,True,71.5\n"
        "P2,2025-12-02,,1.0,\n"
        "P2,nope,,False,N/A\n"
    )
    (tmp_path / "other.csv").write_text("a,b\n1,x\n")
    (tmp_path / "readme.txt").write_text("not a table")
    (tmp_path / "nested").mkdir()
    return str(tmp_path)


def test_a_directory_of_csv_files_is_a_database(spark, csv_dir):
    tables = load_tables(spark, csv_dir)
    assert sorted(tables) == ["fact_patient_day", "other", "patients"]
    assert rows(tables["other"]) == [("1", "x")]
    assert rows(tables["patients"]) == [
        ("P1", "C001", "2025-12-01", "bad", None, 'said "hi", twice'),
        ("P2", None, None, "2025-12-02", "2025-13-01", None),
    ]
    assert rows(tables["fact_patient_day"], "is_active_day", "fall_risk_score") == [
        (0, None),
        (1, 71.5),
        (1, None),
        (1, None),
    ]


def test_unreadable_dates_become_null(spark, csv_dir):
    tables = coerce_dates(load_tables(spark, csv_dir))
    assert rows(tables["patients"], "enrollment_date", "install_date", "first_data_date") == [
        (day("2025-12-01"), None, None),
        (None, day("2025-12-02"), None),
    ]
    assert rows(date_range(tables["fact_patient_day"])) == [
        (day("2025-12-01"), day("2025-12-02"), -1)
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-12-01 10:20:30", dt.datetime(2025, 12, 1, 10, 20, 30)),
        ("2025-12-01 10:20:30.5", dt.datetime(2025, 12, 1, 10, 20, 30, 500000)),
        ("2025-12-01", dt.datetime(2025, 12, 1)),  # a column of midnights is written so
        ("2025-12-01T10:20", dt.datetime(2025, 12, 1, 10, 20)),
        ("2025-12-01 10:20:30Z", None),
        ("2025-12-01 10:20:30.", None),
        ("2025-12-1 10:20:30", None),
        ("2025-02-29 10:20:30", None),
        ("2025-12-01 24:00:00", None),
        ("bad", None),
        (None, None),
    ],
)
def test_one_format_per_timestamp_column(spark, text, expected):
    table = spark.createDataFrame([(text, None)], "created_ts string, ack_ts string")
    assert coerce_dates({"alerts": table})["alerts"].first()[0] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-12-01", "2025-12-01"),
        ("2024-02-29", "2024-02-29"),
        ("2025-02-29", None),
        ("2025-12", None),
        ("2025-12-01 00:00:00", "2025-12-01"),  # a time of day may follow
        (" 2025-12-01", None),
    ],
)
def test_one_format_per_date_column(spark, text, expected):
    table = spark.createDataFrame([(text,)], "date string")
    got = coerce_dates({"fact_patient_day": table})["fact_patient_day"].first()[0]
    assert got == day(expected)


def test_another_format_can_be_declared(spark):
    patients = spark.createDataFrame(
        [("01/12/2025",), ("2025-12-01",)], "enrollment_date string"
    )
    alerts = spark.createDataFrame(
        [("09.03.2025 02:30",), ("2025-03-09 02:30:00",)], "created_ts string"
    )
    formats = {
        "patients": {"enrollment_date": "dd/MM/yyyy"},
        "alerts": {"created_ts": "dd.MM.yyyy HH:mm"},
    }
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        typed = coerce_dates({"patients": patients, "alerts": alerts}, formats)
        got = [[r[0] for r in typed[t].collect()] for t in ("patients", "alerts")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [[day("2025-12-01"), None], [dt.datetime(2025, 3, 9, 2, 30), None]]


def test_wall_clock_times_do_not_depend_on_the_session_zone(spark):
    table = spark.createDataFrame(
        [("2025-03-09 02:30:00", None)], "created_ts string, ack_ts string"
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = coerce_dates({"alerts": table})["alerts"].first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == dt.datetime(2025, 3, 9, 2, 30)


def test_conformance_counts_what_parses(spark, csv_dir):
    got = rows(date_conformance(load_tables(spark, csv_dir)))
    assert got == [
        ("fact_patient_day", 4, "date", 4, 3, 1),
        ("patients", 2, "enrollment_date", 1, 1, 0),
        ("patients", 2, "first_data_date", 1, 0, 1),
        ("patients", 2, "install_date", 2, 1, 1),
    ]


def test_csv_round_trip(spark, tmp_path):
    t = dt.datetime(2025, 12, 1, 1, 2, 3, 4)
    alerts = spark.createDataFrame(
        [("1", "P,1", 'a "b"', t, None), ("2", None, "x", None, t)],
        "alert_id string, patient_id string, alert_type string, "
        "created_ts timestamp_ntz, ack_ts timestamp_ntz",
    )
    write_tables({"alerts": alerts}, str(tmp_path / "out"), fmt="csv")
    back = coerce_dates(load_tables(spark, str(tmp_path / "out")))["alerts"]
    assert rows(back) == rows(alerts)
    assert back.dtypes == alerts.dtypes


def test_stored_fact_prunes_months(spark, fact, tmp_path):
    table = fact(("a", "2025-11-30", 1), ("a", "2025-12-01", 1), ("b", "2026-01-01", 1))
    write_tables({"fact_patient_day": table}, str(tmp_path))
    stored = load_tables(spark, str(tmp_path), "parquet")["fact_patient_day"]
    result = get_billable_patients(stored, "2025-12-01", "2026-01-01", threshold=1)
    assert rows(result) == [(1, 1, 100.0)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_month" in plan
    assert (tmp_path / "fact_patient_day.parquet" / "date_month=2025-12-01").is_dir()


def test_clinics_outside_the_mapping_lose_their_name(spark):
    clinics = spark.createDataFrame(
        [("C001", "x", "y"), ("C777", "x", "y"), (None, "x", "y")],
        "clinic_id string, clinic_name string, region string",
    )
    assert rows(enrich_clinics(clinics)) == [
        ("C001", "Sunrise Physical Therapy", "Florida"),
        ("C777", None, None),
        (None, None, None),
    ]


def test_orphans_have_a_missing_or_unknown_clinic(spark, patients):
    people = patients(
        ("a", None, None, None, "C1"),
        ("b", None, None, None, None),
        ("c", None, None, None, "C9"),
        ("d", None, None, None, "C9"),
    )
    clinics = spark.createDataFrame([("C1",), ("C2",), (None,)], "clinic_id string")
    assert rows(orphan_patients(people, clinics)) == [(3,)]
    assert rows(orphan_patients(people.limit(0), clinics)) == [(0,)]


def test_null_rates_and_profile(patients):
    people = patients(("a", "2025-12-01"), ("b", None), ("c", None))
    assert rows(null_rates(people, ["patient_id", "enrollment_date"])) == [
        ("enrollment_date", 66.67),
        ("patient_id", 0.0),
    ]
    assert rows(table_profile({"patients": people})) == [("patients", 3, 5)]


def test_scratch_folder_follows_the_cluster_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark, "csv")
    assert folder != shared_folder(spark, "csv")
    if configured:
        assert folder.startswith(configured)


def written(spark, folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


@pytest.mark.parametrize(
    "record",
    ['1,"line1\nline2,x"', '1,"a\nb"', '1,"a ""b""\nc"', '"1\n2","3\n4"', '1,"\n"'],
)
def test_torn_records_fail_whatever_their_commas(spark, tmp_path, record):
    folder = written(spark, tmp_path, notes=f"id,note\n{record}\n2,plain\n")
    # Spark itself refuses pieces with too few fields, if it meets them first.
    with pytest.raises(Exception, match="records that span lines|Malformed|MALFORMED"):
        load_tables(spark, folder)["notes"].collect()
    with pytest.raises(Exception, match="records that span lines|Malformed|MALFORMED"):
        load_tables(spark, folder)["notes"].select("id").collect()
    whole = load_tables(spark, folder, multiline=True)["notes"]
    assert whole.count() == 2


def test_whole_records_with_quotes_pass(spark, tmp_path):
    folder = written(spark, tmp_path, notes='id,note\n1,"a ""b"", c"\n2,"""x"""\n3,\n')
    got = rows(load_tables(spark, folder)["notes"])
    assert got == [("1", 'a "b", c'), ("2", '"x"'), ("3", None)]


def test_types_are_inferred_from_all_values(spark, tmp_path):
    text = (
        "flag,n,x,mixed,day,ts,word,empty,zip\n"
        "true,1,1,1,2024-01-31,2024-01-31 10:00:00,a,,007\n"
        "FALSE,-20,2.5e3,2.5,2024-02-29,2024-01-31,1,NA,12\n"
        "NA,,.5,x,,,true,,\n"
    )
    table = load_tables(spark, written(spark, tmp_path, other=text), infer=True)["other"]
    assert dict(table.dtypes) == {
        "flag": "boolean", "n": "bigint", "x": "double", "mixed": "string", "day": "date",
        "ts": "timestamp_ntz", "word": "string", "empty": "string", "zip": "bigint",
    }
    first = table.first()
    assert (first.flag, first.n, first.x, first.day, first.zip) == (True, 1, 1.0, day("2024-01-31"), 7)
    assert table.filter("flag is null and n is null and x = 0.5").count() == 1


@pytest.mark.parametrize("text", ["2024-02-30", "1d", "99999999999999999999", "2024", "0x1F", " 1"])
def test_odd_values_are_not_narrowed_too_far(spark, text):
    found = infer_types(spark.createDataFrame([(text,)], "v string"), ["v"])["v"].simpleString()
    assert found == {"2024": "bigint", "99999999999999999999": "double"}.get(text, "string")


def test_declared_columns_keep_their_types(spark, tmp_path):
    folder = written(spark, tmp_path, clinics="clinic_id,beds\n1,20\n2,30\n")
    assert load_tables(spark, folder, infer=True)["clinics"].dtypes == [("clinic_id", "string"), ("beds", "bigint")]
    assert load_tables(spark, folder)["clinics"].dtypes == [("clinic_id", "string"), ("beds", "string")]


def test_inference_over_no_rows(spark, tmp_path):
    table = load_tables(spark, written(spark, tmp_path, other="a,b\n"), infer=True)["other"]
    assert table.dtypes == [("a", "string"), ("b", "string")] and table.count() == 0


@pytest.mark.parametrize(
    "texts, form, days",
    [
        (["01/31/2024", "02/01/2024", "junk"], "M/d/yyyy[ H:mm[:ss]]", ["2024-01-31", "2024-02-01", None]),
        (["31.01.2024", "1.2.2024", None], "d.M.yyyy[ H:mm[:ss]]", ["2024-01-31", "2024-02-01", None]),
        (["13/02/2024", "03/04/2024"], "d/M/yyyy[ H:mm[:ss]]", ["2024-02-13", "2024-04-03"]),
        (["2024-01-31", "2024-02-01", "01/02/2024"], "ISO", ["2024-01-31", "2024-02-01", None]),
        (["20240131", "20240230"], "yyyyMMdd", ["2024-01-31", None]),
        (["31 Jan 2024", "1 Feb 2024"], "d MMM yyyy[ H:mm[:ss]]", ["2024-01-31", "2024-02-01"]),
        (["04/04/2024", "05/05/2024"], "M/d/yyyy[ H:mm[:ss]]", ["2024-04-04", "2024-05-05"]),
        (["x", None], "ISO", [None, None]),
    ],
)
def test_the_form_of_dates_is_that_of_the_data(spark, texts, form, days):
    table = spark.createDataFrame([(t,) for t in texts], "enrollment_date string")
    formats = infer_date_formats({"patients": table})
    assert formats == {"patients": {"enrollment_date": form}}
    got = coerce_dates({"patients": table}, formats)["patients"]
    assert [r[0] for r in got.collect()] == [day(d) for d in days]


def test_times_of_day_in_other_forms(spark):
    table = spark.createDataFrame([("31.01.2024 9:05",), ("31.01.2024",)], "created_ts string")
    formats = infer_date_formats({"alerts": table})
    got = [r[0] for r in coerce_dates({"alerts": table}, formats)["alerts"].collect()]
    assert got == [dt.datetime(2024, 1, 31, 9, 5), dt.datetime(2024, 1, 31)]


@pytest.mark.parametrize("texts", [["03/04/2024", "05/06/2024"], ["2024-01-31", "01/31/2024"]])
def test_ambiguous_dates_name_both_forms(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "enrollment_date string")
    with pytest.raises(ValueError, match="patients.enrollment_date reads as .* and as .*: give a format"):
        infer_date_formats({"patients": table})


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    def content():
        found = {t: rows(df) for t, df in load_tables(spark, str(tmp_path), "parquet").items()}
        return found, sorted(p.name for p in tmp_path.iterdir())

    one = {t: spark.createDataFrame([(n,)], "v int") for n, t in enumerate(("a", "b"))}
    write_tables(one, str(tmp_path))
    before = content()
    assert before[1] == ["a.parquet", "b.parquet"]
    bad = {"a": spark.createDataFrame([(7,)], "v int"), "b": spark.range(1).selectExpr("raise_error('no') AS v")}
    with pytest.raises(Exception, match="no"):
        write_tables(bad, str(tmp_path))
    assert content() == before

    def refuse():
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        write_tables({"a": bad["a"], "c": bad["a"]}, str(tmp_path), check=refuse)
    assert content() == before
    write_tables({"a": bad["a"], "c": bad["a"]}, str(tmp_path))
    assert content()[0] == {"a": [(7,)], "b": [(1,)], "c": [(7,)]}
    assert content()[1] == ["a.parquet", "b.parquet", "c.parquet"]
