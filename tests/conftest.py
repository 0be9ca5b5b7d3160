import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).parent)]

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture
def fact(spark):
    """Builds a fact table from (patient, date, active[, score[, clinic]]) tuples."""

    def build(*rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(
            [(p, day(d), a, s, c) for p, d, a, s, c in full],
            "patient_id string, date date, is_active_day int, "
            "fall_risk_score double, clinic_id string",
        )

    return build


@pytest.fixture
def patients(spark):
    """Builds patients from (id, enrollment[, install[, first data[, clinic]]])."""

    def build(*rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(
            [(p, day(e), day(i), day(f), c) for p, e, i, f, c in full],
            "patient_id string, enrollment_date date, install_date date, "
            "first_data_date date, clinic_id string",
        )

    return build


def rows(df, *columns):
    """The rows as sorted tuples, NULLs first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [str(v) for v in r])
