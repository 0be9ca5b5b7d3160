"""Rolling activity, compliance, drop-off risk, assessments and alerts."""

import datetime as dt
import random
import statistics

import pytest

from conftest import day, rows
from pulseplan import (
    active_days_snapshot,
    alert_ack,
    assessment_completion,
    assessment_completion_sets,
    compliance_16_30,
    dropoff_risk,
    rolling_active_days,
    with_active_day,
)
from pulseplan.operators.order_statistics import exact_median, median_in_cells, top_cells


def test_active_day_needs_minutes_or_steps(spark):
    table = spark.createDataFrame(
        [(None, 300), (10, None), (9, 299), (None, None)],
        "background_data_minutes int, steps_count int",
    )
    flags = [r.is_active_day for r in with_active_day(table).collect()]
    assert flags == [1, 1, 0, 0]


def test_rolling_windows_count_calendar_days(fact):
    table = fact(
        ("a", "2025-12-01", 1), ("a", "2025-12-09", 1), ("b", "2025-12-09", 0)
    )
    assert rows(rolling_active_days(table)) == [
        ("a", day("2025-12-01"), 1, 1, 1, 1),
        ("a", day("2025-12-09"), 1, 1, 2, 2),
        ("b", day("2025-12-09"), 0, 0, 0, 0),
    ]


def test_rolling_windows_of_repeated_rows(fact):
    table = fact(*[("a", "2025-12-01", 1)] * 3, ("a", "2025-12-02", 0))
    assert rows(rolling_active_days(table, (2,))) == [
        ("a", day("2025-12-01"), 3, 3),
        ("a", day("2025-12-02"), 0, 3),
    ]
    once = table.distinct()
    assert rows(rolling_active_days(once, one_row_per_day=True)) == rows(
        rolling_active_days(once)
    )


def test_snapshot_marks_who_is_too_new(fact, patients):
    people = patients(
        ("a", None, None, "2025-12-01"),
        ("b", None, None, "2025-12-02"),
        ("c", None, None, None),
    )
    table = fact(
        ("a", "2025-12-01", 1),
        ("a", "2025-12-07", 1),
        ("a", "2025-12-08", 1),  # after the as-of day
        ("b", "2025-12-07", 1),
    )
    assert rows(active_days_snapshot(table, people, "2025-12-07", (1, 7))) == [
        ("a", 1, 2, True, True),
        ("b", 1, 1, True, False),
        ("c", 0, 0, False, False),
    ]


@pytest.mark.parametrize(
    ("as_of", "eligible"), [("2025-12-29", False), ("2025-12-30", True)]
)
def test_compliance_is_due_after_thirty_days(fact, patients, as_of, eligible):
    people = patients(("a", None, None, "2025-12-01"), ("b", None, None, None))
    table = fact(*[("a", f"2025-12-{d:02d}", 1) for d in range(1, 17)])
    assert rows(compliance_16_30(table, people, as_of)) == [
        ("a", day("2025-12-01"), 16, eligible, eligible),
        ("b", None, 0, False, False),
    ]


def test_dropoff_after_three_days(fact, patients):
    people = patients(*[(p, None) for p in "abcd"])
    table = fact(
        ("a", "2025-12-05", 1),
        ("b", "2025-12-06", 1),
        ("c", "2025-12-08", 0),
        ("d", "2025-12-01", 1),
        ("d", "2025-12-09", 1),  # not known on the as-of day
    )
    assert rows(dropoff_risk(table, people, "2025-12-08")) == [
        ("a", day("2025-12-05"), 3, "at_risk", True),
        ("b", day("2025-12-06"), 2, "active", False),
        ("c", None, None, "pre_first_data", False),
        ("d", day("2025-12-01"), 7, "at_risk", True),
    ]


@pytest.fixture
def assignments(spark):
    def stamp(text):
        return dt.datetime.fromisoformat(text) if text else None

    data = [
        ("C1", "balance", "2025-12-01", "2025-12-03", "2025-12-05", "completed"),
        ("C1", "balance", "2025-12-07", "2025-12-20", "2025-12-15", "completed"),
        ("C1", "gait", "2025-12-08", None, "2025-12-15", "assigned"),
        (None, "gait", "2025-12-08", "2025-12-09", "2025-12-15", "assigned"),
    ]
    return spark.createDataFrame(
        [(c, t, stamp(a), stamp(e), day(u), s) for c, t, a, e, u, s in data],
        "clinic_id string, assessment_type string, assigned_ts timestamp_ntz, "
        "completed_ts timestamp_ntz, due_date date, status string",
    )


def test_late_completion_is_completed_but_not_on_time(assignments):
    assert rows(assessment_completion(assignments, ["assessment_type"])) == [
        ("balance", 2, 2, 1, 100.0, 50.0),
        ("gait", 2, 0, 0, 0.0, 0.0),
    ]


def test_breakdowns_by_one_dimension_each(assignments):
    sets = assessment_completion_sets(assignments)
    assert rows(sets.drop("completion_rate", "on_time_rate")) == sorted(
        [
            ("assessment_type", None, None, "balance", 2, 2, 1),
            ("assessment_type", None, None, "gait", 2, 0, 0),
            ("clinic_id", None, "C1", None, 3, 2, 1),
            ("clinic_id", None, None, None, 1, 0, 0),
            ("week_start", day("2025-12-01"), None, None, 2, 2, 1),
            ("week_start", day("2025-12-08"), None, None, 2, 0, 0),
        ],
        key=lambda r: [str(v) for v in r],
    )


@pytest.fixture
def alerts(spark):
    t = dt.datetime(2025, 12, 1)
    data = [
        ("fall", t, t + dt.timedelta(hours=1)),
        ("fall", t, t + dt.timedelta(hours=4)),
        ("fall", t, None),
        ("quiet", t, None),
        (None, t, t + dt.timedelta(minutes=30)),
    ]
    return spark.createDataFrame(
        data, "alert_type string, created_ts timestamp_ntz, ack_ts timestamp_ntz"
    )


@pytest.mark.parametrize("rescan", [False, True])
def test_unacknowledged_alerts_lower_the_rate_only(alerts, rescan):
    assert rows(alert_ack(alerts, rescan=rescan)) == [
        (None, 1, 1, 100.0, 0.5),
        ("fall", 3, 2, 2 / 3 * 100, 2.5),
        ("quiet", 1, 0, 0.0, None),
    ]
    assert rows(alert_ack(alerts, by=(), rescan=rescan)) == [(5, 3, 60.0, 1.0)]
    empty = alerts.limit(0)
    assert rows(alert_ack(empty, rescan=rescan)) == []
    assert rows(alert_ack(empty, by=(), rescan=rescan)) == rows(alert_ack(empty, by=()))


def test_exact_median_of_wide_skewed_and_negative_values(spark):
    draw = random.Random(7)
    data = [("hot", draw.randrange(draw.choice([50, 1 << 55]))) for _ in range(3000)]
    data += [("odd", v) for v in (-5, -(1 << 45), 3)]
    data += [("even", v) for v in (-(1 << 21), -1)]
    data += [("same", 9)] * 8 + [("none", None)]
    for i in range(40):
        data += [(f"g{i}", draw.randrange(-(1 << 30), 1 << 30)) for _ in range(i + 1)]
    expected = {
        g: statistics.median([v for k, v in data if k == g])
        for g in {k for k, v in data if v is not None}
    }
    table = spark.createDataFrame(data, "g string, v bigint")
    got = dict(tuple(r) for r in exact_median(table, ["g"], "v").collect())
    assert got == {g: float(m) for g, m in expected.items()}
    cells = top_cells(table, ["g"], "v")
    narrowed = median_in_cells(table, ["g"], "v", cells)
    assert dict(tuple(r) for r in narrowed.collect()) == got


def test_rescanning_shuffles_cells_and_not_the_values(spark):
    """100,000 distinct values over a day: what is stored of each pass is a few cells."""
    table = spark.range(100_000).selectExpr("'g' AS g", "id * 864001 AS v")
    cells = top_cells(table, ["g"], "v")
    assert cells.count() <= 2
    narrowed = median_in_cells(table, ["g"], "v", cells)
    assert rows(narrowed) == [("g", (49_999 + 50_000) / 2 * 864001)]
    lines = narrowed._jdf.queryExecution().executedPlan().toString().splitlines()
    # The rows of the last scan meet the cell of the median, and are counted, before any shuffle.
    scans = [n for n, line in enumerate(lines) if "Range (0, 100000" in line]
    assert scans
    for n in scans:
        above = max(m for m, line in enumerate(lines[:n]) if "Exchange hashpartitioning" in line)
        between = "\n".join(lines[above:n])
        assert "partial_count" in between and "BroadcastHashJoin" in between
