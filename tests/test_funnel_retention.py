"""The funnel, first-month activity and the retention curve."""

import datetime as dt
import math

import pytest

from conftest import rows
from pulseplan import (
    dropoff_chart,
    first_30_statistics,
    funnel_conversion,
    get_active_days_in_first_30,
    get_patient_funnel,
    get_retention_by_active_days,
    get_stage_patients,
    retention_milestones,
    top_dropoffs,
)


def span(patient, start, days, active=1):
    first = dt.date.fromisoformat(start)
    return [
        (patient, (first + dt.timedelta(days=i)).isoformat(), active)
        for i in range(days)
    ]


def test_first_data_must_come_within_a_week(fact, patients):
    people = patients(
        ("before", "2025-12-02", None, "2025-12-01"),
        ("same", "2025-12-02", None, "2025-12-02"),
        ("seven", "2025-12-02", None, "2025-12-09"),
        ("eight", "2025-12-02", None, "2025-12-10"),
        ("none", None, None, "2025-12-02"),
    )
    members = rows(get_stage_patients(people, fact()))
    assert [p for s, p in members if s == "first_data"] == ["same", "seven"]


def test_compliance_counts_days_0_to_29(fact, patients):
    people = patients(("a", "2025-12-01"), ("b", "2025-12-01"), ("c", None))
    table = fact(
        *span("a", "2025-11-21", 26),  # day -10 .. 15: sixteen from day 0
        *span("b", "2025-12-16", 16),  # day 15 .. 30: fifteen up to day 29
        *span("c", "2025-12-01", 20),
        *span("stranger", "2025-12-01", 20),
    )
    members = rows(get_stage_patients(people, table))
    assert [p for s, p in members if s == "compliant"] == ["a"]


def test_stages_are_independent_and_rates_half_even(fact, patients):
    people = patients(
        ("a", "2025-12-01", "2025-12-01"),
        ("b", None, "2025-12-01"),
        ("c", None, "2025-12-01"),
    )
    funnel = [tuple(r) for r in get_patient_funnel(people, fact()).collect()]
    assert funnel == [
        ("1. Enrolled", 1, 100.0, 100.0),
        ("2. Installed", 3, 300.0, 300.0),
        ("3. First Data", 0, 0.0, 0.0),
        ("4. 16/30 Compliant", 0, 0.0, None),
    ]
    assert rows(funnel_conversion(people, fact())) == [(1, 0, 0.0)]


def test_nobody_enrolled(fact, patients):
    people = patients(("a", None, "2025-12-01"), ("b", None, "2025-12-02"))
    funnel = [tuple(r)[1:] for r in get_patient_funnel(people, fact()).collect()]
    assert funnel == [
        (0, None, 100.0),
        (2, math.inf, math.inf),
        (0, None, 0.0),
        (0, None, None),
    ]
    assert rows(funnel_conversion(people, fact())) == [(0, 0, 0.0)]


def test_first_month_sums_flags_and_keeps_everyone_enrolled(fact, patients):
    people = patients(("a", "2025-12-02"), ("b", "2025-12-02"), ("c", None))
    table = fact(
        ("a", "2025-12-01", 1),  # day -1
        ("a", "2025-12-02", 1),  # day 0
        ("a", "2025-12-31", 1),  # day 29
        ("a", "2026-01-01", 1),  # day 30
        ("a", "2025-12-05", None),
        ("b", "2025-12-05", 0),
        ("c", "2025-12-05", 1),
    )
    first = get_active_days_in_first_30(people, table)
    assert rows(first) == [("a", 2), ("b", 0)]
    assert dict(first.dtypes)["active_days_in_first_30"] == "int"
    assert rows(first_30_statistics(first)) == [(2, 1.0, 1.0)]


@pytest.fixture
def retention(spark):
    def build(*days):
        return get_retention_by_active_days(
            spark.createDataFrame(
                [(d,) for d in days], "active_days_in_first_30 int"
            )
        )

    return build


def test_retention_curve(retention):
    got = [tuple(r) for r in retention(0, 2, 2, 40).collect()]
    assert len(got) == 31
    assert got[:4] == [
        (0, 4, 100.0, 0, 0.0),
        (1, 3, 75.0, 1, 25.0),
        (2, 3, 75.0, 0, 0.0),
        (3, 1, 25.0, 2, 2 / 3 * 100),
    ]
    assert got[30] == (30, 1, 25.0, 0, 0.0)


def test_retention_of_nobody_is_zero(retention):
    assert {tuple(r)[1:] for r in retention().collect()} == {(0, 0.0, 0, 0.0)}


def test_retention_invariants(retention):
    days = [d % 37 for d in range(0, 900, 7)]
    got = retention(*days).collect()
    users = [r.users_reached for r in got]
    assert users[0] == len(days)
    assert users == sorted(users, reverse=True)
    assert sum(r.drop_from_previous for r in got) == users[0] - users[30]


def test_top_dropoffs_prefer_the_lower_threshold(retention):
    # drops of 5, 7, 5 and 7 users at 1, 2, 3 and 4 active days
    days = [0] * 5 + [1] * 7 + [2] * 5 + [3] * 7
    table = retention(*days)
    assert [r[0] for r in top_dropoffs(table, 3).collect()] == [2, 4, 1]
    chart = {r.threshold: r for r in dropoff_chart(table).collect()}
    assert sorted(chart) == list(range(1, 31))
    assert [k for k, r in chart.items() if r.is_max_drop] == [2]
    assert chart[1].share_of_max == 5 / 7


def test_no_drop_at_all(retention):
    chart = dropoff_chart(retention(30, 30)).collect()
    assert {r.share_of_max for r in chart} == {0.0}
    assert [r.threshold for r in chart if r.is_max_drop] == [1]


def test_milestones(retention):
    got = [r[0] for r in retention_milestones(retention(3)).collect()]
    assert got == [1, 5, 10, 16, 20, 25, 30]
