"""Patient count, billable, active and high-risk patients."""

import pytest

from conftest import rows
from pulseplan import (
    get_active_patients,
    get_billable_patient_ids,
    get_billable_patients,
    get_high_fall_risk_patient_ids,
    get_high_fall_risk_patients,
    get_patient_count,
)

WINDOW = ("2025-12-01", "2026-01-01")


def test_patient_count_counts_rows(patients):
    people = patients(("a", None), ("a", None), ("b", "2025-12-01"))
    assert rows(get_patient_count(people)) == [(3,)]


def test_billable_counts_active_rows_in_the_half_open_window(fact):
    table = fact(
        ("a", "2025-11-30", 1),  # before the window
        ("a", "2025-12-01", 1),
        ("a", "2025-12-31", 1),
        ("b", "2025-12-01", 1),
        ("b", "2026-01-01", 1),  # exactly the end: excluded
        ("c", "2025-12-05", 0),
        ("d", "2026-01-02", 1),  # never seen in the window
    )
    assert rows(get_billable_patients(table, *WINDOW, threshold=2)) == [
        (1, 3, 1 / 3 * 100)
    ]
    assert rows(get_billable_patient_ids(table, *WINDOW, threshold=2)) == [("a",)]


def test_a_patient_without_active_days_is_never_billable(fact):
    table = fact(("a", "2025-12-01", 0), ("b", "2025-12-01", 1))
    assert rows(get_billable_patient_ids(table, *WINDOW, threshold=0)) == [("b",)]
    assert rows(get_billable_patients(table, *WINDOW, threshold=0)) == [(1, 2, 50.0)]


def test_active_patients_with_the_rate_over_everyone(fact, patients):
    table = fact(
        ("a", "2025-12-01", 1), ("b", "2025-12-01", 0), ("c", "2025-12-02", None)
    )
    everyone = patients(*[(p, None) for p in "abcd"])
    assert rows(get_active_patients(table, *WINDOW)) == [(1, 3, 1 / 3 * 100)]
    assert rows(get_active_patients(table, *WINDOW, patients=everyone)) == [
        (1, 3, 1 / 3 * 100, 4, 25.0)
    ]


def test_fall_risk_window_and_threshold_are_closed(fact):
    table = fact(
        ("a", "2026-01-01", 1, 70.0),  # exactly 7 days before, exactly 70
        ("b", "2025-12-31", 1, 99.0),  # too old
        ("c", "2026-01-08", 1, 69.9),
        ("d", "2026-01-08", 1, float("nan")),  # NaN is no score
        ("e", "2026-01-05", 1, None),
        ("a", "2026-01-02", 1, 80.0),
        ("f", "2026-01-09", 1, 99.0),  # after the as-of day
    )
    assert rows(get_high_fall_risk_patients(table)) == [(1, 4, 25.0)]
    assert rows(get_high_fall_risk_patient_ids(table)) == [("a",)]
    assert rows(get_high_fall_risk_patients(table, threshold=75)) == [(1, 4, 25.0)]
    assert rows(get_high_fall_risk_patients(table, threshold=81)) == [(0, 4, 0.0)]


@pytest.mark.parametrize("metric", [get_billable_patients, get_active_patients])
def test_an_empty_fact_gives_zeros(fact, metric):
    assert rows(metric(fact(), *WINDOW)) == [(0, 0, 0.0)]


def test_fall_risk_of_an_empty_fact(fact):
    assert rows(get_high_fall_risk_patients(fact())) == [(0, 0, 0.0)]


def test_the_default_window_needs_no_arguments(fact):
    assert rows(get_active_patients(fact(("a", "2000-01-01", 1)))) == [(0, 0, 0.0)]
