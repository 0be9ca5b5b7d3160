"""Operators against plain-Python counts on random tables with repeated rows and NULLs."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows

from pulseplan import (
    active_days_snapshot,
    compliance_16_30,
    dropoff_risk,
    get_active_days_in_first_30,
    get_active_users_biweekly,
    get_billable_patients,
    get_high_fall_risk_patient_ids,
    get_stage_patients,
    rolling_active_days,
)

FIRST = dt.date(2025, 11, 20)
AS_OF = dt.date(2026, 1, 8)


def later(days):
    return FIRST + dt.timedelta(days=days)


@pytest.fixture(scope="module", params=[1, 2, 3])
def world(request, spark):
    draw = random.Random(request.param)

    def maybe(value, share=0.15):
        return None if draw.random() < share else value

    people = [
        (
            p,
            maybe(later(draw.randrange(25))),
            maybe(later(draw.randrange(30))),
            maybe(later(draw.randrange(35))),
        )
        for p in range(40)
    ]
    fact = []
    for p in range(45):  # five of them are not patients
        for _ in range(draw.choice([0, 5, 30, 60])):
            day, flag = later(draw.randrange(60)), draw.choice([1, 1, 1, 0, None])
            score = draw.choice([None, float("nan"), 10.0, 69.99, 70.0, 88.0])
            fact += [(p, day, flag, score)] * draw.choice([1, 1, 1, 2])
    frames = (
        spark.createDataFrame(
            people,
            "patient_id bigint, enrollment_date date, install_date date, "
            "first_data_date date",
        ),
        spark.createDataFrame(
            fact,
            "patient_id bigint, date date, is_active_day int, fall_risk_score double",
        ),
    )
    return people, fact, *frames


def active_within(fact, anchors, days):
    """Active rows on days [0, days) after each patient's anchor."""
    counts = Counter()
    for p, day, flag, _ in fact:
        anchor = anchors.get(p)
        if anchor and flag == 1 and 0 <= (day - anchor).days < days:
            counts[p] += 1
    return counts


def test_billable(world):
    _, fact, _, table = world
    inside = [r for r in fact if dt.date(2025, 12, 1) <= r[1] < dt.date(2026, 1, 1)]
    active = Counter(p for p, _, flag, _ in inside if flag == 1)
    enough, seen = sum(n >= 16 for n in active.values()), len({r[0] for r in inside})
    assert rows(get_billable_patients(table, "2025-12-01", "2026-01-01")) == [
        (enough, seen, enough / seen * 100)
    ]


def test_fall_risk(world):
    _, fact, _, table = world
    high = {
        p
        for p, day, _, score in fact
        if score is not None and score >= 70 and 0 <= (AS_OF - day).days <= 7
    }
    assert {r[0] for r in rows(get_high_fall_risk_patient_ids(table))} == high


@pytest.mark.parametrize(("weeks", "threshold"), [(1, 3), (2, 8)])
def test_active_users(world, weeks, threshold):
    _, fact, _, table = world
    origin = dt.date(1969, 12, 30)
    active = Counter(
        (p, (day - origin).days // (7 * weeks)) for p, day, flag, _ in fact if flag == 1
    )
    users = Counter(period for (_, period), n in active.items() if n >= threshold)
    expected = [
        (origin + dt.timedelta(days=period * 7 * weeks), n)
        for period, n in sorted(users.items())
    ]
    got = get_active_users_biweekly(table, threshold, weeks)
    assert rows(got, "period_start", "active_users") == expected


def test_funnel_stages(world):
    people, fact, patients, table = world
    first_month = active_within(fact, {p: e for p, e, _, _ in people}, 30)
    expected = defaultdict(set)
    for p, enrolled, installed, data in people:
        if enrolled:
            expected["enrolled"].add(p)
        if installed:
            expected["installed"].add(p)
        if enrolled and data and 0 <= (data - enrolled).days <= 7:
            expected["first_data"].add(p)
        if first_month[p] >= 16:
            expected["compliant"].add(p)
    got = defaultdict(set)
    for stage, p in rows(get_stage_patients(patients, table)):
        assert p not in got[stage]
        got[stage].add(p)
    assert dict(got) == {k: v for k, v in expected.items() if v}


def test_first_month(world):
    people, fact, patients, table = world
    counts = active_within(fact, {p: e for p, e, _, _ in people}, 30)
    expected = {p: counts[p] for p, enrolled, _, _ in people if enrolled}
    assert dict(rows(get_active_days_in_first_30(patients, table))) == expected


def test_compliance(world):
    people, fact, patients, table = world
    known = [r for r in fact if r[1] <= AS_OF]
    counts = active_within(known, {p: d for p, _, _, d in people}, 30)
    for p, first, days, eligible, compliant in rows(
        compliance_16_30(table, patients, AS_OF)
    ):
        due = first is not None and (AS_OF - first).days >= 29
        assert (days, eligible) == (counts[p], due)
        assert compliant == (due and counts[p] >= 16)


def test_snapshot_and_dropoff(world):
    people, fact, patients, table = world
    sums, last = defaultdict(Counter), {}
    for p, day, flag, _ in fact:
        if flag == 1 and day <= AS_OF:
            last[p] = max(day, last.get(p, day))
            for n in (7, 14, 30):
                sums[n][p] += (AS_OF - day).days < n
    got = rows(active_days_snapshot(table, patients, AS_OF))
    assert len(got) == len(people)
    for p, *rest in got:
        assert rest[:3] == [sums[n][p] for n in (7, 14, 30)]
    for p, day, since, status, at_risk in rows(dropoff_risk(table, patients, AS_OF)):
        assert day == last.get(p)
        if day is None:
            assert (since, status, at_risk) == (None, "pre_first_data", False)
        else:
            assert since == (AS_OF - day).days
            assert (status, at_risk) == (
                ("at_risk", True) if since >= 3 else ("active", False)
            )


def test_rolling(world):
    _, fact, _, table = world
    flags = defaultdict(Counter)
    for p, day, flag, _ in fact:
        flags[p][day] += flag or 0
    got = rows(rolling_active_days(table))
    assert len(got) == sum(len(days) for days in flags.values())
    for p, day, today, *sums in got:
        assert today == flags[p][day]
        assert sums == [
            sum(v for d, v in flags[p].items() if 0 <= (day - d).days < n)
            for n in (7, 14, 30)
        ]
