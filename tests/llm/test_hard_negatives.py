"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from conftest import TESTDATA

import oracle
from pulseplan.llm import hard_negatives as hn
from pulseplan.llm import registry

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, block int, kind int, score int, uid int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, 3, 4, 5) for i, v, y in rows], SCHEMA)


def brute(rows):
    good = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        good.append((i, (y + 1) % 10 if i % 7 == 0 else y, tuple(whole)))
    out = []
    for i, y, v in dict.fromkeys(r for r in good if r[0] % 50 == 0):
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in good if j != i and len(v) == len(w)
        )
        for p, positive, _ in [s for s in scored if s[2] == y][:5]:
            inside = [(-s, j) for s, j, z in scored if z != y and -50 * p <= -100 * s <= -95 * p][:3]
            out += [(i, positive, n + 1, j, -p, s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


def mined(frame):
    return sorted(map(tuple, hn.hard_negatives(frame).collect()))


ODD = [
    (0, [1.0, 0.5, 0.0], 1), (50, [0.25, 0.5, -1.0], 2), (1, [1.0, 0.5, 0.0], 1), (2, [0.75, 0.25, 0.0], 3),
    (2, [0.75, 0.25, 0.0], 3), (2, [0.8, 0.25, 0.1], 4), (3, [0.5, 0.5, 0.5], 1), (3, [0.6, 0.4, 0.5], 1),
    (4, None, 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 0.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1),
    (9, [], 1), (None, [1.0, 1.0, 1.0], 1), (10, [0.9, 0.5, 0.1], None), (7, [0.9, 0.5, 0.1], 0),
    (100, [0.0, 0.0, 0.0], 1), (11, [0.2, 0.9], 1), (150, [0.2, 0.8], 1), (12, [0.1, 0.9], 2), (13, [0.1, 0.6], 2),
    (0, [1.0, 0.5, 0.0], 1), (0, [0.3, 0.9, 0.0], 2), (200, [-1.0, -0.5, 0.0], 5), (14, [0.4, 0.1, 0.0], 4),
]


@pytest.mark.parametrize("blocks", [16_384, 3])
def test_odd_rows(spark, blocks, monkeypatch):
    monkeypatch.setattr(hn.mine, "__defaults__", (*hn.mine.__defaults__[:-1], blocks))
    assert mined(table(spark, ODD)) == brute(ODD)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(3, [1.0], 1), (4, [0.6], 2)]])
def test_nothing_to_mine(spark, rows):
    assert mined(table(spark, rows)) == []


def test_hot_vector_and_label(spark):
    """A third of the rows hold one vector, and half of them one label."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist(), int(rng.integers(4))) for i in range(400)]
    rows += [(400 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(200)]
    assert mined(table(spark, rows)) == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(0, [200000.0] * 8, 1), (1, [200000.0] * 8, 1), (2, [150000.00390625] * 8, 2), (3, [120000.0] * 8, 2)]
    assert mined(table(spark, rows)) == brute(rows)
    a = np.full((1, 40), 2.0**25 + 1)
    assert int(hn._scores(a, a)[0, 0]) == 40 * (2**25 + 1) ** 2


def test_plan_has_the_secondary_sort(spark):
    plan = hn.hard_negatives(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    head = plan.split("MapInArrow")[1]
    assert "Sort [anchor" in head and "Exchange hashpartitioning(anchor" in head
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_against_sql(spark, sf):
    sf_dir = str(TESTDATA / sf)
    found = registry.op12_hard_negatives(spark, sf_dir)
    assert oracle.compare(found, oracle.connect(sf_dir), hn.HARD_NEGATIVES_SQL) == []
