"""Facts stored by month and by patient: what is read, what is shuffled, and the results."""

import re
from pathlib import Path

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F
from test_plans import plan, small_shuffles  # noqa: F401

from pulseplan import (
    compliance_16_30,
    get_active_days_in_first_30,
    get_active_rate_by_day_since_enrollment,
    get_patient_funnel,
    load_tables,
    rolling_active_days,
    write_tables,
)
from pulseplan.plans.star_schema import derive_tables
from pulseplan.sources import cluster_fact

JOINS = {
    "curve": lambda p, f: get_active_rate_by_day_since_enrollment(p, f),
    "first": lambda p, f: get_active_days_in_first_30(p, f),
    "funnel": lambda p, f: get_patient_funnel(p, f),
    "compliance": lambda p, f: compliance_16_30(f, p, "2024-03-01"),
}


def days(spark):
    """400 patients, enrolled in February 2024, with a row for each day of half a year."""
    people = spark.range(400).selectExpr(
        "id AS patient_id",
        "date_add(DATE'2024-02-01', CAST(id % 20 AS int)) AS enrollment_date",
        "CAST(NULL AS date) AS install_date",
        "date_add(DATE'2024-02-03', CAST(id % 20 AS int)) AS first_data_date",
    )
    fact = spark.range(400 * 180).selectExpr(
        "id % 400 AS patient_id",
        "date_add(DATE'2023-12-01', CAST(id DIV 400 AS int)) AS date",
        "CAST(hash(id) % 3 = 0 AS int) AS is_active_day",
    )
    return people, fact


@pytest.fixture
def by_month(spark, tmp_path):
    people, fact = days(spark)
    write_tables({"patients": people, "fact_patient_day": fact}, str(tmp_path))
    stored = load_tables(spark, str(tmp_path), fmt="parquet")
    return people, fact, stored["patients"], stored["fact_patient_day"]


@pytest.mark.parametrize("name", sorted(JOINS))
def test_only_months_near_an_anchor_are_read(spark, by_month, name):
    people, fact, stored_people, stored_fact = by_month
    query = JOINS[name](stored_people, stored_fact)
    assert rows(query) == rows(JOINS[name](people, fact))
    text = plan(query)
    assert re.search(r"PartitionFilters: \[[^]]*date_month#\d+ >= [^]]*ubquery", text)
    # February and March, and January for the day of slack, of seven months.
    months = stored_fact.select("date_month").distinct().count()
    assert months == 6
    read = re.findall(r"number of partitions read: (\d+)", metrics(query))
    assert read and max(map(int, read)) <= 3


def metrics(query):
    """The scan metrics of a plan that has run, as text."""
    query.collect()
    found, todo = [], [query._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            values = node.metrics()
            if values.contains("numPartitions"):
                found.append(f"number of partitions read: {values.apply('numPartitions').value()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "\n".join(found)


def test_no_anchor_reads_no_month(spark, by_month):
    _, _, people, fact = by_month
    none = people.withColumn("enrollment_date", F.lit(None).cast("date"))
    curve = get_active_rate_by_day_since_enrollment(none, fact)
    assert {r[1:3] for r in rows(curve)} == {(0, 0)}


def exchanges_over_the_fact(text):
    """Exchanges in a plan's text that lie between the fact's scan and the first join or window above it."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "is_active_day" in line)
    depth = lambda line: len(re.match(r"[^A-Za-z(*]*", line).group())
    count, here = 0, depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            if "Join" in line or "Window" in line:
                return count
            count += "Exchange" in line
    raise AssertionError("no join or window")


@pytest.fixture
def clustered(spark, tmp_path):
    people, fact = days(spark)
    name = f"fact_{tmp_path.name}".replace("-", "_")
    yield people, fact, cluster_fact(fact, name, str(tmp_path / "fact"), 8)
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("name", sorted(JOINS))
def test_a_clustered_fact_is_joined_where_it_lies(spark, small_shuffles, clustered, name):  # noqa: F811
    people, fact, stored = clustered
    query = JOINS[name](people, stored)
    assert exchanges_over_the_fact(plan(query)) == 0
    assert exchanges_over_the_fact(plan(JOINS[name](people, stored.hint("rebalance")))) > 0
    assert rows(query) == rows(JOINS[name](people, fact))


def test_a_clustered_fact_rolls_without_an_exchange(spark, clustered):
    _, fact, stored = clustered
    query = rolling_active_days(stored)
    assert exchanges_over_the_fact(plan(query)) == 0 and "Exchange" not in plan(query)
    assert rows(query) == rows(rolling_active_days(fact))


def test_clustered_tables_are_not_replaced(spark, clustered, tmp_path):
    people, fact, stored = clustered
    name = f"fact_{tmp_path.name}".replace("-", "_")
    with pytest.raises(Exception, match="already exists"):
        cluster_fact(fact, name, str(tmp_path / "other"), 8)
    with pytest.raises(ValueError):
        cluster_fact(fact, "any", str(Path(tmp_path) / "third"), 0)


def test_derived_tables_agree(spark, tmp_path):
    tables = derive_tables(spark, str(TESTDATA / "sf0.001"))
    kept = {name: tables[name] for name in ("patients", "fact_patient_day")}
    write_tables(kept, str(tmp_path))
    stored = load_tables(spark, str(tmp_path), fmt="parquet")
    for query in JOINS.values():
        got = query(stored["patients"], stored["fact_patient_day"])
        assert rows(got) == rows(query(tables["patients"], tables["fact_patient_day"]))
