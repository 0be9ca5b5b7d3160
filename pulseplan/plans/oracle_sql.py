"""The registered queries once more, as plain SQL to check the results against.

Each text starts with the derived tables as common table expressions. It is
written for DuckDB, straight from the definition of the metric, and shares
nothing with the DataFrame code.
"""

from __future__ import annotations

# --- fixed values: the texts that stand for a missing value in a CSV field ---
_NA = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
    "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
# --- end of fixed values ---

_TABLES = """
WITH clinics AS (
  SELECT 'C' || lpad(CAST(n_nationkey + 1 AS varchar), 3, '0') AS clinic_id,
         n_name AS clinic_name, CAST(n_regionkey AS varchar) AS region
  FROM nation
),
first_seen AS (
  SELECT user_id, min(CAST(ts AS date)) AS first_data_date FROM events GROUP BY user_id
),
patients AS (
  SELECT c_custkey AS patient_id,
         CASE WHEN c_custkey % 29 = 0 THEN NULL
              WHEN c_custkey % 23 = 0 THEN 'C099'
              ELSE 'C' || lpad(CAST(c_nationkey + 1 AS varchar), 3, '0') END AS clinic_id,
         CASE WHEN c_custkey % 17 <> 0
              THEN DATE '2023-12-22' + CAST(c_custkey * 7 % 30 AS int) END AS enrollment_date,
         CASE WHEN c_custkey % 5 <> 0
              THEN DATE '2023-12-22' + CAST(c_custkey * 7 % 30 + c_custkey % 4 AS int)
              END AS install_date,
         first_data_date
  FROM customer LEFT JOIN first_seen ON user_id = c_custkey
),
days AS (
  SELECT user_id AS patient_id, CAST(ts AS date) AS date,
         CAST(coalesce(sum(CASE WHEN event_type IN ('view', 'click')
              THEN CAST(floor(value) AS bigint) END), 0) AS bigint) AS background_data_minutes,
         CAST(coalesce(sum(CASE WHEN event_type = 'purchase'
              THEN 5 * CAST(floor(value) AS bigint) END), 0) AS bigint) AS steps_count,
         max(CASE WHEN event_type = 'error' THEN least(value, 100.0) END) AS fall_risk_score
  FROM events GROUP BY ALL
),
fact AS (
  SELECT *, CASE WHEN patient_id % 23 = 0 THEN 'C099'
                 ELSE 'C' || lpad(CAST(patient_id % 25 + 1 AS varchar), 3, '0') END AS clinic_id,
         CAST(background_data_minutes >= 10 OR steps_count >= 300 AS int) AS is_active_day
  FROM days
),
ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
assignments AS (
  SELECT o_orderkey AS assignment_id, o_custkey AS patient_id,
         CASE WHEN o_custkey % 23 = 0 THEN 'C099'
              ELSE 'C' || lpad(CAST(o_custkey % 25 + 1 AS varchar), 3, '0') END AS clinic_id,
         o_orderpriority AS assessment_type, o_orderdate AS assigned_ts,
         CASE WHEN o_orderstatus = 'F' THEN last_ship END AS completed_ts,
         CAST(o_orderdate AS date) + 30 AS due_date,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'assigned' END AS status
  FROM orders LEFT JOIN ship ON l_orderkey = o_orderkey
),
alerts AS (
  SELECT event_id AS alert_id, user_id AS patient_id, event_type AS alert_type,
         ts AS created_ts,
         CASE WHEN event_id % 3 <> 0
              THEN ts + to_minutes(CAST(floor(value) AS bigint)) END AS ack_ts
  FROM events
),
providers AS (
  SELECT s_suppkey AS provider_id,
         'C' || lpad(CAST(s_suppkey % 25 + 1 AS varchar), 3, '0') AS clinic_id
  FROM supplier
),
rtm_monthly AS (
  SELECT patient_id, CAST(date_trunc('month', date) AS date) AS month_start,
         CAST(sum(is_active_day) AS bigint) AS active_days
  FROM fact GROUP BY 1, 2
)"""

_START, _END, _AS_OF = "DATE '2024-01-01'", "DATE '2024-01-31'", "DATE '2024-01-30'"


def _spoiled(key: str, column: str) -> str:
    return (
        f"CASE WHEN {key} % 41 = 0 THEN 'not a date' WHEN {key} % 37 = 0 "
        f"THEN '2024-13-45' ELSE CAST({column} AS varchar) END"
    )


def _clean(key: str, column: str, kind: str) -> str:
    """The column after cleaning: what was spoiled is NULL."""
    return (
        f"CASE WHEN {key} % 41 = 0 OR {key} % 37 = 0 THEN NULL "
        f"ELSE CAST({column} AS {kind}) END AS {column}"
    )


# Steps that several metrics start from, appended to the tables when named.
_STEPS: dict[str, str] = {
    "in_window": f"SELECT * FROM fact WHERE date >= {_START} AND date < {_END}",
    "dist": """
      SELECT patient_id, count(*) FILTER (WHERE is_active_day = 1) AS active_days
      FROM in_window GROUP BY patient_id""",
    "recent": f"SELECT * FROM fact WHERE date BETWEEN {_AS_OF} - 7 AND {_AS_OF}",
    "weekly": """
      SELECT period_start, count(*) AS active_users
      FROM (SELECT patient_id, CAST(date_trunc('week', date - 1) AS date) + 1 AS period_start
            FROM fact WHERE is_active_day = 1
            GROUP BY ALL HAVING count(*) >= 4)
      GROUP BY period_start""",
    "enrolling": """
      SELECT CAST(date_trunc('week', enrollment_date - 1) AS date) + 1 AS period_start,
             count(*) AS new_patients
      FROM patients WHERE enrollment_date IS NOT NULL GROUP BY 1""",
    "offsets": """
      SELECT p.patient_id, datediff('day', p.enrollment_date, f.date) AS day_no,
             f.is_active_day
      FROM fact f JOIN patients p ON p.patient_id = f.patient_id
      WHERE p.enrollment_date IS NOT NULL""",
    "by_day": """
      SELECT day_no, count(DISTINCT patient_id) AS total, sum(is_active_day) AS active
      FROM offsets WHERE day_no BETWEEN 0 AND 30 GROUP BY day_no""",
    "curve": """
      SELECT CAST(d AS int) AS day_since_enrollment,
             CAST(coalesce(total, 0) AS bigint) AS total_patients,
             CAST(coalesce(active, 0) AS bigint) AS active_patients,
             coalesce(CAST(active AS double) / total * 100, 0.0::double) AS active_rate
      FROM range(31) r(d) LEFT JOIN by_day ON day_no = d""",
    "compliant_ids": """
      SELECT patient_id FROM offsets
      WHERE day_no BETWEEN 0 AND 29 AND is_active_day = 1
      GROUP BY patient_id HAVING count(*) >= 16""",
    "members": """
      SELECT 'enrolled' AS stage, patient_id FROM patients WHERE enrollment_date IS NOT NULL
      UNION ALL
      SELECT 'installed', patient_id FROM patients WHERE install_date IS NOT NULL
      UNION ALL
      SELECT 'first_data', patient_id FROM patients
      WHERE datediff('day', enrollment_date, first_data_date) BETWEEN 0 AND 7
      UNION ALL
      SELECT 'compliant', patient_id FROM compliant_ids""",
    "stages": """
      SELECT no, title, count(patient_id) AS n
      FROM (VALUES (1, 'enrolled', '1. Enrolled'), (2, 'installed', '2. Installed'),
                   (3, 'first_data', '3. First Data'),
                   (4, 'compliant', '4. 16/30 Compliant')) s(no, key, title)
      LEFT JOIN members ON stage = key GROUP BY no, title""",
    "funnel": """
      SELECT no, title AS stage, n AS "count",
             round_even(CAST(n AS double) / first_value(n) OVER (ORDER BY no) * 100, 1)
               AS rate_from_enrolled,
             CASE WHEN no = 1 THEN 100.0::double ELSE
               round_even(CAST(n AS double) / lag(n) OVER (ORDER BY no) * 100, 1)
             END AS rate_from_previous
      FROM stages""",
    "first30": """
      SELECT p.patient_id, CAST(coalesce(s.n, 0) AS int) AS active_days_in_first_30
      FROM patients p LEFT JOIN (
        SELECT patient_id, sum(is_active_day) AS n FROM offsets
        WHERE day_no BETWEEN 0 AND 29 GROUP BY patient_id) s ON s.patient_id = p.patient_id
      WHERE p.enrollment_date IS NOT NULL""",
    "reached": """
      SELECT CAST(k AS int) AS k,
             (SELECT count(*) FROM first30 WHERE active_days_in_first_30 >= k) AS users,
             (SELECT count(*) FROM first30) AS everyone
      FROM range(31) r(k)""",
    "retention": """
      SELECT k AS active_days_threshold, users AS users_reached,
             CAST(users AS double) / everyone * 100 AS pct_reached,
             coalesce(lag(users) OVER w - users, 0) AS drop_from_previous,
             coalesce(CAST(lag(users) OVER w - users AS double)
                      / nullif(lag(users) OVER w, 0) * 100, 0.0::double) AS drop_pct
      FROM reached WINDOW w AS (ORDER BY k)""",
    "first_after_data": f"""
      SELECT p.patient_id, count(*) AS n
      FROM fact f JOIN patients p ON p.patient_id = f.patient_id
      WHERE f.is_active_day = 1 AND f.date <= {_AS_OF}
        AND datediff('day', p.first_data_date, f.date) BETWEEN 0 AND 29
      GROUP BY p.patient_id""",
    "tasks": """
      SELECT assigned_ts, CAST(date_trunc('week', assigned_ts) AS date) AS week_start, clinic_id,
             assessment_type, status = 'completed' AS done,
             status = 'completed' AND CAST(completed_ts AS date) <= due_date AS in_time
      FROM assignments""",
    "waits": """
      SELECT alert_type, ack_ts, datediff('microsecond', created_ts, ack_ts) AS wait
      FROM alerts""",
}

# Which steps a step is itself built on.
_NEEDS: dict[str, tuple[str, ...]] = {
    "dist": ("in_window",),
    "by_day": ("offsets",),
    "curve": ("by_day",),
    "compliant_ids": ("offsets",),
    "members": ("compliant_ids",),
    "stages": ("members",),
    "funnel": ("stages",),
    "first30": ("offsets",),
    "reached": ("first30",),
    "retention": ("reached",),
}


def _sql(steps: str, select: str) -> str:
    """The tables, the named steps with all they need, and the final SELECT."""
    order: list[str] = []

    def add(step: str) -> None:
        for needed in _NEEDS.get(step, ()):
            add(needed)
        if step not in order:
            order.append(step)

    for step in steps.split():
        add(step)
    return _TABLES + "".join(f",\n{s} AS ({_STEPS[s]})" for s in order) + "\n" + select


def _rate(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS double) / {whole} * 100 "
        "ELSE 0.0::double END"
    )


_PERIOD_7 = """period_start, period_start + 6 AS period_end,
       CAST(period_start AS varchar) || '/' || CAST(period_start + 6 AS varchar) AS bi_week"""
_PERIOD_14 = """period_start, period_start + 13 AS period_end,
       CAST(period_start AS varchar) || '/' || CAST(period_start + 13 AS varchar) AS bi_week"""


def _fortnight(day: str) -> str:
    return (
        "DATE '1969-12-30' + CAST(floor((datediff('day', DATE '1970-01-01', "
        f"{day}) + 2) / 14.0) AS int) * 14"
    )


def _changes(value: str) -> str:
    return f"""{value} - lag({value}) OVER (ORDER BY period_start) AS change,
       (CAST({value} AS double) / lag({value}) OVER (ORDER BY period_start) - 1) * 100
         AS pct_change"""


def _fall_risk(threshold: int) -> str:
    return _sql(
        "recent",
        f"""SELECT *, {_rate('high_risk_count', 'total_patients')} AS high_risk_rate,
       CAST(high_risk_count AS double) / all_patients * 100 AS high_risk_rate_all
FROM (SELECT count(DISTINCT patient_id) FILTER (WHERE fall_risk_score >= {threshold})
               AS high_risk_count,
             count(DISTINCT patient_id) AS total_patients,
             (SELECT count(*) FROM patients) AS all_patients
      FROM recent)""",
    )


def _conformance(table: str, name: str, key: str, columns: list[str]) -> list[str]:
    return [
        f"""SELECT '{name}' AS table_name, count(*) AS row_count, '{c}' AS column_name,
       count({_spoiled(key, c)}) AS non_null,
       count(CASE WHEN {key} % 41 <> 0 AND {key} % 37 <> 0 THEN {c} END) AS parseable
FROM {table}"""
        for c in columns
    ]


def _report() -> str:
    """The long table: one SELECT per printed figure or group of figures."""

    def row(section: str, metric: str, value: str, source: str) -> str:
        return (
            f"SELECT '{section}' AS section, {metric} AS metric, "
            f"round(CAST({value} AS double), 9) AS value FROM {source}"
        )

    def one(section: str, metric: str, value: str, source: str) -> str:
        return row(section, f"'{metric}'", value, source)

    everyone = "(SELECT count(*) FROM patients)"
    billable = "count(*) FILTER (WHERE active_days >= 16)"
    active = "count(*) FILTER (WHERE active_days > 0)"
    risky = "count(DISTINCT patient_id) FILTER (WHERE fall_risk_score >= 70)"
    parts = [
        one("overall", "patient_count", "count(*)", "patients"),
        one("overall", "billable_count", billable, "dist"),
        one("overall", "billable_total_patients", "count(*)", "dist"),
        one("overall", "billable_rate", f"CAST({billable} AS double) / count(*) * 100", "dist"),
        one("overall", "active_count", active, "dist"),
        one("overall", "active_rate_all", f"CAST({active} AS double) / {everyone} * 100", "dist"),
        one("overall", "high_risk_count", risky, "recent"),
        one("overall", "high_risk_rate_all", f"CAST({risky} AS double) / {everyone} * 100",
            "recent"),
        one("active_days", "total_patient_days", "count(*)", "in_window"),
        one("active_days", "total_active_days", "sum(is_active_day)", "in_window"),
        one("active_days", "active_days_rate",
            "CAST(sum(is_active_day) AS double) / count(*) * 100", "in_window"),
        one("active_days", "mean_active_days", "avg(active_days)", "dist"),
        one("active_days", "median_active_days", "median(active_days)", "dist"),
        one("active_days", "min_active_days", "min(active_days)", "dist"),
        one("active_days", "max_active_days", "max(active_days)", "dist"),
        one("curve", "mean_active_rate", "avg(active_rate)", "curve"),
        one("curve", "median_active_rate", "median(active_rate)", "curve"),
        one("curve", "min_active_rate", "min(active_rate)", "curve"),
        one("curve", "max_active_rate", "max(active_rate)", "curve"),
        one("retention", "patients", "count(*)", "first30"),
        one("retention", "mean_active_days", "avg(active_days_in_first_30)", "first30"),
        one("retention", "median_active_days", "median(active_days_in_first_30)", "first30"),
        one("funnel", "conversion",
            "CAST(max(n) FILTER (WHERE no = 4) AS double) / max(n) FILTER (WHERE no = 1) * 100",
            "stages"),
    ]
    for column in ("count", "rate_from_enrolled", "rate_from_previous"):
        parts.append(row("funnel", f"'{column}[' || stage || ']'", f'"{column}"', "funnel"))
    for name, source in (("active_users", "weekly"), ("new_patients", "enrolling")):
        changed = f"(SELECT {_PERIOD_7}, {name}, {_changes(name)} FROM {source})"
        parts.append(row("trends", f"'{name}[' || bi_week || ']'", name, changed))
        for c in ("change", "pct_change"):
            rows = f"{changed} WHERE {c} IS NOT NULL"
            parts.append(row("trends", f"'{name}_{c}[' || bi_week || ']'", c, rows))
    clinic = """(SELECT clinic_name, count(is_active_day) AS total_days,
        sum(is_active_day) AS active_days,
        CAST(sum(is_active_day) AS double) / count(is_active_day) * 100 AS active_rate
        FROM in_window JOIN clinics USING (clinic_id) GROUP BY clinic_id, clinic_name)"""
    for c in ("total_days", "active_days", "active_rate"):
        parts.append(row("clinics", f"'{c}[' || clinic_name || ']'", c, clinic))
    top = """(SELECT * FROM retention WHERE active_days_threshold > 0
        ORDER BY drop_from_previous DESC, active_days_threshold LIMIT 5)"""
    for c in ("drop_from_previous", "drop_pct"):
        parts.append(row("retention", f"'{c}[' || active_days_threshold || ']'", c, top))
    miles = "retention WHERE active_days_threshold IN (1, 5, 10, 16, 20, 25, 30)"
    for c in ("users_reached", "pct_reached"):
        parts.append(row("retention", f"'{c}[' || active_days_threshold || ']'", c, miles))
    return _sql(
        "dist recent curve funnel weekly enrolling retention",
        "\nUNION ALL\n".join(parts),
    )


def all_oracles() -> dict[str, str]:
    """Query name -> SQL text."""
    snapshot = ",\n       ".join(
        f"CAST(coalesce(a{n}, 0) AS bigint) AS active_{n}, "
        f"coalesce({_AS_OF} >= first_data_date + {n - 1}, false) AS eligible_{n}"
        for n in (7, 14, 30)
    )
    recent_sums = ", ".join(
        f"sum(is_active_day) FILTER (WHERE date > {_AS_OF} - {n}) AS a{n}"
        for n in (7, 14, 30)
    )
    rolling = ",\n       ".join(
        f"""CAST(sum(is_active_day) OVER (PARTITION BY patient_id
         ORDER BY datediff('day', DATE '1970-01-01', date)
         RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS bigint) AS active_{n}"""
        for n in (7, 14, 30)
    )
    task_counts = f"""count(*) AS assigned, count(*) FILTER (WHERE done) AS completed,
       count(*) FILTER (WHERE in_time) AS completed_on_time,
       {_rate('count(*) FILTER (WHERE done)', 'count(*)')} AS completion_rate,
       {_rate('count(*) FILTER (WHERE in_time)', 'count(*)')} AS on_time_rate"""
    profile = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {source}"
        for name, source, n in (
            ("patients", "patients", 5),
            ("fact_patient_day", "fact", 7),
            ("clinics", "clinics", 3),
            ("assessment_assignments", "assignments", 8),
            ("alerts", "alerts", 5),
            ("providers", "providers", 2),
            ("rtm_monthly", "rtm_monthly", 3),
        )
    )
    nulls = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round_even(avg(CAST({c} IS NULL AS int)) * 100, 2) "
        "AS null_pct FROM patients"
        for c in ("clinic_id", "enrollment_date", "install_date", "first_data_date")
    )
    conformance = " UNION ALL ".join(
        _conformance("patients", "patients", "patient_id",
                     ["enrollment_date", "install_date", "first_data_date"])
        + _conformance("fact", "fact_patient_day", "patient_id", ["date"])
        + _conformance("assignments", "assessment_assignments", "assignment_id",
                       ["assigned_ts", "completed_ts"])
        + _conformance("alerts", "alerts", "alert_id", ["created_ts", "ack_ts"])
    )
    conformance = (
        "SELECT table_name, row_count, column_name, non_null, parseable, "
        f"non_null - parseable AS unparseable FROM ({conformance})"
    )
    return {
        "patient_count": _sql("", "SELECT count(*) AS patient_count FROM patients"),
        "billable_patients": _sql("dist", f"""
SELECT *, {_rate('billable_count', 'total_patients')} AS billable_rate
FROM (SELECT count(*) FILTER (WHERE active_days >= 16) AS billable_count,
             count(*) AS total_patients FROM dist)"""),
        "billable_patient_ids": _sql(
            "dist", "SELECT patient_id FROM dist WHERE active_days >= 16"),
        "active_patients": _sql("in_window", f"""
SELECT *, {_rate('active_count', 'total_patients')} AS active_rate,
       CAST(active_count AS double) / all_patients * 100 AS active_rate_all
FROM (SELECT count(DISTINCT patient_id) FILTER (WHERE is_active_day = 1) AS active_count,
             count(DISTINCT patient_id) AS total_patients,
             (SELECT count(*) FROM patients) AS all_patients
      FROM in_window)"""),
        "high_fall_risk": _fall_risk(70),
        "high_fall_risk_strict": _fall_risk(75),
        "high_fall_risk_ids": _sql(
            "recent", "SELECT DISTINCT patient_id FROM recent WHERE fall_risk_score >= 70"),
        "active_users_period": _sql(
            "weekly", f"SELECT {_PERIOD_7}, active_users FROM weekly"),
        "active_users_14d": _sql("", f"""
SELECT {_PERIOD_14}, count(*) AS active_users
FROM (SELECT patient_id, {_fortnight('date')} AS period_start
      FROM fact WHERE is_active_day = 1 GROUP BY ALL HAVING count(*) >= 8)
GROUP BY period_start"""),
        "enrollments_period": _sql(
            "enrolling", f"SELECT {_PERIOD_7}, new_patients FROM enrolling"),
        "enrollments_14d": _sql("", f"""
SELECT {_PERIOD_14}, count(*) AS new_patients
FROM (SELECT {_fortnight('enrollment_date')} AS period_start
      FROM patients WHERE enrollment_date IS NOT NULL)
GROUP BY period_start"""),
        "active_users_changes": _sql("weekly", f"""
SELECT {_PERIOD_7}, active_users, {_changes('active_users')} FROM weekly"""),
        "enrollment_changes": _sql("enrolling", f"""
SELECT {_PERIOD_7}, new_patients, {_changes('new_patients')} FROM enrolling"""),
        "enrollment_change_rows": _sql("enrolling", f"""
SELECT * FROM (SELECT {_PERIOD_7}, new_patients, {_changes('new_patients')} FROM enrolling)
WHERE change IS NOT NULL"""),
        "total_active_rate": _sql("in_window", f"""
SELECT *, {_rate('total_active_days', 'total_patient_days')} AS active_days_rate
FROM (SELECT count(*) AS total_patient_days,
             CAST(sum(is_active_day) AS bigint) AS total_active_days FROM in_window)"""),
        "active_rate_by_clinic": _sql("in_window", """
SELECT clinic_id, clinic_name, count(is_active_day) AS total_days,
       CAST(sum(is_active_day) AS bigint) AS active_days,
       CAST(sum(is_active_day) AS double) / count(is_active_day) * 100 AS active_rate
FROM in_window JOIN clinics USING (clinic_id) GROUP BY clinic_id, clinic_name"""),
        "active_day_distribution": _sql("dist", "SELECT * FROM dist"),
        "active_day_stats": _sql("dist", """
SELECT avg(active_days) AS mean, median(active_days) AS median,
       min(active_days) AS min, max(active_days) AS max FROM dist"""),
        "enrollment_curve": _sql("curve", "SELECT * FROM curve"),
        "enrollment_curve_summary": _sql("curve", """
SELECT round(avg(active_rate), 9) AS mean_active_rate,
       median(active_rate) AS median_active_rate,
       min(active_rate) AS min_active_rate, max(active_rate) AS max_active_rate
FROM curve"""),
        "patient_funnel": _sql("funnel", """
SELECT stage, "count", rate_from_enrolled, rate_from_previous FROM funnel"""),
        "funnel_members": _sql("members", "SELECT stage, patient_id FROM members"),
        "funnel_conversion": _sql("stages", f"""
SELECT enrolled, compliant, {_rate('compliant', 'enrolled')} AS rate
FROM (SELECT max(n) FILTER (WHERE no = 1) AS enrolled,
             max(n) FILTER (WHERE no = 4) AS compliant FROM stages)"""),
        "first30_active_days": _sql("first30", "SELECT * FROM first30"),
        "first30_stats": _sql("first30", """
SELECT count(*) AS patients, avg(active_days_in_first_30) AS mean,
       median(active_days_in_first_30) AS median FROM first30"""),
        "retention_curve": _sql("retention", "SELECT * FROM retention"),
        "top_dropoffs": _sql("retention", """
SELECT * FROM retention WHERE active_days_threshold > 0
ORDER BY drop_from_previous DESC, active_days_threshold LIMIT 5"""),
        "retention_milestones": _sql("retention", """
SELECT * FROM retention WHERE active_days_threshold IN (1, 5, 10, 16, 20, 25, 30)"""),
        "report_metrics": _report(),
        "report_from_months": _report(),
        "stored_profile": "\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count, "
            f"(SELECT CAST(count(*) AS int) FROM (DESCRIBE {t})) AS column_count FROM {t}"
            for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")
        ),
        "table_profile": _sql("", profile),
        "null_rates": _sql("", nulls),
        "date_range": _sql("", """
SELECT min(date) AS min_date, max(date) AS max_date,
       CAST(datediff('day', max(date), min(date)) AS int) AS day_difference FROM fact"""),
        "orphan_patients": _sql("", """
SELECT count(*) AS orphan_patients FROM patients
WHERE clinic_id IS NULL OR clinic_id NOT IN (SELECT clinic_id FROM clinics)"""),
        "clinics_enriched": _sql("", """
SELECT clinic_id,
       CASE clinic_id WHEN 'C001' THEN 'Sunrise Physical Therapy'
         WHEN 'C002' THEN 'Evergreen Rehabilitation Center'
         WHEN 'C003' THEN 'Summit Health Partners' WHEN 'C004' THEN 'Coastal Wellness Clinic'
         WHEN 'C005' THEN 'Maple Grove Medical' WHEN 'C006' THEN 'Horizon Recovery Institute'
       END AS clinic_name,
       CASE clinic_id WHEN 'C001' THEN 'Florida' WHEN 'C002' THEN 'Washington'
         WHEN 'C003' THEN 'Colorado' WHEN 'C004' THEN 'California'
         WHEN 'C005' THEN 'Minnesota' WHEN 'C006' THEN 'Arizona' END AS region
FROM clinics"""),
        "active_day_flag": _sql("", """
SELECT patient_id, date, background_data_minutes, steps_count, is_active_day FROM fact"""),
        "rolling_active_days": _sql("", f"""
SELECT patient_id, date, CAST(is_active_day AS bigint) AS is_active_day,
       {rolling}
FROM fact"""),
        "active_days_snapshot": _sql("", f"""
SELECT p.patient_id, {snapshot}
FROM patients p LEFT JOIN (
  SELECT patient_id, {recent_sums} FROM fact WHERE date <= {_AS_OF} GROUP BY patient_id
) s ON s.patient_id = p.patient_id"""),
        "compliance_16_30": _sql("first_after_data", f"""
SELECT patient_id, first_data_date, active_days_first_30, eligible,
       eligible AND active_days_first_30 >= 16 AS compliant
FROM (SELECT p.patient_id, first_data_date, coalesce(n, 0) AS active_days_first_30,
             coalesce({_AS_OF} >= first_data_date + 29, false) AS eligible
      FROM patients p LEFT JOIN first_after_data c ON c.patient_id = p.patient_id)"""),
        "dropoff_risk": _sql("", f"""
SELECT patient_id, last_active_date,
       CAST({_AS_OF} - last_active_date AS int) AS days_since_last_active,
       CASE WHEN last_active_date IS NULL THEN 'pre_first_data'
            WHEN {_AS_OF} - last_active_date >= 3 THEN 'at_risk' ELSE 'active' END AS status,
       coalesce({_AS_OF} - last_active_date >= 3, false) AS at_risk
FROM (SELECT p.patient_id, l.last_active_date FROM patients p LEFT JOIN (
        SELECT patient_id, max(date) AS last_active_date FROM fact
        WHERE is_active_day = 1 AND date <= {_AS_OF} GROUP BY patient_id
      ) l ON l.patient_id = p.patient_id)"""),
        "assessment_completion": _sql("tasks", f"""
SELECT week_start, clinic_id, assessment_type, {task_counts}
FROM tasks GROUP BY week_start, clinic_id, assessment_type"""),
        "assessment_completion_window": _sql("tasks", f"""
SELECT week_start, clinic_id, assessment_type, {task_counts}
FROM tasks
WHERE assigned_ts >= TIMESTAMP '1995-01-01' AND assigned_ts < TIMESTAMP '1995-04-01 12:00:00'
GROUP BY week_start, clinic_id, assessment_type"""),
        "assessment_completion_sets": _sql("tasks", f"""
SELECT CASE WHEN grouping(week_start) = 0 THEN 'week_start'
            WHEN grouping(clinic_id) = 0 THEN 'clinic_id'
            ELSE 'assessment_type' END AS dimension,
       week_start, clinic_id, assessment_type, {task_counts}
FROM tasks GROUP BY GROUPING SETS ((week_start), (clinic_id), (assessment_type))"""),
        "alert_ack": _sql("waits", f"""
SELECT alert_type, count(*) AS total, count(ack_ts) AS acked,
       {_rate('count(ack_ts)', 'count(*)')} AS ack_rate,
       median(wait) / 3600000000 AS median_hours_to_ack
FROM waits GROUP BY alert_type"""),
        "alert_ack_rescan": _sql("waits", f"""
SELECT alert_type, count(*) AS total, count(ack_ts) AS acked,
       {_rate('count(ack_ts)', 'count(*)')} AS ack_rate,
       median(wait) / 3600000000 AS median_hours_to_ack
FROM waits GROUP BY alert_type"""),
        "alert_ack_overall": _sql("waits", f"""
SELECT count(*) AS total, count(ack_ts) AS acked,
       {_rate('count(ack_ts)', 'count(*)')} AS ack_rate,
       median(wait) / 3600000000 AS median_hours_to_ack
FROM waits"""),
        "hist_active_days": _sql("dist", """
SELECT CAST(b AS int) AS bin, count(active_days) AS patients, b = 16 AS is_threshold
FROM range(32) r(b) LEFT JOIN dist
  ON active_days BETWEEN 0 AND 32 AND least(active_days, 31) = b
GROUP BY b"""),
        "curve_chart": _sql("curve", """
SELECT *, round(avg(active_rate) OVER (), 9) AS mean_rate FROM curve"""),
        "dropoff_chart": _sql("retention", """
SELECT active_days_threshold AS threshold, drop_from_previous AS "drop",
       CASE WHEN max(drop_from_previous) OVER () > 0
            THEN CAST(drop_from_previous AS double) / max(drop_from_previous) OVER ()
            ELSE 0.0::double END AS share_of_max,
       row_number() OVER (ORDER BY drop_from_previous DESC, active_days_threshold) = 1
         AS is_max_drop
FROM retention WHERE active_days_threshold > 0"""),
        "date_conformance": _sql("", conformance),
        "dates_coerced": _sql("", f"""
SELECT patient_id, clinic_id, {_clean('patient_id', 'enrollment_date', 'date')},
       {_clean('patient_id', 'install_date', 'date')},
       {_clean('patient_id', 'first_data_date', 'date')}
FROM patients"""),
        "dates_inferred": _sql("", f"""
SELECT patient_id, clinic_id, {_clean('patient_id', 'enrollment_date', 'date')},
       {_clean('patient_id', 'install_date', 'date')},
       {_clean('patient_id', 'first_data_date', 'date')}
FROM patients"""),
        "dates_coerced_fact": _sql("", f"""
SELECT patient_id, {_clean('patient_id', 'date', 'date')}, is_active_day FROM fact"""),
        "dates_coerced_assignments": _sql("", f"""
SELECT assignment_id, {_clean('assignment_id', 'assigned_ts', 'timestamp')},
       {_clean('assignment_id', 'completed_ts', 'timestamp')}
FROM assignments"""),
        "dates_coerced_alerts": _sql("", f"""
SELECT alert_id, {_clean('alert_id', 'created_ts', 'timestamp')},
       {_clean('alert_id', 'ack_ts', 'timestamp')}
FROM alerts"""),
        "csv_inferred": """
SELECT *, o_totalprice > 150000 AS o_large, CAST(o_orderdate AS DATE) AS o_day FROM orders""",
        "csv_roundtrip": _sql("", "SELECT * FROM patients"),
        "csv_texts": f"""
SELECT doc_id, CASE WHEN text NOT IN ({_NA}) THEN text END AS text,
       CASE WHEN source NOT IN ({_NA}) THEN source END AS source
FROM documents""",
    }
