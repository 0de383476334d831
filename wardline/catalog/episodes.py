"""Covered days, drug courses, readmissions, follow-up, clinic visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import END, FLOOR, STAY_END, query, rounded, view, views
from wardline.operators.clean import between_dates
from wardline.operators.episodes import (admissions_within, covered_days, drug_courses, drug_offset, effective_end,
                                         first_death, first_episode, first_visit, follow_up, index_date,
                                         length_of_stay, merge_intervals, positive_tests, readmission_chain,
                                         readmission_count, readmission_los, reattendance_days, stay_offsets,
                                         treatment_window, visit_count, visit_course_cost, with_courses, within_flags)
from wardline.operators.lookup import in_cohort

# --- shared steps, in both languages ---------------------------------------------------------

INDEX_SQL = f"""
firsts AS (SELECT * FROM stays WHERE admission_date >= DATE '{FLOOR}'
           QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY admission_date, hn_number) = 1),
tested AS (SELECT ref, MIN(reference_datetime) AS pcr_date FROM tests
           WHERE test_description LIKE '%PCR%' AND result IN ('Detected', 'Detected  **') GROUP BY ref),
cohort AS (SELECT f.ref, COALESCE(t.pcr_date, f.admission_date) AS start_episode FROM firsts f LEFT JOIN tested t ON f.ref = t.ref
           WHERE COALESCE(t.pcr_date, f.admission_date) >= DATE '{FLOOR}')"""
INDEX = views("stays", "tests").rstrip() + "," + INDEX_SQL

OFFSETS_SQL = """
g0 AS (SELECT DISTINCT s.ref, CAST(s.admission_date - c.start_episode AS INT) AS start_day,
              CAST(CASE WHEN s.discharge_status IN ('ACUTE', 'CONV.') THEN NULL ELSE s.discharge_date END - c.start_episode AS INT) AS end_day
       FROM stays s JOIN cohort c ON s.ref = c.ref WHERE s.admission_date >= c.start_episode)"""


def _pass_sql(i: int, last: bool) -> str:
    before = "(SELECT *, end_day AS e0 FROM g0)" if i == 1 else f"g{i - 1}"
    keep = "" if last else " WHERE NOT (start_day IS NULL AND end_day IS NULL) AND NOT COALESCE(gap_time < 0, FALSE)"
    return f""",
f{i} AS (SELECT ref, start_day, e0, COALESCE(end_day, LEAD(end_day) OVER w) AS end_day FROM {before}
        WINDOW w AS (PARTITION BY ref ORDER BY start_day, e0 NULLS LAST)),
h{i} AS (SELECT *, start_day - LAG(end_day) OVER w AS gap_time, ROW_NUMBER() OVER w AS nth FROM f{i}
        WINDOW w AS (PARTITION BY ref ORDER BY start_day, e0 NULLS LAST)),
g{i} AS (SELECT * FROM h{i}{keep})"""


CHAIN_SQL = OFFSETS_SQL + "".join(_pass_sql(i, i == 6) for i in range(1, 7)) + """,
chain AS (SELECT ref, start_day, end_day, CAST(gap_time AS INT) AS gap_time,
                 CAST(CASE WHEN nth = 1 THEN 9999999 WHEN gap_time IS NOT NULL THEN nth - 1 END AS INT) AS gap_mark FROM g6)"""
CHAIN = INDEX + "," + CHAIN_SQL


def index_cohort(spark, sf):
    stays = between_dates(view(spark, sf, "stays"), "admission_date", FLOOR)
    return index_date(first_episode(stays), positive_tests(view(spark, sf, "tests")), FLOOR).select("ref", "start_episode")


def chain(spark, sf, cohort):
    offsets = stay_offsets(effective_end(view(spark, sf, "stays")), cohort)
    return readmission_chain(offsets, unique=True)


# --- queries --------------------------------------------------------------------------------------

@query("covered_days", views("dispensing") + """, d AS (SELECT DISTINCT ref, drug_name, prescription_start + CAST(u AS INT) AS day
FROM dispensing, UNNEST(GENERATE_SERIES(0, dispensing_duration - 1)) AS t(u))
SELECT ref, drug_name, COUNT(*) AS days FROM d GROUP BY 1, 2""")
def _(spark, sf):
    return covered_days(view(spark, sf, "dispensing"), ["ref", "drug_name"], "prescription_start", "dispensing_duration")


@query("length_of_stay", INDEX + f""", d AS (SELECT DISTINCT s.ref, s.admission_date + CAST(u AS INT) AS day
FROM stays s JOIN cohort c ON s.ref = c.ref, UNNEST(GENERATE_SERIES(0, COALESCE(s.length_of_stay, CAST(DATE '{STAY_END}' - s.admission_date AS INT)))) AS t(u)
WHERE s.admission_date >= c.start_episode) SELECT c.ref, c.start_episode, COALESCE(x.n, 0) AS los FROM cohort c
LEFT JOIN (SELECT ref, COUNT(*) AS n FROM d GROUP BY ref) x ON c.ref = x.ref""")
def _(spark, sf):
    return length_of_stay(view(spark, sf, "stays"), index_cohort(spark, sf), STAY_END).select("ref", "start_episode", "los")


COURSE_SQL = """
x AS (SELECT d.ref, CAST(d.prescription_start - c.start_episode AS INT) AS s, d.dispensing_duration + 1 AS n,
             d.drug_name LIKE '%MOLNUPIRAVIR%' AS molnupiravir, d.drug_name LIKE '%PAXLOVID%' AS paxlovid
      FROM dispensing d JOIN cohort c ON d.ref = c.ref WHERE d.prescription_start >= c.start_episode
      AND (d.drug_name LIKE '%MOLNUPIRAVIR%' OR d.drug_name LIKE '%PAXLOVID%')),
y AS (SELECT ref, molnupiravir, paxlovid, COUNT(*) AS duration FROM
      (SELECT DISTINCT ref, molnupiravir, paxlovid, s + u AS day FROM x, UNNEST(GENERATE_SERIES(0, n - 1)) AS t(u)) GROUP BY 1, 2, 3),
courses AS (SELECT y.*, CAST(FLOOR(duration * CASE WHEN paxlovid THEN 105.8::DOUBLE ELSE 141.4::DOUBLE END) AS INT) AS cost,
      (SELECT MIN(s) FROM x WHERE x.ref = y.ref) AS start_drug,
      CASE WHEN duration = 5 THEN 2 ELSE 1 END AS antiviral_course FROM y)"""
COURSE = views("stays", "tests", "dispensing").rstrip() + "," + INDEX_SQL + "," + COURSE_SQL


@query("drug_courses", COURSE + " SELECT * FROM courses")
def _(spark, sf):
    return drug_courses(view(spark, sf, "dispensing"), index_cohort(spark, sf))


@query("patient_courses", COURSE + """ SELECT c.ref, COALESCE(MAX(CAST(molnupiravir AS INT)), 0) AS molnupiravir,
COALESCE(MAX(CAST(paxlovid AS INT)), 0) AS paxlovid, COALESCE(MAX(antiviral_course), 0) AS antiviral_course,
COALESCE(MIN(start_drug), 0) AS start_drug, CAST(SUM(cost) AS BIGINT) AS drug_cost FROM cohort c LEFT JOIN courses k ON c.ref = k.ref GROUP BY c.ref""")
def _(spark, sf):
    cohort = index_cohort(spark, sf)
    return with_courses(cohort, drug_courses(view(spark, sf, "dispensing"), cohort)).drop("start_episode")


@query("treatment_window", COURSE + """ SELECT c.ref, COALESCE(MIN(start_drug), 0) AS start_drug FROM cohort c
LEFT JOIN courses k ON c.ref = k.ref GROUP BY c.ref HAVING COALESCE(MIN(start_drug), 0) <= 7""")
def _(spark, sf):
    cohort = index_cohort(spark, sf)
    people = with_courses(cohort, drug_courses(view(spark, sf, "dispensing"), cohort))
    return treatment_window(people).select("ref", "start_drug")


@query("readmission_chain", CHAIN + " SELECT * FROM chain")
def _(spark, sf):
    return chain(spark, sf, index_cohort(spark, sf))


@query("merge_intervals", views("stays") + """, s AS (SELECT ref, admission_date AS a, MAX(COALESCE(discharge_date, admission_date)) AS e FROM stays GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN a <= MAX(e) OVER (PARTITION BY ref ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM s),
i AS (SELECT *, SUM(o) OVER (PARTITION BY ref ORDER BY a) AS island FROM m)
SELECT ref, CAST(island AS BIGINT) AS island, MIN(a) AS admission_date, MAX(e) AS discharge_date FROM i GROUP BY ref, island""")
def _(spark, sf):
    return merge_intervals(view(spark, sf, "stays"), "ref", "admission_date", "discharge_date")


@query("effective_end", views("stays") + "SELECT hn_number, CASE WHEN discharge_status IN ('ACUTE', 'CONV.') THEN NULL ELSE discharge_date END AS end_date FROM stays")
def _(spark, sf):
    return effective_end(view(spark, sf, "stays")).select("hn_number", "end_date")


@query("within_flags", CHAIN + """ SELECT c.ref, CASE WHEN m <= 7 THEN 1 ELSE 0 END AS unplan_7d, CASE WHEN m <= 14 THEN 1 ELSE 0 END AS unplan_14d,
CASE WHEN m <= 21 THEN 1 ELSE 0 END AS unplan_21d, CASE WHEN m <= 28 THEN 1 ELSE 0 END AS unplan_28d
FROM cohort c LEFT JOIN (SELECT ref, MIN(gap_time) AS m FROM chain GROUP BY ref) g ON c.ref = g.ref""")
def _(spark, sf):
    cohort = index_cohort(spark, sf)
    return within_flags(chain(spark, sf, cohort), cohort).drop("start_episode")


@query("readmission_count", CHAIN + """ SELECT c.ref, COALESCE(n, 0) AS ane_times FROM cohort c LEFT JOIN
(SELECT ref, COUNT(*) AS n FROM chain WHERE gap_mark <> 9999999 GROUP BY ref) g ON c.ref = g.ref""")
def _(spark, sf):
    cohort = index_cohort(spark, sf)
    return readmission_count(chain(spark, sf, cohort), cohort).drop("start_episode")


DEATH_SQL = f"""
dead AS (SELECT ref, discharge_date AS dead_date FROM stays WHERE discharge_status = 'DEATH'
         QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY admission_date, hn_number) = 1),
fup AS (SELECT c.ref, c.start_episode, DATE '{END}' AS end_episode, d.dead_date, CASE WHEN d.dead_date IS NULL THEN 0 ELSE 1 END AS dead,
        CASE WHEN d.ref IS NULL THEN 0 ELSE 1 END AS dead_record,
        CAST(d.dead_date - c.start_episode AS INT) AS dead_time,
        CAST(COALESCE(d.dead_date, DATE '{END}') - c.start_episode AS INT) AS fu FROM cohort c LEFT JOIN dead d ON c.ref = d.ref)"""


@query("readmission_los", CHAIN + "," + DEATH_SQL + """ SELECT k.ref, k.start_day, k.gap_time, k.gap_mark, f.fu, k.end_day AS old_end,
COALESCE(k.end_day, f.fu) AS end_day, COALESCE(k.end_day, f.fu) - k.start_day AS los FROM chain k JOIN fup f ON k.ref = f.ref
WHERE k.gap_time <= 28 AND k.gap_mark = 1""")
def _(spark, sf):
    cohort = index_cohort(spark, sf)
    people = follow_up(cohort, first_death(view(spark, sf, "stays")), END)
    return readmission_los(chain(spark, sf, cohort), people)


@query("index_date", INDEX + " SELECT * FROM cohort")
def _(spark, sf):
    return index_cohort(spark, sf)


@query("positive_tests", views("tests") + "SELECT ref, reference_datetime, result FROM tests WHERE test_description LIKE '%PCR%' AND result IN ('Detected', 'Detected  **')")
def _(spark, sf):
    return positive_tests(view(spark, sf, "tests")).select("ref", "reference_datetime", "result")


@query("follow_up_inpatient", INDEX + "," + DEATH_SQL + " SELECT ref, start_episode, dead_date, end_episode, dead, dead_time, fu FROM fup")
def _(spark, sf):
    return follow_up(index_cohort(spark, sf), first_death(view(spark, sf, "stays")), END)


@query("follow_up_clinic", INDEX + "," + DEATH_SQL + " SELECT ref, start_episode, dead_date, end_episode, dead_record AS dead, dead_time, fu FROM fup")
def _(spark, sf):
    return follow_up(index_cohort(spark, sf), first_death(view(spark, sf, "stays")), END, dead_by="record")


@query("first_episode", views("stays") + """SELECT ref, hn_number, admission_date FROM (SELECT *, ROW_NUMBER() OVER
(PARTITION BY ref ORDER BY admission_date, hn_number) AS rn FROM stays) WHERE rn = 1 AND admission_source = 'A&E'""")
def _(spark, sf):
    return first_episode(view(spark, sf, "stays")).filter(F.col("admission_source") == "A&E").select(
        "ref", "hn_number", "admission_date")


FIRST_VISIT_SQL = """, cohort AS (SELECT ref, appointment_date AS start_episode, event_id FROM visits
QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY appointment_date, event_id) = 1)"""


@query("first_visit", views("visits") + FIRST_VISIT_SQL + " SELECT ref, start_episode, event_id FROM cohort")
def _(spark, sf):
    return first_visit(view(spark, sf, "visits"), order=["event_id"]).select(
        "ref", F.col("appointment_date").alias("start_episode"), "event_id")


@query("visit_count", views("visits") + """SELECT ref, COUNT(DISTINCT appointment_date) AS dc_read,
CASE WHEN COUNT(DISTINCT appointment_date) >= 2 THEN 1 ELSE 0 END AS reattended FROM visits GROUP BY ref""")
def _(spark, sf):
    return visit_count(view(spark, sf, "visits"))


def _clinic(spark, sf):
    return view(spark, sf, "visits").groupBy("ref").agg(F.min("appointment_date").alias("start_episode"))


@query("clinic_reattendance", views("visits") + """, d AS (SELECT DISTINCT v.ref, v.appointment_date - f.d0 AS days FROM visits v
JOIN (SELECT ref, MIN(appointment_date) AS d0 FROM visits WHERE value < 50 GROUP BY ref) f ON v.ref = f.ref WHERE v.appointment_date <> f.d0),
p AS (SELECT DISTINCT ref FROM visits WHERE value < 50)
SELECT p.ref, CASE WHEN m <= 7 THEN 1 ELSE 0 END AS unplan_7d, CASE WHEN m <= 14 THEN 1 ELSE 0 END AS unplan_14d,
CASE WHEN m <= 21 THEN 1 ELSE 0 END AS unplan_21d, CASE WHEN m <= 28 THEN 1 ELSE 0 END AS unplan_28d
FROM p LEFT JOIN (SELECT ref, MIN(days) AS m FROM d GROUP BY ref) x ON p.ref = x.ref""")
def _(spark, sf):
    visits = view(spark, sf, "visits")
    cohort = _clinic_low(visits)
    return within_flags(reattendance_days(visits, cohort), cohort, "days").drop("start_episode")


def _clinic_low(visits):
    return visits.filter(F.col("value") < 50).groupBy("ref").agg(F.min("appointment_date").alias("start_episode"))


@query("admissions_within", views("patients", "stays") + """, c AS (SELECT ref, DATE '1995-01-15' + CAST(age * 20 AS INT) AS start_episode FROM patients),
h AS (SELECT s.ref, COUNT(*) AS n FROM stays s JOIN c ON s.ref = c.ref WHERE s.emergency_admission = 'Y'
AND s.admission_date - c.start_episode BETWEEN 0 AND 28 GROUP BY s.ref)
SELECT c.ref, c.start_episode, h.n AS ane_times, CASE WHEN h.n >= 1 THEN 1 END AS ane FROM c LEFT JOIN h ON c.ref = h.ref""")
def _(spark, sf):
    cohort = view(spark, sf, "patients").select("ref", F.expr("DATE '1995-01-15' + age * 20").alias("start_episode"))
    emergency = view(spark, sf, "stays").filter(F.col("emergency_admission") == "Y")
    return admissions_within(emergency, cohort)


@query("visit_course_cost", views("visits") + """, d AS (SELECT * FROM visits WHERE active_medication LIKE '%PAXLOVID%' OR active_medication LIKE '%MOLNUPIRAVIR%'),
p AS (SELECT ref, appointment_date AS course_start, COUNT(*) AS n, MIN(active_medication) AS drug,
LEAD(appointment_date) OVER (PARTITION BY ref ORDER BY appointment_date) AS nxt,
ROW_NUMBER() OVER (PARTITION BY ref ORDER BY appointment_date) AS nth FROM d GROUP BY 1, 2),
g AS (SELECT *, CAST(CASE WHEN n > 1 THEN 0 ELSE COALESCE(nxt - course_start, 5) END AS INT) AS gap FROM p WHERE nth = 1)
SELECT ref, course_start, gap, ROUND(LEAST(gap, 5) * CASE WHEN drug LIKE '%MOLNUPIRAVIR%' THEN 141.4::DOUBLE ELSE 105.8::DOUBLE END, 6) AS dc_drug_cost FROM g""")
def _(spark, sf):
    return rounded(visit_course_cost(view(spark, sf, "visits")))


@query("course_cost", COURSE + " SELECT ref, molnupiravir, paxlovid, duration, cost FROM courses")
def _(spark, sf):
    return drug_courses(view(spark, sf, "dispensing"), index_cohort(spark, sf)).select(
        "ref", "molnupiravir", "paxlovid", "duration", "cost")


@query("drug_offset", views("visits") + """, c AS (SELECT ref, MIN(appointment_date) AS start_episode, DATE '2024-02-15' AS end_episode FROM visits GROUP BY ref),
k AS (SELECT *, CASE WHEN active_medication LIKE '%PAXLOVID%' THEN 1 ELSE 0 END + CASE WHEN active_medication LIKE '%MOLNUPIRAVIR%' THEN 2 ELSE 0 END AS code FROM visits),
f AS (SELECT ref, code, appointment_date FROM k WHERE code > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY appointment_date, event_id) = 1)
SELECT c.ref, COALESCE(f.code, 0) AS antiviral_code, f.appointment_date AS antiviral_date,
CAST(c.end_episode - f.appointment_date AS INT) AS start_drug FROM c LEFT JOIN f ON c.ref = f.ref""")
def _(spark, sf):
    cohort = _clinic(spark, sf).withColumn("end_episode", F.lit("2024-02-15").cast("date"))
    out = drug_offset(cohort, view(spark, sf, "visits"), order=["event_id"])
    return out.select("ref", "antiviral_code", "antiviral_date", "start_drug")
