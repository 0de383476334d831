"""Joins: first match, membership, exclusion, date bounds, weights by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, table, view, views
from wardline.operators.lookup import (events_after_index, exclude, hot_keys, in_cohort, life_years, lookup_first,
                                       with_weight)

_FIRST_STAY = """first_stay AS (SELECT ref, discharge_date AS first_end, discharge_status AS first_status FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY ref ORDER BY admission_date, CAST(hn_number AS BIGINT)) AS rn FROM stays) WHERE rn = 1)"""


def _first_cols(spark, sf):
    return view(spark, sf, "stays").select(
        "ref", "admission_date", F.col("hn_number").cast("long").alias("hn"),
        F.col("discharge_date").alias("first_end"), F.col("discharge_status").alias("first_status"))


@query("lookup_first", views("patients", "stays").rstrip() + f", {_FIRST_STAY} " + """
SELECT p.ref, p.age, f.first_end, f.first_status FROM patients p LEFT JOIN first_stay f ON p.ref = f.ref""")
def _(spark, sf):
    people = view(spark, sf, "patients").select("ref", "age")
    return lookup_first(people, _first_cols(spark, sf), "ref", ["first_end", "first_status"], ["admission_date", "hn"])


@query("lookup_first_hot_keys", views("visits").rstrip() + """, f AS (SELECT ref, MIN(appointment_date) AS first_day FROM visits
GROUP BY ref) SELECT v.event_id, v.ref, f.first_day FROM visits v LEFT JOIN f ON v.ref = f.ref""")
def _(spark, sf):
    visits = view(spark, sf, "visits").select("event_id", "ref", "appointment_date")
    firsts = visits.select("ref", F.col("appointment_date").alias("first_day"))
    hot = hot_keys(visits, "ref", 0.008)
    return lookup_first(visits, firsts, "ref", ["first_day"], "first_day", hot=hot).select("event_id", "ref", "first_day")


@query("left_join_all", "SELECT n_name, r_name, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def _(spark, sf):
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(s, s.s_nationkey == n.n_nationkey, "left").select(
        "n_name", "r_name", "s_suppkey")


@query("in_cohort", views("stays", "plasma") + "SELECT ref, hn_number FROM stays WHERE ref IN (SELECT ref FROM plasma)")
def _(spark, sf):
    return in_cohort(view(spark, sf, "stays"), view(spark, sf, "plasma")).select("ref", "hn_number")


@query("exclude", views("stays", "plasma", "interferon") + """SELECT ref, hn_number FROM stays
WHERE ref NOT IN (SELECT ref FROM plasma) AND ref NOT IN (SELECT ref FROM interferon)""")
def _(spark, sf):
    return exclude(view(spark, sf, "stays"), view(spark, sf, "plasma"), view(spark, sf, "interferon")).select("ref", "hn_number")


@query("exclude_hot_keys", views("visits") + """SELECT event_id, ref FROM visits WHERE ref NOT IN
(SELECT ref FROM visits WHERE value > 450)""")
def _(spark, sf):
    visits = view(spark, sf, "visits").select("event_id", "ref", "value")
    out = visits.filter(F.col("value") > 450)
    return exclude(visits, out, hot=hot_keys(visits, "ref", 0.008)).select("event_id", "ref")


@query("life_table_lookup", views("patients", "lifetable") + """SELECT ref, ROUND(CASE WHEN sex = 'M' THEN 0 ELSE female END +
CASE WHEN sex = 'F' THEN 0 ELSE male END, 6)::DOUBLE AS life FROM patients JOIN lifetable USING (age)""")
def _(spark, sf):
    return rounded(life_years(view(spark, sf, "patients"), view(spark, sf, "lifetable")).select("ref", "life"))


@query("events_after_index", views("visits").rstrip() + """, f AS (SELECT ref, MIN(appointment_date) AS d0 FROM visits GROUP BY ref)
SELECT v.event_id, v.ref, CAST(v.appointment_date - f.d0 AS INT) AS "offset" FROM visits v JOIN f ON v.ref = f.ref
WHERE v.appointment_date - f.d0 BETWEEN 1 AND 14""")
def _(spark, sf):
    visits = view(spark, sf, "visits")
    cohort = visits.groupBy("ref").agg(F.min("appointment_date").alias("start_episode"))
    return events_after_index(cohort, visits, "appointment_date", 1, 14).select("event_id", "ref", "offset")


@query("with_weight", views("patients") + """SELECT p.ref, p.age, x.weight FROM patients p LEFT JOIN
(SELECT ref, w * 2 AS weight FROM patients WHERE sex = 'F') x ON p.ref = x.ref""")
def _(spark, sf):
    p = view(spark, sf, "patients")
    weights = p.filter(F.col("sex") == "F").select("ref", (F.col("w") * 2).alias("weight"))
    return with_weight(p.select("ref", "age"), weights)
