"""Propensity scores, ATT weights, balance: saturated models have a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, view, views
from wardline.operators.design import Factor
from wardline.operators.weights import (att_weights, att_weights_multi, balance_table, ess, largest_weights,
                                        propensity, reweight, weight_summary, weighted_means)

SEG = [Factor("segment")]
_USED = """, u AS (SELECT *, CASE WHEN arm = 'Did not use' THEN 0 ELSE 1 END AS used FROM patients),
ps AS (SELECT segment, AVG(used) AS ps FROM u GROUP BY segment),
x AS (SELECT u.*, ps.ps, CASE WHEN used = 1 THEN 1.0 ELSE ps.ps / (1 - ps.ps) END::DOUBLE AS weight FROM u JOIN ps ON u.segment = ps.segment)"""
_MULTI = """, n AS (SELECT segment, arm, COUNT(*)::DOUBLE AS n FROM patients GROUP BY 1, 2),
tot AS (SELECT arm, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER () AS share FROM patients GROUP BY arm),
y AS (SELECT p.*, f.n / o.n AS weight, share FROM patients p JOIN n o ON p.segment = o.segment AND p.arm = o.arm
JOIN n f ON f.segment = p.segment AND f.arm = 'Did not use' JOIN tot ON tot.arm = p.arm)"""


def people(spark, sf):
    return view(spark, sf, "patients").withColumn("used", F.when(F.col("arm") == "Did not use", 0).otherwise(1))


def weighted(spark, sf):
    return att_weights(propensity(people(spark, sf), "used", SEG), "used")


def weighted_multi(spark, sf, **kw):
    return att_weights_multi(view(spark, sf, "patients"), "arm", SEG, "Did not use", **kw)


@query("propensity", views("patients") + _USED + " SELECT ref, used, ROUND(ps, 6) AS ps FROM x")
def _(spark, sf):
    return rounded(propensity(people(spark, sf), "used", SEG).select("ref", "used", "ps"))


@query("att_weights", views("patients") + _USED + " SELECT ref, used, ROUND(weight, 6) AS weight FROM x")
def _(spark, sf):
    return rounded(weighted(spark, sf).select("ref", "used", "weight"))


@query("att_weights_three_arms", views("patients") + _MULTI + " SELECT ref, arm, ROUND(weight, 6) AS weight FROM y")
def _(spark, sf):
    return rounded(weighted_multi(spark, sf).select("ref", "arm", "weight"))


@query("stabilised_weights", views("patients") + _MULTI + " SELECT ref, arm, ROUND(weight * share, 6) AS weight FROM y")
def _(spark, sf):
    return rounded(weighted_multi(spark, sf, stabilize=True).select("ref", "arm", "weight"))


@query("balance_table", views("patients") + _USED + """, a AS (SELECT used, AVG(age) AS m, STDDEV_SAMP(age) AS s, SUM(weight * age) / SUM(weight) AS wm FROM x GROUP BY used),
g AS (SELECT segment, SUM(CASE WHEN used = 1 THEN 1.0 ELSE 0 END) / (SELECT COUNT(*) FROM x WHERE used = 1) - SUM(CASE WHEN used = 0 THEN 1.0 ELSE 0 END) / (SELECT COUNT(*) FROM x WHERE used = 0) AS d0,
SUM(CASE WHEN used = 1 THEN weight ELSE 0 END) / (SELECT SUM(weight) FROM x WHERE used = 1) - SUM(CASE WHEN used = 0 THEN weight ELSE 0 END) / (SELECT SUM(weight) FROM x WHERE used = 0) AS d1 FROM x GROUP BY segment)
SELECT 'age' AS variable, NULL AS level, '0' AS arm, ROUND((t.m - c.m) / t.s, 6) + 0.0 AS diff_unadjusted, ROUND((t.wm - c.wm) / t.s, 6) + 0.0 AS diff_adjusted FROM a t, a c WHERE t.used = 1 AND c.used = 0
UNION ALL SELECT 'segment', segment, '0', ROUND(d0::DOUBLE, 6) + 0.0, ROUND(d1::DOUBLE, 6) + 0.0 FROM g""")
def _(spark, sf):
    return rounded(balance_table(weighted(spark, sf), ["age"], ["segment"], "used", "weight"))


@query("effective_sample_size", views("patients") + _USED + " SELECT used, COUNT(*)::DOUBLE AS n, ROUND(POWER(SUM(weight), 2) / SUM(weight * weight), 6) AS ess FROM x GROUP BY used")
def _(spark, sf):
    return rounded(ess(weighted(spark, sf), "used", "weight"))


@query("weight_summary", views("patients") + _MULTI + """ SELECT arm, COUNT(*) AS n, ROUND(MIN(weight), 6) AS min, ROUND(MAX(weight), 6) AS max, ROUND(AVG(weight), 6) AS mean,
ROUND(CASE WHEN STDDEV_SAMP(weight) < 1e-9 THEN 0 ELSE STDDEV_SAMP(weight) END / AVG(weight), 6) AS cv, COUNT(*) FILTER (WHERE weight = 0) AS zeros, ROUND(POWER(SUM(weight), 2) / SUM(weight * weight), 6) AS ess FROM y GROUP BY arm""")
def _(spark, sf):
    return rounded(weight_summary(weighted_multi(spark, sf), "arm", "weight"))


@query("largest_weights", views("patients") + _MULTI + """ SELECT arm, ref, ROUND(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY ROUND(weight, 9) DESC, ref) AS rank FROM y) WHERE rank <= 5""")
def _(spark, sf):
    w = weighted_multi(spark, sf).withColumn("weight", F.round("weight", 9))
    return rounded(largest_weights(w, "arm", "weight").select("arm", "ref", "weight", "rank"))


@query("reweight_survivors", views("patients") + """, s AS (SELECT *, CASE WHEN arm = 'Did not use' THEN 0 ELSE 1 END AS used FROM patients WHERE outcome = 0),
ps AS (SELECT segment, AVG(used) AS ps FROM s GROUP BY segment)
SELECT s.ref, ROUND(CASE WHEN used = 1 THEN 1.0 ELSE ps / (1 - ps) END, 6)::DOUBLE AS weight FROM s JOIN ps ON s.segment = ps.segment""")
def _(spark, sf):
    return rounded(reweight(people(spark, sf), F.col("outcome") == 0, "used", SEG).select("ref", "weight"))


@query("reweight_survivors_three_arms", views("patients") + """, s AS (SELECT * FROM patients WHERE outcome = 0),
n AS (SELECT segment, arm, COUNT(*)::DOUBLE AS n FROM s GROUP BY 1, 2)
SELECT s.ref, ROUND(f.n / o.n, 6) AS weight FROM s JOIN n o ON s.segment = o.segment AND s.arm = o.arm JOIN n f ON f.segment = s.segment AND f.arm = 'Did not use'""")
def _(spark, sf):
    return rounded(reweight(people(spark, sf), F.col("outcome") == 0, "arm", SEG, "Did not use").select("ref", "weight"))


@query("weighted_arm_means", views("patients") + _MULTI + """ SELECT arm, 'los' AS variable, ROUND(SUM(weight * los) / SUM(weight), 6) AS mean FROM y GROUP BY arm
UNION ALL SELECT arm, 'acctbal', ROUND(SUM(weight * acctbal) / SUM(weight), 6) FROM y GROUP BY arm""")
def _(spark, sf):
    return rounded(weighted_means(weighted_multi(spark, sf), ["los", "acctbal"], "arm", "weight"))
