"""Regressions.  A saturated model has a closed form, which is the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, view, views
from wardline.catalog.weighting import _MULTI, people, weighted_multi
from wardline.operators.design import Factor, Interaction
from wardline.operators.models import glance, logit, neg_binomial, ratio_table, svy_logit, tidy, zinb

_CELLS = """, c AS (SELECT SUM(CASE WHEN sex = 'M' AND outcome = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS a, SUM(CASE WHEN sex = 'M' AND outcome = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS b,
SUM(CASE WHEN sex = 'F' AND outcome = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS c, SUM(CASE WHEN sex = 'F' AND outcome = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS d FROM patients)"""


@query("logit_ratio", views("patients") + _CELLS + """ SELECT 'sexM' AS term, ROUND(a * d / (b * c), 6) AS ratio,
ROUND(a * d / (b * c) * EXP(-1.959963984540054 * SQRT(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS conf_low,
ROUND(a * d / (b * c) * EXP(1.959963984540054 * SQRT(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS conf_high FROM c
UNION ALL SELECT '(Intercept)', ROUND(c / d, 6), ROUND(c / d * EXP(-1.959963984540054 * SQRT(1 / c + 1 / d)), 6), ROUND(c / d * EXP(1.959963984540054 * SQRT(1 / c + 1 / d)), 6) FROM c""")
def _(spark, sf):
    return rounded(ratio_table(logit(view(spark, sf, "patients"), "outcome", [Factor("sex", ("F", "M"))]), interval="wald"))


@query("logit_tidy", views("patients") + _CELLS + """, t AS (SELECT 'sexM' AS term, LN(a * d / (b * c)) AS e, SQRT(1 / a + 1 / b + 1 / c + 1 / d) AS s FROM c
UNION ALL SELECT '(Intercept)', LN(c / d), SQRT(1 / c + 1 / d) FROM c)
SELECT term, ROUND(e, 6) AS estimate, ROUND(s, 6) AS std_error, ROUND(e / s, 6) AS statistic FROM t""")
def _(spark, sf):
    return rounded(tidy(logit(view(spark, sf, "patients"), "outcome", [Factor("sex", ("F", "M"))])).drop("p_value"))


@query("logit_glance", views("patients") + """, g AS (SELECT sex, COUNT(*)::DOUBLE AS n, AVG(outcome) AS p FROM patients GROUP BY sex),
l AS (SELECT SUM(n) AS n, SUM(n * (p * LN(p) + (1 - p) * LN(1 - p))) AS ll FROM g)
SELECT CAST(n AS BIGINT) AS n, ROUND(ll, 6) AS loglik, ROUND(-2 * ll, 6) AS minus_2_loglik, ROUND(-2 * ll + 4, 6) AS aic, '' AS dropped, true AS converged, 0::BIGINT AS no_exposure FROM l""")
def _(spark, sf):
    return rounded(glance(logit(view(spark, sf, "patients"), "outcome", [Factor("sex", ("F", "M"))])).drop("iterations"))


@query("logit_adjusted")
def _(spark, sf):
    terms = [Factor("sex"), Factor("arm", ("Did not use", "Paxlovid only", "Molnupiravir only")), Factor("segment"), "age"]
    return rounded(ratio_table(logit(view(spark, sf, "patients"), "outcome", terms), interval="wald"))


def _profile_sql() -> str:
    """Limits by halving.  For the difference the best intercept is the root of a quadratic; for the intercept the other group is free."""
    part = lambda n, y, eta: f"({y} * ({eta}) - ({n}) * LN(1 + EXP({eta})))"
    u = "((-q + SQRT(q * q + 4 * EXP(x) * (n - y) * y)) / (2 * EXP(x) * (n - y)))"
    like = f"""CASE WHEN term = 'sexM' THEN {part('c + d', 'c', f'LN({u})')} + {part('a + b', 'a', f'LN({u}) + x')}
ELSE {part('c + d', 'c', 'x')} + {part('a + b', 'a', 'LN(a / b)')} END"""
    return f""", m AS (SELECT *, a + b + c + d AS n, a + c AS y, {part('c + d', 'c', 'LN(c / d)')} + {part('a + b', 'a', 'LN(a / b)')} AS top FROM c),
e AS (SELECT m.*, term, side, CASE WHEN term = 'sexM' THEN LN(a * d / (b * c)) ELSE LN(c / d) END AS est FROM m, (VALUES ('sexM', -1), ('sexM', 1), ('(Intercept)', -1), ('(Intercept)', 1)) v(term, side)),
r AS (WITH RECURSIVE h AS (SELECT e.*, 0 AS step, est AS near, est + 8 * side AS far FROM e
UNION ALL SELECT a, b, c, d, n, y, top, term, side, est, step + 1, CASE WHEN 2 * (top - ({like})) < 3.841458820694124 THEN x ELSE near END,
CASE WHEN 2 * (top - ({like})) < 3.841458820694124 THEN far ELSE x END FROM (SELECT *, (c + d) + (a + b) * EXP(x) - y * (1 + EXP(x)) AS q FROM (SELECT *, (near + far) / 2 AS x FROM h WHERE step < 60)))
SELECT term, side, est, near FROM h WHERE step = 60)
SELECT term, ROUND(EXP(ANY_VALUE(est)), 5) AS ratio, ROUND(EXP(MIN(near)), 5) AS conf_low, ROUND(EXP(MAX(near)), 5) AS conf_high FROM r GROUP BY term"""


@query("logit_profile_interval", views("patients") + _CELLS + _profile_sql())
def _(spark, sf):
    return rounded(ratio_table(logit(view(spark, sf, "patients"), "outcome", [Factor("sex", ("F", "M"))]), interval="profile"), 5)


@query("survey_logit", views("patients") + _MULTI + """, g AS (SELECT CASE WHEN arm = 'Did not use' THEN 0 WHEN arm = 'Paxlovid only' THEN 1 ELSE 2 END AS k,
SUM(weight) AS w, SUM(weight * outcome) / SUM(weight) AS p, (SELECT COUNT(*) FROM y)::DOUBLE AS n FROM y GROUP BY 1),
v AS (SELECT CASE WHEN y.arm = 'Did not use' THEN 0 WHEN y.arm = 'Paxlovid only' THEN 1 ELSE 2 END AS k, weight, outcome FROM y),
h AS (SELECT g.k, LN(g.p / (1 - g.p)) AS lo, g.n / (g.n - 1) * SUM(POWER(v.weight * (v.outcome - g.p), 2)) / POWER(g.w * g.p * (1 - g.p), 2) AS var FROM g JOIN v ON v.k = g.k GROUP BY g.k, g.p, g.w, g.n)
SELECT CASE a.k WHEN 0 THEN '(Intercept)' WHEN 1 THEN 'armPaxlovid only' ELSE 'armMolnupiravir only' END AS term,
ROUND(a.lo - CASE WHEN a.k = 0 THEN 0 ELSE b.lo END, 6) AS estimate, ROUND(SQRT(a.var + CASE WHEN a.k = 0 THEN 0 ELSE b.var END), 6) AS std_error FROM h a, h b WHERE b.k = 0""")
def _(spark, sf):
    arm = Factor("arm", ("Did not use", "Paxlovid only", "Molnupiravir only"))
    return rounded(tidy(svy_logit(weighted_multi(spark, sf), "outcome", [arm], "weight")).select("term", "estimate", "std_error"))


@query("interaction_logit", views("patients") + """, g AS (SELECT sex, from_elderly_home AS h, LN(AVG(outcome) / (1 - AVG(outcome))) AS lo FROM patients GROUP BY 1, 2),
c AS (SELECT MAX(lo) FILTER (WHERE sex = 'F' AND h = 'N') AS f0, MAX(lo) FILTER (WHERE sex = 'M' AND h = 'N') AS m0,
MAX(lo) FILTER (WHERE sex = 'F' AND h = 'Y') AS f1, MAX(lo) FILTER (WHERE sex = 'M' AND h = 'Y') AS m1 FROM g)
SELECT '(Intercept)' AS term, ROUND(f0, 6) AS estimate FROM c UNION ALL SELECT 'sexM', ROUND(m0 - f0, 6) FROM c
UNION ALL SELECT 'from_elderly_homeY', ROUND(f1 - f0, 6) FROM c UNION ALL SELECT 'sexM:from_elderly_homeY', ROUND(m1 - m0 - f1 + f0, 6) FROM c""")
def _(spark, sf):
    sex, home = Factor("sex"), Factor("from_elderly_home")
    fit = logit(view(spark, sf, "patients"), "outcome", [sex, home, Interaction(sex, home)])
    return rounded(tidy(fit).select("term", "estimate"))


@query("neg_binomial_ratio", views("patients") + """, g AS (SELECT sex, AVG(los) AS m FROM patients WHERE outcome = 0 GROUP BY sex)
SELECT '(Intercept)' AS term, ROUND(m, 5) AS ratio FROM g WHERE sex = 'F'
UNION ALL SELECT 'sexM', ROUND(a.m / b.m, 5) FROM g a, g b WHERE a.sex = 'M' AND b.sex = 'F'""")
def _(spark, sf):
    fit = neg_binomial(view(spark, sf, "patients"), "los", [Factor("sex")], where=F.col("outcome") == 0)
    return rounded(ratio_table(fit).select("term", "ratio"), 5)


def _nb_sql(rows: str, steps: int = 40) -> str:
    """Two groups with exposure: Newton steps of both log rates and of log theta, written out."""
    sql = f", d AS MATERIALIZED ({rows}), p0 AS (SELECT LN(SUM(w * y * (1 - x)) / SUM(w * o * (1 - x))) AS a, LN(SUM(w * y * x) / SUM(w * o * x)) AS c, LN(1.5) AS k FROM d)"
    for i in range(1, steps + 1):
        sql += f""", e{i} AS (SELECT d.*, EXP(CASE WHEN x = 1 THEN c ELSE a END) * o AS mu, EXP(k) AS th FROM d, p{i - 1}),
s{i} AS (SELECT SUM(w * (y - mu) / (1 + mu / th) * (1 - x)) AS ua, SUM(w * mu / (1 + mu / th) * (1 - x)) AS ia, SUM(w * (y - mu) / (1 + mu / th) * x) AS uc, SUM(w * mu / (1 + mu / th) * x) AS ic,
SUM(w * (COALESCE(list_sum(list_transform(range(y), lambda j: 1 / (th + j))), 0) + LN(th) + 1 - LN(th + mu) - (y + th) / (mu + th))) AS ut,
SUM(w * (COALESCE(list_sum(list_transform(range(y), lambda j: 1 / POWER(th + j, 2))), 0) - 1 / th + 2 / (mu + th) - (y + th) / POWER(mu + th, 2))) AS it, ANY_VALUE(th) AS th FROM e{i}),
p{i} AS MATERIALIZED (SELECT a + ua / ia AS a, c + uc / ic AS c, k + GREATEST(-0.5, LEAST(0.5, CASE WHEN it * th * th - ut * th > 0 THEN ut * th / (it * th * th - ut * th) ELSE SIGN(ut) END)) AS k FROM p{i - 1}, s{i})"""
    i = steps
    return sql + f""", f AS (SELECT a, c, SUM(w * mu / (1 + mu / EXP(k)) * (1 - x)) AS ia, SUM(w * mu / (1 + mu / EXP(k)) * x) AS ic FROM
(SELECT d.*, EXP(CASE WHEN x = 1 THEN c ELSE a END) * o AS mu, a, c, k FROM d, p{i}) GROUP BY a, c)
SELECT '(Intercept)' AS term, ROUND(a, 4) AS estimate, ROUND(SQRT(1 / ia), 4) AS std_error FROM f
UNION ALL SELECT 'sexM', ROUND(c - a, 4), ROUND(SQRT(1 / ia + 1 / ic), 4) FROM f"""


@query("neg_binomial_two_groups", views("patients") + _nb_sql(
    "SELECT los AS y, fu::DOUBLE AS o, 1.0::DOUBLE AS w, CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS x FROM patients WHERE outcome = 0"))
def _(spark, sf):
    fit = neg_binomial(view(spark, sf, "patients"), "los", [Factor("sex")], "fu", where=F.col("outcome") == 0)
    return rounded(tidy(fit).select("term", "estimate", "std_error"), 4)


@query("neg_binomial_two_groups_weighted", views("patients") + _nb_sql(
    "SELECT los AS y, fu::DOUBLE AS o, w, CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS x FROM patients"))
def _(spark, sf):
    return rounded(tidy(neg_binomial(view(spark, sf, "patients"), "los", [Factor("sex")], "fu", "w")).select("term", "estimate", "std_error"), 4)


@query("logit_one_number", views("patients") + ", b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS c)" + "".join(
    f""", s{i} AS MATERIALIZED (SELECT SUM(outcome - mu) AS u0, SUM(age * (outcome - mu)) AS u1, SUM(v) AS i00, SUM(v * age) AS i01, SUM(v * age * age) AS i11 FROM
(SELECT *, mu * (1 - mu) AS v FROM (SELECT outcome, age, 1 / (1 + EXP(-(a + c * age))) AS mu FROM patients, b{i - 1}))),
b{i} AS MATERIALIZED (SELECT a + (u0 * i11 - u1 * i01) / (i00 * i11 - i01 * i01) AS a, c + (u1 * i00 - u0 * i01) / (i00 * i11 - i01 * i01) AS c,
SQRT(i11 / (i00 * i11 - i01 * i01)) AS sa, SQRT(i00 / (i00 * i11 - i01 * i01)) AS sc FROM b{i - 1}, s{i})""" for i in range(1, 10)) + """
SELECT '(Intercept)' AS term, ROUND(a, 6) AS estimate, ROUND(sa, 6) AS std_error FROM b9 UNION ALL SELECT 'age', ROUND(c, 6), ROUND(sc, 6) FROM b9""")
def _(spark, sf):
    return rounded(tidy(logit(view(spark, sf, "patients"), "outcome", ["age"])).select("term", "estimate", "std_error"))


@query("neg_binomial_exposure")
def _(spark, sf):
    fit = neg_binomial(people(spark, sf), "los", [Factor("sex"), Factor("arm"), "age"], "fu", where=F.col("outcome") == 0)
    return rounded(tidy(fit), 5)


@query("neg_binomial_weighted")
def _(spark, sf):
    return rounded(ratio_table(neg_binomial(weighted_multi(spark, sf), "los", [Factor("sex"), Factor("arm")], "fu", "weight"), interval="wald"), 5)


@query("zero_inflated_neg_binomial")
def _(spark, sf):
    stays = view(spark, sf, "patients").withColumn("los", F.when(F.col("age") % 4 == 0, 0).otherwise(F.col("los")))
    return rounded(tidy(zinb(stays, "los", [Factor("sex")], "fu", "w")), 5)


@query("subset_logit", views("patients") + """, c AS (SELECT COUNT(*) FILTER (WHERE sex = 'M' AND outcome = 1)::DOUBLE AS a, COUNT(*) FILTER (WHERE sex = 'M' AND outcome = 0)::DOUBLE AS b,
COUNT(*) FILTER (WHERE sex = 'F' AND outcome = 1)::DOUBLE AS c, COUNT(*) FILTER (WHERE sex = 'F' AND outcome = 0)::DOUBLE AS d FROM patients WHERE age >= 60)
SELECT 'sexM' AS term, ROUND(a * d / (b * c), 6) AS ratio FROM c UNION ALL SELECT '(Intercept)', ROUND(c / d, 6) FROM c""")
def _(spark, sf):
    fit = logit(view(spark, sf, "patients"), "outcome", [Factor("sex")], where=F.col("age") >= 60)
    return rounded(ratio_table(fit).select("term", "ratio"))
