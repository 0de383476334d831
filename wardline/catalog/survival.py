"""Kaplan-Meier, log-rank and Cox models over days to the next admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.coxsql import (chi2_p, cox_many, inverse, naive_variance, normal_p, robust_variance, sym,
                                     tidy_rows)
from wardline.catalog.registry import FOLLOWED, followed, query, rounded, views
from wardline.operators.design import Factor
from wardline.operators.models import ratio_table, tidy
from wardline.operators.survival import (cox, cox_residuals, cox_summary, cox_terms, kaplan_meier, logrank, median_survival,
                                         pairwise_logrank, ph_test, risk_table, schoenfeld)

BASE = views("patients", "stays").rstrip() + "," + FOLLOWED


def _km_sql(weight: str) -> str:
    return BASE + f""", d AS (SELECT arm, fu AS time, SUM({weight}) AS n, SUM(CASE WHEN event = 1 THEN {weight} ELSE 0 END) AS e FROM followed GROUP BY 1, 2),
r AS (SELECT *, SUM(n) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM d),
km AS (SELECT arm, time, risk AS n_risk, e AS n_event, n - e AS n_censor,
CASE WHEN MIN(risk - e) OVER w < 1e-9 THEN 0 ELSE EXP(SUM(LN(CASE WHEN risk - e < 1e-9 THEN 1 ELSE 1 - e / risk END)) OVER w) END AS survival,
SUM(CASE WHEN risk > e THEN e / (risk * (risk - e)) END) OVER w AS gw FROM r WINDOW w AS (PARTITION BY arm ORDER BY time))"""


@query("kaplan_meier", _km_sql("1.0::DOUBLE") + """ SELECT arm, time, n_risk, n_event, n_censor, ROUND(survival, 6) AS survival,
ROUND(CASE WHEN survival > 0 THEN survival * SQRT(gw) END, 6) AS std_error, ROUND(CASE WHEN survival > 0 THEN -LN(survival) END, 6) + 0.0 AS cum_hazard FROM km""")
def _(spark, sf):
    return rounded(kaplan_meier(followed(spark, sf), "fu", "event", "arm"))


@query("kaplan_meier_weighted", _km_sql("w") + """ SELECT arm, time, n_risk, n_event, n_censor, ROUND(survival, 6) AS survival,
ROUND(CASE WHEN survival > 0 THEN survival * SQRT(gw) END, 6) AS std_error, ROUND(CASE WHEN survival > 0 THEN -LN(survival) END, 6) + 0.0 AS cum_hazard FROM km""")
def _(spark, sf):
    return rounded(kaplan_meier(followed(spark, sf), "fu", "event", "arm", "w"))


@query("risk_table", BASE + """, t AS (SELECT UNNEST([0, 100, 300, 1000]) AS at), a AS (SELECT DISTINCT arm FROM followed)
SELECT a.arm, CAST(t.at AS INT) AS at, (SELECT COUNT(*) FROM followed f WHERE f.arm = a.arm AND f.fu >= t.at)::DOUBLE AS n_risk FROM a, t""")
def _(spark, sf):
    return risk_table(kaplan_meier(followed(spark, sf), "fu", "event", "arm"), [0, 100, 300, 1000], "arm").drop("survival")


@query("median_survival", _km_sql("1.0::DOUBLE") + " SELECT arm, MIN(time) FILTER (WHERE survival <= 0.5) AS median FROM km GROUP BY arm")
def _(spark, sf):
    return median_survival(kaplan_meier(followed(spark, sf), "fu", "event", "arm"), "arm")


def _two_arm(where: str) -> str:
    return f"""x AS (SELECT fu, event, CASE WHEN arm = 'Did not use' THEN 0 ELSE 1 END AS g FROM followed {where}),
d AS (SELECT fu AS t, COUNT(*)::DOUBLE AS m, SUM(g)::DOUBLE AS m1, SUM(event)::DOUBLE AS d, SUM(event * g)::DOUBLE AS d1 FROM x GROUP BY fu),
r AS (SELECT *, SUM(m) OVER (ORDER BY t DESC) AS n, SUM(m1) OVER (ORDER BY t DESC) AS n1 FROM d),
s AS (SELECT SUM(d1) AS o1, SUM(d) AS o, SUM(d * n1 / n) AS e1, SUM(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r)"""


@query("logrank", BASE + "," + _two_arm("") + """ SELECT '1' AS arm, (SELECT COUNT(*) FROM x WHERE g = 1) AS n, o1 AS observed, ROUND(e1, 6) AS expected,
ROUND(POWER(o1 - e1, 2) / v, 6) AS chisq, 1 AS df, ROUND(""" + chi2_p("POWER(o1 - e1, 2) / v", "1") + """, 6) + 0.0 AS p_value FROM s
UNION ALL SELECT '0', (SELECT COUNT(*) FROM x WHERE g = 0), o - o1, ROUND(o - e1, 6), ROUND(POWER(o1 - e1, 2) / v, 6), 1, ROUND(""" + chi2_p("POWER(o1 - e1, 2) / v", "1") + """, 6) + 0.0 FROM s""")
def _(spark, sf):
    f = followed(spark, sf).withColumn("g", F.when(F.col("arm") == "Did not use", 0).otherwise(1))
    return rounded(logrank(f, "fu", "event", "g"))


@query("logrank_three_arms", BASE + """, d AS (SELECT fu AS t, COUNT(*)::DOUBLE AS m, COUNT(*) FILTER (WHERE arm = 'Did not use')::DOUBLE AS m0, COUNT(*) FILTER (WHERE arm = 'Paxlovid only')::DOUBLE AS m1,
SUM(event)::DOUBLE AS d, COALESCE(SUM(event) FILTER (WHERE arm = 'Did not use'), 0)::DOUBLE AS d0, COALESCE(SUM(event) FILTER (WHERE arm = 'Paxlovid only'), 0)::DOUBLE AS d1 FROM followed GROUP BY fu),
r AS (SELECT *, SUM(m) OVER w AS n, SUM(m0) OVER w AS n0, SUM(m1) OVER w AS n1 FROM d WINDOW w AS (ORDER BY t DESC)),
x AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS c FROM r),
s AS (SELECT SUM(m) AS n, SUM(m0) AS k0, SUM(m1) AS k1, SUM(d) AS o, SUM(d0) AS o0, SUM(d1) AS o1, SUM(d * n0 / n) AS e0, SUM(d * n1 / n) AS e1,
SUM(c * n0 / n * (1 - n0 / n)) AS v00, SUM(c * n1 / n * (1 - n1 / n)) AS v11, -SUM(c * n0 / n * n1 / n) AS v01 FROM x),
c AS (SELECT *, ((o0 - e0) * (o0 - e0) * v11 - 2 * (o0 - e0) * (o1 - e1) * v01 + (o1 - e1) * (o1 - e1) * v00) / (v00 * v11 - v01 * v01) AS chi FROM s)
SELECT 'Did not use' AS arm, k0::BIGINT AS n, o0 AS observed, ROUND(e0, 6) AS expected, ROUND(chi, 6) AS chisq, 2 AS df, ROUND(EXP(-chi / 2), 6) AS p_value FROM c
UNION ALL SELECT 'Paxlovid only', k1::BIGINT, o1, ROUND(e1, 6), ROUND(chi, 6), 2, ROUND(EXP(-chi / 2), 6) FROM c
UNION ALL SELECT 'Molnupiravir only', (n - k0 - k1)::BIGINT, o - o0 - o1, ROUND(o - e0 - e1, 6), ROUND(chi, 6), 2, ROUND(EXP(-chi / 2), 6) FROM c""")
def _(spark, sf):
    return rounded(logrank(followed(spark, sf), "fu", "event", "arm"))


_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS arm_a, '{b}' AS arm_b, fu, event, CASE WHEN arm = '{b}' THEN 1 ELSE 0 END AS g FROM followed WHERE arm IN ('{a}', '{b}')"""
    for a, b in (("Did not use", "Molnupiravir only"), ("Did not use", "Paxlovid only"), ("Molnupiravir only", "Paxlovid only")))


@query("pairwise_logrank", BASE + f""", x AS ({_PAIRS}),
d AS (SELECT arm_a, arm_b, fu AS t, COUNT(*)::DOUBLE AS m, SUM(g)::DOUBLE AS m1, SUM(event)::DOUBLE AS d, SUM(event * g)::DOUBLE AS d1 FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, SUM(m) OVER w AS n, SUM(m1) OVER w AS n1 FROM d WINDOW w AS (PARTITION BY arm_a, arm_b ORDER BY t DESC)),
s AS (SELECT arm_a, arm_b, SUM(d1) AS o1, SUM(d * n1 / n) AS e1, SUM(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r GROUP BY 1, 2),
c AS (SELECT arm_a, arm_b, POWER(o1 - e1, 2) / v AS chi FROM s), p AS (SELECT *, """ + chi2_p("chi", "1") + """ AS p FROM c),
o AS (SELECT *, p * 3 / ROW_NUMBER() OVER (ORDER BY p) AS q FROM p)
SELECT arm_a, arm_b, ROUND(chi, 6) AS chisq, ROUND(p, 6) + 0.0 AS p_value, ROUND(LEAST(1, MIN(q) OVER (ORDER BY p DESC)), 6) + 0.0 AS p_adjusted FROM o""")
def _(spark, sf):
    return rounded(pairwise_logrank(followed(spark, sf), "fu", "event", "arm"))


# --- Cox with one term: Newton steps written out as common table expressions ------------------------

def _day_table(i: str, b: str) -> str:
    on_event = lambda c: f"SUM(CASE WHEN e = 1 THEN {c} ELSE 0 END)"
    r = "w * EXP(b * x)"
    return f""",
r{i} AS MATERIALIZED (SELECT s, t, SUM({r}) AS r0, SUM({r} * x) AS r1, SUM({r} * x * x) AS r2, {on_event(r)} AS d0, {on_event(f"{r} * x")} AS d1,
{on_event(f"{r} * x * x")} AS d2, {on_event("w")} AS dw, {on_event("w * x")} AS dx, COUNT(*) FILTER (WHERE e = 1) AS dn FROM d, {b} GROUP BY s, t),
q{i} AS MATERIALIZED (SELECT *, SUM(r0) OVER v AS s0, SUM(r1) OVER v AS s1, SUM(r2) OVER v AS s2 FROM r{i} WINDOW v AS (PARTITION BY s ORDER BY t DESC)),
l{i} AS MATERIALIZED (SELECT s, t, dn, dx / dn AS xl, dw / dn AS wb, k / dn::DOUBLE AS f, s0 - k / dn::DOUBLE * d0 AS z,
(s1 - k / dn::DOUBLE * d1) / (s0 - k / dn::DOUBLE * d0) AS m,
(s2 - k / dn::DOUBLE * d2) / (s0 - k / dn::DOUBLE * d0) - POWER((s1 - k / dn::DOUBLE * d1) / (s0 - k / dn::DOUBLE * d0), 2) AS v
FROM q{i}, UNNEST(GENERATE_SERIES(0, dn - 1)) AS u(k) WHERE dn > 0)"""


def _cox_sql(rows: str, steps: int = 8) -> str:
    sql = BASE + f", d AS MATERIALIZED ({rows}), b0 AS (SELECT 0.0::DOUBLE AS b)"
    for i in range(1, steps + 1):
        sql += _day_table(str(i), f"b{i - 1}")
        sql += f", b{i} AS MATERIALIZED (SELECT (SELECT b FROM b{i - 1}) + SUM(xl - wb * m) / SUM(wb * v) AS b FROM l{i})"
    sql += _day_table("z", f"b{steps}") + f""", fit AS MATERIALIZED (SELECT (SELECT b FROM b{steps}) AS b, SUM(wb * v) AS info FROM lz),
a AS (SELECT s, t, SUM(wb / z) AS a0, SUM(wb * f / z) AS a1, AVG(m) AS mean FROM lz GROUP BY s, t),
h AS MATERIALIZED (SELECT q.s, q.t, SUM(COALESCE(a0, 0)) OVER (PARTITION BY q.s ORDER BY q.t) AS hz, COALESCE(a1, 0) AS own, mean
FROM qz q LEFT JOIN a ON q.s = a.s AND q.t = a.t),
mart AS MATERIALIZED (SELECT d.ref, d.t AS time, d.e AS event, fit.b * (d.x - (SELECT SUM(w * x) / SUM(w) FROM d)) AS linear, d.x - h.mean AS score,
d.e - EXP(fit.b * d.x) * (h.hz - CASE WHEN d.e = 1 THEN h.own ELSE 0 END) AS m FROM d JOIN h ON d.s = h.s AND d.t = h.t, fit)"""
    return sql


_SEX = "SELECT ref, 0 AS s, fu AS t, event AS e, 1.0::DOUBLE AS w, CASE WHEN sex = 'M' THEN 1.0::DOUBLE ELSE 0 END AS x FROM followed"
_SEX_BY_SEGMENT = _SEX.replace("0 AS s", "segment AS s")
_AGE_WEIGHTED = "SELECT ref, 0 AS s, fu AS t, event AS e, w, age::DOUBLE AS x FROM followed"
_AGE_STRATA = "SELECT ref, sex || segment AS s, fu AS t, event AS e, 1.0::DOUBLE AS w, age::DOUBLE AS x FROM followed"
_TIDY = " SELECT '{}' AS term, ROUND(b, 6) AS estimate, ROUND(1 / SQRT(info), 6) AS std_error, ROUND(b * SQRT(info), 5) AS statistic FROM fit"


def _short(fit):
    return rounded(tidy(fit).select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                                    F.round("statistic", 5).alias("statistic")))


@query("cox_one_term", _cox_sql(_SEX) + _TIDY.format("sexM"))
def _(spark, sf):
    return _short(cox(followed(spark, sf), "fu", "event", [Factor("sex")]))


@query("cox_weighted_one_term", _cox_sql(_AGE_WEIGHTED) + _TIDY.format("age"))
def _(spark, sf):
    return _short(cox(followed(spark, sf), "fu", "event", ["age"], "w", robust=False))


@query("cox_stratified_one_term", _cox_sql(_AGE_STRATA) + _TIDY.format("age"))
def _(spark, sf):
    return _short(cox(followed(spark, sf), "fu", "event", ["age"], strata=["sex", "segment"]))


@query("hazard_ratio_one_term", _cox_sql(_SEX) + """ SELECT 'sexM' AS term, ROUND(EXP(b), 6) AS ratio, ROUND(EXP(b - 1.959963984540054 / SQRT(info)), 6) AS conf_low,
ROUND(EXP(b + 1.959963984540054 / SQRT(info)), 6) AS conf_high FROM fit""")
def _(spark, sf):
    return rounded(ratio_table(cox(followed(spark, sf), "fu", "event", [Factor("sex")])))


@query("ph_test_one_term", _cox_sql(_SEX) + """, k AS (SELECT t, COUNT(*)::DOUBLE AS m, SUM(e)::DOUBLE AS dd FROM d GROUP BY t),
k2 AS (SELECT *, SUM(m) OVER (ORDER BY t DESC) AS n FROM k),
g AS (SELECT t, 1 - COALESCE(EXP(SUM(LN(CASE WHEN n > dd THEN 1 - dd / n ELSE 1e-300 END)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM k2),
u AS (SELECT SUM(g * (xl - wb * m)) AS u, SUM(g * wb * v) AS i1, SUM(g * g * wb * v) AS i2, SUM(wb * v) AS i0 FROM lz JOIN g ON lz.t = g.t),
c AS (SELECT ROUND(u * u / (i2 - i1 * i1 / i0), 5) AS chisq, """ + chi2_p("u * u / (i2 - i1 * i1 / i0)", "1") + """ AS p FROM u)
SELECT 'sex' AS term, chisq, 1 AS df, ROUND(p, 5) + 0.0 AS p_value FROM c UNION ALL SELECT 'GLOBAL', chisq, 1, ROUND(p, 5) + 0.0 FROM c""")
def _(spark, sf):
    return rounded(ph_test(cox(followed(spark, sf), "fu", "event", [Factor("sex")])), 5)


ARM = Factor("arm", ("Did not use", "Paxlovid only", "Molnupiravir only"))



# --- Cox with several terms: the same steps for a few columns, and the people's score residuals -------------------------

_ARMS = "CASE WHEN arm = 'Paxlovid only' THEN 1.0::DOUBLE ELSE 0 END AS x0, CASE WHEN arm = 'Molnupiravir only' THEN 1.0::DOUBLE ELSE 0 END AS x1"
_MALE = "CASE WHEN sex = 'M' THEN 1.0::DOUBLE ELSE 0 END"
_ONE = "SELECT ref, 0 AS s, fu AS t, event AS e, 1.0::DOUBLE AS w, "
_ARM_NAMES = ["armPaxlovid only", "armMolnupiravir only"]
_ARM_SEX = BASE + cox_many(f"{_ONE}{_ARMS}, {_MALE} AS x2 FROM followed", 3)
_ARM_SEX_AGE = BASE + cox_many(f"{_ONE}{_ARMS}, {_MALE} AS x2, age::DOUBLE AS x3 FROM followed", 4, 6)
_WEIGHTED = BASE + cox_many(f"SELECT ref, 0 AS s, fu AS t, event AS e, w, {_ARMS} FROM followed", 2)
_STRATIFIED = BASE + cox_many(f"SELECT ref, sex || segment AS s, fu AS t, event AS e, w, {_ARMS}, age::DOUBLE AS x2 FROM followed", 3)


@query("cox", _ARM_SEX_AGE + naive_variance(4) + " " + tidy_rows([*_ARM_NAMES, "sexM", "age"]))
def _(spark, sf):
    return rounded(tidy(cox(followed(spark, sf), "fu", "event", [ARM, Factor("sex"), "age"])), 5)


@query("cox_weighted", _WEIGHTED + robust_variance(2) + " " + tidy_rows(_ARM_NAMES))
def _(spark, sf):
    return rounded(tidy(cox(followed(spark, sf), "fu", "event", [ARM], "w")), 5)


@query("cox_stratified", _STRATIFIED + robust_variance(3) + " " + tidy_rows([*_ARM_NAMES, "age"]))
def _(spark, sf):
    return rounded(tidy(cox(followed(spark, sf), "fu", "event", [ARM, "age"], "w", ["sex", "segment"])), 5)


@query("cox_errors", _STRATIFIED + robust_variance(3) + " " + " UNION ALL ".join(
    f"""SELECT '{name}' AS term, ROUND(b{j}, 5) AS estimate, ROUND(EXP(b{j}), 5) AS ratio, ROUND(SQRT(naive{j}), 5) AS model_error,
ROUND(SQRT(v{j}{j}), 5) AS robust_error, ROUND({normal_p(f'b{j} / SQRT(v{j}{j})')}, 5) + 0.0 AS p_value FROM fit, var""" for j, name in enumerate([*_ARM_NAMES, "age"])))
def _(spark, sf):
    return rounded(cox_terms(cox(followed(spark, sf), "fu", "event", [ARM, "age"], "w", ["sex", "segment"])), 5)


@query("hazard_ratios", _ARM_SEX + naive_variance(3) + " " + " UNION ALL ".join(
    f"""SELECT '{name}' AS term, ROUND(EXP(b{j}), 5) AS ratio, ROUND(EXP(b{j} - 1.959963984540054 * SQRT(v{j}{j})), 5) AS conf_low,
ROUND(EXP(b{j} + 1.959963984540054 * SQRT(v{j}{j})), 5) AS conf_high FROM fit, var""" for j, name in enumerate([*_ARM_NAMES, "sexM"])))
def _(spark, sf):
    return rounded(ratio_table(cox(followed(spark, sf), "fu", "event", [ARM, Factor("sex")])), 5)


def _ph_sql(p: int, groups: list[tuple[str, list[int]]]) -> str:
    """Score tests along g(t): the information of the tested columns less what the fitted ones explain."""
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    sums = [f"SUM(g * (dx{j} / dn - wb * m{j})) AS y{j}" for j in range(p)]
    sums += [f"SUM(wb * v{j}{k}) AS i{j}{k}, SUM(g * wb * v{j}{k}) AS h{j}{k}, SUM(g * g * wb * v{j}{k}) AS k{j}{k}" for j, k in pairs]
    inv, h, k2 = inverse(sym("i", p)), sym("h", p), sym("k", p)
    sql = f""", k AS (SELECT t, COUNT(*)::DOUBLE AS m, SUM(e)::DOUBLE AS dd FROM d GROUP BY t),
k2 AS (SELECT *, SUM(m) OVER (ORDER BY t DESC) AS n FROM k),
g AS (SELECT t, 1 - COALESCE(EXP(SUM(LN(CASE WHEN n > dd THEN 1 - dd / n ELSE 1e-300 END)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM k2),
y AS MATERIALIZED (SELECT {', '.join(sums)} FROM lz JOIN g ON lz.t = g.t), iv AS MATERIALIZED (SELECT y.*, {', '.join(f'{inv[j][k]} AS n{j}{k}' for j, k in pairs)} FROM y)"""
    n, rows = sym("n", p), []
    sch = lambda a, b: f"({k2[a][b]} - (" + " + ".join(f"{h[a][i]} * {n[i][j]} * {h[j][b]}" for i in range(p) for j in range(p)) + "))"
    for number, (name, idx) in enumerate(groups):
        cells = ", ".join(f"{sch(idx[a], idx[b])} AS c{a}{b}" for a in range(len(idx)) for b in range(a, len(idx)))
        sql += f", e{number} AS MATERIALIZED (SELECT {', '.join(f'y{j} AS y{i}' for i, j in enumerate(idx))}, {cells} FROM iv)"
        c = inverse(sym("c", len(idx)))
        stat = " + ".join(f"y{a} * {c[a][b]} * y{b}" for a in range(len(idx)) for b in range(len(idx)))
        rows.append(f"SELECT '{name}' AS term, ROUND({stat}, 5) AS chisq, {len(idx)} AS df, ROUND({chi2_p(stat, str(len(idx)))}, 5) + 0.0 AS p_value FROM e{number}")
    return sql + " " + " UNION ALL ".join(rows)


@query("ph_test", _ARM_SEX + _ph_sql(3, [("arm", [0, 1]), ("sex", [2]), ("GLOBAL", [0, 1, 2])]))
def _(spark, sf):
    return rounded(ph_test(cox(followed(spark, sf), "fu", "event", [ARM, Factor("sex")])), 5)


def _concordance_sql(p: int) -> str:
    """Every comparable pair: the earlier event against who is left, and against censoring at the same time."""
    score = " + ".join(f"b{j} * x{j}" for j in range(p))
    return f""", sc AS MATERIALIZED (SELECT s, t, e, w, ROUND({score}, 9) AS y FROM d, fit),
pr AS (SELECT a.w * b.w AS pw, CASE WHEN a.y > b.y THEN 1 WHEN a.y = b.y THEN 0 ELSE -1 END AS k FROM sc a JOIN sc b ON a.s = b.s AND a.e = 1 AND (b.t > a.t OR b.t = a.t AND b.e = 0)),
cc AS (SELECT COALESCE(SUM(pw) FILTER (WHERE k = 1), 0)::DOUBLE AS concordant, COALESCE(SUM(pw) FILTER (WHERE k = -1), 0)::DOUBLE AS discordant, COALESCE(SUM(pw) FILTER (WHERE k = 0), 0)::DOUBLE AS tied FROM pr)"""


def _summary_sql(p: int) -> str:
    inv = inverse(sym("i", p))
    quad = lambda m, v: " + ".join(f"{v}{j} * {m[j][k]} * {v}{k}" for j in range(p) for k in range(p))
    v = inverse(sym("v", p))
    return _concordance_sql(p) + f""", w AS (SELECT {quad(v, 'b')} AS wald FROM fit, var), sco AS (SELECT {quad(inv, 'u')} AS score, ll AS ll0 FROM u1),
z AS (SELECT (SELECT COUNT(*) FROM d) AS n, (SELECT SUM(e)::BIGINT FROM d) AS events, ll0, fit.ll, 2 * (fit.ll - ll0) AS lr, wald, score, concordant, discordant, tied FROM fit, w, sco, cc)
SELECT n, events, ROUND(ll0, 5) AS null_loglik, ROUND(ll, 5) AS loglik, ROUND(lr, 5) AS lr_test, ROUND({chi2_p('lr', str(p))}, 5) + 0.0 AS lr_p,
ROUND(wald, 5) AS wald_test, ROUND({chi2_p('wald', str(p))}, 5) + 0.0 AS wald_p, ROUND(score, 5) AS score_test, ROUND({chi2_p('score', str(p))}, 5) + 0.0 AS score_p,
{p} AS df, concordant, discordant, tied, ROUND((concordant + tied / 2) / (concordant + discordant + tied), 5) AS concordance, true AS converged FROM z"""


@query("cox_summary", _ARM_SEX_AGE + naive_variance(4) + _summary_sql(4))
def _(spark, sf):
    return rounded(cox_summary(cox(followed(spark, sf), "fu", "event", [ARM, Factor("sex"), "age"])).drop("iterations"), 5)


@query("cox_summary_weighted", _STRATIFIED + robust_variance(3) + _summary_sql(3))
def _(spark, sf):
    return rounded(cox_summary(cox(followed(spark, sf), "fu", "event", [ARM, "age"], "w", ["sex", "segment"])).drop("iterations"), 5)


@query("survival_limits", BASE + """, d AS (SELECT arm, fu AS time, SUM(w) AS n, SUM(CASE WHEN event = 1 THEN w ELSE 0 END) AS e FROM followed GROUP BY 1, 2),
r AS (SELECT *, SUM(n) OVER (PARTITION BY arm ORDER BY time DESC) AS risk FROM d),
km AS (SELECT arm, time, risk, e, CASE WHEN MIN(risk - e) OVER v < 1e-9 THEN 0 ELSE EXP(SUM(LN(CASE WHEN risk - e < 1e-9 THEN 1 ELSE 1 - e / risk END)) OVER v) END AS survival,
SUM(CASE WHEN risk > e THEN e / (risk * (risk - e)) ELSE 0 END) OVER v AS gw FROM r WINDOW v AS (PARTITION BY arm ORDER BY time)),
own AS (SELECT f.arm, f.fu AS left_at, SUM(f.w * f.w * POWER(CASE WHEN f.event = 1 AND k.risk > k.e THEN 1 / (k.risk - k.e) ELSE 0 END - k.gw, 2)) AS q, SUM(f.w * f.w) AS w2
FROM followed f JOIN km k ON k.arm = f.arm AND k.time = f.fu GROUP BY 1, 2),
i AS (SELECT k.*, SQRT(SUM(CASE WHEN o.left_at <= k.time THEN o.q ELSE k.gw * k.gw * o.w2 END)) AS se FROM km k JOIN own o ON o.arm = k.arm GROUP BY ALL)
SELECT arm, time, ROUND(survival, 6) AS survival, ROUND(CASE WHEN survival > 0 THEN survival * SQRT(gw) END, 6) AS std_error,
ROUND(CASE WHEN survival > 0 THEN survival * se END, 6) AS robust_error, ROUND(CASE WHEN survival > 0 THEN survival * EXP(-1.959963984540054 * se) END, 6) AS conf_low,
ROUND(CASE WHEN survival > 0 THEN LEAST(1, survival * EXP(1.959963984540054 * se)) END, 6) AS conf_high FROM i""")
def _(spark, sf):
    km = kaplan_meier(followed(spark, sf), "fu", "event", "arm", "w", limits=True)
    return rounded(km.select("arm", "time", "survival", "std_error", "robust_error", "conf_low", "conf_high"))


@query("schoenfeld_residuals", _cox_sql(_SEX) + " SELECT ref, time, 'sexM' AS term, ROUND(score, 5) + 0.0 AS residual FROM mart WHERE event = 1")
def _(spark, sf):
    return rounded(schoenfeld(cox(followed(spark, sf), "fu", "event", [Factor("sex")])), 5)


@query("deviance_residuals", _cox_sql(_SEX_BY_SEGMENT) + """ SELECT ref, time, event, ROUND(linear, 5) + 0.0 AS linear,
ROUND(SIGN(m) * SQRT(GREATEST(-2 * (m + CASE WHEN event = 1 THEN LN(event - m) ELSE 0 END), 0)), 5) + 0.0 AS residual FROM mart""")
def _(spark, sf):
    return rounded(cox_residuals(cox(followed(spark, sf), "fu", "event", [Factor("sex")], strata=["segment"])), 5)


@query("martingale_residuals", _cox_sql(_SEX) + " SELECT ref, time, event, ROUND(linear, 5) + 0.0 AS linear, ROUND(m, 5) + 0.0 AS residual FROM mart")
def _(spark, sf):
    return rounded(cox_residuals(cox(followed(spark, sf), "fu", "event", [Factor("sex")]), "martingale"), 5)
