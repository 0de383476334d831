"""Model diagnostics: leverage and residuals of a saturated model have a closed form in SQL."""

from __future__ import annotations

from wardline.catalog.registry import query, rounded, view, views
from wardline.operators.design import Factor
from wardline.operators.diagnostics import (augment, corr_matrix, influence_index, largest_cooks, outliers, refit, vif)
from wardline.operators.models import logit, ratio_table

_AUG = """, g AS (SELECT sex, COUNT(*)::DOUBLE AS n, AVG(outcome) AS p FROM patients GROUP BY sex),
a AS (SELECT x.ref, x.outcome, g.p AS fitted, 1 / g.n AS hat,
CASE WHEN x.outcome = 1 THEN SQRT(-2 * LN(g.p)) ELSE -SQRT(-2 * LN(1 - g.p)) END AS resid,
(x.outcome - g.p) / SQRT(g.p * (1 - g.p)) AS pearson FROM patients x JOIN g ON x.sex = g.sex),
aug AS (SELECT ref, outcome, fitted, hat, resid, resid / SQRT(1 - hat) AS std_resid, POWER(pearson / (1 - hat), 2) * hat / 2 AS cooksd FROM a)"""


def _fit(spark, sf):
    return logit(view(spark, sf, "patients"), "outcome", [Factor("sex", ("F", "M"))])


def _aug(spark, sf):
    return augment(_fit(spark, sf)).select("ref", "outcome", "fitted", "hat", "resid", "std_resid", "cooksd")


@query("augment", views("patients") + _AUG + """ SELECT ref, outcome, ROUND(fitted, 6) AS fitted, ROUND(hat, 6) AS hat, ROUND(resid, 6) AS resid,
ROUND(std_resid, 6) AS std_resid, ROUND(cooksd, 6) AS cooksd FROM aug""")
def _(spark, sf):
    return rounded(_aug(spark, sf))


@query("influence_index", views("patients") + _AUG + """ SELECT ROW_NUMBER() OVER (ORDER BY ref) AS "index", ref, ROUND(fitted, 6) AS fitted,
ROUND(std_resid, 6) AS std_resid, ROUND(hat, 6) AS hat, ROUND(cooksd, 6) AS cooksd FROM aug""")
def _(spark, sf):
    return rounded(influence_index(_aug(spark, sf)))


@query("largest_cooks", views("patients") + _AUG + """, r AS (SELECT ref, ROUND(cooksd, 9) AS cooksd FROM aug)
SELECT ref, ROUND(cooksd, 6) AS cooksd FROM r WHERE cooksd >= (SELECT MIN(cooksd) FROM (SELECT cooksd FROM r ORDER BY cooksd DESC LIMIT 3))""")
def _(spark, sf):
    return rounded(largest_cooks(rounded(_aug(spark, sf).select("ref", "cooksd"), 9)))


@query("outliers", views("patients") + _AUG + " SELECT ref, ROUND(std_resid, 6) AS std_resid FROM aug WHERE ABS(std_resid) > 1.2 AND cooksd > 0.0008")
def _(spark, sf):
    return rounded(outliers(_aug(spark, sf), 1.2, 0.0008).select("ref", "std_resid"))


@query("vif")
def _(spark, sf):
    fit = logit(view(spark, sf, "patients"), "outcome", [Factor("sex"), Factor("arm"), Factor("segment"), "age"])
    return rounded(vif(fit))


@query("refit_without_outliers")
def _(spark, sf):
    terms = [Factor("sex"), Factor("segment"), "age"]
    fit = logit(view(spark, sf, "patients"), "outcome", terms)
    return rounded(ratio_table(refit(fit, augment(fit), terms, 1.4, 1.0), interval="wald"))


@query("corr_matrix", views("patients") + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS r FROM patients" for a in ("age", "acctbal", "los") for b in ("age", "acctbal", "los")))
def _(spark, sf):
    return rounded(corr_matrix(view(spark, sf, "patients"), ["age", "acctbal", "los"]))
