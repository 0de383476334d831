"""Fits and tables on data at the edge: separated, constant, unweighted, certain."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wardline.operators import models
from wardline.operators.design import Factor
from wardline.operators.diagnostics import augment, largest_cooks
from wardline.operators.models import expit, glance, logit, neg_binomial, profile_limits, ratio_table, tidy
from wardline.operators.tables import smd_table, table_one
from wardline.operators.weights import att_weights, balance_table, ess, propensity, weight_summary


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        g, a, z = "uvw"[i % 3], float(rng.integers(0, 4)), float(np.round(rng.normal(), 1))
        y = int(rng.random() < 1 / (1 + math.exp(-(-0.5 + 0.6 * (g == "v") + 0.3 * a - 0.8 * z))))
        rows.append((i, g, a, z, y, int(rng.poisson(2 + a) * (1 + y)), float(rng.integers(0, 3)), float(rng.integers(1, 4))))
    return spark.createDataFrame(rows, "ref int, g string, a double, z double, y int, n int, fu double, w double").cache()


def design_matrix(p):
    return np.column_stack([np.ones(len(p)), p.g == "v", p.g == "w", p.a, p.z]).astype(float)


def test_profile_limits_of_all_terms(people):
    p = people.toPandas()
    x, y = design_matrix(p), p.y.to_numpy(float)
    fit = logit(people, "y", [Factor("g"), "a", "z"])
    assert fit.extra["converged"]
    low, high = profile_limits(fit)

    def best(j, value):
        others = [k for k in range(5) if k != j]
        b = np.zeros(4)
        for _ in range(60):
            eta = x[:, others] @ b + x[:, j] * value
            mu = expit(eta)
            b += np.linalg.solve((x[:, others] * (mu * (1 - mu))[:, None]).T @ x[:, others], x[:, others].T @ (y - mu))
        eta = x[:, others] @ b + x[:, j] * value
        return np.sum(y * eta - np.logaddexp(0, eta))
    for j in range(5):
        for end in (low[j], high[j]):
            assert 2 * (fit.loglik - best(j, end)) == pytest.approx(3.841458820694124, abs=1e-6)
        assert low[j] < fit.beta[j] < high[j]
    assert [r.conf_low for r in ratio_table(fit).collect()] == pytest.approx(np.exp(low))


def test_profile_jobs_do_not_grow_with_terms(people, monkeypatch):
    calls = []
    real = models.sum_blocks
    monkeypatch.setattr(models, "sum_blocks", lambda *a: calls.append(1) or real(*a))
    counts = []
    for terms in (["z"], [Factor("g"), "a", "z"]):
        fit = logit(people, "y", terms)
        calls.clear()
        profile_limits(fit)
        counts.append(len(calls))
    assert max(counts) <= 12 and counts[1] <= counts[0] + 3


def test_negative_binomial_profile_holds_theta(people):
    fit = neg_binomial(people, "n", ["a"], "fu")
    assert fit.extra["no_exposure"] == people.filter("fu <= 0").count() == glance(fit).first().no_exposure
    p = people.filter("fu > 0").toPandas()
    y, off, theta = p.n.to_numpy(float), np.log(p.fu.to_numpy()), fit.extra["theta"]

    def like(b0, b1):
        mu = np.exp(b0 + b1 * p.a.to_numpy() + off)
        return float(np.sum(y * np.log(mu / (mu + theta)) - theta * np.log(1 + mu / theta)))
    top = like(*fit.beta)
    for end in (v[1] for v in profile_limits(fit)):
        grid = max(like(b0, end) for b0 in np.linspace(fit.beta[0] - 1, fit.beta[0] + 1, 4001))
        assert 2 * (top - grid) == pytest.approx(3.8414588, abs=1e-3)


def test_separated_data(spark):
    rows = [(i, int(i >= 20), "a" if i < 20 else "b", float(i % 5)) for i in range(40)] + [(40, 0, "a", 9.0)]
    df = spark.createDataFrame(rows, "ref int, y int, g string, z double")
    fit = logit(df, "y", [Factor("g"), "z"])
    assert not fit.extra["converged"] and glance(fit).first().converged is False
    row = ratio_table(fit).filter("term = 'gb'").first()
    assert row.conf_high is None and 1 < row.conf_low < 1e6
    for r in ratio_table(fit, interval="wald").collect():
        assert all(v is None or math.isfinite(v) for v in r[1:])
    aug = augment(fit).collect()
    assert all(math.isfinite(r.resid) and math.isfinite(r.hat) and r.hat <= 1 for r in aug)


def test_certain_scores_have_no_weight(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (0, 1.0, "x"), (0, 0.5, "y"), (0, 0.0, "y")], "t int, ps double, k string")
    got = [r.weight for r in att_weights(df, "t").collect()]
    assert got == [1.0, None, 1.0, 0.0]


def test_certain_fitted_values(spark):
    df = spark.createDataFrame([(i, int(i > 50) if i != 3 else 1, float(i)) for i in range(100)], "ref int, y int, x double")
    fit = logit(df, "y", ["x"])
    fit.beta = np.array([-800.0, 16.0])  # fitted values that round to 0 and 1
    aug = augment(fit)
    rows = aug.collect()
    assert {0.0, 1.0} <= {r.fitted for r in rows}
    assert all(r.resid is not None and math.isfinite(r.resid) and r.hat >= 0 for r in rows)
    assert largest_cooks(aug, 2).count() >= 2


def test_an_arm_of_weight_nothing(people):
    df = people.withColumn("w", F.when(F.col("g") == "w", 0.0).otherwise(F.col("w"))).withColumn("c", F.lit(5.0))
    table = {(r.variable, r.level, r.stratum): r for r in table_one(df, ["a", "c"], ["y"], "g", "w").collect()}
    assert table[("a", None, "w")]["mean"] is None and table[("y", "1", "w")].percent is None
    alone = table_one(df.filter("g <> 'w'"), ["a"], ["y"], "g", "w").filter("variable = 'a'").first()
    assert table[("a", None, "u")].p_value == pytest.approx(alone.p_value) and table[("a", None, "u")].smd == pytest.approx(alone.smd)
    assert smd_table(df, ["a"], ["y"], "g", "w").count() == 2
    assert {r.g: r.ess for r in ess(df, "g", "w").collect()}["w"] is None
    summary = {r.g: r for r in weight_summary(df, "g", "w").collect()}
    assert summary["w"].cv is None and summary["w"].ess is None and summary["u"].ess > 0
    rows = balance_table(df, ["a", "c"], ["y"], "g", "w", "u").collect()
    by = {(r.variable, r.level, r.arm): r for r in rows}
    assert by[("c", None, "v")].diff_unadjusted is None  # constant: a row without a difference
    assert by[("a", None, "w")].diff_unadjusted is not None and by[("a", None, "w")].diff_adjusted is None
    assert by[("y", "1", "w")].diff_adjusted is None and by[("y", "1", "v")].diff_adjusted is not None


def test_balance_without_the_focal_arm(people):
    rows = balance_table(people.filter("g <> 'u'"), ["a"], ["y"], "g", "w", "u").collect()
    assert rows and all(r.diff_unadjusted is None for r in rows)


def test_no_variance_prints_no_limits(people):
    fit = logit(people, "y", ["z"])
    fit.cov = np.full((2, 2), np.nan)
    assert all(r.conf_low is None and r.conf_high is None and r.ratio for r in ratio_table(fit, interval="wald").collect())
    assert propensity(people.withColumn("t", F.col("y")), "t", ["z"]).filter("ps is null").count() == 0
    assert tidy(logit(people, "y", ["z"])).count() == 2
