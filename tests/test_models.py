"""Fits against brute force on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wardline.functions import tails
from wardline.operators.design import Factor, Interaction
from wardline.operators.diagnostics import augment, vif
from wardline.operators.models import logit, neg_binomial, ratio_table, svy_logit, tidy, zinb
from wardline.operators.survival import (benjamini_hochberg, cox, cox_residuals, kaplan_meier, logrank, ph_test,
                                         risk_table, schoenfeld)
from wardline.operators.tables import chi_square, table_one
from wardline.operators.weights import att_weights, att_weights_multi, balance_table, propensity

# Remission times of the published leukaemia trial (weeks, event, arm).
AML = [(9, 1, "M"), (13, 1, "M"), (13, 0, "M"), (18, 1, "M"), (23, 1, "M"), (28, 0, "M"), (31, 1, "M"), (34, 1, "M"),
       (45, 0, "M"), (48, 1, "M"), (161, 0, "M"), (5, 1, "N"), (5, 1, "N"), (8, 1, "N"), (8, 1, "N"), (12, 1, "N"),
       (16, 0, "N"), (23, 1, "N"), (27, 1, "N"), (30, 1, "N"), (33, 1, "N"), (43, 1, "N"), (45, 1, "N")]


@pytest.fixture(scope="module")
def aml(spark):
    rows = [(f"{i:02d}", t, e, x, 1.0 + i % 3, float((i * 7) % 5), i % 2) for i, (t, e, x) in enumerate(AML)]
    return spark.createDataFrame(rows, "ref string, t int, e int, x string, w double, z double, st int").cache()


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, g = rng.randrange(4), rng.choice("uv")
        mean = math.exp(0.2 + 0.15 * a + (0.4 if g == "v" else 0))
        lam = rng.gammavariate(2.0, mean / 2.0)
        y = 0
        limit, p = math.exp(-lam), rng.random()
        while p > limit:
            y, p = y + 1, p * rng.random()
        y = 0 if rng.random() < 0.15 else y
        rows.append((str(i), float(a), g, y, 1 + i % 4, 1.0 + (i % 5) / 2, int(rng.random() < 0.3 + 0.1 * a)))
    return spark.createDataFrame(rows, "ref string, a double, g string, y int, fu int, w double, b int").cache()


def frame(counts):
    p = counts.orderBy(F.col("ref").cast("int")).toPandas()
    x = np.column_stack([np.ones(len(p)), (p.g == "v").astype(float), p.a])
    return p, x


def derivatives(fn, at, h=1e-4):
    k = len(at)
    eye = np.eye(k) * h
    grad = np.array([(fn(at + eye[i]) - fn(at - eye[i])) / (2 * h) for i in range(k)])
    hess = np.array([[(fn(at + eye[i] + eye[j]) - fn(at + eye[i] - eye[j]) - fn(at - eye[i] + eye[j])
                       + fn(at - eye[i] - eye[j])) / (4 * h * h) for j in range(k)] for i in range(k)])
    return grad, hess


def maximise(fn, at):
    for _ in range(60):
        grad, hess = derivatives(fn, at)
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 0.5 / max(np.max(np.abs(move)), 1e-12))
        at = at - move
        if np.max(np.abs(move)) < 1e-9:
            break
    return at, derivatives(fn, at)[1]


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.f_tail(4.0, 1, 20) == pytest.approx(tails.t_two_sided(2.0, 20), abs=1e-12)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert tails.chi2_tail(10.0, 4) == pytest.approx(0.04042768199451279, abs=1e-12)


def test_logit_and_sandwich(counts):
    p, x = frame(counts)
    y, w = p.b.to_numpy(float), p.w.to_numpy()
    for weights, fit in ((np.ones(len(p)), logit(counts, "b", [Factor("g"), "a"])),
                         (w, svy_logit(counts, "b", [Factor("g"), "a"], "w"))):
        beta = np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ beta))
            info = (x * (weights * mu * (1 - mu))[:, None]).T @ x
            beta = beta + np.linalg.solve(info, x.T @ (weights * (y - mu)))
        cov = np.linalg.inv(info)
        if fit.kind == "svy_logit":
            u = x * (weights * (y - mu))[:, None]
            cov = cov @ u.T @ u @ cov * len(p) / (len(p) - 1)
        assert fit.beta == pytest.approx(beta, abs=1e-8)
        assert fit.cov == pytest.approx(cov, abs=1e-8)


def test_profile_interval(counts):
    p, x = frame(counts)
    x = x[:, :2]
    y = p.b.to_numpy(float)
    fit = logit(counts, "b", [Factor("g")])
    row = ratio_table(fit, interval="profile").filter("term = 'gv'").first()

    def best(b1):
        b0 = 0.0
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(b0 + b1 * x[:, 1])))
            b0 += np.sum(y - mu) / np.sum(mu * (1 - mu))
        eta = b0 + b1 * x[:, 1]
        return np.sum(y * eta - np.logaddexp(0, eta))

    for end in (row.conf_low, row.conf_high):
        assert 2 * (fit.loglik - best(math.log(end))) == pytest.approx(3.841458820694124, abs=1e-5)


def nb_density(y, mu, theta):
    lg = np.vectorize(math.lgamma)
    return lg(theta + y) - lg(theta) - lg(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))


@pytest.mark.parametrize("weight", [None, "w"])
def test_negative_binomial(counts, weight):
    p, x = frame(counts)
    y, off = p.y.to_numpy(float), np.log(p.fu.to_numpy(float))
    w = p.w.to_numpy() if weight else np.ones(len(p))
    like = lambda v: float(np.sum(w * nb_density(y, np.exp(x @ v[:3] + off), math.exp(v[3]))))
    at, _ = maximise(like, np.array([0.0, 0.0, 0.0, 0.0]))
    fit = neg_binomial(counts, "y", [Factor("g"), "a"], "fu", weight)
    assert fit.beta == pytest.approx(at[:3], abs=1e-5)
    assert fit.extra["theta"] == pytest.approx(math.exp(at[3]), rel=1e-5)
    assert fit.loglik == pytest.approx(like(at), abs=1e-6)


def test_zero_inflated(counts):
    counts = counts.withColumn("y", F.when(F.col("ref").cast("int") % 3 == 0, 0).otherwise(F.col("y") + F.col("fu")))
    p, x = frame(counts)
    x = x[:, :2]
    y, off, w = p.y.to_numpy(float), np.log(p.fu.to_numpy(float)), p.w.to_numpy()

    def like(v):
        pi = 1 / (1 + math.exp(-v[2]))
        dens = np.exp(nb_density(y, np.exp(x @ v[:2] + off), math.exp(v[3])))
        return float(np.sum(w * np.log(np.where(y == 0, pi, 0) + (1 - pi) * dens)))

    fit = zinb(counts, "y", [Factor("g")], "fu", "w")
    start = np.array([*fit.beta[:2], fit.beta[2], math.log(fit.extra["theta"])])
    at, hess = maximise(like, start + 0.01)
    assert fit.beta == pytest.approx(at[:3], abs=1e-4)
    assert fit.std_errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-hess)))[:3], rel=1e-2)


def test_cox_published_values(aml):
    fit = cox(aml, "t", "e", [Factor("x")])
    assert fit.beta[0] == pytest.approx(0.9155, abs=5e-5)
    assert fit.std_errors[0] == pytest.approx(0.5119, abs=5e-5)
    row = ph_test(fit).first()
    assert row.chisq == pytest.approx(0.00788, abs=5e-6)
    assert logrank(aml, "t", "e", "x").first().chisq == pytest.approx(3.4, abs=0.05)


def cox_loglik(rows, b):
    total = 0.0
    for st in {r.st for r in rows}:
        part = [r for r in rows if r.st == st]
        eta = [b[0] * (r.x == "N") + b[1] * r.z for r in part]
        for t in sorted({r.t for r in part if r.e}):
            risk = sum(r.w * math.exp(h) for r, h in zip(part, eta) if r.t >= t)
            dead = [(r.w, h) for r, h in zip(part, eta) if r.t == t and r.e]
            own = sum(w * math.exp(h) for w, h in dead)
            total += sum(w * h for w, h in dead)
            total -= sum(w for w, _ in dead) / len(dead) * sum(
                math.log(risk - i / len(dead) * own) for i in range(len(dead)))
    return total


def test_cox_weighted_stratified(aml):
    rows = aml.collect()
    fit = cox(aml, "t", "e", [Factor("x"), "z"], "w", ["st"], robust=False)
    at, hess = maximise(lambda b: cox_loglik(rows, b), np.zeros(2))
    assert fit.beta == pytest.approx(at, abs=1e-6)
    assert fit.loglik == pytest.approx(cox_loglik(rows, at), abs=1e-8)
    assert fit.std_errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-hess))), rel=1e-4)


def test_martingale_and_schoenfeld_sum_to_zero(aml):
    fit = cox(aml, "t", "e", [Factor("x"), "z"])
    assert cox_residuals(fit, "martingale").agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-8)
    for r in schoenfeld(fit).groupBy("term").agg(F.sum("residual").alias("s")).collect():
        assert r.s == pytest.approx(0, abs=1e-6)


def test_kaplan_meier_when_all_die(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 3, 0)], "arm string, t int, e int")
    km = kaplan_meier(df, "t", "e", "arm")
    last = km.filter("arm = 'a' and time = 2").first()
    assert last.survival == 0 and last.std_error is None
    at = {(r.arm, r["at"]): (r.n_risk, r.survival) for r in risk_table(km, [0, 2, 9], "arm").collect()}
    assert at[("a", 2)] == (1, 0) and at[("a", 9)] == (0, 0) and at[("b", 2)] == (1, 1)


def test_benjamini_hochberg():
    assert benjamini_hochberg([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.04, 0.04])


def test_weights_balance_the_arms(counts):
    df = counts.withColumn("treated", F.when((F.col("a") >= 2) | (F.col("ref").cast("int") % 3 == 0), 1).otherwise(0))
    # a saturated score balances the covariates exactly, an additive one only nearly
    g, fu = Factor("g"), Factor("fu")
    near = att_weights(propensity(df, "treated", [g, fu]), "treated")
    assert max(abs(r.diff_adjusted) for r in balance_table(near, [], ["g", "fu"], "treated", "weight").collect()) < 0.05
    w = att_weights(propensity(df, "treated", [g, fu, Interaction(g, fu)]), "treated")
    rows = balance_table(w, [], ["g", "fu"], "treated", "weight").collect()
    assert max(abs(r.diff_adjusted) for r in rows) < 1e-6 <= max(abs(r.diff_unadjusted) for r in rows)


def test_three_arm_weights_leave_unlabelled_people_without(counts):
    arm = F.when(F.col("fu") == 4, None).when(F.col("fu") == 1, "none").otherwise(F.concat(F.lit("d"), F.col("fu")))
    df = att_weights_multi(counts.withColumn("arm", arm), "arm", [Factor("g")], "none")
    assert df.filter("arm is null and weight is not null").count() == 0
    assert df.filter("arm = 'none' and weight <> 1").count() == 0
    assert df.filter("arm is not null and weight is null").count() == 0


def test_one_level_factor_is_dropped_and_reported(counts):
    fit = logit(counts.withColumn("c", F.lit("x")).withColumn("k", F.lit(3)), "b", [Factor("g"), Factor("c"), "k"])
    assert fit.terms == ["(Intercept)", "gv"] and fit.design.dropped == ["c", "k"]


def test_reference_level_is_the_first_given(counts):
    fit = logit(counts, "b", [Factor("g", ("v", "u"))])
    assert fit.terms == ["(Intercept)", "gu"]


def test_interaction_and_vif(counts):
    fit = logit(counts, "b", [Factor("g"), "a", Interaction(Factor("g"), "a")])
    assert fit.terms == ["(Intercept)", "gv", "a", "gv:a"]
    two = logit(counts, "b", [Factor("g"), "a"])
    r = two.cov[1, 2] / math.sqrt(two.cov[1, 1] * two.cov[2, 2])
    for row in vif(two).collect():
        assert row.gvif == pytest.approx(1 / (1 - r * r))


def test_augment_matches_the_hat_matrix(counts):
    p, x = frame(counts)
    fit = logit(counts, "b", [Factor("g"), "a"])
    mu = 1 / (1 + np.exp(-x @ fit.beta))
    v = mu * (1 - mu)
    hat = v * np.einsum("ij,jk,ik->i", x, np.linalg.inv((x * v[:, None]).T @ x), x)
    pear = (p.b - mu) / np.sqrt(v)
    got = augment(fit).orderBy(F.col("ref").cast("int")).toPandas()
    assert got.hat.to_numpy() == pytest.approx(hat, abs=1e-9)
    assert got.cooksd.to_numpy() == pytest.approx((pear / (1 - hat)) ** 2 * hat / 3, abs=1e-9)


def test_unit_weights_give_the_plain_table(counts):
    df = counts.withColumn("one", F.lit(1.0))
    plain = table_one(df, ["a", "y"], ["g"], "b").orderBy("variable", "level", "stratum").collect()
    weighted = table_one(df, ["a", "y"], ["g"], "b", "one").orderBy("variable", "level", "stratum").collect()
    for u, v in zip(plain, weighted):
        assert (u.n, u.mean, u.sd, u.percent) == pytest.approx((v.n, v.mean, v.sd, v.percent))
        assert u.smd == pytest.approx(v.smd)
    # with unit weights the survey tests come close to the plain ones (without continuity correction)
    p = {r.variable: r.p_value for r in weighted}
    assert p["g"] == pytest.approx(chi_square(df, "g", "b", correct=False).first().p_value, abs=0.005)
    plain_p = {r.variable: r.p_value for r in plain}
    assert p["a"] == pytest.approx(plain_p["a"], abs=0.02) and p["y"] == pytest.approx(plain_p["y"], abs=0.05)


def test_tidy_p_values(counts):
    for r in tidy(logit(counts, "b", [Factor("g")])).collect():
        assert r.p_value == pytest.approx(tails.normal_two_sided(r.statistic))
