"""Cox scans over many parts, tie sums, running sums, concordance and curve limits against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wardline.functions.tiesums import efron, rising
from wardline.operators.concordance import concordance, pair_weights
from wardline.operators.design import Factor
from wardline.operators.running import PART, ranged, running
from wardline.operators.survival import cox, cox_residuals, cox_summary, cox_terms, kaplan_meier, ph_test, schoenfeld


@pytest.fixture(scope="module")
def split(spark):
    """Many parts also for small tables."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(220):
        t = int(rng.choice([28, 28, *range(1, 12)])) if i % 3 else float(rng.integers(1, 9)) + 0.5
        out.append((i, "ab"[i % 2], float(t), int(rng.random() < (0.1 if t == 28 else 0.6)), float(rng.integers(1, 4)) / 2,
                    "uv"[int(rng.random() < 0.4)], float(np.round(rng.normal(), 3))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "ref long, st string, t double, e int, w double, x string, z double").repartition(5)


def plain_cox(rows, beta, strata=True):
    """Log-likelihood, score, information, and per person score residual and own hazard, with Efron's ties, one by one."""
    x = np.array([[r[5] == "v", r[6]] for r in rows], float)
    st, t, e, w = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    st = st if strata else np.zeros(len(rows))
    risk = w * np.exp(x @ beta)
    like, score, info = 0.0, np.zeros(2), np.zeros((2, 2))
    res, hazard = x * 0, np.zeros(len(rows))
    for s, u in sorted({(s, u) for s, u, d in zip(st, t, e) if d}):
        at, dead = (st == s) & (t >= u), (st == s) & (t == u) & (e == 1)
        d, wbar = dead.sum(), w[dead].mean()
        like += (w[dead] * (x[dead] @ beta)).sum()
        for k in range(d):
            use = risk * at - k / d * risk * dead
            mean = use @ x / use.sum()
            like -= wbar * math.log(use.sum())
            score += (w[dead] @ x[dead]) / d - wbar * mean
            info += wbar * ((x - mean).T * use) @ (x - mean) / use.sum()
            share = (at - k / d * dead) * wbar / use.sum()
            hazard += share
            res += dead[:, None] * (x - mean) / d - (np.exp(x @ beta) * share)[:, None] * (x - mean)
    return like, score, info, res, hazard


@pytest.mark.parametrize("strata", [True, False])
def test_cox_over_many_parts(split, rows, strata):
    df = frame(split, rows)
    fit = cox(df, "t", "e", [Factor("x"), "z"], "w", ["st"] if strata else [])
    assert fit.extra["table"].parts == 7 and fit.extra["converged"]
    like, score, info, res, hazard = plain_cox(rows, fit.beta, strata)
    assert np.abs(score).max() < 1e-6 and fit.loglik == pytest.approx(like, abs=1e-8)
    inv, w = np.linalg.inv(info), np.array([r[4] for r in rows])
    assert fit.extra["naive"] == pytest.approx(inv, rel=1e-8)
    meat = (res * (w ** 2)[:, None]).T @ res
    assert fit.cov == pytest.approx(inv @ meat @ inv, rel=1e-6)
    x = np.array([[r[5] == "v", r[6]] for r in rows], float)
    got = {r.ref: r.residual for r in cox_residuals(fit, "martingale").collect()}
    centred = np.exp((x - (w @ x) / w.sum()) @ fit.beta)
    scale = np.exp(-(w @ x) / w.sum() @ fit.beta)
    assert [got[i] for i in range(len(rows))] == pytest.approx(
        [r[3] - c * h / scale for r, c, h in zip(rows, centred, hazard)], abs=1e-8)
    assert len(schoenfeld(fit).collect()) == 2 * sum(r[3] for r in rows)
    at_zero = plain_cox(rows, np.zeros(2), strata)
    row = cox_summary(fit).first()
    assert row.score_test == pytest.approx(at_zero[1] @ np.linalg.inv(at_zero[2]) @ at_zero[1], rel=1e-8)
    assert row.lr_test == pytest.approx(2 * (like - at_zero[0]), rel=1e-8)
    terms = cox_terms(fit).collect()
    assert [r.model_error for r in terms] == pytest.approx(np.sqrt(np.diag(inv)), rel=1e-8)


def test_parts_do_not_show(split, rows):
    many = cox(frame(split, rows), "t", "e", [Factor("x"), "z"], strata=["st"])
    split.conf.set("spark.sql.shuffle.partitions", "1")
    one = cox(frame(split, rows), "t", "e", [Factor("x"), "z"], strata=["st"])
    split.conf.set("spark.sql.shuffle.partitions", "7")
    assert one.extra["table"].rows.rdd.getNumPartitions() == 1
    assert one.cov == pytest.approx(many.cov, rel=1e-9) and one.beta == pytest.approx(many.beta, rel=1e-9)
    assert [r.chisq for r in ph_test(one).collect()] == pytest.approx([r.chisq for r in ph_test(many).collect()], rel=1e-8)


def test_separated_data_does_not_converge(spark):
    df = spark.createDataFrame([(float(i), int(i < 5), float(i < 5)) for i in range(1, 10)], "t double, e int, z double")
    assert not cox(df, "t", "e", ["z"], max_iter=8).extra["converged"]


def test_concordance(split, rows):
    df = frame(split, rows).withColumn("y", F.floor(F.col("z") * 8).cast("double"))
    got = concordance(df, "st", "t", "e", "y", "w")
    want = np.zeros(3)
    for a in rows:
        for b in rows:
            if a[3] and a[1] == b[1] and (b[2] > a[2] or b[2] == a[2] and not b[3]):
                ya, yb = math.floor(a[6] * 8), math.floor(b[6] * 8)
                want[0 if yb < ya else 1 if yb > ya else 2] += a[4] * b[4]
    assert got == pytest.approx(tuple(want), rel=1e-12)


@pytest.mark.parametrize("kinds", [3, 50, 100_000])
def test_pair_weights_in_blocks(kinds, monkeypatch):
    from wardline.operators import concordance as module
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(kinds)
    o, y = rng.integers(0, kinds, 300), rng.integers(0, 40, 300).astype(float)
    w = rng.integers(1, 5, 300).astype(float)
    e = np.where(rng.random(300) < 0.5, w, 0.0)
    later = o[None, :] > o[:, None]
    pairs = later * e[:, None] * w[None, :]
    side = np.sign(y[None, :] - y[:, None])
    assert pair_weights(o, y, e, w) == pytest.approx([pairs[side == k].sum() for k in (-1, 1, 0)])


def test_tie_sums_equal_the_loop():
    rng = np.random.default_rng(2)
    for d in (1, 2, 23, 24, 25, 60, 1000, 10 ** 6):
        for share in (0.97, 0.5, 1e-3, 1e-7):
            s0 = float(10 ** rng.uniform(-2, 5))
            f = np.arange(d) / d
            s = s0 - f * share * s0
            want = [math.fsum(v) for v in (1 / s, f / s, 1 / s ** 2, f / s ** 2, f * f / s ** 2, np.log(s))]
            got = efron(np.array([d]), np.array([s0]), np.array([share * s0]))[:, 0]
            scale = np.array([1 / s0, 1 / s0, 1 / s0 ** 2, 1 / s0 ** 2, 1 / s0 ** 2, 1]) * d
            assert np.abs(got - want).max() >= 0 and (np.abs(got - want) / np.maximum(np.abs(want), scale)).max() < 1e-10
    assert not efron(np.array([0, 3]), np.array([1.0, 2.0]), np.array([0.0, 0.0])).any()
    y = np.array([0, 1, 24, 25, 10 ** 6])
    for theta in (0.01, 1.0, 40.0):
        for k, n in enumerate(y):
            j = theta + np.arange(n)
            want = [math.fsum(1 / j), math.fsum(1 / j ** 2), math.fsum(np.log(j))]
            assert [v[k] for v in rising(y, theta)] == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("down", [False, True])
def test_running_sums_over_parts(split, down):
    rows = [(None if i % 5 == 0 else "kl"[i % 2], i * 7 % 41, float(i % 4 + 1)) for i in range(200)]
    df = ranged(split.createDataFrame(rows, "k string, t int, v double"), ["k"], "t")
    assert df.select(PART).distinct().count() > 3
    got = running(df, ["k"], "t", {"s": "v"}, down, {"p": F.lit(1.0) + F.col("v") / 8}).collect()
    for r in got:
        own = [v for k, t, v in rows if k == r.k and (t >= r.t if down else t <= r.t)]
        assert r.s == pytest.approx(sum(own)) and r.p == pytest.approx(math.prod(1 + v / 8 for v in own))


def test_limits_of_a_weighted_curve(split, rows):
    """The error is the sum of squares of what leaving each person's weight out changes, to first order."""
    km = {(r.st, r.time): r for r in kaplan_meier(frame(split, rows), "t", "e", "st", "w", limits=True).collect()}

    def curve(group, weights, at):
        s = 1.0
        for u in sorted({r[2] for r in group if r[2] <= at}):
            n = sum(w for r, w in zip(group, weights) if r[2] >= u)
            s *= 1 - sum(w for r, w in zip(group, weights) if r[2] == u and r[3]) / n
        return s
    for st in "ab":
        group = [r for r in rows if r[1] == st]
        w = [r[4] for r in group]
        for at in (2.0, 5.5, 11.0):
            r = km[(st, at)]
            total, h = 0.0, 1e-5
            for i in range(len(group)):
                up, low = list(w), list(w)
                up[i] += h
                low[i] -= h
                total += (w[i] * (curve(group, up, at) - curve(group, low, at)) / (2 * h)) ** 2
            assert r.robust_error == pytest.approx(math.sqrt(total), rel=1e-4)
            assert r.conf_low < r.survival < r.conf_high <= 1
