"""Propensity scores, ATT weights and balance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.design import Design, column, complete, matrix, patterns, solve, sum_blocks, term_sources
from wardline.operators.models import expit, fit_logit_patterns, rows_frame
from wardline.operators.tables import _variance, collect_moments

def _score(d: Design, beta: np.ndarray):
    """Fitted probability as a column expression on the person's own columns."""
    total = F.lit(0.0)
    for b, e in zip(beta, d.exprs):
        total = total + F.lit(float(b)) * e
    return 1 / (1 + F.exp(-total))


def propensity(df: DataFrame, treatment: str, covariates, name: str = "ps") -> DataFrame:
    """Probability of treatment (1) given the covariates, from a logistic model.

    The score is attached as an expression on the row itself: no join back.
    """
    used = complete(df, [treatment, *term_sources(covariates)])
    d, table = patterns(used, covariates, treatment)
    if table.select("_y").distinct().limit(2).count() < 2:
        raise ValueError(f"{treatment} has only one value")
    beta = fit_logit_patterns(table, d.width, d.few)[0]
    return df.withColumn(name, _score(d, beta))


def att_weights(df: DataFrame, treatment: str, ps: str = "ps", name: str = "weight") -> DataFrame:
    """Treated 1, controls p/(1-p); NULL for a control whose score is 1, who stands for nobody that could be treated."""
    return df.withColumn(name, F.when(F.col(treatment) == 1, 1.0).when(
        F.col(treatment) == 0, F.try_divide(F.col(ps), 1 - F.col(ps))))


def _fit_arms(table: DataFrame, treatment: str, arms: list, p: int, few: bool, tol: float = 1e-6,
              max_iter: int = 50) -> np.ndarray:
    """One-against-the-rest logistic coefficients of every arm, all arms in the same passes."""
    index = F
    for k, arm in enumerate(arms):
        index = index.when(F.col(treatment) == arm, k)
    rows = table.select("_x", "_w", index.alias("_arm")).filter(F.col("_arm").isNotNull())
    k, size = len(arms), p * p + p + 1

    def sums(betas):
        def block(batch):
            x, w, arm = matrix(batch), column(batch, "_w"), column(batch, "_arm")
            out = []
            for i in range(k):
                y, eta = (arm == i).astype(float), x @ betas[i]
                mu = expit(eta)
                out += [((x * (w * mu * (1 - mu))[:, None]).T @ x).ravel(), x.T @ (w * (y - mu)),
                        [np.sum(w * (y * eta - np.logaddexp(0, eta)))]]
            return np.concatenate(out)

        return sum_blocks(rows, k * size, block, few).reshape(k, size)

    betas, now = np.zeros((k, p)), sums(np.zeros((k, p)))
    for _ in range(max_iter):
        moves = np.array([solve(s[:p * p].reshape(p, p), s[p * p:-1]) for s in now])
        scale = np.ones((k, 1))
        while True:
            new = sums(betas + scale * moves)
            worse = (new[:, -1] < now[:, -1] - 1e-12 * np.abs(now[:, -1])) & (scale[:, 0] > 1e-6)
            if not worse.any():
                break
            scale[worse] /= 2
        betas, now = betas + scale * moves, new
        if np.max(np.abs(scale * moves)) < tol * (1 + np.max(np.abs(betas))):
            break
    return betas


def att_weights_multi(df: DataFrame, treatment: str, covariates, focal: str, stabilize: bool = False,
                      name: str = "weight", scores: bool = False) -> DataFrame:
    """Several arms: one logistic model per arm, weight e_focal / e_own (NULL where e_own is 0); the focal arm has 1.

    All models share one table of covariate patterns.  ``stabilize`` multiplies by the arm's
    share of people.  People without an arm get no weight.
    """
    used = complete(df, [treatment, *term_sources(covariates)])
    d, table = patterns(used.withColumn("_one", F.lit(1)), covariates, "_one", keys=[treatment])
    shares = {r[treatment]: r["n"] for r in table.groupBy(treatment).agg(F.sum("_n").alias("n")).limit(101).collect()}
    if len(shares) > 100:
        raise ValueError("too many arms")
    total = sum(shares.values())
    arms = sorted(shares)
    fitted = dict(zip(arms, _fit_arms(table, treatment, arms, d.width, d.few)))
    score = {arm: _score(d, beta) for arm, beta in fitted.items()}
    weight = F
    for arm in arms:
        ratio = F.lit(1.0) if arm == focal else F.try_divide(score[focal], score[arm])
        share = shares[arm] / total if stabilize else 1.0
        weight = weight.when(F.col(treatment) == arm, ratio * F.lit(share))
    out = df.withColumn(name, weight)
    if scores:
        out = out.withColumns({f"ps_{i}": score[a] for i, a in enumerate(arms)})
    return out


def ess(df: DataFrame, treatment: str, weight: str) -> DataFrame:
    """Effective sample size per arm, before and after weighting; NULL for an arm of weight 0."""
    w = F.col(weight)
    return df.groupBy(treatment).agg(F.count(w).cast("double").alias("n"),
                                     F.try_divide(F.sum(w) ** 2, F.sum(w * w)).alias("ess"))


def _mean(cell) -> float | None:
    return cell.wx / cell.w if cell is not None and cell.w else None


def _gap(a: float | None, b: float | None, unit: float = 1.0) -> float | None:
    return None if a is None or b is None or not unit else (a - b) / unit


def balance_table(df: DataFrame, nums, cats, treatment: str, weight: str, focal=1) -> DataFrame:
    """Differences of every covariate between each arm and the focal one, before and after weighting.

    Numbers are divided by the focal arm's own standard deviation; levels are plain
    differences of their shares.  A difference is NULL where it has no meaning: the covariate does not vary in the
    focal arm, or an arm has no people or no weight.
    """
    nums, cats, focal = list(nums), list(cats), str(focal)
    known = df.filter(F.col(weight).isNotNull())
    before, after = collect_moments(known, nums, cats, treatment, weight)
    out = []
    for v in [*nums, *cats]:
        if v in nums:
            base = {r.stratum: r for r in before[v]}
            adj = {r.stratum: r for r in after[v]}
            sd = math.sqrt(_variance(base[focal], False) or 0.0) if focal in base else 0.0
            for arm in sorted(base):
                if arm != focal:
                    out.append((v, None, arm, *[_gap(_mean(m.get(focal)), _mean(m.get(arm)), sd) for m in (base, adj)]))
            continue
        shares = []
        for rows in (before[v], after[v]):
            size: dict[str, float] = {}
            for r in rows:
                size[r.stratum] = size.get(r.stratum, 0.0) + r.w
            shares.append(({(r.level, r.stratum): r.w for r in rows}, size))
        arms = sorted({r.stratum for r in before[v]})
        for level in sorted({r.level for r in before[v]}):
            for arm in arms:
                if arm != focal:
                    diff = [_gap(*[part.get((level, a), 0.0) / size[a] if size.get(a) else None for a in (focal, arm)])
                            for part, size in shares]
                    out.append((v, level, arm, diff[0], diff[1]))
    return rows_frame(df.sparkSession, out,
                       "variable string, level string, arm string, diff_unadjusted double, diff_adjusted double")


def weight_summary(df: DataFrame, treatment: str, weight: str) -> DataFrame:
    """Per arm: range, mean, coefficient of variation, zeros and effective sample size."""
    w = F.col(weight)
    return df.filter(w.isNotNull()).groupBy(treatment).agg(
        F.count(w).alias("n"), F.min(w).alias("min"), F.max(w).alias("max"), F.avg(w).alias("mean"),
        F.try_divide(F.stddev_samp(w), F.avg(w)).alias("cv"), F.count_if(w == 0).alias("zeros"),
        F.try_divide(F.sum(w) ** 2, F.sum(w * w)).alias("ess"))


def largest_weights(df: DataFrame, treatment: str, weight: str, k: int = 5, key: str = "ref") -> DataFrame:
    """The k largest weights of each arm; every task keeps only k per arm before the shuffle."""
    w = Window.partitionBy(treatment).orderBy(F.desc(weight), key)
    return df.select(treatment, key, weight).filter(F.col(weight).isNotNull()).withColumn(
        "rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reweight(df: DataFrame, condition, treatment: str, covariates, focal: str | None = None, **options) -> DataFrame:
    """New weights for the people who meet a condition (such as survivors)."""
    part = df.filter(condition)
    if focal is None:
        return att_weights(propensity(part, treatment, covariates), treatment)
    return att_weights_multi(part, treatment, covariates, focal, **options)


def weighted_means(df: DataFrame, values, by: str, weight: str) -> DataFrame:
    """Weighted mean of each measure per arm, one row per arm and measure."""
    sums = df.groupBy(by).agg(*[
        F.try_divide(F.sum(F.col(weight) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v)
        for v in values])
    return sums.unpivot([by], list(values), "variable", "mean")
