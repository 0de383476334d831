"""Logistic, survey-weighted logistic, negative binomial and zero-inflated models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.tails import (chi2_quantile_1df, normal_quantile, normal_two_sided, t_quantile,
                                      t_two_sided)
from wardline.functions.tiesums import rising
from wardline.operators.design import (Design, column, complete, invert, matrix, patterns, solve, sum_blocks,
                                       term_sources)

TIDY = "term string, estimate double, std_error double, statistic double, p_value double"
RATIO = "term string, ratio double, conf_low double, conf_high double"


@dataclass
class Fit:
    """A fitted model: coefficients, their covariance and what later steps need."""

    spark: SparkSession
    kind: str
    design: Design
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    df_resid: float | None = None
    patterns: DataFrame | None = None
    data: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @property
    def terms(self) -> list[str]:
        return self.design.names

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * (len(self.beta) + self.extra.get("extra_params", 0))


# --- logistic ----------------------------------------------------------------------------------

@dataclass
class LogitSums:
    """What one pass over the pattern rows yields at a coefficient vector."""

    info: np.ndarray
    score: np.ndarray
    meat: np.ndarray
    like: float
    n: float


def expit(eta: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(eta))
    return np.where(eta >= 0, 1.0, small) / (1 + small)


def logit_pass(table: DataFrame, beta: np.ndarray, few: bool = False) -> LogitSums:
    p = len(beta)

    def block(batch):
        x, y = matrix(batch), column(batch, "_y")
        w, w2, n = column(batch, "_w"), column(batch, "_w2"), column(batch, "_n")
        eta = x @ beta + column(batch, "_offset")
        mu = expit(eta)
        info = (x * (w * mu * (1 - mu))[:, None]).T @ x
        meat = (x * (w2 * (y - mu) ** 2)[:, None]).T @ x
        like = np.sum(w * (y * eta - np.logaddexp(0, eta)))
        return np.concatenate([info.ravel(), x.T @ (w * (y - mu)), meat.ravel(), [like, n.sum()]])

    s = sum_blocks(table, 2 * p * p + p + 2, block, few)
    return LogitSums(s[:p * p].reshape(p, p), s[p * p:p * p + p],
                     s[p * p + p:2 * p * p + p].reshape(p, p), float(s[-2]), float(s[-1]))


def fit_logit_patterns(table: DataFrame, p: int, few: bool = False, tol: float = 1e-6, max_iter: int = 50
                       ) -> tuple[np.ndarray, LogitSums, bool, int]:
    """Newton steps, halved while the likelihood drops; one Spark job of p x p sums per step.

    Newton squares its error, so a last step below 1e-6 leaves about 1e-12.  Also says whether it got there, and in how many
    steps: on separated data steps stay long while the likelihood no longer grows, and it ends without converging.

    Spark ML's own GLM starts from values that depend on the row weights, which drives it
    away on pattern rows whose weight is a count in the thousands.
    """
    beta = np.zeros(p)
    now = logit_pass(table, beta, few)
    converged, steps = False, 0
    while steps < max_iter and not converged:
        steps += 1
        move = solve(now.info, now.score)
        scale = 1.0
        while True:
            new = logit_pass(table, beta + scale * move, few)
            if new.like >= now.like - 1e-12 * abs(now.like) or scale < 1e-6:
                break
            scale /= 2
        gain = new.like - now.like
        beta, now = beta + scale * move, new
        converged = bool(np.max(np.abs(scale * move)) < tol * (1 + np.max(np.abs(beta))))
        if gain < 1e-9 and np.max(np.abs(scale * move)) > 0.1 * (1 + np.max(np.abs(beta))) / steps:
            break
    return beta, now, converged, steps


def logit(df: DataFrame, y: str, terms, weight: str | None = None, where=None, offset: str | None = None) -> Fit:
    """Logistic regression with maximum-likelihood covariance."""
    df = df if where is None else df.filter(where)
    df = complete(df, {y, *term_sources(terms), *([weight] if weight else []), *([offset] if offset else [])})
    d, table = patterns(df, terms, y, weight, offset)
    beta, sums, converged, steps = fit_logit_patterns(table, d.width, d.few)
    n = int(sums.n)
    return Fit(df.sparkSession, "logit", d, beta, invert(sums.info), sums.like, n, n - d.width, table, df,
               {"y": y, "weight": weight, "offset": offset, "meat": sums.meat, "converged": converged, "iterations": steps})


def svy_logit(df: DataFrame, y: str, terms, weight: str, where=None) -> Fit:
    """Survey-weighted logistic regression (independent rows), linearised sandwich variance."""
    fit = logit(df, y, terms, weight, where)
    fit.cov = fit.cov @ fit.extra["meat"] @ fit.cov * (fit.n / (fit.n - 1))
    fit.kind = "svy_logit"
    return fit


# --- tables of coefficients -----------------------------------------------------------------------

def rows_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _p_value(fit: Fit, z: float) -> float:
    return t_two_sided(z, fit.df_resid) if fit.kind == "svy_logit" else normal_two_sided(z)


def tidy(fit: Fit) -> DataFrame:
    """Estimate, standard error, statistic and p-value per term."""
    rows = []
    for name, b, se in zip(fit.terms, fit.beta, fit.std_errors):
        z = float(b / se)
        rows.append((name, float(b), float(se), z, _p_value(fit, z)))
    return rows_frame(fit.spark, rows, TIDY)


def glance(fit: Fit) -> DataFrame:
    """Size, likelihood, what was dropped, and whether the fit converged (NULL where it says nothing), in how many steps.

    ``no_exposure`` is the number of rows left out for want of a positive exposure.
    """
    row = (fit.n, fit.loglik, -2 * fit.loglik, fit.aic, ",".join(fit.design.dropped), fit.extra.get("converged"),
           fit.extra.get("iterations"), fit.extra.get("no_exposure", 0))
    return rows_frame(fit.spark, [row], "n long, loglik double, minus_2_loglik double, aic double, dropped string, "
                                        "converged boolean, iterations int, no_exposure long")


def _exp(x: float | None) -> float | None:
    """NULL where the value is not finite: separated data bounds a ratio on one side only."""
    return math.exp(x) if x is not None and -700 < x < 700 else None


def ratio_table(fit: Fit, level: float = 0.95, interval: str | None = None) -> DataFrame:
    """Odds, rate or hazard ratios with their interval.

    ``interval`` is ``"profile"`` (the default of logistic and negative binomial fits) or ``"wald"`` (the only one for
    survey-weighted, zero-inflated and Cox fits).  A limit that does not exist is NULL.
    """
    if (interval or ("profile" if fit.kind in PROFILED else "wald")) == "profile":
        low, high = profile_limits(fit, level)
    else:
        q = t_quantile(0.5 + level / 2, fit.df_resid) if fit.kind == "svy_logit" else normal_quantile(0.5 + level / 2)
        with np.errstate(invalid="ignore"):
            low, high = fit.beta - q * fit.std_errors, fit.beta + q * fit.std_errors
    rows = [(name, *(_exp(None if v is None or np.isnan(v) else float(v)) for v in bounds))
            for name, *bounds in zip(fit.terms, fit.beta, low, high)]
    return rows_frame(fit.spark, rows, RATIO)


# --- profile likelihood ----------------------------------------------------------------------------

PROFILED = ("logit", "neg_binomial")


def _likelihoods(fit: Fit, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, score and expected information at many coefficient vectors, from one pass over the patterns."""
    k, p = betas.shape
    theta = fit.extra.get("theta")

    def block(batch):
        x, y, w = matrix(batch), column(batch, "_y"), column(batch, "_w")
        out = []
        for beta in betas:
            eta = x @ beta + column(batch, "_offset")
            if theta is None:
                mu = expit(eta)
                like, slope, curve = y * eta - np.logaddexp(0, eta), y - mu, mu * (1 - mu)
            else:
                log_both = np.logaddexp(math.log(theta), eta)
                share = np.exp(eta - log_both)
                like = y * (eta - log_both) - theta * (log_both - math.log(theta))
                slope, curve = y * (1 - share) - theta * share, theta * share
            out.append(np.concatenate([[np.sum(w * like)], x.T @ (w * slope), ((x * (w * curve)[:, None]).T @ x).ravel()]))
        return np.concatenate(out)

    s = sum_blocks(fit.patterns, k * (1 + p + p * p), block, fit.design.few).reshape(k, -1)
    return s[:, 0], s[:, 1:1 + p], s[:, 1 + p:].reshape(k, p, p)


def _spans(fit: Fit) -> np.ndarray:
    """How far each column of the design reaches, so that steps can be told in units of the linear predictor."""
    p = fit.design.width
    row = fit.patterns.agg(*[F.max(F.abs(F.col("_x")[j])).alias(f"m{j}") for j in range(p)]).first()
    return np.array([float(row[j] or 0.0) or 1.0 for j in range(p)])


def profile_limits(fit: Fit, level: float = 0.95, max_steps: int = 60) -> tuple[list, list]:
    """Both limits of every term where twice the log-likelihood lost by holding it meets the chi-square quantile.

    All limits are sought at once, each with its own coefficients: a step solves for the point where, to second order, the other
    coefficients are at their best and the likelihood is on target.  One pass over the patterns serves the steps of
    all limits, so the number of jobs does not grow with the terms.  A likelihood that stays above the target however far a
    coefficient goes has no limit there (None).  The dispersion of a negative binomial fit is held.
    """
    p, half = fit.design.width, chi2_quantile_1df(level) / 2
    top, _, info = (v[0] for v in _likelihoods(fit, fit.beta[None, :]))
    inv, spans = invert(info), _spans(fit)
    found: dict[tuple[int, int], float | None] = {}
    at: dict[tuple[int, int], np.ndarray] = {}
    for j in range(p):
        reach = math.sqrt(max(2 * half * inv[j, j], 0.0))
        move = inv[:, j] / max(inv[j, j], 1e-300) * min(reach, 2 / spans[j])
        for side in (-1, 1):
            at[j, side] = fit.beta + side * move
    for _ in range(max_steps):
        if not at:
            break
        keys = list(at)
        likes, scores, infos = _likelihoods(fit, np.array([at[k] for k in keys]))
        for key, like, g, i in zip(keys, likes, scores, infos):
            j, side = key
            others = [a for a in range(p) if a != j]
            gap = like - (top - half)
            free = solve(i[np.ix_(others, others)], np.column_stack([g[others], i[others, j]])) if others else np.zeros((0, 2))
            nuisance = float(g[others] @ free[:, 0]) / 2
            if abs(gap) < 1e-9 * (1 + half) and nuisance < 1e-9:
                found[key] = float(at[key][j])
                del at[key]
                continue
            # the coefficient itself: -a s^2 + b s + c = 0 with the others at their best
            a = max(float(i[j, j] - i[j, others] @ free[:, 1]) / 2, 1e-300)
            b, c = float(g[j] - i[j, others] @ free[:, 0]), gap + nuisance
            root = b * b + 4 * a * c
            step = (b + side * math.sqrt(root)) / (2 * a) if root > 0 else b / (2 * a)
            step = float(np.clip(step, -2 / spans[j], 2 / spans[j]))
            move = np.zeros(p)
            move[j] = step
            move[others] = free[:, 0] - step * free[:, 1]
            at[key] = at[key] + np.clip(move, -4 / spans, 4 / spans)
            # on the way to 0 the estimate itself may be far out
            far = 25 + max(-side * fit.beta[j], 0.0) * spans[j]
            if gap > 0 and side * (at[key][j] - fit.beta[j]) * spans[j] > far:
                found[key] = None
                del at[key]
    return [found.get((j, -1)) for j in range(p)], [found.get((j, 1)) for j in range(p)]


# --- negative binomial -----------------------------------------------------------------------------

def _nb_log_density(y, mu, theta):
    return (rising(y, theta)[2] - rising(y, 1.0)[2] + theta * np.log(theta / (theta + mu))
            + np.where(y > 0, y * np.log(mu / (theta + mu)), 0.0))


@dataclass
class NbSums:
    """What one pass yields: expected information, score and observed information of (beta, log theta), likelihood."""

    expected: np.ndarray
    score: np.ndarray
    observed: np.ndarray
    like: float


def _nb_sums(table: DataFrame, beta: np.ndarray, theta: float, few: bool = False) -> NbSums:
    p = len(beta)

    def block(batch):
        x, y, w = matrix(batch), column(batch, "_y"), column(batch, "_w")
        mu = np.exp(x @ beta + column(batch, "_offset"))
        both = theta + mu
        fisher = (x * (w * mu * theta / both)[:, None]).T @ x
        exact = (x * (w * mu * (theta + y) * theta / both ** 2)[:, None]).T @ x
        score = x.T @ (w * (y - mu) * theta / both)
        cross = x.T @ (w * (y - mu) * mu * theta / both ** 2)
        inverse, square, _ = rising(y, theta)
        slope = np.sum(w * (inverse + np.log(theta) + 1 - np.log(both) - (y + theta) / both))
        curve = np.sum(w * (square - 1 / theta + 2 / both - (y + theta) / both ** 2))
        like = np.sum(w * _nb_log_density(y, mu, theta))
        return np.concatenate([fisher.ravel(), exact.ravel(), score, cross, [slope, curve, like]])

    s = sum_blocks(table, 2 * p * p + 2 * p + 3, block, few)
    fisher, exact = s[:p * p].reshape(p, p), s[p * p:2 * p * p].reshape(p, p)
    score, cross = s[2 * p * p:2 * p * p + p], s[2 * p * p + p:2 * p * p + 2 * p]
    slope, curve, like = s[-3:]
    observed = np.block([[exact, -cross[:, None]], [-cross[None, :], np.array([[curve * theta ** 2 - slope * theta]])]])
    return NbSums(fisher, np.concatenate([score, [slope * theta]]), observed, float(like))


def _nb_start(table: DataFrame) -> tuple[float, float]:
    """Log mean rate and a moment estimate of theta."""
    w = F.col("_w")
    r = table.agg((F.sum(w * F.col("_y")) / F.sum(w * F.exp("_offset"))).alias("rate"),
                  (F.sum(w * F.col("_y")) / F.sum(w)).alias("mean"),
                  (F.sum(w * F.col("_y") * F.col("_y")) / F.sum(w)).alias("square")).first()
    spread = r.square - r.mean ** 2 - r.mean
    return math.log(max(r.rate, 1e-8)), (r.mean ** 2 / spread if spread > 1e-8 else 100.0)


def _nb_fit(table: DataFrame, p: int, few: bool = False, tol: float = 1e-6, max_iter: int = 100
            ) -> tuple[np.ndarray, float, NbSums, bool, int]:
    """Newton steps of (beta, log theta); scoring steps where the likelihood is not concave."""
    rate, theta = _nb_start(table)
    beta = np.zeros(p)
    beta[0] = rate
    now = _nb_sums(table, beta, theta, few)
    converged, steps = False, 0
    while steps < max_iter and not converged:
        steps += 1
        if np.all(np.linalg.eigvalsh(now.observed) > 0):
            move = solve(now.observed, now.score)
        else:
            move = np.concatenate([solve(now.expected, now.score[:-1]), [np.sign(now.score[-1])]])
        move[-1] = np.clip(move[-1], -1, 1)
        scale = 1.0
        while True:
            nb, nt = beta + scale * move[:-1], theta * math.exp(scale * move[-1])
            new = _nb_sums(table, nb, nt, few)
            if new.like >= now.like - 1e-9 * abs(now.like) or scale < 1e-4:
                break
            scale /= 2
        beta, theta, now = nb, nt, new
        converged = bool(np.max(np.abs(scale * move)) < tol * (1 + np.max(np.abs(beta))))
        if theta > 1e8:  # no spread beyond Poisson's
            break
    return beta, theta, now, converged, steps


def _with_exposure(df: DataFrame, offset: str | None) -> tuple[DataFrame, str | None, int]:
    """Rows with a logarithm of their exposure, its name, and the number of rows without one."""
    if not offset:
        return df, None, 0
    without = df.filter(~F.coalesce(F.col(offset) > 0, F.lit(False))).count()
    return df.filter(F.col(offset) > 0).withColumn("_log_exposure", F.log(F.col(offset).cast("double"))), "_log_exposure", without


def neg_binomial(df: DataFrame, y: str, terms, offset: str | None = None, weight: str | None = None,
                 where=None) -> Fit:
    """Negative binomial regression; ``offset`` is the exposure, entering as its logarithm.

    Rows without positive exposure have no finite offset and are left out; ``extra["no_exposure"]`` (and ``glance``) has their
    number.
    """
    df = df if where is None else df.filter(where)
    df = complete(df, {y, *term_sources(terms), *([weight] if weight else []), *([offset] if offset else [])})
    df, log_exposure, without = _with_exposure(df, offset)
    d, table = patterns(df, terms, y, weight, log_exposure)
    beta, theta, sums, converged, steps = _nb_fit(table, d.width, few=d.few)
    theta_info = (sums.observed[-1, -1] + sums.score[-1]) / theta ** 2
    n = table.agg(F.sum("_n").alias("n")).first().n
    return Fit(df.sparkSession, "neg_binomial", d, beta, invert(sums.expected), sums.like, int(n), None, table, df,
               {"theta": theta, "theta_se": 1 / math.sqrt(theta_info) if theta_info > 0 else None, "extra_params": 1,
                "y": y, "weight": weight, "offset": offset, "converged": converged, "iterations": steps, "no_exposure": without})


# --- zero-inflated negative binomial -------------------------------------------------------------------

def _zinb_gradients(table: DataFrame, points: list[np.ndarray], few: bool) -> np.ndarray:
    """Score of the observed likelihood at several parameter points (beta, logit pi, log theta) in one pass."""
    q = len(points[0])

    def block(batch):
        x, y, w = matrix(batch), column(batch, "_y"), column(batch, "_w")
        off = column(batch, "_offset")
        out = []
        for point in points:
            beta, gamma, theta = point[:-2], point[-2], math.exp(point[-1])
            pi = 1 / (1 + math.exp(-gamma))
            mu = np.exp(x @ beta + off)
            zero = y == 0
            p0 = np.exp(theta * np.log(theta / (theta + mu)))
            both = pi + (1 - pi) * p0
            # posterior chance that a row belongs to the count part
            count = np.where(zero, (1 - pi) * p0 / both, 1.0)
            score = x.T @ (w * count * (y - mu) / (1 + mu / theta))
            d_theta = np.sum(w * count * theta * (rising(y, theta)[0] + np.log(theta) + 1 - np.log(theta + mu)
                                                  - (y + theta) / (mu + theta)))
            d_gamma = np.sum(w * ((1 - count) - pi))
            out.append(np.concatenate([score, [d_gamma, d_theta]]))
        return np.concatenate(out)

    return sum_blocks(table, q * len(points), block, few).reshape(len(points), q)


def _zinb_loglik(table: DataFrame, beta, pi, theta, few: bool) -> float:
    def block(batch):
        x, y, w = matrix(batch), column(batch, "_y"), column(batch, "_w")
        mu = np.exp(x @ beta + column(batch, "_offset"))
        dens = np.exp(_nb_log_density(y, mu, theta))
        return np.array([np.sum(w * np.log(np.where(y == 0, pi + (1 - pi) * dens, (1 - pi) * dens)))])

    return float(sum_blocks(table, 1, block, few)[0])


def zinb(df: DataFrame, y: str, terms, offset: str | None = None, weight: str | None = None, where=None,
         tol: float = 1e-8, max_iter: int = 200) -> Fit:
    """Zero-inflated negative binomial with a constant inflation part.

    Newton steps on the observed likelihood, whose Hessian is the central difference of the
    score at 2(p+2) nearby points, all taken in one pass; steps that do not gain are halved.
    """
    df = df if where is None else df.filter(where)
    df = complete(df, {y, *term_sources(terms), *([weight] if weight else []), *([offset] if offset else [])})
    df, log_exposure, without = _with_exposure(df, offset)
    d, table = patterns(df, terms, y, weight, log_exposure)
    beta, theta, *_ = _nb_fit(table, d.width, few=d.few, tol=1e-3)
    share = table.agg((F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0)) / F.sum("_w")).alias("z")).first().z
    pi = min(max(share / 2, 1e-3), 0.9)
    par = np.concatenate([beta, [math.log(pi / (1 - pi)), math.log(theta)]])
    q = len(par)

    def like_at(v):
        return _zinb_loglik(table, v[:-2], 1 / (1 + math.exp(-v[-2])), math.exp(v[-1]), d.few)

    like = like_at(par)
    hess, done, steps = np.eye(q), False, 0
    while steps < max_iter and not done:
        steps += 1
        h = 1e-5 * (1 + np.abs(par))
        points = [par] + [par + s * h[i] * np.eye(q)[i] for i in range(q) for s in (1, -1)]
        grads = _zinb_gradients(table, points, d.few)
        hess = np.array([(grads[1 + 2 * i] - grads[2 + 2 * i]) / (2 * h[i]) for i in range(q)])
        hess = (hess + hess.T) / 2
        vals, vecs = np.linalg.eigh(-hess)
        move = vecs @ ((vecs.T @ grads[0]) / np.maximum(np.abs(vals), 1e-8 * np.max(np.abs(vals))))
        move *= min(1.0, 2.0 / max(np.max(np.abs(move)), 1e-300))
        scale = 1.0
        while True:
            nxt = par + scale * move
            new = like_at(nxt)
            if new >= like - 1e-10 * abs(like) or scale < 1e-6:
                break
            scale /= 2
        done = bool(np.max(np.abs(scale * move)) < tol * (1 + np.max(np.abs(par))))
        par, like = nxt, new
    cov = invert(-hess)
    n = table.agg(F.sum("_n").alias("n")).first().n
    full = Design([*[f"count_{t}" for t in d.names], "zero_(Intercept)"], [*d.exprs, F.lit(1.0)], d.sources, d.groups,
                  d.dropped)
    return Fit(df.sparkSession, "zinb", full, par[:-1], cov[:-1, :-1], like, int(n), None, table, df,
               {"theta": math.exp(par[-1]), "zero_share": 1 / (1 + math.exp(-par[-2])), "extra_params": 1,
                "converged": done, "iterations": steps, "no_exposure": without})
