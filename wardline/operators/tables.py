"""Table One with and without weights, tests and standardised differences.

One pass over the people gives moments per (variable, level, group); everything after that
works on those few numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.tails import chi2_tail, f_tail
from wardline.operators.design import MAX_LEVELS
from wardline.operators.models import rows_frame

OVERALL = "Overall"
TABLE = ("variable string, level string, stratum string, n double, count double, percent double, mean double, "
         "sd double, p_value double, smd double")


def _strata_column(strata: str | None):
    return F.col(strata).cast("string") if strata else F.lit(OVERALL)


@dataclass(frozen=True)
class Cell:
    """Sums of one (variable, level, group): counts and values, plain and weighted."""

    level: str | None
    stratum: str
    n: float
    w: float
    wx: float
    wxx: float
    w2: float
    w2x: float
    w2xx: float


def moments(df: DataFrame, nums, cats, strata: str | None = None, weight: str | None = None) -> DataFrame:
    """Weight, value and squared-weight sums per variable, level and group; NULLs left out.

    All variables are laid out as rows inside the one scan and combined there, so a single
    row per (variable, level, group) and task is shuffled.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    text, number = F.lit(None).cast("string"), F.lit(0.0)
    cells = [F.struct(F.lit(v).alias("variable"), text.alias("level"), F.col(v).cast("double").alias("x"),
                      F.col(v).isNotNull().alias("known")) for v in nums]
    cells += [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"), number.alias("x"),
                       F.col(c).isNotNull().alias("known")) for c in cats]
    long = df.select(_strata_column(strata).alias("stratum"), w.alias("_w"), F.inline(F.array(*cells))).filter(
        F.col("known") & F.col("stratum").isNotNull() & F.col("_w").isNotNull())
    x, w, w2 = F.col("x"), F.col("_w"), F.col("_w") * F.col("_w")
    return long.groupBy("variable", "level", "stratum").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("x"), F.sum(x * x).alias("xx"), F.sum(w).alias("w"),
        F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w2).alias("w2"), F.sum(w2 * x).alias("w2x"),
        F.sum(w2 * x * x).alias("w2xx"))


def collect_moments(df: DataFrame, nums, cats, strata=None, weight=None
                    ) -> tuple[dict[str, list[Cell]], dict[str, list[Cell]]]:
    """The moments on the driver, plain and weighted: a checked number of rows."""
    limit = MAX_LEVELS * (len(nums) + len(cats) + 1) * 10
    rows = moments(df, nums, cats, strata, weight).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a categorical variable has too many levels for a table")
    plain: dict[str, list] = {v: [] for v in [*nums, *cats]}
    weighted: dict[str, list] = {v: [] for v in [*nums, *cats]}
    for r in rows:
        plain[r.variable].append(Cell(r.level, r.stratum, r.n, r.n, r.x, r.xx, r.n, r.x, r.xx))
        weighted[r.variable].append(Cell(r.level, r.stratum, r.n, r.w, r.wx, r.wxx, r.w2, r.w2x, r.w2xx))
    return plain, weighted


# --- tests -----------------------------------------------------------------------------------------

def _variance(r, weighted: bool) -> float | None:
    """Sample variance; with weights the weighted mean square times n/(n-1)."""
    if not r.w or r.n < 2:
        return None
    m = r.wx / r.w
    return max(r.wxx / r.w - m * m, 0.0) * r.n / (r.n - 1)


def anova_p(groups) -> float | None:
    """One-way analysis of variance with equal variances."""
    groups = [g for g in groups if g.n > 0]
    n, k = sum(g.n for g in groups), len(groups)
    if k < 2 or n <= k:
        return None
    grand = sum(g.wx for g in groups) / n
    between = sum(g.n * (g.wx / g.n - grand) ** 2 for g in groups)
    within = sum(g.wxx - g.wx ** 2 / g.n for g in groups)
    if within <= 0:
        return None
    return f_tail((between / (k - 1)) / (within / (n - k)), k - 1, n - k)


def svy_means_p(groups) -> float | None:
    """Design-based Wald F test that the weighted means of the groups are equal; groups of weight 0 are left out."""
    groups = [g for g in groups if g.n > 0 and g.w > 0]
    n, k = sum(g.n for g in groups), len(groups)
    if k < 2 or n <= k:
        return None
    mean = [g.wx / g.w for g in groups]
    var = [n / (n - 1) * max(g.w2xx - 2 * m * g.w2x + m * m * g.w2, 0.0) / g.w ** 2 for g, m in zip(groups, mean)]
    diff = np.array(mean[1:]) - mean[0]
    cov = np.diag(var[1:]) + var[0]
    if np.linalg.matrix_rank(cov) < k - 1:
        return None
    return f_tail(float(diff @ np.linalg.solve(cov, diff)) / (k - 1), k - 1, n - k)


def _counts(rows, field: str) -> tuple[list[str], list[str], np.ndarray]:
    levels = sorted({r.level for r in rows})
    groups = sorted({r.stratum for r in rows})
    t = np.zeros((len(levels), len(groups)))
    for r in rows:
        t[levels.index(r.level), groups.index(r.stratum)] = getattr(r, field)
    return levels, groups, t


def chi_square_stat(t: np.ndarray, correct: bool = True) -> tuple[float, int] | None:
    """Pearson chi-square, continuity-corrected for 2 x 2 tables."""
    t = t[t.sum(1) > 0][:, t.sum(0) > 0]
    if min(t.shape) < 2:
        return None
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    cut = min(0.5, float(np.abs(t - e).min())) if correct and t.shape == (2, 2) else 0.0
    return float((((np.abs(t - e)) - cut) ** 2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)


def rao_scott_p(rows) -> float | None:
    """Second-order Rao-Scott F test of a weighted cross-table with independent rows."""
    _, _, w = _counts(rows, "w")
    _, _, w2 = _counts(rows, "w2")
    n = sum(r.n for r in rows)
    keep_r, keep_c = w.sum(1) > 0, w.sum(0) > 0
    w, w2 = w[keep_r][:, keep_c], w2[keep_r][:, keep_c]
    nr, nc = w.shape
    if min(nr, nc) < 2:
        return None
    p = (w / w.sum()).T.ravel()
    s = w2.T.ravel() / w.sum() ** 2
    # covariance of the cell shares from squared weights, against simple random sampling
    cov = (np.diag(s) - np.outer(s, p) - np.outer(p, s) + s.sum() * np.outer(p, p)) * n / (n - 1)
    rows_x = np.array([[1.0, *[float(i == a) for a in range(1, nr)], *[float(j == b) for b in range(1, nc)]]
                       for j in range(nc) for i in range(nr)])
    inter = np.array([[float(i == a) * float(j == b) for b in range(1, nc) for a in range(1, nr)]
                      for j in range(nc) for i in range(nr)])
    c = inter - rows_x @ np.linalg.lstsq(rows_x, inter, rcond=None)[0]
    inv = np.diag(np.where(p > 0, 1 / np.where(p > 0, p, 1), 0.0))
    delta = np.linalg.solve(c.T @ inv @ c / n, c.T @ inv @ cov @ inv @ c)
    stat = chi_square_stat(w / w.sum() * n, correct=False)
    if stat is None:
        return None
    trace = float(np.trace(delta))
    d0 = trace ** 2 / float(np.trace(delta @ delta))
    return f_tail(stat[0] / trace, d0, d0 * (n - 1))


# --- standardised differences ---------------------------------------------------------------------------

def _smd_numeric(groups, weighted: bool) -> float | None:
    vals = []
    for a, b in combinations([g for g in groups if g.w > 0], 2):
        va, vb = _variance(a, weighted), _variance(b, weighted)
        if va is None or vb is None:
            return None
        diff, pooled = abs(a.wx / a.w - b.wx / b.w), math.sqrt((va + vb) / 2)
        vals.append(0.0 if diff == 0 else (diff / pooled if pooled > 0 else math.inf))
    return float(np.mean(vals)) if vals else None


def _smd_levels(rows) -> float | None:
    """Yang-Dalton distance of the level shares without the first level; one share for two levels."""
    t = _counts(rows, "w")[2]
    t = t[:, t.sum(0) > 0]
    shares = t / t.sum(0)
    vals = []
    for a, b in combinations(range(t.shape[1]), 2):
        pa, pb = shares[1:, a], shares[1:, b]
        cov = (np.diag(pa) - np.outer(pa, pa) + np.diag(pb) - np.outer(pb, pb)) / 2
        diff = pa - pb
        if len(diff) == 0 or np.allclose(diff, 0, atol=1e-15):
            vals.append(0.0)
        else:
            vals.append(math.sqrt(max(float(diff @ np.linalg.pinv(cov) @ diff), 0.0)))
    return float(np.mean(vals)) if vals else None


def _p_and_smd(rows, numeric: bool, weighted: bool) -> tuple[float | None, float | None]:
    if numeric:
        groups = sorted((r for r in rows if r.n > 0), key=lambda r: r.stratum)
        return (svy_means_p(groups) if weighted else anova_p(groups)), _smd_numeric(groups, weighted)
    if weighted:
        return rao_scott_p(rows), _smd_levels(rows)
    stat = chi_square_stat(_counts(rows, "n")[2])
    return (chi2_tail(*stat) if stat else None), _smd_levels(rows)


def table_one(df: DataFrame, nums=(), cats=(), strata: str | None = None, weight: str | None = None,
              test: bool = True, smd: bool = True) -> DataFrame:
    """Rows (variable, level, group): size, count and percent, or mean and SD, with p-value and SMD.

    Without weights: analysis of variance and chi-square.  With weights: survey Wald F and
    Rao-Scott F.  More than two groups give the mean of the pairwise SMDs.
    """
    nums, cats = list(nums), list(cats)
    sums = collect_moments(df, nums, cats, strata, weight)[1]
    out = []
    for v, rows in sums.items():
        numeric = v in nums
        p = d = None
        if strata and rows and (test or smd):
            p, d = _p_and_smd(rows, numeric, weight is not None)
        totals: dict[str, float] = {}
        for r in rows:
            totals[r.stratum] = totals.get(r.stratum, 0.0) + r.w
        for r in sorted(rows, key=lambda r: (r.level or "", r.stratum)):
            pv, dv = (p if test else None), (d if smd else None)
            if numeric:
                var = _variance(r, weight is not None)
                out.append((v, None, r.stratum, r.n, r.w, None, r.wx / r.w if r.w else None,
                            math.sqrt(var) if var is not None else None, pv, dv))
            else:
                out.append((v, r.level, r.stratum, r.n, r.w, 100 * r.w / totals[r.stratum] if totals[r.stratum] else None, None, None,
                            pv, dv))
    return rows_frame(df.sparkSession, out, TABLE)


def smd_table(df: DataFrame, nums=(), cats=(), strata: str = "arm", weight: str | None = None) -> DataFrame:
    sums = collect_moments(df, list(nums), list(cats), strata, weight)[1]
    rows = [(v, _p_and_smd(r, v in set(nums), weight is not None)[1]) for v, r in sums.items()]
    return rows_frame(df.sparkSession, rows, "variable string, smd double")


def chi_square(df: DataFrame, a: str, b: str, correct: bool = True) -> DataFrame:
    rows = collect_moments(df, [], [a], b)[0][a]
    stat = chi_square_stat(_counts(rows, "n")[2], correct)
    out = [(stat[0], stat[1], chi2_tail(*stat))] if stat else [(None, None, None)]
    return rows_frame(df.sparkSession, out, "chisq double, df int, p_value double")


def report_rows(table: DataFrame) -> DataFrame:
    """Printed form: one text per variable, level and group."""
    size = F.format_string("%.1f (%.1f)", F.col("count"), F.col("percent"))
    mean = F.format_string("%.2f (%.2f)", F.col("mean"), F.col("sd"))
    p = F.when(F.col("p_value") < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.col("p_value")))
    return table.select(
        "variable", "level", "stratum", F.when(F.col("mean").isNotNull(), mean).otherwise(size).alias("text"),
        F.when(F.col("p_value").isNotNull(), p).alias("p"),
        F.when(F.col("smd").isNotNull(), F.format_string("%.3f", F.col("smd"))).alias("smd"))
