"""Model checks: VIF, leverage, residuals, influence, outliers, correlations."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.design import dot, invert
from wardline.operators.grouping import top_n, with_index
from wardline.operators.models import Fit, logit, logit_pass, rows_frame


def vif(fit: Fit) -> DataFrame:
    """Generalised variance inflation per term, from the correlation of the coefficients."""
    skip = 1 if fit.design.intercept else 0
    cov = fit.cov[skip:, skip:]
    s = np.sqrt(np.diag(cov))
    r = cov / np.outer(s, s)
    rows = []
    for name, idx in fit.design.groups.items():
        own = [i - skip for i in idx]
        rest = [i for i in range(len(r)) if i not in own]
        value = 1.0 if not rest else float(
            np.linalg.det(r[np.ix_(own, own)]) * np.linalg.det(r[np.ix_(rest, rest)]) / np.linalg.det(r))
        rows.append((name, value, len(own), value ** (1 / (2 * len(own)))))
    return rows_frame(fit.spark, rows, "term string, gvif double, df int, gvif_root double")


def augment(fit: Fit, df: DataFrame | None = None) -> DataFrame:
    """People of a logistic fit with fitted value, deviance and standardised residual, leverage, Cook's distance.

    Leverage is a quadratic form in the person's own terms with a p x p matrix; all of it is column
    arithmetic, without a join back to the people.  It is written in the linear predictor, so that a fitted value that rounds
    to 0 or 1 has leverage 0 and finite residuals; with leverage 1 the standardised residual and Cook's distance are NULL.
    """
    df = fit.data if df is None else df
    y, weight = fit.extra["y"], fit.extra.get("weight")
    inverse = invert(_information(fit)) if fit.kind == "svy_logit" else fit.cov

    def along(row: Column) -> Column:
        return F.aggregate(F.zip_with(row, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    across = F.transform(F.lit(inverse.tolist()), along)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = df.withColumn("_x", fit.design.array()).withColumn("_eta", dot("_x", fit.beta))
    eta, obs = F.col("_eta"), F.col(y).cast("double")
    small = F.exp(-F.abs(eta))
    out = out.withColumn("fitted", F.when(eta >= 0, 1.0).otherwise(small) / (1 + small)).withColumn("_q", along(across))
    out = out.withColumn("hat", w * small / (1 + small) ** 2 * F.col("_q"))
    away = F.when(obs == 1, -eta).otherwise(eta)  # log-odds against what was observed
    side = F.when(obs == 1, 1.0).otherwise(-1.0)
    loss = F.greatest(away, F.lit(0.0)) + F.log1p(small)
    out = out.withColumn("resid", side * F.sqrt(2 * w * loss))
    pearson = side * F.sqrt(w * F.exp(away))
    h, p = F.col("hat"), float(fit.design.width)
    return out.withColumn("std_resid", F.try_divide(F.col("resid"), F.sqrt(F.greatest(1 - h, F.lit(0.0))))).withColumn(
        "cooksd", F.try_divide(pearson, 1 - h) ** 2 * h / F.lit(p)).drop("_x", "_eta", "_q")


def _information(fit: Fit) -> np.ndarray:
    return logit_pass(fit.patterns, fit.beta, fit.design.few).info


def influence_index(aug: DataFrame, key: str = "ref") -> DataFrame:
    """Row number in key order beside the influence measures."""
    return with_index(aug, key).select("index", key, "fitted", "std_resid", "hat", "cooksd")


def largest_cooks(aug: DataFrame, k: int = 3) -> DataFrame:
    return top_n(aug, k, "cooksd")


def outliers(aug: DataFrame, resid: float = 3.0, cooks: float | None = None) -> DataFrame:
    out = aug.filter(F.abs("std_resid") > resid)
    return out if cooks is None else out.filter(F.col("cooksd") > cooks)


def without_outliers(aug: DataFrame, resid: float = 3.0, cooks: float = 1.0) -> DataFrame:
    return aug.filter((F.abs("std_resid") <= resid) & (F.col("cooksd") <= cooks))


def refit(fit: Fit, aug: DataFrame, terms, resid: float = 3.0, cooks: float = 1.0) -> Fit:
    """The same logistic model on the people that are no outliers."""
    return logit(without_outliers(aug, resid, cooks), fit.extra["y"], terms, fit.extra.get("weight"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlations of the (numeric) columns, one row per pair."""
    cols = list(cols)
    rows = df.select([F.col(c).cast("double").alias(c) for c in cols]).dropna()
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(rows).select("v")
    m = Correlation.corr(vectors, "v").first()[0].toArray()
    return rows_frame(df.sparkSession,
                       [(a, b, float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)],
                       "a string, b string, r double")
