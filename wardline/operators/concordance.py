"""Concordance of a score with survival, counted over all comparable pairs without forming them.

People are summed by (stratum, time, event, score) and laid on a grid: parts of the times, buckets of the score.  A pair
lies in different parts and buckets, in one bucket, in one part, or in one cell of the grid; each kind is counted on
its own sums by sorted search, so a busy time or score is one row per part or bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.running import PART, ranged

BLOCK = 1024
DIGITS = 9
SUMS = "concordant double, discordant double, tied double"


def pair_weights(order: np.ndarray, score: np.ndarray, event: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Weights of (earlier event, later person) pairs with a lower, a higher and the same score of the later one.

    ``order`` is the place in time; equal places are not compared.
    """
    total = np.zeros(3)
    if not len(order):
        return total
    by = np.argsort(-order, kind="stable")
    order, score, event, all_ = order[by], score[by], event[by], all_[by]
    cuts = [0, *(np.flatnonzero(order[1:] != order[:-1]) + 1), len(order)]
    seen, weight = np.empty(0), np.empty(0)  # scores of later people, sorted
    start = 0
    for i in range(1, len(cuts)):
        if i + 1 < len(cuts) and cuts[i + 1] - cuts[start] <= BLOCK:
            continue
        a, b = cuts[start], cuts[i]
        hit = np.flatnonzero(event[a:b] > 0) + a
        if len(hit):
            sums = np.concatenate([[0.0], np.cumsum(weight)])
            low, up = np.searchsorted(seen, score[hit], "left"), np.searchsorted(seen, score[hit], "right")
            total += [event[hit] @ sums[low], event[hit] @ (sums[-1] - sums[up]), event[hit] @ (sums[up] - sums[low])]
            if i - start > 1:
                pairs = np.where(order[None, a:b] > order[hit, None], event[hit, None] * all_[None, a:b], 0.0)
                side = np.sign(score[None, a:b] - score[hit, None])
                total += [pairs[side < 0].sum(), pairs[side > 0].sum(), pairs[side == 0].sum()]
        if b < len(order):
            kinds, where = np.unique(np.concatenate([seen, score[a:b]]), return_inverse=True)
            weight = np.bincount(where, np.concatenate([weight, all_[a:b]]))
            seen = kinds
        start = i
    return total


def concordance(people: DataFrame, stratum: str, time: str, event: str, score: str, weight: str) -> tuple[float, float, float]:
    """Weights of concordant, discordant and tied pairs: an event against everyone who is left after it, and against
    those censored at its time, within a stratum.  Concordant is the higher score failing first; scores that agree
    to nine digits are tied.
    """
    cells = people.groupBy(F.col(stratum).alias("_s"), F.col(time).cast("double").alias("_tt"),
                           F.when(F.col(event) == 1, 0).otherwise(1).alias("_f"),
                           F.round(score, DIGITS).alias("_y")).agg(F.sum(weight).alias("_w"))
    cells = ranged(cells, ["_s"], "_tt").withColumn("_e", F.when(F.col("_f") == 0, F.col("_w")).otherwise(0.0))
    buckets = max(2, int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = cells.agg(F.percentile_approx("_y", [i / buckets for i in range(1, buckets)], 10_000).alias("at")).first()["at"]
    bounds = sorted(set(at or []))
    over = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col("_y"))) if bounds else F.lit(0)
    cells = cells.withColumn("_b", over)
    sums = [F.sum("_e").alias("_e"), F.sum("_w").alias("_w")]
    part = F.col(PART).cast("double")

    def counted(rows: DataFrame, keys: list[str], equal_counts: bool) -> DataFrame:
        def run(g: pd.DataFrame) -> pd.DataFrame:
            place = g["_o"].rank(method="dense").to_numpy()
            low, high, same = pair_weights(2 * place + g["_f"].to_numpy(), g["_v"].to_numpy(), g["_e"].to_numpy(), g["_w"].to_numpy())
            return pd.DataFrame({"concordant": [low], "discordant": [high], "tied": [same if equal_counts else 0.0]})
        return rows.groupBy(*keys).applyInPandas(run, SUMS)

    grid = cells.groupBy("_s", part.alias("_o"), F.col("_b").cast("double").alias("_v")).agg(*sums).withColumn("_f", F.lit(0))
    strips = cells.groupBy("_s", "_b", part.alias("_o"), F.col("_y").alias("_v")).agg(*sums).withColumn("_f", F.lit(0))
    parts = cells.groupBy("_s", PART, F.col("_tt").alias("_o"), "_f", F.col("_b").cast("double").alias("_v")).agg(*sums)
    inner = cells.select("_s", PART, "_b", F.col("_tt").alias("_o"), "_f", F.col("_y").alias("_v"), "_e", "_w")
    found = (counted(grid, ["_s"], False).unionByName(counted(strips, ["_s", "_b"], True))
             .unionByName(counted(parts, ["_s", PART], False)).unionByName(counted(inner, ["_s", PART, "_b"], True)))
    row = found.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("concordant", "discordant", "tied")]).first()
    return row["concordant"], row["discordant"], row["tied"]
