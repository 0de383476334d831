"""Connected components by alternating large-star and small-star, on Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage


def attach(rows: DataFrame, per_key: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row for each key.

    The keys of ``per_key`` (long or string) are computed anew, so that an aggregate's own partitioning is not reused and both
    sides are plain exchanges: only then may Spark split a hot key of ``rows`` (or broadcast the other side by size).
    """
    names = [f"{k}__" for k in keys]
    kinds = dict(per_key.dtypes)
    side = per_key.select(*[(F.concat(k, F.lit("")) if kinds[k] == "string" else F.bitwise_not(F.bitwise_not(k))).alias(n)
                            for k, n in zip(keys, names)],
                          *[c for c in per_key.columns if c not in keys])
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    return rows.join(side, on, how).drop(*names)


def _mark(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code)).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``, long or string); the component is its smallest node.

    Links with a null end and loops are left out, repeated ones count once; without links the result is empty.
    Each half step is one combined minimum per node and one join, so a node with a third of all links is split.
    It ends when a step changes nothing, which takes a number of steps that grows with the logarithm of the links.
    """
    def settle(df: DataFrame) -> DataFrame:
        return cut_lineage(df.filter("u <> v").distinct())

    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter(F.col("u").isNotNull() & F.col("v").isNotNull()))
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = attach(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
