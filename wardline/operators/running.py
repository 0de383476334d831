"""Running sums and products in two levels, without one task for a whole table.

Rows are dealt by ranges of (keys, order) and keep their part; a window runs inside each part, and what came before the
part is a window over one row per part and key (at most parts + keys rows), joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut_lineage

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` dealt by ranges of keys and order, with the number of its part; written once, so that parts stay as they are."""
    return cut_lineage(df.repartitionByRange(*keys, order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column | str], descending: bool = False,
            products: dict[str, Column | str] | None = None) -> DataFrame:
    """``df`` (from ``ranged``) with running sums and products per key along ``order``, own row (and equal ones) included.

    With ``descending`` they run from the last row back.  Sums are of doubles or integers and never NULL.
    """
    products = products or {}
    ways = {name: (F.sum, c) for name, c in sums.items()} | {name: (F.product, c) for name, c in products.items()}
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(PART, *keys).orderBy(turn(order)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    column = {name: F.col(c) if isinstance(c, str) else c for name, (_, c) in ways.items()}
    totals = df.groupBy(PART, *keys).agg(*[f(column[name]).alias(f"_of_{name}") for name, (f, _) in ways.items()])
    past = Window.partitionBy(*keys) if keys else Window
    past = past.orderBy(turn(PART)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           *[f(f"_of_{name}").over(past).alias(f"_to_{name}") for name, (f, _) in ways.items()])
    same = (F.col(PART) == F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = df.withColumns({f"_in_{name}": f(column[name]).over(inside) for name, (f, _) in ways.items()})
    joined = local.join(before, same)
    done = {name: F.col(f"_in_{name}") + F.coalesce(F.col(f"_to_{name}"), F.lit(0)) for name in sums}
    done |= {name: F.col(f"_in_{name}") * F.coalesce(F.col(f"_to_{name}"), F.lit(1.0)) for name in products}
    return joined.select(*[F.col(c) for c in df.columns if c not in ways], *[c.alias(n) for n, c in done.items()])
