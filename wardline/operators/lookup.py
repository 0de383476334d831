"""Lookups between tables.  None of them multiplies rows, except the plain left join.

Right sides are first reduced to one row per key with map-side combining.  No broadcast is
forced: Catalyst and AQE take it when the measured side is below their threshold, and
otherwise sort-merge with AQE's skew split.  For a key known to be hot, ``hot`` spreads its
rows over ``SALTS`` tasks and repeats only that key's single lookup row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def hot_keys(df: DataFrame, on: str, share: float = 0.01) -> list:
    """Keys that hold more than ``share`` of the rows: at most 1/share values."""
    counts = df.groupBy(on).count()
    total = counts.agg(F.sum("count").alias("rows"))
    over = counts.join(F.broadcast(total), F.col("count") > share * F.col("rows"))
    return [r[0] for r in over.select(on).collect()]


def first_rows(right: DataFrame, on, cols, order_by) -> DataFrame:
    """Per key the columns of the first row in the order; a NULL in that row stays NULL."""
    keys, order = _keys(on), _keys(order_by)
    picked = right.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols])


def _salted(left: DataFrame, one_per_key: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    """Join with the hot keys' left rows spread by a hash of the row itself (stable under retries)."""
    is_hot = F.col(key).isin(hot)
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    left = left.withColumn("_salt", F.when(is_hot, spread).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one_per_key.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup_first(left: DataFrame, right: DataFrame, on, cols, order_by, hot: list | None = None) -> DataFrame:
    """Values of the first right row with the same key, else NULL."""
    keys = _keys(on)
    firsts = first_rows(right, keys, list(cols), order_by)
    if hot:
        return _salted(left, firsts, keys[0], "left", hot)
    return left.join(firsts, keys, "left")


def in_cohort(df: DataFrame, cohort: DataFrame, on: str = "ref", hot: list | None = None) -> DataFrame:
    """Rows whose key is in the cohort."""
    if hot:
        return _salted(df, cohort.select(on).distinct(), on, "left_semi", hot)
    return df.join(cohort.select(on), on, "left_semi")


def of_cohort(df: DataFrame, cohort: DataFrame, on: str = "ref", index: str = "start_episode") -> DataFrame:
    """Rows of cohort members, ahead of any aggregate over the rows.

    A semi join: Spark broadcasts a small cohort, and puts a Bloom filter of a larger one into the scan of a big table by itself
    (``spark.sql.optimizer.runtime.bloomFilter``), for which the comparison on the index day marks the cohort as selective.
    """
    dated = cohort.filter(F.col(index) >= F.lit("1900-01-01").cast("date")) if index in cohort.columns else cohort
    return df.join(dated.select(on), on, "left_semi")


def exclude(df: DataFrame, *sets: DataFrame, on: str = "ref", hot: list | None = None) -> DataFrame:
    """Rows whose key is in none of the sets."""
    for other in sets:
        if hot:
            df = _salted(df, other.select(on).distinct(), on, "left_anti", hot)
        else:
            df = df.join(other.select(on), on, "left_anti")
    return df


def events_after_index(cohort: DataFrame, events: DataFrame, date: str, lo: int = 0, hi: int | None = None,
                       index: str = "start_episode", on: str = "ref", offset: str = "offset") -> DataFrame:
    """Events of cohort members with their day offset from the index day, inside [lo, hi]."""
    joined = events.join(cohort.select(on, index), on)
    joined = joined.withColumn(offset, F.datediff(date, index)).filter(F.col(offset) >= lo)
    return joined if hi is None else joined.filter(F.col(offset) <= hi)


def with_weight(df: DataFrame, weights: DataFrame, on: str = "ref") -> DataFrame:
    """Per-person model output (weight, residual) back on the people, by key and never by position."""
    return df.join(weights, on, "left")


def life_years(df: DataFrame, lifetable: DataFrame, age: str = "age", sex: str = "sex") -> DataFrame:
    """Remaining life by age and sex; an unknown sex counts both columns, as no entry is zeroed."""
    table = first_rows(lifetable, "age", ["female", "male"], ["female", "male"]).withColumnRenamed("age", age)
    out = df.join(table, age, "left")
    female = F.when(F.col(sex) == "M", F.lit(0.0)).otherwise(F.col("female").cast("double"))
    male = F.when(F.col(sex) == "F", F.lit(0.0)).otherwise(F.col("male").cast("double"))
    return out.withColumn("life", female + male).drop("female", "male")
