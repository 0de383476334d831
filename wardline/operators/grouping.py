"""Counts, firsts, gaps, indexes, top lists, unions and expansions.

Per-patient windows only ever run over rows that were first brought to day grain with
map-side combining, so that a patient with a third of all rows still yields at most one
row per calendar day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.running import ranged, running
from wardline.session import cut_lineage


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


# --- counts -----------------------------------------------------------------------------

def count_by(df: DataFrame, keys, name: str = "n") -> DataFrame:
    return df.groupBy(*_list(keys)).agg(F.count(F.lit(1)).alias(name))


def count_visits(df: DataFrame, key: str = "ref", date: str = "appointment_date", name: str = "visits") -> DataFrame:
    """Distinct visit days per patient: per day first, then per patient."""
    return df.filter(F.col(date).isNotNull()).groupBy(key).agg(F.countDistinct(date).alias(name))


def flag_members(df: DataFrame, other: DataFrame, name: str, on: str = "ref") -> DataFrame:
    """``df`` with a boolean telling whether the key is in ``other``."""
    member = other.select(F.col(on).alias("_member")).filter(F.col("_member").isNotNull()).distinct()
    return df.join(member, F.col(on) == F.col("_member"), "left").withColumn(name, F.col("_member").isNotNull()).drop("_member")


def steps_reached(df: DataFrame, steps: dict[str, Column], key: str = "ref") -> DataFrame:
    """Per patient, one bit for each step that a row of theirs meets; the bits are OR-ed before the shuffle."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(met, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, met in enumerate(steps.values())])
    return df.select(F.col(key).alias("key"), bits.alias("_bits")).filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.bit_or("_bits").alias("_bits"))


def attrition(df: DataFrame, steps: dict[str, Column], key: str = "ref") -> DataFrame:
    """Patients left after each step, in step order, from one pass over the rows (63 steps at most).

    A step is a condition on a row; it implies the ones before it (``flag_members`` gives conditions on other sets).
    """
    return count_steps(steps_reached(df, steps, key), list(steps))


def count_steps(reached: DataFrame, names: list[str]) -> DataFrame:
    """Patients per bit of ``steps_reached``, one row for each step."""
    counts = reached.agg(*[F.count_if(F.getbit("_bits", F.lit(i)) == 1).alias(f"_{i}") for i in range(len(names))])
    rows = [F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"_{i}").alias("patients"))
            for i, name in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


def freq(df: DataFrame, a: str, b: str | None = None) -> DataFrame:
    return count_by(df, [a] if b is None else [a, b])


def describe_num(df: DataFrame, col: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count of a whole-day (or other discrete) measure.

    Rows are first counted per value; the exact quartiles are selected by rank (``percentiles``).
    """
    per_value = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known, q = F.col("_v").isNotNull(), percentiles(df, col, [0.25, 0.5, 0.75])
    sums = per_value.agg(
        F.min("_v").cast("double").alias("min"),
        F.try_divide(F.sum(F.col("_v").cast("double") * F.col("_n")), F.sum(F.when(known, F.col("_n")))).alias("mean"),
        F.max("_v").cast("double").alias("max"),
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("nulls"))
    quartiles = [F.lit(v).cast("double").alias(n) for n, v in zip(("q1", "median", "q3"), q)]
    return sums.select("min", *quartiles[:2], "mean", quartiles[2], "max", "nulls")


def percentiles(df: DataFrame, col: str, at: list[float]) -> list[float | None]:
    """Exact percentiles (linear between neighbours) of the known values, without one task for the values.

    Values are counted, dealt by ranges and given running counts in two levels; the values at the ranks wanted are minima over
    the tail that reaches them, so only a pair of numbers per percentile leaves the tasks.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    upto = cut_lineage(running(ranged(counts, [], "_v"), [], "_v", {"_upto": "_n"}))
    n = upto.agg(F.max("_upto")).first()[0]
    if not n:
        return [None] * len(at)
    ranks = sorted({r for q in at for r in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))})
    row = upto.agg(*[F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(f"r{r}") for r in ranks]).first()
    out = []
    for q in at:
        low = int(q * (n - 1))
        a, b = row[f"r{low}"], row[f"r{min(low + 1, n - 1)}"]
        out.append(a + (q * (n - 1) - low) * (b - a))
    return out


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def hist_bins(df: DataFrame, col: str, breaks: list[float]) -> DataFrame:
    """Counts in right-closed bins (the first one closed on both sides); outside values are an error."""
    edges = list(breaks)
    c = F.col(col)
    branches = F.when((c >= edges[0]) & (c <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        branches = branches.when((c > edges[i]) & (c <= edges[i + 1]), i)
    bad = F.raise_error(F.lit(f"{col} outside the breaks"))
    binned = df.filter(c.isNotNull()).select(branches.otherwise(bad.cast("int")).alias("bin"))
    low = F.element_at(F.lit(edges), F.col("bin") + 1)
    high = F.element_at(F.lit(edges), F.col("bin") + 2)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", low.alias("low"), high.alias("high"), "n")


# --- firsts, repeats, gaps ----------------------------------------------------------------

def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row per key.  Spark limits every map task to one row per key before the shuffle."""
    w = Window.partitionBy(*_list(keys)).orderBy(*_list(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def repeat_rows(df: DataFrame, keys, order) -> DataFrame:
    """All but the first row per key.  ``order`` must tell any two rows of a key apart.

    The first order value is one combined aggregate per key; the rows meet it in a join,
    which AQE can split for a hot key (a window could not).
    """
    keys, order = _list(keys), _list(order)
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(firsts, keys).filter(F.struct(*order) > F.col("_first")).drop("_first").select(*df.columns)


def gap_to_next(df: DataFrame, key: str, date: str) -> DataFrame:
    """Visit days per patient with rows on the day and days to the next visit day (NULL at the last)."""
    days = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(key).orderBy(date)
    return days.withColumn("gap", F.datediff(F.lead(date).over(w), date))


def with_index(df: DataFrame, order: str = "ref", name: str = "index") -> DataFrame:
    """Row number over the whole table in key order, without moving it into one task.

    The range-sorted rows are checkpointed, which fixes partitions and positions; the start
    of each partition is a running sum over one row per partition, small enough to broadcast.
    """
    fixed = cut_lineage(df.orderBy(order)).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return fixed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_pos") + 1).drop(
        "_part", "_pos", "_start")


def top_n(df: DataFrame, k: int, col: str) -> DataFrame:
    """The k largest, ties at the last place kept, in one pass.

    Every task keeps its own k largest with ties before anything is moved (a rank limit); the rest, k rows and ties of each
    task, is ranked once more.
    """
    place = F.rank().over(Window.orderBy(F.desc(col)))
    return df.filter(F.col(col).isNotNull()).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


# --- unions and expansions ------------------------------------------------------------------

def tagged_union(frames: dict[str, DataFrame], tag: str = "source", fill_missing: bool = False) -> DataFrame:
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), parts)


def expand_rows(df: DataFrame, n: str, index: str = "copy") -> DataFrame:
    """Each row n times, numbered from 1; rows with n below 1 (or NULL) vanish."""
    return df.filter(F.col(n) >= 1).withColumn(index, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def expand_days(df: DataFrame, start: str, length: str, day: str = "day") -> DataFrame:
    """One row per day of an interval given by its first day and its length."""
    out = expand_rows(df, length, "_nth")
    moved = F.date_add(start, F.col("_nth") - 1) if dict(df.dtypes)[start] == "date" else F.col(start) + F.col("_nth") - 1
    return out.withColumn(day, moved).drop("_nth")
