"""Model terms, covariate patterns and cross-product sums.

A model never iterates over people.  Rows are first summed per covariate pattern (one
combining aggregate); the fits then work on that table, which is checkpointed.  Matrices
leave Spark only as sums of size p x p.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import cut_lineage

MAX_LEVELS = 1000
CELL = "pos int, value double"
FEW_TASKS = 32


@dataclass(frozen=True)
class Factor:
    """Categorical term.  The first level is the reference; levels left out are found and sorted."""

    name: str
    levels: tuple = ()


@dataclass(frozen=True)
class Interaction:
    """Product of two terms (main effects are given separately)."""

    left: object
    right: object


@dataclass
class Design:
    """Names, 0/1 or numeric expressions and source columns of a model matrix."""

    names: list[str]
    exprs: list[Column]
    sources: list[str]
    groups: dict[str, list[int]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    intercept: bool = True
    few: bool = False

    @property
    def width(self) -> int:
        return len(self.names)

    def array(self) -> Column:
        return F.array(*[e.cast("double") for e in self.exprs])


def _term_name(term) -> str:
    if isinstance(term, Factor):
        return term.name
    if isinstance(term, Interaction):
        return f"{_term_name(term.left)}:{_term_name(term.right)}"
    return term


def _sources(term) -> list[str]:
    if isinstance(term, Interaction):
        return _sources(term.left) + _sources(term.right)
    return [term.name if isinstance(term, Factor) else term]


def term_sources(terms) -> list[str]:
    return [s for t in terms for s in _sources(t)]


def _columns(term, levels) -> list[tuple[str, Column]]:
    if isinstance(term, Interaction):
        return [(f"{ln}:{rn}", lc * rc) for ln, lc in _columns(term.left, levels)
                for rn, rc in _columns(term.right, levels)]
    if isinstance(term, Factor):
        return [(f"{term.name}{lv}", (F.col(term.name).cast("string") == lv).cast("double"))
                for lv in levels[term.name][1:]]
    return [(term, F.col(term).cast("double"))]


def _factors(terms):
    for t in terms:
        if isinstance(t, Factor):
            yield t
        elif isinstance(t, Interaction):
            yield from _factors([t.left, t.right])


def _levels_present(df: DataFrame, names: list[str]) -> dict[str, set]:
    """Levels of the factors, with a bound on what reaches the driver."""
    out: dict[str, set] = {n: set() for n in names}
    if not names:
        return out
    cells = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("string").alias("level")) for n in names])
    rows = df.select(F.inline(cells)).filter(F.col("level").isNotNull()).distinct().limit(
        MAX_LEVELS * len(names) + 1).collect()
    for r in rows:
        out[r.n].add(r.level)
    for n, found in out.items():
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{n} has more than {MAX_LEVELS} levels")
    return out


def design(df: DataFrame, terms, intercept: bool = True) -> Design:
    """Encode terms.  Levels without rows and constant columns are dropped and reported.

    ``df`` is best the table of covariate patterns: it has the same levels as the people.
    """
    terms = [t if isinstance(t, (Factor, Interaction)) else str(t) for t in terms]
    factors = list({f.name: f for f in _factors(terms)}.values())
    plain = [t for t in terms if isinstance(t, str)]
    present = _levels_present(df, [f.name for f in factors])
    levels = {f.name: [x for x in ([str(x) for x in f.levels] or sorted(present[f.name])) if x in present[f.name]]
              for f in factors}
    varies = df.agg(*[(F.min(t) < F.max(t)).alias(f"v{i}") for i, t in enumerate(plain)]).first() if plain else ()
    constant = {t for i, t in enumerate(plain) if not varies[i]}
    names, exprs, groups, sources, dropped = [], [], {}, term_sources(terms), []
    for t in terms:
        cols = [] if t in constant else _columns(t, levels)
        if isinstance(t, Interaction) and cols:
            spread = df.agg(*[(F.min(e) < F.max(e)).alias(f"c{i}") for i, (_, e) in enumerate(cols)]).first()
            dropped += [name for i, (name, _) in enumerate(cols) if not spread[i]]
            cols = [c for i, c in enumerate(cols) if spread[i]]
        elif not cols:
            dropped.append(_term_name(t))
        for name, expr in cols:
            groups.setdefault(_term_name(t), []).append(len(names) + (1 if intercept else 0))
            names.append(name)
            exprs.append(expr)
    if intercept:
        names, exprs = ["(Intercept)", *names], [F.lit(1.0), *exprs]
    return Design(names, exprs, list(dict.fromkeys(sources)), groups, dropped, intercept)


def complete(df: DataFrame, cols) -> DataFrame:
    """Rows without NULL in the model columns; a fit leaves the others out."""
    return df.dropna(subset=list(cols))


def patterns(df: DataFrame, terms, y: str, weight: str | None = None, offset: str | None = None,
             keys=(), intercept: bool = True) -> tuple[Design, DataFrame]:
    """One row per distinct (covariates, response, offset) with weight sums, and its encoding.

    This is the only pass over the people: levels, encoding and all fit steps use the
    checkpointed patterns.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    group = list(dict.fromkeys([*keys, *term_sources(terms)]))
    cols = [*[F.col(c) for c in group], F.col(y).cast("double").alias("_y"),
            (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_offset")]
    table = cut_lineage(df.select(*cols, w.alias("_w")).groupBy(*group, "_y", "_offset").agg(
        F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"),
        F.count(F.lit(1)).alias("_n")))
    d = design(table, terms, intercept)
    d.few = few_tasks(table)
    return d, table.select(*keys, d.array().alias("_x"), "_y", "_offset", "_w", "_w2", "_n")


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str = "_x") -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(name))
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def few_tasks(checkpointed: DataFrame) -> bool:
    return checkpointed.rdd.getNumPartitions() <= FEW_TASKS


def sum_blocks(df: DataFrame, size: int, block, few: bool = False) -> np.ndarray:
    """Sum of a vector-valued function of Arrow batches over the whole table.

    Every task adds up its own batches and emits its sum once; Spark adds the cells by
    position.  ``size`` depends on the number of model terms, never on the rows.  With ``few``
    tasks (a checked number) their sums come to the driver directly, which saves a stage.
    """

    def task_sum(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += block(batch)
        return total

    if few:
        def one_row(batches):
            yield pa.RecordBatch.from_arrays([pa.array([task_sum(batches)])], names=["sums"])

        return np.sum([r.sums for r in df.mapInArrow(one_row, "sums array<double>").collect()], axis=0)

    def per_cell(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(task_sum(batches))],
                                         names=["pos", "value"])

    out = np.zeros(size)
    for r in df.mapInArrow(per_cell, CELL).groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r.pos] = r.value
    return out


def solve(info: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Newton direction; aliased columns share it (least norm) instead of stopping the fit."""
    try:
        return np.linalg.solve(info, score)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(info) @ score


def invert(info: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(info)


def dot(x: str, beta) -> Column:
    """Linear predictor from the array column."""
    total = F.lit(0.0)
    for i, b in enumerate(beta):
        total = total + F.lit(float(b)) * F.col(x)[i]
    return total
