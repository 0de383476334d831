"""Cleaning steps on extracts: mandatory values, duplicates, projections, casts, audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.exprs import any_of, case_when, to_day, try_double, try_int
from wardline.sources.extracts import ORDER


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose mandatory columns are neither NULL nor blank text."""
    for c in cols:
        keep = F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, T.StringType):
            keep = keep & (F.col(c) != "")
        df = df.filter(keep)
    return df


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, combined before the shuffle; an ingest order keeps its first position."""
    if ORDER not in df.columns:
        return df.distinct()
    others = [c for c in df.columns if c != ORDER]
    return df.groupBy(*others).agg(F.min(ORDER).alias(ORDER))


def select_range(df: DataFrame, first: str, last: str, *extra: str) -> DataFrame:
    """Columns from ``first`` to ``last`` in table order, after the extra ones."""
    cols = df.columns
    return df.select(*extra, *cols[cols.index(first):cols.index(last) + 1])


def between_dates(df: DataFrame, col: str, lo: str | date | None, hi: str | date | None = None) -> DataFrame:
    """Closed date window; a bare comparison with a literal, so that it reaches the scan."""
    if lo is not None:
        df = df.filter(F.col(col) >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.filter(F.col(col) <= F.lit(hi).cast("date"))
    return df


def fill_zero(df: DataFrame, cols) -> DataFrame:
    return df.fillna({c: 0 for c in cols})


def as_levels(df: DataFrame, cols) -> DataFrame:
    """Categorical columns are plain text; their level order is given where a model needs it."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


_CASTS = {"int": try_int, "double": try_double, "date": to_day}


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns from text; bad text becomes NULL instead of an error."""
    return df.withColumns({c: _CASTS[t](c) if t in _CASTS else F.col(c).try_cast(t) for c, t in types.items()})


def derive(df: DataFrame, name: str, branches, default=None) -> DataFrame:
    return df.withColumn(name, case_when(branches, default))


def null_audit(df: DataFrame, cols=None) -> DataFrame:
    """One row per column: rows with NULL in it, and rows with NULL in any of the columns."""
    cols = list(cols or df.columns)
    any_null = any_of([F.col(c).isNull() for c in cols])
    counts = df.agg(F.count_if(any_null).alias("rows_any_null"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot(["rows_any_null"], cols, "column", "rows_null").select(
        "column", "rows_null", "rows_any_null")


def rows_with_null(df: DataFrame, cols=None) -> DataFrame:
    return df.filter(any_of([F.col(c).isNull() for c in (cols or df.columns)]))


def level_audit(df: DataFrame, cols=None) -> DataFrame:
    """Distinct values of every column with their row counts, in one pass over the table."""
    cols = list(cols or df.columns)
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def covariates_except(df: DataFrame, removed) -> list[str]:
    """Names of a covariate frame without the excluded ones."""
    removed = set(removed)
    return [c for c in df.columns if c not in removed]


def strip_zeros(col: str | Column) -> Column:
    """Patient key as the numeric detour leaves it: without leading zeros."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"^0+(?=.)", "")
