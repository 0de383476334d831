"""Column expressions: conditions, recodes and rule tables.  All run inside codegen."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def contains_any(col: str | Column, terms) -> Column:
    """True when one of the substrings occurs; NULL text stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return any_of([c.contains(t) for t in terms])


def case_when(branches, default=None) -> Column:
    """First true branch wins; an unknown condition counts as false."""
    out = F
    for cond, value in branches:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that keeps unknown as NULL (unlike ``when().otherwise()``)."""
    return F.when(cond, yes).when(~cond, no)


def recode(col: str | Column, labels: dict) -> Column:
    """Codes to labels through a literal map; a code without a label becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable((str(k), lab) for k, lab in labels.items())])
    return F.try_element_at(table, c.cast("string"))


def known(col: str | Column) -> Column:
    """1 where a value is present, NULL where it is not."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.lit(1))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(later, earlier)


def band(col: str | Column, bands, default=None) -> Column:
    """Inclusive (label, low, high) bands; an open end is None."""
    c = F.col(col) if isinstance(col, str) else col
    branches = []
    for label, low, high in bands:
        if low is None:
            cond = c <= high
        elif high is None:
            cond = c >= low
        else:
            cond = c.between(low, high)
        branches.append((cond, label))
    return case_when(branches, default)


def try_int(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("int")


def try_double(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def to_day(col: str | Column) -> Column:
    """Text (date or date-time, ISO) to day; bad text to NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, 10).try_cast("date")
