"""Causes of death of a cohort as one plan: cohort and death register to flags, composites and tables by arm."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.functions.rules import death_causes, death_composites
from wardline.operators.tables import table_one

# The rows of the table, in its order.
SHOWN = ("covid", "cancer", "heart", "stroke", "nervous_sys", "genitourinary", "diabetes", "others", "all")


def cohort_death_causes(people: DataFrame, deaths: DataFrame, keep=("antiviral",), code: str = "main_cause",
                        anchored: bool = False) -> DataFrame:
    """One row per member and death record: ``ref``, the ``keep`` columns of ``people``, the code, its 16 flags and composites.

    Members without a record have unknown causes and are left out, as are records of others; a record without a code has
    no named cause and counts under ``others``.  The register is cut to the cohort by the join before a flag is worked out,
    and only ``keep`` is taken along, since flags share names with comorbidities (``dementia``).
    """
    members = people.select("ref", *keep)
    return death_composites(death_causes(members.join(deaths.select("ref", code), "ref"), code, anchored))


def death_cause_table(causes: DataFrame, strata: str | None = "antiviral", shown=SHOWN) -> DataFrame:
    """Counts and percentages of the causes, over all and by arm, with chi-square p-values and SMD between arms."""
    whole = table_one(causes, cats=shown)
    return whole if strata is None else whole.unionByName(table_one(causes, cats=shown, strata=strata))
