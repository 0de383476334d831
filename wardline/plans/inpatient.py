"""The inpatient cohort as one plan: stays, tests, drugs and diagnoses to one row per patient."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.rules import eligible
from wardline.operators.clean import between_dates, dedupe_rows
from wardline.operators.comorbidity import charlson
from wardline.operators.episodes import (drug_courses, effective_end, first_death, first_episode, follow_up,
                                         index_date, length_of_stay, positive_tests, readmission_chain,
                                         readmission_count, readmission_los, stay_offsets, with_courses, within_flags)
from wardline.operators.grouping import count_steps, flag_members, steps_reached, tagged_union
from wardline.operators.lookup import exclude, of_cohort
from wardline.session import cut_lineage


@dataclass(frozen=True)
class Window:
    """Dates of the study."""

    floor: str = study.INDEX_FLOOR
    stay_end: str = study.STAY_END
    end: str = study.INPATIENT_END


STEPS = ["stays", "in the window", "without plasma or interferon", "without clinic patients", "with an index date", "eligible"]


@dataclass
class InpatientCohort:
    people: DataFrame
    readmissions: DataFrame
    reached: DataFrame

    def attrition(self) -> DataFrame:
        """Patients left after each step."""
        return count_steps(self.reached, STEPS)


def clinic_patients(visits: DataFrame, floor: str, *excluded: DataFrame) -> DataFrame:
    """Patients with a clinic visit in the study window, outside the excluded sets."""
    seen = between_dates(visits, "appointment_date", floor).select("ref").distinct()
    return exclude(seen, *excluded)


def inpatient_cohort(dx: DataFrame, pcr: DataFrame, tests: DataFrame, dispensing: DataFrame, diagnoses: DataFrame,
                     plasma: DataFrame, interferon: DataFrame, visits: DataFrame, window: Window = Window(),
                     source: str | None = "A&E", comorbidity: DataFrame | None = None) -> InpatientCohort:
    """First episode per patient with drug course, outcomes and comorbidity.

    ``dx`` and ``pcr`` are stay extracts with ref, hn_number, admission_date, discharge_date,
    discharge_status, length_of_stay, age, admission_source and any attributes.  The cleaned
    stays, the index rows and the people are checkpointed, since several later steps read them.  Tests, dispensing
    and diagnoses are cut down to the patients wanted before anything is summed over them.
    """
    floor = window.floor
    stays = dedupe_rows(tagged_union({"dx": dx, "pcr": pcr}, "extract"))
    clinic = cut_lineage(clinic_patients(visits, floor, plasma, interferon))
    kept = cut_lineage(exclude(between_dates(stays, "admission_date", floor), plasma, interferon, clinic))

    firsts = cut_lineage(first_episode(kept, order=("admission_date", "hn_number", "extract")))
    index = cut_lineage(index_date(firsts, of_cohort(positive_tests(tests), firsts), floor))
    key = index.select("ref", "start_episode")

    people = with_courses(index, drug_courses(dispensing, key))
    people = follow_up(people, first_death(kept), window.end)
    gaps = cut_lineage(readmission_chain(stay_offsets(effective_end(kept), key), unique=True))
    people = within_flags(gaps, people)
    people = readmission_count(gaps, people)
    los = length_of_stay(kept, key, window.stay_end).select("ref", "los")
    people = people.join(los, "ref", "left")
    people = people.join(comorbidity if comorbidity is not None else charlson(diagnoses, cohort=key), "ref", "left")
    people = people.filter(eligible())
    if source:
        people = people.filter(F.col("admission_source") == source)
    people = cut_lineage(people)
    return InpatientCohort(people, readmission_los(gaps, people), _reached(stays, floor, (plasma, interferon, clinic), index, people))


def _reached(stays: DataFrame, floor: str, sets: tuple, index: DataFrame, people: DataFrame) -> DataFrame:
    """Steps per patient: the stays are read once and brought to patients, what follows are sets of patients."""
    recent = F.coalesce(F.col("admission_date") >= F.lit(floor).cast("date"), F.lit(False))
    out = steps_reached(stays, {"stays": F.lit(True), "in the window": recent}).withColumnRenamed("key", "ref")
    for name, other in zip(("_plasma", "_interferon", "_clinic", "_index", "_eligible"), (*sets, index, people)):
        out = flag_members(out, other, name)
    clean = F.getbit("_bits", F.lit(1)) == 1
    clean = clean & ~F.col("_plasma") & ~F.col("_interferon")
    bits = F.col("_bits")
    for i, met in enumerate((clean, clean & ~F.col("_clinic"), F.col("_index"), F.col("_eligible")), 2):
        bits = bits.bitwiseOR(F.when(met, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out.select(F.col("ref").alias("key"), bits.alias("_bits"))
