"""The clinic cohort as one plan: visits to one row per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.rules import arm_label
from wardline.operators.clean import between_dates, dedupe_rows
from wardline.operators.comorbidity import charlson
from wardline.operators.episodes import (admissions_within, drug_offset, first_death, first_visit, follow_up,
                                         reattendance_days, visit_count, visit_course_cost, within_flags)
from wardline.operators.lookup import exclude, lookup_first, of_cohort
from wardline.session import cut_lineage


def outpatient_cohort(visits: DataFrame, demographics: DataFrame, hospital: DataFrame, diagnoses: DataFrame,
                      plasma: DataFrame, interferon: DataFrame, floor: str = study.INDEX_FLOOR,
                      end: str = study.CLINIC_END, demo_cols=("age", "sex", "paycode_opas", "paycode_eis", "race_code"),
                      visit_order=(), comorbidity: DataFrame | None = None) -> DataFrame:
    """First clinic visit per patient with re-attendance, admissions, death, comorbidity and arm.

    ``visits``: ref, appointment_date, active_medication; ``hospital``: ref, admission_date,
    discharge_date, discharge_status, emergency_admission, hn_number; ``demographics``: one or
    more dated rows per patient, of which the first one counts.
    """
    drug_visits = between_dates(dedupe_rows(visits), "appointment_date", floor)
    kept = cut_lineage(exclude(drug_visits, plasma, interferon))
    index = first_visit(kept, order=visit_order).select("ref", F.col("appointment_date").alias("start_episode"))
    index = cut_lineage(index)

    people = lookup_first(index, demographics, "ref", list(demo_cols), ["appointment_date", *demo_cols])
    people = people.join(visit_count(kept), "ref", "left")
    people = within_flags(reattendance_days(kept, index), people, "days")
    emergency = dedupe_rows(hospital.filter(F.col("emergency_admission") == "Y"))
    people = admissions_within(emergency, people)
    people = follow_up(people, first_death(of_cohort(hospital, index)), end, dead_by="record")
    people = people.join(comorbidity if comorbidity is not None else charlson(diagnoses, cohort=index), "ref", "left")
    people = drug_offset(people, drug_visits, order=visit_order).withColumn("antiviral", arm_label("antiviral_code"))
    costs = visit_course_cost(drug_visits, index).select("ref", "dc_drug_cost")
    return people.join(costs, "ref", "left")
