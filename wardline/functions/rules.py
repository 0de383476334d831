"""Clinical rule columns: arms, bands, causes of death, pay codes, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.exprs import any_of, band, case_when, contains_any, recode


def treatment_arm(drug_text: str, second: str = "MOLNUPIRAVIR", first: str = "PAXLOVID") -> Column:
    """0 none, 1 first drug, 2 second drug, 3 both, by substring; no text means none."""
    has_first = F.coalesce(F.col(drug_text).contains(first).cast("int"), F.lit(0))
    has_second = F.coalesce(F.col(drug_text).contains(second).cast("int"), F.lit(0))
    return has_first + 2 * has_second


def arm_from_flags(first: str = "paxlovid", second: str = "molnupiravir") -> Column:
    return F.col(first).cast("int") + 2 * F.col(second).cast("int")


def arm_label(code: str | Column) -> Column:
    """Three-level label; both drugs (code 3) has none."""
    return recode(code, study.ARM_LABELS)


def any_treatment(label: str) -> Column:
    """0 for the no-use label, else 1: an arm without a label counts as use."""
    return F.when(F.col(label) == study.NO_USE, 0).otherwise(1)


def any_treatment_label(label: str) -> Column:
    return recode(any_treatment(label), study.USE_LABELS)


def age_band(age: str) -> Column:
    return band(age, study.AGE_BANDS)


def utility_weight(age: str) -> Column:
    return band(age, [(w, lo, hi) for lo, hi, w in study.UTILITY_BANDS], study.UTILITY_DEFAULT)


def paycode_class(code: str, fallback: str) -> Column:
    """Ordered rules over one code; without a hit the other code is taken as it is."""
    branches = [
        (F.col(code).contains(text) if how == "contains" else F.col(code) == text, label)
        for how, text, label in study.PAYCODE_RULES
    ]
    return case_when(branches, F.col(fallback).cast("string"))


def paycode_binary(paycode: str | Column) -> Column:
    c = F.col(paycode) if isinstance(paycode, str) else paycode
    return F.when(c == "PA", "PA").otherwise("Non PA")


def race_flag(race: str, text: str = "CH") -> Column:
    return F.when(F.col(race).contains(text), "Yes").otherwise("No")


def _cause(code: Column, rule: str, anchored: bool) -> Column:
    whole = [p[1:] for p in rule.split() if p.startswith("=")]
    parts = [p for p in rule.split() if not p.startswith("=")]
    tests = [code.isin(whole)] if whole else []
    tests += [code.startswith(p) if anchored else code.contains(p) for p in parts]
    return F.when(any_of(tests), 1).otherwise(0)


def death_causes(df: DataFrame, code: str = "main_cause", anchored: bool = False) -> DataFrame:
    """16 cause flags of an ICD-10 code.  Unanchored by default: a letter counts anywhere."""
    return df.withColumns({name: _cause(F.col(code), rule, anchored)
                           for name, rule in study.DEATH_GROUPS.items()})


def death_composites(df: DataFrame, keep_all: bool = True) -> DataFrame:
    """Heart, others and all flags over the cause flags; unmatched people (NULL flags) drop out."""
    named = [F.col(c) == 1 for c in study.NAMED_GROUPS]
    none_named = F.lit(True)
    for c in study.NAMED_GROUPS:
        none_named = none_named & (F.col(c) == 0)
    out = df.withColumns({
        "heart": F.when(any_of([F.col(c) == 1 for c in study.HEART_GROUPS]), 1).otherwise(0),
        "others": F.when(none_named, 1).otherwise(0),
    }).withColumn("all", F.when(any_of(named) | (F.col("others") == 1), 1).otherwise(0))
    return out.filter(F.col("all") == 1) if keep_all else out


def no_disease(include_dementia: bool = False) -> Column:
    """1 when none of the comorbidity flags is set; dementia is left out unless asked for."""
    flags = [c for c in study.CHARLSON if include_dementia or c != "dementia"]
    return F.when(F.greatest(*flags) == 0, 1).otherwise(0)


def eligible(age: str = "age", disease_free: str = "no_disease", min_age: int = 60) -> Column:
    """Old enough, or with a comorbidity; known truth wins over an unknown."""
    return (F.col(age) >= min_age) | (F.col(disease_free) == 0)


def has_drug(drug_text: str, terms) -> Column:
    return contains_any(drug_text, terms)
