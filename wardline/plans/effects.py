"""Treatment effects on a finished cohort: arms, covariates, weights, tables and models."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.rules import (age_band, any_treatment, any_treatment_label, arm_from_flags, arm_label, eligible,
                                      paycode_binary, paycode_class, race_flag, utility_weight)
from wardline.operators.clean import fill_zero
from wardline.operators.design import Factor
from wardline.operators.episodes import treatment_window
from wardline.operators.lookup import life_years
from wardline.operators.models import Fit, logit, neg_binomial, ratio_table, svy_logit, tidy
from wardline.operators.survival import cox
from wardline.operators.tables import table_one
from wardline.operators.weights import att_weights, att_weights_multi, balance_table, propensity
from wardline.session import cut_lineage

BANDS = tuple(label for label, _, _ in study.AGE_BANDS)
ARMS = tuple(study.ARM_LABELS.values())
ARM = Factor("antiviral", ARMS)


def inpatient_analysis(people: DataFrame, lifetable: DataFrame | None = None, first_days: int = 7) -> DataFrame:
    """Arms, bands, life years and QALY of the inpatient cohort, inside the treatment window."""
    out = people.withColumn("antiviral_code", arm_from_flags()).withColumn("antiviral", arm_label("antiviral_code"))
    out = out.withColumns({"used": any_treatment("antiviral"), "use_antiviral": any_treatment_label("antiviral"),
                           "age_gp": age_band("age"), "utility": utility_weight("age")})
    out = treatment_window(out, first_days).filter(eligible())
    out = fill_zero(out, [*study.CHARLSON, "no_disease"])
    if lifetable is not None:
        out = life_years(out, lifetable).withColumn("qaly", F.col("utility") * F.col("life"))
    return out


def clinic_analysis(people: DataFrame) -> DataFrame:
    """Arms, bands, pay-code class and ethnicity flag of the clinic cohort."""
    out = people.withColumn("paycode", paycode_class("paycode_opas", "paycode_eis"))
    out = out.withColumns({"paycode_bi": paycode_binary("paycode"), "chin": race_flag("race_code"),
                           "used": any_treatment("antiviral"), "use_antiviral": any_treatment_label("antiviral"),
                           "age_gp": age_band("age")})
    return fill_zero(out.filter(eligible()), [*study.CHARLSON, "ane"])


def comorbidity_terms(df: DataFrame) -> list[Factor]:
    return [Factor(c, ("0", "1")) for c in study.CHARLSON if c in df.columns]


@dataclass
class Effect:
    """People with their weight, balance before and after, weighted table and outcome models."""

    people: DataFrame
    balance: DataFrame
    table: DataFrame
    outcome: Fit
    adjusted: Fit


def weighted_effect(df: DataFrame, outcome: str, covariates, multi: bool = False, stabilize: bool = False) -> Effect:
    """ATT weights on the covariates, balance and weighted table, weighted and adjusted odds.

    Two groups (``used``) or three arms (``antiviral``).  The weighted people are
    checkpointed: the balance, the table and the models all read them.
    """
    names = [c.name if isinstance(c, Factor) else c for c in covariates]
    nums = [c for c in covariates if not isinstance(c, Factor)]
    cats = [c.name for c in covariates if isinstance(c, Factor)]
    treatment, term, focal = ("antiviral", ARM, study.NO_USE) if multi else ("used", Factor("used", ("0", "1")), 1)
    slim = df.select(*dict.fromkeys(["ref", outcome, "used", "antiviral", *names])).filter(F.col(treatment).isNotNull())
    if multi:
        weighted = att_weights_multi(slim, treatment, covariates, focal, stabilize)
    else:
        weighted = att_weights(propensity(slim, treatment, covariates), treatment)
    weighted = cut_lineage(weighted)
    return Effect(weighted, balance_table(weighted, nums, cats, treatment, "weight", focal),
                  table_one(weighted, nums, cats, treatment, "weight"),
                  svy_logit(weighted, outcome, [term], "weight"),
                  logit(weighted, outcome, [term, *covariates]))


# A weighted share of people below this, or above one less this, gives no odds.
RARE = 1e-6
# A log hazard ratio beyond this is taken for a likelihood that rises without end, which has no estimate.
RUNAWAY = 8.0


@dataclass
class Outcomes:
    """Weighted people, their balance, and one weighted logistic fit for each outcome."""

    people: DataFrame
    balance: DataFrame
    fits: dict[str, Fit]

    term: Factor
    shares: dict[str, dict[str, float]]

    def _known(self, outcome: str, top: float) -> list[str]:
        """Terms whose arm and reference arm both have the outcome, and a share below ``top``."""
        share = self.shares[outcome]
        fine = [a for a in self.term.levels if RARE < share.get(a, 0.0) < top]
        return [self.term.name + a for a in fine if self.term.levels[0] in fine]

    def odds(self) -> DataFrame:
        """``outcome, term, ratio, conf_low, conf_high, std_error`` of every fit but its intercept.

        All four are NULL where one of the two arms has no odds, as nobody or everybody in it has the outcome.
        """
        rows = []
        for name, fit in self.fits.items():
            own = ratio_table(fit).join(tidy(fit).select("term", "std_error"), "term").filter(F.col("term") != "(Intercept)")
            known = F.col("term").isin(self._known(name, 1 - RARE))
            rows.append(own.select(F.lit(name).alias("outcome"), "term", *[
                F.when(known, F.col(c)).alias(c) for c in ("ratio", "conf_low", "conf_high", "std_error")]))
        return reduce(DataFrame.unionByName, rows)

    def deaths(self) -> DataFrame:
        """Terms of the weighted Cox model by arm; NULL where one of the two arms has no death or the estimate runs away."""
        fit = tidy(death_model(self.people, [self.term], "weight"))
        known = F.col("term").isin(self._known("dead", math.inf)) & (F.abs("estimate") < RUNAWAY)
        return fit.select("term", *[F.when(known, F.col(c)).alias(c) for c in fit.columns if c != "term"])


def weighted_outcomes(df: DataFrame, outcomes, covariates, multi: bool = False, stabilize: bool = False,
                      where=None, keep=("dead", "fu")) -> Outcomes:
    """Weights once, then the weighted odds of every outcome, for two groups (``used``) or three arms (``antiviral``).

    ``where`` (such as survivors) is applied before the scores are fitted, so that part gets weights of its own.
    ``keep`` are further columns for the models that follow.  A person whose arm is unknown has no score and is left out.
    """
    names = [c.name if isinstance(c, Factor) else c for c in covariates]
    treatment, term, focal = ("antiviral", ARM, study.NO_USE) if multi else ("used", Factor("used", ("0", "1")), 1)
    part = df if where is None else df.filter(where)
    slim = part.select(*dict.fromkeys(["ref", *outcomes, *keep, treatment, *names])).filter(F.col(treatment).isNotNull())
    if multi:
        weighted = att_weights_multi(slim, treatment, covariates, focal, stabilize)
    else:
        weighted = att_weights(propensity(slim, treatment, covariates), treatment)
    weighted = cut_lineage(weighted)
    balance = balance_table(weighted, [c for c in covariates if not isinstance(c, Factor)],
                            [c.name for c in covariates if isinstance(c, Factor)], treatment, "weight", focal)
    measured = [y for y in dict.fromkeys([*outcomes, "dead"]) if y in weighted.columns]
    rows = weighted.groupBy(treatment).agg(*[F.try_divide(F.sum(F.col("weight") * F.col(y)), F.sum("weight")).alias(f"_{y}")
                                             for y in measured]).collect()
    shares = {y: {str(r[treatment]): r[f"_{y}"] or 0.0 for r in rows} for y in measured}
    return Outcomes(weighted, balance, {y: svy_logit(weighted, y, [term], "weight") for y in outcomes}, term, shares)


def clinic_outcomes(people: DataFrame, days=study.FLAG_DAYS) -> tuple[DataFrame, list[str]]:
    """The clinic analysis with its 0/1 outcomes: attended twice or more, again within X days, admitted as an emergency."""
    out = people.withColumn("reattended", F.when(F.col("dc_read") >= 2, 1).otherwise(0))
    return out, ["reattended", *[f"unplan_{d}d" for d in days], "ane"]


def stay_model(df: DataFrame, covariates, weight: str | None = None) -> Fit:
    """Length of stay of survivors by arm, negative binomial with follow-up as exposure."""
    return neg_binomial(df, "los", covariates, "fu", weight, where=F.col("dead") == 0)


def death_model(df: DataFrame, covariates, weight: str | None = None, strata=()) -> Fit:
    return cox(df, "fu", "dead", covariates, weight, strata)
