"""Whole cohorts and effects on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import study
from wardline.catalog.episodes import DEATH_SQL
from wardline.catalog.coxsql import cox_many, robust_variance, tidy_rows
from wardline.catalog.registry import END, FLOOR, STAY_END, TABLES, VIEWS, query, rounded, table, view, views
from wardline.catalog.rules import _CAUSES, _CHARLSON_SQL, _PAY
from wardline.operators.clean import between_dates
from wardline.operators.comorbidity import charlson
from wardline.operators.design import Factor
from wardline.operators.episodes import first_episode, effective_end, readmission_chain, stay_offsets, within_flags
from wardline.operators.models import ratio_table, svy_logit, tidy
from wardline.operators.survival import kaplan_meier
from wardline.operators.weights import att_weights_multi
from wardline.plans.deaths import SHOWN, cohort_death_causes, death_cause_table
from wardline.plans.effects import (ARM, clinic_analysis, clinic_outcomes, death_model, inpatient_analysis, stay_model,
                                    weighted_effect, weighted_outcomes)
from wardline.plans.inpatient import Window, inpatient_cohort
from wardline.plans.outpatient import outpatient_cohort
from wardline.session import cut_lineage

WINDOW = Window(FLOOR, STAY_END, END)


def inpatient(spark, sf):
    people = view(spark, sf, "patients").select("ref", "age", "sex", "from_elderly_home")
    stays = view(spark, sf, "stays").join(people, "ref")
    number = F.col("hn_number").cast("long")
    return inpatient_cohort(
        stays.filter(number % 3 != 0), stays.filter(number % 3 == 0), view(spark, sf, "tests"),
        view(spark, sf, "dispensing"), view(spark, sf, "diagnoses"), view(spark, sf, "plasma"),
        view(spark, sf, "interferon"), view(spark, sf, "visits"), WINDOW)


_IP_BASE = views("patients", "stays", "tests", "dispensing", "diagnoses", "plasma", "interferon", "visits").rstrip().replace(
    "stays AS (", "all_stays AS (", 1)
_IP_COHORT = _IP_BASE + f""", recent AS (SELECT s.*, p.age, p.sex, p.from_elderly_home FROM all_stays s JOIN patients p ON s.ref = p.ref WHERE admission_date >= DATE '{FLOOR}'),
clean AS (SELECT * FROM recent WHERE ref NOT IN (SELECT ref FROM plasma) AND ref NOT IN (SELECT ref FROM interferon)),
stays AS (SELECT * FROM clean WHERE ref NOT IN (SELECT ref FROM visits WHERE ref NOT IN (SELECT ref FROM plasma) AND ref NOT IN (SELECT ref FROM interferon))),
"""


def _sql_tail():
    from wardline.catalog.episodes import CHAIN_SQL, COURSE_SQL, INDEX_SQL
    return _IP_COHORT + INDEX_SQL + "," + CHAIN_SQL + "," + COURSE_SQL + "," + DEATH_SQL + "," + _CHARLSON_SQL + f""",
drugs AS (SELECT ref, MAX(CAST(molnupiravir AS INT)) AS molnupiravir, MAX(CAST(paxlovid AS INT)) AS paxlovid, MIN(start_drug) AS start_drug, CAST(SUM(cost) AS BIGINT) AS drug_cost FROM courses GROUP BY ref),
losd AS (SELECT DISTINCT s.ref, s.admission_date + CAST(u AS INT) AS day FROM stays s JOIN cohort c ON s.ref = c.ref,
UNNEST(GENERATE_SERIES(0, COALESCE(s.length_of_stay, CAST(DATE '{STAY_END}' - s.admission_date AS INT)))) AS t(u) WHERE s.admission_date >= c.start_episode),
los AS (SELECT ref, COUNT(*) AS los FROM losd GROUP BY ref),
gm AS (SELECT ref, MIN(gap_time) AS m, COUNT(*) FILTER (WHERE gap_mark IS NOT NULL AND gap_mark <> 9999999) AS n FROM chain GROUP BY ref),
people AS (SELECT f.ref, f.start_episode, f.dead, f.fu, x.age, COALESCE(d.molnupiravir, 0) AS molnupiravir, COALESCE(d.paxlovid, 0) AS paxlovid,
COALESCE(d.start_drug, 0) AS start_drug, d.drug_cost, COALESCE(l.los, 0) AS los, COALESCE(g.n, 0) AS ane_times,
CASE WHEN g.m <= 7 THEN 1 ELSE 0 END AS unplan_7d, CASE WHEN g.m <= 28 THEN 1 ELSE 0 END AS unplan_28d, q.diab, q.canc, q.no_disease
FROM fup f JOIN firsts x ON x.ref = f.ref LEFT JOIN drugs d ON d.ref = f.ref LEFT JOIN los l ON l.ref = f.ref LEFT JOIN gm g ON g.ref = f.ref LEFT JOIN cci q ON q.ref = f.ref
WHERE (x.age >= 60 OR q.no_disease = 0) AND x.admission_source = 'A&E')"""


@query("inpatient_cohort", _sql_tail() + " SELECT * FROM people")
def _(spark, sf):
    return inpatient(spark, sf).people.select(
        "ref", "start_episode", "dead", "fu", "age", "molnupiravir", "paxlovid", "start_drug", "drug_cost", "los", "ane_times",
        "unplan_7d", "unplan_28d", "diab", "canc", "no_disease")


@query("inpatient_attrition", _sql_tail() + """ SELECT 1 AS step_no, 'stays' AS step, COUNT(DISTINCT ref) AS patients FROM all_stays
UNION ALL SELECT 2, 'in the window', COUNT(DISTINCT ref) FROM recent UNION ALL SELECT 3, 'without plasma or interferon', COUNT(DISTINCT ref) FROM clean
UNION ALL SELECT 4, 'without clinic patients', COUNT(DISTINCT ref) FROM stays UNION ALL SELECT 5, 'with an index date', COUNT(DISTINCT ref) FROM cohort
UNION ALL SELECT 6, 'eligible', COUNT(DISTINCT ref) FROM people""")
def _(spark, sf):
    return inpatient(spark, sf).attrition()


@query("inpatient_readmission_los", _sql_tail() + """ SELECT k.ref, k.start_day, k.gap_time, COALESCE(k.end_day, p.fu) - k.start_day AS los
FROM chain k JOIN people p ON k.ref = p.ref WHERE k.gap_time <= 28 AND k.gap_mark = 1""")
def _(spark, sf):
    return inpatient(spark, sf).readmissions.select("ref", "start_day", "gap_time", "los")


_HOSPITAL = """SELECT CAST(o_custkey AS STRING) AS ref, CAST(o_orderkey AS STRING) AS hn_number,
DATE '2023-12-20' + CAST(o_orderkey % 70 AS INT) AS admission_date, DATE '2023-12-20' + CAST(o_orderkey % 70 + o_orderkey % 9 AS INT) AS discharge_date,
CASE WHEN o_orderkey % 29 = 0 THEN 'DEATH' ELSE 'HOME' END AS discharge_status,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS emergency_admission FROM {orders}"""
_DEMO = """SELECT CAST(c_custkey AS STRING) AS ref, DATE '2024-01-01' + CAST(c_custkey % 9 AS INT) AS appointment_date, CAST(18 + (c_custkey * 7) % 85 AS INT) AS age,
CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, k.opas AS paycode_opas, k.eis AS paycode_eis, k.race AS race_code
FROM {customer} c JOIN (""" + _PAY.replace("SELECT c_custkey,", "SELECT c_custkey AS ck,") + ") k ON k.ck = c.c_custkey"


def outpatient(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return outpatient_cohort(
        view(spark, sf, "visits"), spark.sql(_DEMO, customer=c), spark.sql(_HOSPITAL, orders=o), view(spark, sf, "diagnoses"),
        view(spark, sf, "plasma"), view(spark, sf, "interferon"), "2024-01-03", "2024-02-15", visit_order=["event_id"])


_OP_SQL = views("visits", "diagnoses", "plasma", "interferon").rstrip() + f""", hospital AS ({_HOSPITAL.format(orders='orders')}), demo AS ({_DEMO.format(customer='customer')}),
{_CHARLSON_SQL}, dv AS (SELECT * FROM visits WHERE appointment_date >= DATE '2024-01-03'),
kept AS (SELECT * FROM dv WHERE ref NOT IN (SELECT ref FROM plasma) AND ref NOT IN (SELECT ref FROM interferon)),
c AS (SELECT ref, MIN(appointment_date) AS start_episode, COUNT(DISTINCT appointment_date) AS dc_read FROM kept GROUP BY ref),
b AS (SELECT k.ref, MIN(k.appointment_date - c.start_episode) AS m FROM kept k JOIN c ON k.ref = c.ref WHERE k.appointment_date > c.start_episode GROUP BY k.ref),
e AS (SELECT h.ref, COUNT(*) AS n FROM hospital h JOIN c ON h.ref = c.ref WHERE h.emergency_admission = 'Y' AND h.admission_date - c.start_episode BETWEEN 0 AND 28 GROUP BY h.ref),
dd AS (SELECT ref, discharge_date AS dead_date FROM hospital WHERE discharge_status = 'DEATH' QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY admission_date, hn_number) = 1),
k0 AS (SELECT *, CASE WHEN active_medication LIKE '%PAXLOVID%' THEN 1 ELSE 0 END + CASE WHEN active_medication LIKE '%MOLNUPIRAVIR%' THEN 2 ELSE 0 END AS code FROM dv),
k AS (SELECT ref, code, appointment_date FROM k0 WHERE code > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY appointment_date, event_id) = 1),
people AS (SELECT c.ref, c.start_episode, d.age, d.sex, c.dc_read, CASE WHEN b.m <= 7 THEN 1 ELSE 0 END AS unplan_7d, CASE WHEN b.m <= 28 THEN 1 ELSE 0 END AS unplan_28d,
e.n AS ane_times, CASE WHEN e.n >= 1 THEN 1 END AS ane, CASE WHEN dd.ref IS NULL THEN 0 ELSE 1 END AS dead,
CAST(COALESCE(dd.dead_date, DATE '2024-02-15') - c.start_episode AS INT) AS fu, q.no_disease,
CASE COALESCE(k.code, 0) WHEN 0 THEN 'Did not use' WHEN 1 THEN 'Paxlovid only' WHEN 2 THEN 'Molnupiravir only' END AS antiviral,
CAST(DATE '2024-02-15' - k.appointment_date AS INT) AS start_drug
FROM c LEFT JOIN demo d ON d.ref = c.ref LEFT JOIN b ON b.ref = c.ref LEFT JOIN e ON e.ref = c.ref LEFT JOIN dd ON dd.ref = c.ref LEFT JOIN cci q ON q.ref = c.ref LEFT JOIN k ON k.ref = c.ref)"""


@query("outpatient_cohort", _OP_SQL + " SELECT * FROM people")
def _(spark, sf):
    return outpatient(spark, sf).select("ref", "start_episode", "age", "sex", "dc_read", "unplan_7d", "unplan_28d", "ane_times", "ane",
                                        "dead", "fu", "no_disease", "antiviral", "start_drug")


@query("clinic_analysis", _OP_SQL + """, a AS (SELECT p.*, CASE WHEN d.paycode_opas LIKE '%DGS%' OR d.paycode_opas LIKE '%DH%' OR d.paycode_opas LIKE '%EP%' THEN 'Non PA'
WHEN d.paycode_opas LIKE '%GAZ%' THEN 'PA' WHEN d.paycode_opas LIKE '%HA%' OR d.paycode_opas LIKE '%NE%' THEN 'Non PA' WHEN d.paycode_opas IN ('P', 'PA') THEN 'PA'
WHEN d.paycode_opas LIKE '%RH%' THEN 'Non PA' ELSE d.paycode_eis END AS paycode, CASE WHEN d.race_code LIKE '%CH%' THEN 'Yes' ELSE 'No' END AS chin
FROM people p LEFT JOIN demo d ON d.ref = p.ref)
SELECT ref, CASE WHEN paycode = 'PA' THEN 'PA' ELSE 'Non PA' END AS paycode_bi, chin, CASE WHEN antiviral = 'Did not use' THEN 0 ELSE 1 END AS used,
COALESCE(ane, 0) AS ane, CASE WHEN age < 60 THEN '<60' WHEN age <= 69 THEN '60-69' WHEN age <= 79 THEN '70-79' WHEN age <= 89 THEN '80-89' WHEN age >= 90 THEN '>=90' END AS age_gp
FROM a WHERE age >= 60 OR no_disease = 0""")
def _(spark, sf):
    return clinic_analysis(outpatient(spark, sf)).select("ref", "paycode_bi", "chin", "used", "ane", "age_gp")


# --- effects: 28-day readmission by arm, weighted ---------------------------------------------

_EFFECT_SQL = views("patients", "stays").rstrip() + f""",
cohort AS (SELECT ref, admission_date AS start_episode FROM stays WHERE admission_date >= DATE '{FLOOR}'
           QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY admission_date, hn_number) = 1),
"""


def _effect_sql():
    from wardline.catalog.episodes import CHAIN_SQL
    return _EFFECT_SQL + CHAIN_SQL + """,
m AS (SELECT ref, MIN(gap_time) AS m FROM chain GROUP BY ref),
p AS (SELECT x.ref, x.segment, x.arm, CASE WHEN m.m <= 28 THEN 1 ELSE 0 END AS y FROM cohort c JOIN patients x ON x.ref = c.ref LEFT JOIN m ON m.ref = c.ref),
n AS (SELECT segment, arm, COUNT(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
z AS (SELECT p.*, f.n / o.n AS weight FROM p JOIN n o ON o.segment = p.segment AND o.arm = p.arm JOIN n f ON f.segment = p.segment AND f.arm = 'Did not use'),
g AS (SELECT arm, SUM(weight) AS w, SUM(weight * y) / SUM(weight) AS pr, (SELECT COUNT(*) FROM z)::DOUBLE AS nn FROM z GROUP BY arm),
h AS (SELECT g.arm, LN(g.pr / (1 - g.pr)) AS lo, g.nn / (g.nn - 1) * SUM(POWER(z.weight * (z.y - g.pr), 2)) / POWER(g.w * g.pr * (1 - g.pr), 2) AS var
      FROM g JOIN z ON z.arm = g.arm GROUP BY g.arm, g.pr, g.w, g.nn)
SELECT 'antiviral' || a.arm AS term, ROUND(EXP(a.lo - b.lo), 6) AS ratio, ROUND(SQRT(a.var + b.var), 6) AS std_error
FROM h a, h b WHERE b.arm = 'Did not use' AND a.arm <> 'Did not use'"""


@query("readmission_odds", _effect_sql())
def _(spark, sf):
    stays = between_dates(view(spark, sf, "stays"), "admission_date", FLOOR)
    index = first_episode(stays).select("ref", F.col("admission_date").alias("start_episode"))
    chain = readmission_chain(stay_offsets(effective_end(view(spark, sf, "stays")), index), unique=True)
    flags = within_flags(chain, index)
    people = view(spark, sf, "patients").select("ref", "segment", F.col("arm").alias("antiviral")).join(flags, "ref")
    # the weights and the model both read the people, so the chain is not worked out twice
    people = cut_lineage(people)
    weighted = att_weights_multi(people, "antiviral", [Factor("segment")], study.NO_USE)
    fit = svy_logit(weighted, "unplan_28d", [ARM], "weight")
    odds = ratio_table(fit).select("term", "ratio").join(tidy(fit).select("term", "std_error"), "term")
    return rounded(odds.filter(F.col("term") != "(Intercept)"))


def _analysis(spark, sf):
    """The cohort with the arms of the patient view, which overlap in their covariates."""
    arms = view(spark, sf, "patients").select("ref", (F.col("arm") == "Paxlovid only").cast("int").alias("paxlovid"),
                                              (F.col("arm") == "Molnupiravir only").cast("int").alias("molnupiravir"))
    people = inpatient(spark, sf).people.drop("paxlovid", "molnupiravir").join(arms, "ref").withColumn("start_drug", F.lit(0))
    return cut_lineage(inpatient_analysis(people, view(spark, sf, "lifetable")))


COVARIATES = [Factor("sex"), Factor("age_gp", ("<60", "60-69", "70-79", "80-89", ">=90")), Factor("from_elderly_home")]


@query("inpatient_effect_balance")
def _(spark, sf):
    return rounded(weighted_effect(_analysis(spark, sf), "unplan_28d", COVARIATES).balance, 5)


@query("inpatient_effect_odds")
def _(spark, sf):
    e = weighted_effect(_analysis(spark, sf), "unplan_28d", COVARIATES)
    return rounded(ratio_table(e.outcome).withColumn("model", F.lit("weighted")).unionByName(
        ratio_table(e.adjusted, interval="wald").withColumn("model", F.lit("adjusted"))), 5)


@query("inpatient_stay_model")
def _(spark, sf):
    return rounded(ratio_table(stay_model(_analysis(spark, sf), [Factor("use_antiviral"), Factor("sex"), "age"]), interval="wald"), 5)


@query("inpatient_death_model")
def _(spark, sf):
    df = _analysis(spark, sf).filter(F.col("fu") > 0)
    return rounded(ratio_table(death_model(df, [Factor("use_antiviral"), Factor("sex"), "age"], strata=["age_gp"])), 5)


@query("inpatient_survival_curve", _sql_tail() + """, z AS (SELECT CASE WHEN x.arm = 'Did not use' THEN 'Did not use' ELSE 'Used Paxlovid/Molnupiravir' END AS use_antiviral, p.fu AS time, p.dead
FROM people p JOIN patients x ON x.ref = p.ref),
dd AS (SELECT use_antiviral, time, COUNT(*)::DOUBLE AS n, SUM(dead)::DOUBLE AS e FROM z GROUP BY 1, 2),
rr AS (SELECT *, SUM(n) OVER (PARTITION BY use_antiviral ORDER BY time DESC) AS risk FROM dd),
km AS (SELECT *, CASE WHEN MIN(risk - e) OVER w < 1e-9 THEN 0 ELSE EXP(SUM(LN(CASE WHEN risk - e < 1e-9 THEN 1 ELSE 1 - e / risk END)) OVER w) END AS survival,
SUM(CASE WHEN risk > e THEN e / (risk * (risk - e)) END) OVER w AS gw FROM rr WINDOW w AS (PARTITION BY use_antiviral ORDER BY time))
SELECT use_antiviral, time, risk AS n_risk, e AS n_event, n - e AS n_censor, ROUND(survival, 6) AS survival, ROUND(CASE WHEN survival > 0 THEN survival * SQRT(gw) END, 6) AS std_error,
ROUND(CASE WHEN survival > 0 THEN -LN(survival) END, 6) + 0.0 AS cum_hazard FROM km""")
def _(spark, sf):
    return rounded(kaplan_meier(_analysis(spark, sf), "fu", "dead", "use_antiviral"), 6)


# --- effects of the clinic cohort, of three arms and of survivors: weights of one factor have a closed form -------

_ARMS = ", arms AS (" + VIEWS["patients"].format(**{t: t for t in TABLES}) + ")"
_CLINIC_Z = _OP_SQL + _ARMS + """, z AS (SELECT p.ref, x.arm, CASE WHEN x.arm = 'Did not use' THEN 0 ELSE 1 END AS used, p.sex, COALESCE(p.ane, 0) AS ane, p.dead, p.fu
FROM people p JOIN arms x ON x.ref = p.ref WHERE p.age >= 60 OR p.no_disease = 0)"""
_BED_Z = """, z AS (SELECT p.ref, x.arm, CASE WHEN x.arm = 'Did not use' THEN 0 ELSE 1 END AS used, x.sex, p.unplan_7d, p.unplan_28d, p.dead, p.fu FROM people p JOIN patients x ON x.ref = p.ref)"""
_PAIR, _TRIO = ("used", "1", "0", "used"), ("arm", "'Did not use'", "'Did not use'", "antiviral")


def _weights_sql(arms, where="TRUE"):
    by, focal, _, _ = arms
    return f""", part AS (SELECT * FROM z WHERE {where}), cells AS (SELECT sex, {by}, COUNT(*)::DOUBLE AS n FROM part GROUP BY 1, 2),
wz AS (SELECT part.*, f.n / o.n AS weight FROM part JOIN cells o ON o.sex = part.sex AND o.{by} = part.{by} JOIN cells f ON f.sex = part.sex AND f.{by} = {focal})"""


def _odds_sql(arms, outcomes, where="TRUE"):
    by, _, base, term = arms
    one = [f"""SELECT '{y}' AS outcome, '{term}' || a.{by} AS term, ROUND(CASE WHEN a.fine AND b.fine THEN EXP(a.lo - b.lo) END, 6) AS ratio, ROUND(CASE WHEN a.fine AND b.fine THEN SQRT(a.var + b.var) END, 6) AS std_error FROM
(SELECT g.{by}, g.pr BETWEEN 1e-6 AND 1 - 1e-6 AS fine, CASE WHEN fine THEN LN(g.pr / (1 - g.pr)) END AS lo, CASE WHEN fine THEN g.nn / (g.nn - 1) * SUM(POWER(wz.weight * (wz.{y} - g.pr), 2)) / POWER(g.w * g.pr * (1 - g.pr), 2) END AS var FROM g_{y} g JOIN wz ON wz.{by} = g.{by} GROUP BY g.{by}, g.pr, g.w, g.nn) a,
(SELECT g.{by}, g.pr BETWEEN 1e-6 AND 1 - 1e-6 AS fine, CASE WHEN fine THEN LN(g.pr / (1 - g.pr)) END AS lo, CASE WHEN fine THEN g.nn / (g.nn - 1) * SUM(POWER(wz.weight * (wz.{y} - g.pr), 2)) / POWER(g.w * g.pr * (1 - g.pr), 2) END AS var FROM g_{y} g JOIN wz ON wz.{by} = g.{by} GROUP BY g.{by}, g.pr, g.w, g.nn) b
WHERE b.{by} = {base} AND a.{by} <> {base}""" for y in outcomes]
    sums = "".join(f", g_{y} AS (SELECT {by}, SUM(weight) AS w, SUM(weight * {y}) / SUM(weight) AS pr, (SELECT COUNT(*) FROM wz)::DOUBLE AS nn FROM wz GROUP BY {by})"
                   for y in outcomes)
    return _weights_sql(arms, where) + sums + " " + " UNION ALL ".join(one)


def _clinic(spark, sf):
    """The clinic cohort with the arms of the patient view, as in the clinic view nobody is without a drug."""
    arms = view(spark, sf, "patients").select("ref", F.col("arm").alias("antiviral"))
    return cut_lineage(clinic_outcomes(clinic_analysis(outpatient(spark, sf).drop("antiviral").join(arms, "ref")))[0])


def _odds(found):
    return rounded(found.odds().select("outcome", "term", "ratio", "std_error"))


SEX = [Factor("sex")]


@query("clinic_effect_odds", _CLINIC_Z + _odds_sql(_PAIR, ["ane"]))
def _(spark, sf):
    return _odds(weighted_outcomes(_clinic(spark, sf), ["ane"], SEX))


@query("clinic_arms_odds", _CLINIC_Z + _odds_sql(_TRIO, ["ane"]))
def _(spark, sf):
    return _odds(weighted_outcomes(_clinic(spark, sf), ["ane"], SEX, multi=True))


@query("clinic_survivor_odds", _CLINIC_Z + _odds_sql(_PAIR, ["ane"], "dead = 0"))
def _(spark, sf):
    return _odds(weighted_outcomes(_clinic(spark, sf), ["ane"], SEX, where=F.col("dead") == 0))


@query("clinic_effect_balance", _CLINIC_Z + _weights_sql(_PAIR) + """ SELECT 'sex' AS variable, sex AS level, '0' AS arm,
ROUND(SUM(used)::DOUBLE / (SELECT SUM(used) FROM wz) - SUM(1 - used)::DOUBLE / (SELECT SUM(1 - used) FROM wz), 6) + 0.0 AS diff_unadjusted,
ROUND(SUM(used * weight) / (SELECT SUM(used * weight) FROM wz) - SUM((1 - used) * weight) / (SELECT SUM((1 - used) * weight) FROM wz), 6) + 0.0 AS diff_adjusted FROM wz GROUP BY sex""")
def _(spark, sf):
    return rounded(weighted_outcomes(_clinic(spark, sf), ["ane"], SEX).balance)


@query("clinic_death_model", _CLINIC_Z + _weights_sql(_PAIR) + cox_many(
    "SELECT ref, 1 AS s, fu AS t, dead AS e, weight AS w, used AS x0 FROM wz", 1) + robust_variance(1) + """, tidied AS (""" + tidy_rows(["used1"]) + """),
both_arms AS (SELECT COUNT(DISTINCT used) = 2 AND (SELECT ABS(b0) < 8 FROM fit) AS fine FROM wz WHERE dead = 1)
SELECT term, CASE WHEN fine THEN estimate END AS estimate, CASE WHEN fine THEN std_error END AS std_error, CASE WHEN fine THEN statistic END AS statistic, CASE WHEN fine THEN p_value END AS p_value FROM tidied, both_arms""")
def _(spark, sf):
    return rounded(weighted_outcomes(_clinic(spark, sf), ["ane"], SEX).deaths(), 5)


@query("inpatient_arms_odds", _sql_tail() + _BED_Z + _odds_sql(_TRIO, ["unplan_7d", "unplan_28d"]))
def _(spark, sf):
    return _odds(weighted_outcomes(_analysis(spark, sf), ["unplan_7d", "unplan_28d"], SEX, multi=True))


@query("inpatient_survivor_odds", _sql_tail() + _BED_Z + _odds_sql(_TRIO, ["unplan_7d", "unplan_28d"], "dead = 0"))
def _(spark, sf):
    return _odds(weighted_outcomes(_analysis(spark, sf), ["unplan_7d", "unplan_28d"], SEX, multi=True, where=F.col("dead") == 0))


# --- causes of death of both cohorts --------------------------------------------------------------

def _deaths_sql():
    """Cells of the table over ``z`` (ref, arm); with three arms and two levels the tail of chi-square is EXP(-x / 2)."""
    flags = " UNION ALL ".join(f"""SELECT '{c}' AS variable, CAST("{c}" AS VARCHAR) AS level, arm FROM h""" for c in SHOWN)
    return ", causes AS (" + VIEWS["causes"].format(**{t: t for t in TABLES}) + "), " + _CAUSES + f""",
h AS (SELECT z.arm, d.*, CASE WHEN ischemic_heart + pulmonary_heart + other_heart > 0 THEN 1 ELSE 0 END AS heart,
CASE WHEN diabetes + ischemic_heart + pulmonary_heart + other_heart + covid + cancer + stroke + nervous_sys + genitourinary = 0 THEN 1 ELSE 0 END AS others, 1 AS "all" FROM z JOIN d ON d.ref = z.ref),
long AS ({flags}), cell AS (SELECT variable, level, arm, COUNT(*)::DOUBLE AS n FROM long GROUP BY 1, 2, 3),
col AS (SELECT variable, arm, SUM(n) AS c FROM cell GROUP BY 1, 2), line AS (SELECT variable, level, SUM(n) AS r FROM cell GROUP BY 1, 2),
size AS (SELECT variable, SUM(n) AS t, COUNT(DISTINCT level) AS levels, COUNT(DISTINCT arm) AS arms FROM cell GROUP BY 1),
chi AS (SELECT variable, t * (SUM(n * n / (r * c)) - 1) AS x FROM cell JOIN col USING (variable, arm) JOIN line USING (variable, level) JOIN size USING (variable) GROUP BY variable, t),
share AS (SELECT variable, arm, COALESCE(SUM(n) FILTER (WHERE level = '1'), 0) / SUM(n) AS p FROM cell GROUP BY 1, 2),
apart AS (SELECT variable, AVG(CASE WHEN ABS(a.p - b.p) <= 1e-15 THEN 0 ELSE ABS(a.p - b.p) / SQRT((a.p * (1 - a.p) + b.p * (1 - b.p)) / 2) END) AS smd
FROM share a JOIN share b USING (variable) WHERE a.arm < b.arm GROUP BY variable)
SELECT variable, level, 'Overall' AS stratum, r AS n, ROUND(100 * r / t, 6) AS percent, NULL::DOUBLE AS p_value, NULL::DOUBLE AS smd FROM line JOIN size USING (variable)
UNION ALL SELECT variable, level, arm, n, ROUND(100 * n / c, 6), ROUND(CASE WHEN levels = 2 AND arms = 3 THEN EXP(-x / 2) END, 6),
ROUND(CASE WHEN levels = 2 THEN smd ELSE 0 END, 6) FROM cell JOIN col USING (variable, arm) JOIN size USING (variable) JOIN chi USING (variable) JOIN apart USING (variable)"""


def _death_table(spark, sf, people):
    causes = cut_lineage(cohort_death_causes(people, view(spark, sf, "causes")))
    return rounded(death_cause_table(causes).select("variable", "level", "stratum", "n", "percent", "p_value", "smd"))


@query("inpatient_death_causes", _sql_tail() + _BED_Z + _deaths_sql())
def _(spark, sf):
    return _death_table(spark, sf, _analysis(spark, sf))


@query("clinic_death_causes", _CLINIC_Z + _deaths_sql())
def _(spark, sf):
    return _death_table(spark, sf, _clinic(spark, sf))
