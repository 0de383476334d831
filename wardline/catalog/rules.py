"""Arms, bands, causes of death, comorbidity, pay codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import study
from wardline.catalog.registry import query, rounded, table, view, views
from wardline.functions.rules import (age_band, any_treatment, any_treatment_label, arm_from_flags, arm_label,
                                      death_causes, death_composites, paycode_binary, paycode_class, race_flag,
                                      treatment_arm, utility_weight)
from wardline.operators.comorbidity import charlson
from wardline.operators.lookup import exclude, life_years

_ARM = """a AS (SELECT event_id, CASE WHEN active_medication LIKE '%PAXLOVID%' THEN 1 ELSE 0 END +
CASE WHEN active_medication LIKE '%MOLNUPIRAVIR%' THEN 2 ELSE 0 END AS code FROM visits),
b AS (SELECT *, CASE code WHEN 0 THEN 'Did not use' WHEN 1 THEN 'Paxlovid only' WHEN 2 THEN 'Molnupiravir only' END AS arm FROM a)"""


@query("treatment_arm", views("visits").rstrip() + "," + _ARM + " SELECT event_id, code, arm FROM b")
def _(spark, sf):
    v = view(spark, sf, "visits").select("event_id", treatment_arm("active_medication").alias("code"))
    return v.withColumn("arm", arm_label("code"))


@query("treatment_arm_from_flags", """SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 1 ELSE 0 END + 2 * CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS code FROM part""")
def _(spark, sf):
    flags = table(spark, sf, "part").select("p_partkey", F.col("p_name").contains("red").cast("int").alias("paxlovid"),
                                            (F.col("p_type") == "PROMO").cast("int").alias("molnupiravir"))
    return flags.select("p_partkey", arm_from_flags().alias("code"))


@query("any_treatment", views("visits").rstrip() + "," + _ARM + """ SELECT event_id, CASE WHEN arm = 'Did not use' THEN 0 ELSE 1 END AS used,
CASE WHEN arm = 'Did not use' THEN 'Did not use' ELSE 'Used Paxlovid/Molnupiravir' END AS use_antiviral FROM b""")
def _(spark, sf):
    v = view(spark, sf, "visits").select("event_id", arm_label(treatment_arm("active_medication")).alias("arm"))
    return v.select("event_id", any_treatment("arm").alias("used"), any_treatment_label("arm").alias("use_antiviral"))


_CAUSES = """d AS (SELECT ref, main_cause, CASE WHEN main_cause IN ('B342', 'U071', 'J184') THEN 1 ELSE 0 END AS covid,
CASE WHEN main_cause IN ('A415', 'A419') THEN 1 ELSE 0 END AS sepsis,
CASE WHEN regexp_matches(main_cause, 'C') THEN 1 ELSE 0 END AS cancer,
CASE WHEN regexp_matches(main_cause, 'D[1-4]') THEN 1 ELSE 0 END AS benign_neoplasms,
CASE WHEN regexp_matches(main_cause, 'E') THEN 1 ELSE 0 END AS diabetes,
CASE WHEN regexp_matches(main_cause, 'F') THEN 1 ELSE 0 END AS dementia,
CASE WHEN regexp_matches(main_cause, 'G') THEN 1 ELSE 0 END AS nervous_sys,
CASE WHEN regexp_matches(main_cause, 'I2[0-5]') THEN 1 ELSE 0 END AS ischemic_heart,
CASE WHEN regexp_matches(main_cause, 'I2[6-8]') THEN 1 ELSE 0 END AS pulmonary_heart,
CASE WHEN regexp_matches(main_cause, 'I[345]') THEN 1 ELSE 0 END AS other_heart,
CASE WHEN regexp_matches(main_cause, 'I6') THEN 1 ELSE 0 END AS stroke,
CASE WHEN main_cause IN ('B342', 'U071', 'J184') OR regexp_matches(main_cause, 'J') THEN 1 ELSE 0 END AS respiratory,
CASE WHEN regexp_matches(main_cause, 'L') THEN 1 ELSE 0 END AS skin,
CASE WHEN regexp_matches(main_cause, 'M') THEN 1 ELSE 0 END AS musculoskeletal,
CASE WHEN regexp_matches(main_cause, 'N') THEN 1 ELSE 0 END AS genitourinary,
CASE WHEN regexp_matches(main_cause, 'R5') THEN 1 ELSE 0 END AS shock FROM causes)"""


@query("death_causes", views("causes").rstrip() + "," + _CAUSES + " SELECT * FROM d")
def _(spark, sf):
    return death_causes(view(spark, sf, "causes"))


@query("death_composites", views("causes").rstrip() + "," + _CAUSES + """, h AS (SELECT ref, main_cause,
CASE WHEN ischemic_heart = 1 OR pulmonary_heart = 1 OR other_heart = 1 THEN 1 ELSE 0 END AS heart,
CASE WHEN diabetes + ischemic_heart + pulmonary_heart + other_heart + covid + cancer + stroke + nervous_sys + genitourinary = 0 THEN 1 ELSE 0 END AS others FROM d
WHERE main_cause IS NOT NULL) SELECT ref, main_cause, heart, others, 1 AS "all" FROM h""")
def _(spark, sf):
    people = view(spark, sf, "causes")
    known = death_causes(people.filter(F.col("main_cause").isNotNull()))
    # people without a death record have unknown flags and drop out
    joined = people.select("ref").join(known, "ref", "left")
    return death_composites(joined).select("ref", "main_cause", "heart", "others", "all")


_CHARLSON_SQL = """n AS (SELECT ref, replace(diagnosis_code, '.', '') AS c FROM diagnoses),
f AS (SELECT ref,
MAX(CASE WHEN regexp_matches(c, '^41[02]') THEN 1 ELSE 0 END) AS mi,
MAX(CASE WHEN regexp_matches(c, '^(39891|402[019]1|404[019][13]|425[4-9]|428)') THEN 1 ELSE 0 END) AS chf,
MAX(CASE WHEN regexp_matches(c, '^(0930|4373|44[01]|443[1-9]|4471|557[19]|V434)') THEN 1 ELSE 0 END) AS pvd,
MAX(CASE WHEN regexp_matches(c, '^(36234|43[0-8])') THEN 1 ELSE 0 END) AS cevd,
MAX(CASE WHEN regexp_matches(c, '^(290|2941|3312)') THEN 1 ELSE 0 END) AS dementia,
MAX(CASE WHEN regexp_matches(c, '^(416[89]|49[0-9]|50[0-5]|5064|5081|5088)') THEN 1 ELSE 0 END) AS cpd,
MAX(CASE WHEN regexp_matches(c, '^(4465|710[0-4]|714[0-2]|7148|725)') THEN 1 ELSE 0 END) AS rheumd,
MAX(CASE WHEN regexp_matches(c, '^53[1-4]') THEN 1 ELSE 0 END) AS pud,
MAX(CASE WHEN regexp_matches(c, '^(070[23][23]|070[45]4|0706|0709|57[01]|573[3489]|V427)') THEN 1 ELSE 0 END) AS mld,
MAX(CASE WHEN regexp_matches(c, '^250[0-389]') THEN 1 ELSE 0 END) AS diab,
MAX(CASE WHEN regexp_matches(c, '^250[4-7]') THEN 1 ELSE 0 END) AS diabwc,
MAX(CASE WHEN regexp_matches(c, '^(3341|34[23]|344[0-69])') THEN 1 ELSE 0 END) AS hp,
MAX(CASE WHEN regexp_matches(c, '^(403[019]1|404[019][23]|582|583[0-7]|58[56]|5880|V420|V451|V56)') THEN 1 ELSE 0 END) AS rend,
MAX(CASE WHEN regexp_matches(c, '^(1[4-6][0-9]|17[0-2]|17[4-9]|18[0-9]|19[0-5]|20[0-8]|2386)') THEN 1 ELSE 0 END) AS canc,
MAX(CASE WHEN regexp_matches(c, '^(456[0-2]|572[2-8])') THEN 1 ELSE 0 END) AS msld,
MAX(CASE WHEN regexp_matches(c, '^19[6-9]') THEN 1 ELSE 0 END) AS metacanc,
MAX(CASE WHEN regexp_matches(c, '^04[2-4]') THEN 1 ELSE 0 END) AS aids FROM n GROUP BY ref),
cci AS (SELECT *, CASE WHEN mi + chf + pvd + cevd + cpd + rheumd + pud + mld + diab + diabwc + hp + rend + canc + msld + metacanc + aids = 0
THEN 1 ELSE 0 END AS no_disease FROM f)"""


@query("charlson", views("diagnoses").rstrip() + "," + _CHARLSON_SQL + " SELECT * FROM cci")
def _(spark, sf):
    return charlson(view(spark, sf, "diagnoses"))


@query("no_disease_counts", views("diagnoses").rstrip() + "," + _CHARLSON_SQL + """ SELECT no_disease, COUNT(*) AS n,
CAST(SUM(dementia) AS BIGINT) AS dementia FROM cci GROUP BY no_disease""")
def _(spark, sf):
    return charlson(view(spark, sf, "diagnoses")).groupBy("no_disease").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dementia").alias("dementia"))


_BAND = """CASE WHEN age < 60 THEN '<60' WHEN age <= 69 THEN '60-69' WHEN age <= 79 THEN '70-79' WHEN age <= 89 THEN '80-89' WHEN age >= 90 THEN '>=90' END"""
_UTILITY = """CASE WHEN age BETWEEN 18 AND 24 THEN 0.938 WHEN age BETWEEN 25 AND 34 THEN 0.935 WHEN age BETWEEN 35 AND 44 THEN 0.942
WHEN age BETWEEN 45 AND 54 THEN 0.925 WHEN age BETWEEN 55 AND 64 THEN 0.894 WHEN age >= 65 THEN 0.884 ELSE 0.938 END::DOUBLE"""


@query("age_band", views("patients") + f"SELECT ref, {_BAND} AS age_gp FROM patients")
def _(spark, sf):
    return view(spark, sf, "patients").select("ref", age_band("age").alias("age_gp"))


@query("utility_weight", views("patients") + f"SELECT ref, {_UTILITY} AS utility FROM (SELECT ref, NULLIF(age, 50) AS age FROM patients)")
def _(spark, sf):
    p = view(spark, sf, "patients").select("ref", F.expr("nullif(age, 50)").alias("age"))
    return p.select("ref", utility_weight("age").alias("utility"))


@query("life_years_and_qaly", views("patients", "lifetable") + f"""SELECT ref, ROUND(life, 6) AS life, ROUND(life * u, 6) AS qaly FROM (
SELECT ref, {_UTILITY} AS u, (CASE WHEN sex = 'M' THEN 0 ELSE female END + CASE WHEN sex = 'F' THEN 0 ELSE male END)::DOUBLE AS life
FROM patients JOIN lifetable USING (age))""")
def _(spark, sf):
    people = life_years(view(spark, sf, "patients"), view(spark, sf, "lifetable"))
    return rounded(people.select("ref", "life", (F.col("life") * utility_weight("age")).alias("qaly")))


_PAY = """SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'DGS' WHEN 1 THEN 'XDH2' WHEN 2 THEN 'EP' WHEN 3 THEN 'GAZ' WHEN 4 THEN 'PHA'
WHEN 5 THEN 'NEP' WHEN 6 THEN 'P' WHEN 7 THEN 'PA' WHEN 8 THEN 'RH' WHEN 9 THEN 'GAZHA' WHEN 10 THEN 'ZZ' END AS opas,
CASE WHEN c_custkey % 5 < 2 THEN 'PA' WHEN c_custkey % 5 = 3 THEN 'NEP' END AS eis, CASE c_nationkey % 4 WHEN 0 THEN 'CHI' WHEN 1 THEN 'OTH' WHEN 2 THEN 'MACH' END AS race FROM {customer}"""


@query("paycode_class", f"""WITH p AS ({_PAY.format(customer='customer')}), k AS (SELECT c_custkey, CASE WHEN opas LIKE '%DGS%' OR opas LIKE '%DH%' OR opas LIKE '%EP%' THEN 'Non PA'
WHEN opas LIKE '%GAZ%' THEN 'PA' WHEN opas LIKE '%HA%' OR opas LIKE '%NE%' THEN 'Non PA' WHEN opas IN ('P', 'PA') THEN 'PA' WHEN opas LIKE '%RH%' THEN 'Non PA'
ELSE eis END AS paycode FROM p) SELECT c_custkey, paycode, CASE WHEN paycode = 'PA' THEN 'PA' ELSE 'Non PA' END AS paycode_bi FROM k""")
def _(spark, sf):
    p = spark.sql(_PAY, customer=table(spark, sf, "customer"))
    return p.select("c_custkey", paycode_class("opas", "eis").alias("paycode")).withColumn("paycode_bi", paycode_binary("paycode"))


@query("race_flag", f"WITH p AS ({_PAY.format(customer='customer')}) SELECT c_custkey, CASE WHEN race LIKE '%CH%' THEN 'Yes' ELSE 'No' END AS chin FROM p")
def _(spark, sf):
    return spark.sql(_PAY, customer=table(spark, sf, "customer")).select("c_custkey", race_flag("race").alias("chin"))


@query("exclusion_flags", views("patients", "plasma", "interferon") + """SELECT p.ref, p.ref IN (SELECT ref FROM plasma) AS plasma,
p.ref IN (SELECT ref FROM interferon) AS interferon FROM patients p""")
def _(spark, sf):
    out = view(spark, sf, "patients").select("ref")
    for name in ("plasma", "interferon"):
        flag = view(spark, sf, name).select("ref").distinct().withColumn(name, F.lit(True))
        out = out.join(flag, "ref", "left").fillna({name: False})
    return out
