"""Table One, standardised differences and cross-table tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, view, views
from wardline.operators.tables import chi_square, smd_table, table_one

NUMS, CATS = ["age", "acctbal"], ["sex", "segment"]


def _num(var: str, weight: str | None, strata: str | None) -> str:
    s = strata or "'Overall'"
    w = weight or "1.0::DOUBLE"
    return f"""SELECT '{var}' AS variable, NULL AS level, {s} AS stratum, COUNT({var})::DOUBLE AS n, SUM({w}) AS count, NULL::DOUBLE AS percent,
ROUND(SUM({w} * {var}) / SUM({w}), 6) AS mean, ROUND(SQRT((SUM({w} * {var} * {var}) / SUM({w}) - POWER(SUM({w} * {var}) / SUM({w}), 2))
* COUNT(*) / (COUNT(*) - 1)), 6) AS sd FROM patients GROUP BY 3"""


def _cat(var: str, weight: str | None, strata: str | None) -> str:
    s = strata or "'Overall'"
    w = weight or "1.0::DOUBLE"
    return f"""SELECT '{var}', {var}, {s}, COUNT(*)::DOUBLE, SUM({w}), ROUND(100 * SUM({w}) / SUM(SUM({w})) OVER (PARTITION BY {s}), 6), NULL, NULL
FROM patients GROUP BY {var}, {s}"""


def _table_sql(weight: str | None, strata: str | None) -> str:
    return views("patients") + " UNION ALL ".join([_num(v, weight, strata) for v in NUMS] + [_cat(v, weight, strata) for v in CATS])


def _shape(df):
    return rounded(df.select("variable", "level", "stratum", "n", "count", "percent", "mean", "sd"))


@query("table_one_overall", _table_sql(None, None))
def _(spark, sf):
    return _shape(table_one(view(spark, sf, "patients"), NUMS, CATS))


@query("table_one_stratified", _table_sql(None, "arm"))
def _(spark, sf):
    return _shape(table_one(view(spark, sf, "patients"), NUMS, CATS, "arm"))


@query("table_one_weighted", _table_sql("w", "arm"))
def _(spark, sf):
    return _shape(table_one(view(spark, sf, "patients"), NUMS, CATS, "arm", "w"))


@query("table_one_tests")
def _(spark, sf):
    p = view(spark, sf, "patients")
    plain = table_one(p, NUMS, CATS, "arm").select("variable", F.lit("plain").alias("design"), "p_value", "smd").distinct()
    weighted = table_one(p, NUMS, CATS, "arm", "w").select("variable", F.lit("weighted").alias("design"), "p_value", "smd").distinct()
    return rounded(plain.unionByName(weighted))


# Tails in closed form: F with 2 and m degrees of freedom is (1 + 2 F / m) ^ (-m / 2), chi-square with 2 k is a Poisson sum of k terms.
_FLAT = """SELECT '{v}' AS variable, '{d}' AS design, arm, COUNT(*)::DOUBLE AS n, SUM({w}) AS w, SUM({w} * {v}) AS wx, SUM({w} * {v} * {v}) AS wxx,
SUM({w} * {w}) AS w2, SUM({w} * {w} * {v}) AS w2x, SUM({w} * {w} * {v} * {v}) AS w2xx FROM patients WHERE {v} IS NOT NULL GROUP BY arm"""


def _tests_sql() -> str:
    flat = " UNION ALL ".join(_FLAT.format(v=v, d=d, w=w) for v in NUMS for d, w in (("plain", "1.0::DOUBLE"), ("weighted", "w")))
    cells = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS level, arm, COUNT(*)::DOUBLE AS n FROM patients WHERE {v} IS NOT NULL GROUP BY 2, 3" for v in CATS)
    return views("patients").rstrip() + f""", flat AS ({flat}),
f AS (SELECT variable, design, SUM(n) - 3 AS m, (SUM(wx * wx / n) - SUM(wx) * SUM(wx) / SUM(n)) / 2 / ((SUM(wxx) - SUM(wx * wx / n)) / (SUM(n) - 3)) AS f FROM flat WHERE design = 'plain' GROUP BY 1, 2),
s AS (SELECT variable, design, wx / w AS mean, (SUM(n) OVER (PARTITION BY variable, design)) AS nn, ROW_NUMBER() OVER (PARTITION BY variable, design ORDER BY arm) AS k,
GREATEST(w2xx - 2 * wx / w * w2x + wx / w * wx / w * w2, 0) / (w * w) AS v, n FROM flat WHERE design = 'weighted'),
q AS (SELECT a.variable, a.design, a.nn - 3 AS m, b.mean - a.mean AS d1, c.mean - a.mean AS d2, a.nn / (a.nn - 1) AS u, a.v AS va, b.v AS vb, c.v AS vc
FROM s a JOIN s b USING (variable, design) JOIN s c USING (variable, design) WHERE a.k = 1 AND b.k = 2 AND c.k = 3),
w AS (SELECT variable, design, m, (d1 * d1 * (vc + va) - 2 * d1 * d2 * va + d2 * d2 * (vb + va)) / ((vb + va) * (vc + va) - va * va) / u / 2 AS f FROM q),
cell AS ({cells}), col AS (SELECT variable, arm, SUM(n) AS c FROM cell GROUP BY 1, 2), line AS (SELECT variable, level, SUM(n) AS r FROM cell GROUP BY 1, 2),
chi AS (SELECT variable, ANY_VALUE(t) * (SUM(n * n / (r * c)) - 1) / 2 AS x, COUNT(DISTINCT level) - 1 AS k FROM cell JOIN col USING (variable, arm) JOIN line USING (variable, level)
JOIN (SELECT variable, SUM(n) AS t FROM cell GROUP BY 1) USING (variable) GROUP BY variable)
SELECT variable, design, ROUND(POWER(1 + 2 * f / m, -m / 2), 6) AS p_value FROM f UNION ALL SELECT variable, design, ROUND(POWER(1 + 2 * f / m, -m / 2), 6) FROM w
UNION ALL SELECT variable, 'plain', ROUND(EXP(-x) * list_sum(list_transform(range(k), lambda j: POWER(x, j) / factorial(CAST(j AS INTEGER)))), 6) FROM chi"""


@query("table_one_p_values", _tests_sql())
def _(spark, sf):
    p = view(spark, sf, "patients")
    plain = table_one(p, NUMS, CATS, "arm", smd=False).select("variable", F.lit("plain").alias("design"), "p_value").distinct()
    weighted = table_one(p, NUMS, [], "arm", "w", smd=False).select("variable", F.lit("weighted").alias("design"), "p_value").distinct()
    return rounded(plain.unionByName(weighted))


def _smd_sql(w: str) -> str:
    return views("patients") + f""", u AS (SELECT *, CASE WHEN arm = 'Did not use' THEN 0 ELSE 1 END AS used FROM patients),
m AS (SELECT used, SUM({w}) AS sw, SUM({w} * age) / SUM({w}) AS m, (SUM({w} * age * age) / SUM({w}) - POWER(SUM({w} * age) / SUM({w}), 2)) * COUNT(*) / (COUNT(*) - 1) AS v,
SUM(CASE WHEN sex = 'M' THEN {w} ELSE 0 END) / SUM({w}) AS p,
SUM(CASE WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN {w} ELSE 0 END) / SUM({w}) AS b,
SUM(CASE WHEN segment = 'MACHINERY' THEN {w} ELSE 0 END) / SUM({w}) AS c FROM u GROUP BY used),
x AS (SELECT a.m - b.m AS dm, (a.v + b.v) / 2 AS v, a.p - b.p AS dp, (a.p * (1 - a.p) + b.p * (1 - b.p)) / 2 AS vp,
a.b - b.b AS d1, a.c - b.c AS d2, (a.b * (1 - a.b) + b.b * (1 - b.b)) / 2 AS s11, (a.c * (1 - a.c) + b.c * (1 - b.c)) / 2 AS s22,
-(a.b * a.c + b.b * b.c) / 2 AS s12 FROM m a, m b WHERE a.used = 1 AND b.used = 0)
SELECT 'age' AS variable, ROUND(ABS(dm) / SQRT(v), 6) AS smd FROM x UNION ALL SELECT 'sex', ROUND(ABS(dp) / SQRT(vp), 6) FROM x
UNION ALL SELECT 'group3', ROUND(SQRT((d1 * d1 * s22 - 2 * d1 * d2 * s12 + d2 * d2 * s11) / (s11 * s22 - s12 * s12)), 6) FROM x"""


def _smd_frame(spark, sf):
    p = view(spark, sf, "patients").withColumn("used", F.when(F.col("arm") == "Did not use", 0).otherwise(1))
    return p.withColumn("group3", F.when(F.col("segment").isin("BUILDING", "HOUSEHOLD"), "b").when(
        F.col("segment") == "MACHINERY", "c").otherwise("a"))


@query("smd", _smd_sql("1.0::DOUBLE"))
def _(spark, sf):
    return rounded(smd_table(_smd_frame(spark, sf), ["age"], ["sex", "group3"], "used"))


@query("smd_weighted", _smd_sql("w"))
def _(spark, sf):
    return rounded(smd_table(_smd_frame(spark, sf), ["age"], ["sex", "group3"], "used", "w"))


@query("chi_square", views("patients") + """, t AS (SELECT segment, arm, COUNT(*)::DOUBLE AS o FROM patients GROUP BY 1, 2),
e AS (SELECT o, SUM(o) OVER (PARTITION BY segment) * SUM(o) OVER (PARTITION BY arm) / SUM(o) OVER () AS e FROM t)
SELECT ROUND(SUM((o - e) * (o - e) / e), 6) AS chisq, 8 AS df FROM e""")
def _(spark, sf):
    return rounded(chi_square(view(spark, sf, "patients"), "segment", "arm").select("chisq", "df"))


@query("chi_square_2x2", views("patients") + """, t AS (SELECT sex, outcome, COUNT(*)::DOUBLE AS o FROM patients GROUP BY 1, 2),
e AS (SELECT o, SUM(o) OVER (PARTITION BY sex) * SUM(o) OVER (PARTITION BY outcome) / SUM(o) OVER () AS e FROM t),
m AS (SELECT LEAST(0.5, MIN(ABS(o - e))) AS c FROM e)
SELECT ROUND(SUM(POWER(ABS(o - e) - c, 2) / e), 6) AS chisq, 1 AS df FROM e, m""")
def _(spark, sf):
    return rounded(chi_square(view(spark, sf, "patients"), "sex", "outcome").select("chisq", "df"))
