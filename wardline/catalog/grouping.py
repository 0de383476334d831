"""Counts, firsts, gaps, top lists, unions and expansions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, table, view, views
from wardline.operators.grouping import (attrition, count_by, count_visits, describe_num, expand_days, expand_rows,
                                         first_per_key, flag_members, freq, gap_to_next, hist_bins, repeat_rows, tagged_union, top_n,
                                         value_range, with_index)
from wardline.operators.lookup import exclude


@query("count_by", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return count_by(table(spark, sf, "orders"), "o_custkey")


@query("sum_per_key", "SELECT o_custkey, ROUND(SUM(o_totalprice), 4) AS total FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return rounded(table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), 4)


@query("min_max_per_key", "SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_day, CAST(MAX(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.groupBy("o_custkey").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("attrition", views("stays", "plasma", "interferon") + """, a AS (SELECT * FROM stays WHERE admission_date >= DATE '1996-01-01'),
b AS (SELECT * FROM a WHERE ref NOT IN (SELECT ref FROM plasma)), c AS (SELECT * FROM b WHERE ref NOT IN (SELECT ref FROM interferon))
SELECT 1 AS step_no, 'all stays' AS step, COUNT(DISTINCT ref) AS patients FROM stays UNION ALL SELECT 2, 'after the floor', COUNT(DISTINCT ref) FROM a
UNION ALL SELECT 3, 'without plasma', COUNT(DISTINCT ref) FROM b UNION ALL SELECT 4, 'without interferon', COUNT(DISTINCT ref) FROM c""")
def _(spark, sf):
    stays = view(spark, sf, "stays").select("ref", "admission_date")
    marked = flag_members(flag_members(stays, view(spark, sf, "plasma"), "plasma"), view(spark, sf, "interferon"), "interferon")
    floor = F.col("admission_date") >= F.lit("1996-01-01").cast("date")
    return attrition(marked, {"all stays": F.lit(True), "after the floor": floor, "without plasma": floor & ~F.col("plasma"),
                              "without interferon": floor & ~F.col("plasma") & ~F.col("interferon")})


@query("freq_one_way", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return freq(table(spark, sf, "events"), "event_type")


@query("freq_two_way", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return freq(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("describe_num", views("stays") + """SELECT CAST(MIN(length_of_stay) AS DOUBLE) AS min, QUANTILE_CONT(length_of_stay, 0.25) AS q1,
QUANTILE_CONT(length_of_stay, 0.5) AS median, ROUND(AVG(length_of_stay), 6) AS mean, QUANTILE_CONT(length_of_stay, 0.75) AS q3,
CAST(MAX(length_of_stay) AS DOUBLE) AS max, COUNT(*) FILTER (WHERE length_of_stay IS NULL) AS nulls FROM stays""")
def _(spark, sf):
    return rounded(describe_num(view(spark, sf, "stays"), "length_of_stay"))


@query("value_range", views("dispensing") + "SELECT MIN(prescription_start) AS min, MAX(prescription_start) AS max FROM dispensing")
def _(spark, sf):
    return value_range(view(spark, sf, "dispensing"), "prescription_start")


@query("hist_bins", views("stays") + """, b AS (SELECT CAST(CASE WHEN length_of_stay <= 5 THEN 0 ELSE CEIL(length_of_stay / 5.0) - 1 END AS INT) AS bin
FROM stays WHERE length_of_stay IS NOT NULL) SELECT bin, bin * 5 AS low, bin * 5 + 5 AS high, COUNT(*) AS n FROM b GROUP BY bin""")
def _(spark, sf):
    return hist_bins(view(spark, sf, "stays"), "length_of_stay", list(range(0, 45, 5)))


@query("count_visits", views("visits") + "SELECT ref, COUNT(DISTINCT appointment_date) AS visits FROM visits GROUP BY ref")
def _(spark, sf):
    return count_visits(view(spark, sf, "visits"))


@query("first_per_key", """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("repeat_rows", """SELECT o_custkey, o_orderkey FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return repeat_rows(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("longest_per_day", views("stays") + """SELECT ref, admission_date, hn_number, length_of_stay FROM stays
QUALIFY ROW_NUMBER() OVER (PARTITION BY ref, admission_date ORDER BY length_of_stay DESC NULLS LAST, hn_number) = 1""")
def _(spark, sf):
    s = view(spark, sf, "stays").select("ref", "admission_date", "hn_number", "length_of_stay")
    return first_per_key(s, ["ref", "admission_date"], [F.desc_nulls_last("length_of_stay"), "hn_number"])


@query("gap_to_next", views("visits") + """, d AS (SELECT ref, appointment_date, COUNT(*) AS rows FROM visits GROUP BY 1, 2)
SELECT ref, appointment_date, rows, CAST(LEAD(appointment_date) OVER (PARTITION BY ref ORDER BY appointment_date) - appointment_date AS INT) AS gap FROM d""")
def _(spark, sf):
    return gap_to_next(view(spark, sf, "visits"), "ref", "appointment_date")


@query("fill_end_and_gap", views("stays") + """, s AS (SELECT DISTINCT ref, admission_date AS a, discharge_date AS e FROM stays),
f AS (SELECT ref, a, COALESCE(e, LEAD(e) OVER w) AS e, e AS e0 FROM s WINDOW w AS (PARTITION BY ref ORDER BY a, e NULLS LAST))
SELECT ref, a, e, CAST(a - LAG(e) OVER w AS INT) AS gap, CASE WHEN a - LAG(e) OVER w IS NOT NULL THEN CAST(ROW_NUMBER() OVER w - 1 AS INT) END AS nth
FROM f WINDOW w AS (PARTITION BY ref ORDER BY a, e0 NULLS LAST)""")
def _(spark, sf):
    from pyspark.sql import Window
    s = view(spark, sf, "stays").select("ref", F.col("admission_date").alias("a"), F.col("discharge_date").alias("e")).distinct()
    w = Window.partitionBy("ref").orderBy("a", F.col("e0").asc_nulls_last())
    filled = s.withColumn("e0", F.col("e")).withColumn("e", F.coalesce("e", F.lead("e").over(w)))
    gaps = filled.withColumn("gap", F.datediff("a", F.lag("e").over(w)))
    return gaps.withColumn("nth", F.when(F.col("gap").isNotNull(), F.row_number().over(w) - 1)).drop("e0")


@query("row_number_in_group", """SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey)::INT AS nth FROM orders""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("nth"))


@query("dedupe_days", views("visits") + "SELECT DISTINCT ref, active_medication, appointment_date FROM visits")
def _(spark, sf):
    return view(spark, sf, "visits").select("ref", "active_medication", "appointment_date").dropDuplicates()


@query("with_index", views("patients") + """SELECT ref, age, ROW_NUMBER() OVER (ORDER BY ref) AS "index" FROM patients""")
def _(spark, sf):
    return with_index(view(spark, sf, "patients").select("ref", "age"))


@query("sorted_offsets", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("top_n", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >=
(SELECT MIN(q) FROM (SELECT l_quantity AS q FROM lineitem ORDER BY l_quantity DESC LIMIT 3))""")
def _(spark, sf):
    return top_n(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 3, "l_quantity")


@query("tagged_union", """SELECT DISTINCT o_orderkey, o_custkey, 'dx' AS key FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT DISTINCT o_orderkey, o_custkey, 'pcr' FROM orders WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    dx = o.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    pcr = o.filter(F.col("o_orderstatus") != "P").drop("o_orderstatus")
    return tagged_union({"dx": dx, "pcr": pcr}, "key").distinct()


@query("union_missing_columns", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("expand_rows", "SELECT p_partkey, CAST(u AS INT) AS copy FROM part, UNNEST(GENERATE_SERIES(1, p_size - 10)) AS t(u) WHERE p_size > 10")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 10).alias("n"))
    return expand_rows(parts, "n").drop("n")


@query("expand_days", views("stays") + """SELECT hn_number, admission_date + CAST(u - 1 AS INT) AS day FROM stays,
UNNEST(GENERATE_SERIES(1, length_of_stay)) AS t(u) WHERE length_of_stay > 0""")
def _(spark, sf):
    return expand_days(view(spark, sf, "stays"), "admission_date", "length_of_stay").select("hn_number", "day")
