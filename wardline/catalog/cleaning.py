"""Projections, filters, recodes and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, table, view, views
from wardline.functions.exprs import any_of, case_when, contains_any, if_else, known, recode
from wardline.functions.rules import eligible
from wardline.operators.clean import (as_levels, between_dates, cast_cols, covariates_except, dedupe_rows, fill_zero,
                                      level_audit, null_audit, require, rows_with_null, select_range, strip_zeros)
from wardline.operators.comorbidity import charlson


@query("require_nonblank", """
SELECT event_id, event_type FROM events WHERE NULLIF(NULLIF(event_type, 'click'), '') IS NOT NULL AND event_type <> 'view'""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "")
                                          .when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"))
    return require(e, "event_type")


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(spark, sf):
    return dedupe_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("select_range", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return select_range(table(spark, sf, "lineitem"), "l_quantity", "l_tax", "l_orderkey")


@query("date_window", views("stays") + """
SELECT ref, hn_number, admission_date FROM stays WHERE admission_date >= DATE '1997-03-01' AND admission_date <= DATE '1999-05-31'""")
def _(spark, sf):
    return between_dates(view(spark, sf, "stays"), "admission_date", "1997-03-01", "1999-05-31").select(
        "ref", "hn_number", "admission_date")


@query("number_range", views("stays") + "SELECT ref, hn_number, length_of_stay FROM stays WHERE length_of_stay BETWEEN 0 AND 28")
def _(spark, sf):
    return view(spark, sf, "stays").filter(F.col("length_of_stay").between(0, 28)).select("ref", "hn_number", "length_of_stay")


@query("set_filter", views("stays") + "SELECT ref, hn_number FROM stays WHERE discharge_status IN ('ACUTE', 'CONV.') AND admission_source = 'A&E'")
def _(spark, sf):
    s = view(spark, sf, "stays")
    return s.filter(F.col("discharge_status").isin("ACUTE", "CONV.") & (F.col("admission_source") == "A&E")).select(
        "ref", "hn_number")


@query("contains_any", "SELECT p_partkey, p_name LIKE '%red%' OR p_name LIKE '%bolt%' AS flagged FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", contains_any("p_name", ["red", "bolt"]).alias("flagged"))


@query("lookup_absence", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


_NO_DISEASE = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END"
_AGE = "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(18 + (c_custkey * 7) % 85 AS INT) END"


@query("eligible", f"SELECT c_custkey, {_AGE} AS age FROM customer WHERE ({_AGE}) >= 60 OR ({_NO_DISEASE}) = 0")
def _(spark, sf):
    people = table(spark, sf, "customer").selectExpr("c_custkey", f"{_AGE} AS age", f"{_NO_DISEASE} AS no_disease")
    return people.filter(eligible()).select("c_custkey", "age")


@query("case_when", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN NULLIF(p_size, 20) > 15 THEN 'large' ELSE 'other' END AS class FROM part""")
def _(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", case_when(
        [(size < 10, "small"), (F.nullif(size, F.lit(20)) > 15, "large")], "other").alias("class"))


@query("if_else", """
SELECT p_partkey, CASE WHEN NULLIF(p_size, 20) >= 15 THEN 1 WHEN NOT (NULLIF(p_size, 20) >= 15) THEN 0 END AS flag,
CASE WHEN NULLIF(p_size, 20) IS NOT NULL THEN 1 END AS known FROM part""")
def _(spark, sf):
    size = F.nullif(F.col("p_size"), F.lit(20))
    return table(spark, sf, "part").select("p_partkey", if_else(size >= 15, F.lit(1), F.lit(0)).alias("flag"),
                                           known(size).alias("known"))


@query("fill_zero", views("stays") + "SELECT hn_number, COALESCE(length_of_stay, 0) AS length_of_stay FROM stays")
def _(spark, sf):
    return fill_zero(view(spark, sf, "stays").select("hn_number", "length_of_stay"), ["length_of_stay"])


@query("recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS status FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", recode("o_orderstatus", {"F": "Finished", "O": "Open"}).alias("status"))


@query("as_levels", "SELECT CAST(p_size AS STRING) AS p_size, p_type, COUNT(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    return as_levels(table(spark, sf, "part"), ["p_size", "p_type"]).groupBy("p_size", "p_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("cast_cols", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(user_id AS STRING) END AS INT) AS code,
TRY_CAST(CASE WHEN event_type = 'click' THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) || ' 10:30:00' END AS TIMESTAMP)::DATE AS day
FROM events""")
def _(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string")).alias("code"),
        F.when(F.col("event_type") == "click", "").otherwise(
            F.concat(F.col("ts").cast("date").cast("string"), F.lit(" 10:30:00"))).alias("day"))
    return cast_cols(text, {"code": "int", "day": "date"})


_NULLED = "SELECT NULLIF(o_orderstatus, 'P') AS status, NULLIF(o_orderpriority, '5-LOW') AS priority, o_orderkey FROM orders"


def _nulled(spark, sf):
    return table(spark, sf, "orders").selectExpr("nullif(o_orderstatus, 'P') AS status",
                                                 "nullif(o_orderpriority, '5-LOW') AS priority", "o_orderkey")


@query("null_audit", f"""WITH t AS ({_NULLED}), a AS (SELECT COUNT(*) FILTER (WHERE status IS NULL) AS s,
COUNT(*) FILTER (WHERE priority IS NULL) AS p, COUNT(*) FILTER (WHERE status IS NULL OR priority IS NULL) AS e FROM t)
SELECT 'status' AS "column", s AS rows_null, e AS rows_any_null FROM a UNION ALL SELECT 'priority', p, e FROM a""")
def _(spark, sf):
    return null_audit(_nulled(spark, sf), ["status", "priority"])


@query("rows_with_null", f"WITH t AS ({_NULLED}) SELECT * FROM t WHERE status IS NULL OR priority IS NULL")
def _(spark, sf):
    return rows_with_null(_nulled(spark, sf), ["status", "priority"])


@query("level_audit", f"""WITH t AS ({_NULLED}) SELECT 'status' AS "column", status AS level, COUNT(*) AS n FROM t GROUP BY 2
UNION ALL SELECT 'priority', priority, COUNT(*) FROM t GROUP BY 2""")
def _(spark, sf):
    return level_audit(_nulled(spark, sf), ["status", "priority"])


@query("constant_and_drop", "SELECT s_suppkey, s_nationkey, 1 AS key FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumn("key", F.lit(1))
    return s.select(covariates_except(s, ["s_name", "s_acctbal"]))


@query("strip_zeros", "SELECT c_custkey, LTRIM(LPAD(CAST(c_custkey + 1 AS STRING), 9, '0'), '0') AS ref FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", strip_zeros(
        F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")).alias("ref"))


@query("any_of_flags", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.05 OR l_quantity > 40")
def _(spark, sf):
    return table(spark, sf, "lineitem").filter(any_of([F.col("l_tax") > 0.05, F.col("l_discount") > 0.05, F.col("l_quantity") > 40])
                                               ).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
