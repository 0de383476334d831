"""Sources and sinks: the supplied tables are written as text extracts and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded, table, view, views
from wardline.operators.tables import report_rows, table_one
from wardline.session import shared_dir
from wardline.sources.extracts import lookup_frame, normalise_header, read_extract
from wardline.sources.stages import export_table, load_stage, save_stage


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/extracts-{uuid.uuid4().hex}"


@query("read_extract", views("stays") + """
SELECT ref, CAST(admission_date AS STRING) AS admission_date, CASE WHEN admission_source = 'A&E' THEN discharge_status END
AS discharge_status, admission_source FROM stays""")
def _(spark, sf):
    folder = _folder(spark)
    stays = view(spark, sf, "stays").select("ref", "admission_date", "discharge_status", "admission_source")
    for source, name, cols in (("A&E", "_Hosp_x_(PCR)_IP", ["ref", "admission_date", "discharge_status", "admission_source"]),
                               ("ELECTIVE", "_Hosp_y_(PCR)_IP", ["ref", "admission_date", "admission_source"])):
        stays.filter(F.col("admission_source") == source).select(cols).write.option("header", True).csv(f"{folder}/{name}")
    stays.limit(5).write.option("header", True).csv(f"{folder}/other")
    return _union_of_folders(spark, folder)


def _union_of_folders(spark, folder):
    from functools import reduce

    from pyspark.sql import DataFrame

    from wardline.sources.extracts import list_files
    parts = [read_extract(spark, path, r"^part-.+csv$") for path in list_files(spark, folder, r"_Hosp_.+(PCR).+IP")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(
        "ref", "admission_date", "discharge_status", "admission_source")


@query("read_extract_parquet", "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM nation")
def _(spark, sf):
    return read_extract(spark, sf, r"^nation\.parquet$", format="parquet")


@query("extract_order", "SELECT COUNT(*) AS n, COUNT(*) AS distinct_positions FROM orders")
def _(spark, sf):
    rows = read_extract(spark, sf, r"^orders\.parquet$", columns=["o_orderkey"], format="parquet", with_order=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_ord").alias("distinct_positions"))


@query("normalise_header", "SELECT CAST(c_custkey AS STRING) AS ref, c_name AS full_name, c_mktsegment AS c_mktsegment FROM customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Reference Key."), F.col("c_name").alias("Full Name (English)"),
        F.col("c_mktsegment").alias("C.MktSegment"))
    return normalise_header(raw, {"Full Name (English)": "full_name", "C.MktSegment": "c_mktsegment"})


@query("stage_round_trip", views("stays") + "SELECT ref, hn_number, admission_date, length_of_stay FROM stays")
def _(spark, sf):
    name = f"stays-{uuid.uuid4().hex}"
    save_stage(view(spark, sf, "stays").select("ref", "hn_number", "admission_date", "length_of_stay"), name)
    return load_stage(spark, name)


@query("export_table", "SELECT c_mktsegment AS segment, CAST(COUNT(*) AS STRING) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    path = f"{_folder(spark)}/segments"
    export_table(table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, header=True)


@query("report_matrix", views("patients") + """
SELECT variable, level, stratum, text FROM (
SELECT 'sex' AS variable, sex AS level, arm AS stratum,
       printf('%.1f (%.1f)', CAST(COUNT(*) AS DOUBLE), 100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY arm)) AS text
FROM patients GROUP BY sex, arm
UNION ALL
SELECT 'age', NULL, arm, printf('%.2f (%.2f)', AVG(age), STDDEV_SAMP(age)) FROM patients GROUP BY arm)""")
def _(spark, sf):
    t = table_one(view(spark, sf, "patients"), ["age"], ["sex"], "arm")
    return report_rows(t).select("variable", "level", "stratum", "text")


@query("lookup_codes", """
SELECT o_orderstatus AS code, label, COUNT(*) AS n FROM orders JOIN
(VALUES ('F', 'finished'), ('O', 'open'), ('P', 'partial')) AS c(code, label) ON o_orderstatus = code GROUP BY 1, 2""")
def _(spark, sf):
    codes = lookup_frame(spark, [("F", "finished"), ("O", "open"), ("P", "partial")], "code string, label string")
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(codes), "code").select("code", "label", "n")
