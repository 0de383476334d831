"""Registration of queries and the study views of the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.grouping import gap_to_next

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The study window laid over the supplied order dates.
FLOOR, STAY_END, END = "1996-01-01", "2001-08-15", "2001-09-01"

# Study views as SQL that both engines read; {name} stands for a supplied table.
VIEWS = {
    "patients": """
        SELECT CAST(c_custkey AS STRING) AS ref,
               CAST(18 + (c_custkey * 7) % 85 AS INT) AS age,
               CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Y' ELSE 'N' END AS from_elderly_home,
               c_mktsegment AS segment, c_acctbal AS acctbal,
               CASE WHEN (c_custkey * 37) % 100 + CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 20 ELSE 0 END < 50
                         THEN 'Did not use'
                    WHEN (c_custkey * 37) % 100 + CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 20 ELSE 0 END < 85
                         THEN 'Paxlovid only' ELSE 'Molnupiravir only' END AS arm,
               CASE WHEN (c_custkey * 13) % 10 + CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END >= 6
                         THEN 1 ELSE 0 END AS outcome,
               CAST((c_custkey * 11) % 9 AS INT) AS los, CAST(1 + (c_custkey * 17) % 28 AS INT) AS fu,
               CAST(1 + c_custkey % 3 AS DOUBLE) AS w
        FROM {customer}""",
    "stays": """
        SELECT CAST(o_custkey AS STRING) AS ref, CAST(o_orderkey AS STRING) AS hn_number,
               CAST(o_orderdate AS DATE) AS admission_date,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) END AS discharge_date,
               CASE WHEN o_orderkey % 23 = 0 THEN 'DEATH' WHEN o_orderkey % 7 = 0 THEN 'ACUTE'
                    WHEN o_orderkey % 13 = 0 THEN 'CONV.' ELSE 'HOME' END AS discharge_status,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS INT) END AS length_of_stay,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'A&E' ELSE 'ELECTIVE' END
                   AS admission_source,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS emergency_admission
        FROM {orders}""",
    "tests": """
        SELECT CAST(o_custkey AS STRING) AS ref, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT)
                   AS reference_datetime,
               CASE WHEN o_orderkey % 3 = 0 THEN 'SARS-CoV-2 PCR (nasal)' ELSE 'Rapid antigen' END AS test_description,
               CASE o_orderkey % 4 WHEN 0 THEN 'Detected' WHEN 1 THEN 'Detected  **' WHEN 2 THEN 'Not detected'
                    ELSE 'Detected' END AS result
        FROM {orders}""",
    "dispensing": """
        SELECT CAST(o_custkey AS STRING) AS ref,
               CASE l_returnflag WHEN 'A' THEN 'PAXLOVID TABLET 150MG' WHEN 'N' THEN 'MOLNUPIRAVIR CAPSULE 200MG'
                    ELSE 'OTHER' END AS drug_name,
               CAST(l_shipdate AS DATE) AS prescription_start, CAST(l_quantity AS INT) AS dispensing_duration
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "diagnoses": """
        SELECT CAST(o_custkey AS STRING) AS ref,
               LPAD(CAST((l_partkey * 37 + l_suppkey) % 1000 AS STRING), 3, '0') || '.' ||
               CAST(l_linenumber AS STRING) || CAST(l_suppkey % 10 AS STRING) AS diagnosis_code
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "visits": """
        SELECT CAST(user_id AS STRING) AS ref, CAST(ts AS DATE) AS appointment_date,
               CASE event_type WHEN 'purchase' THEN 'PAXLOVID' WHEN 'signup' THEN 'MOLNUPIRAVIR'
                    WHEN 'error' THEN 'MOLNUPIRAVIR; PAXLOVID' WHEN 'view' THEN 'PARACETAMOL' END AS active_medication,
               event_id, value
        FROM {events}""",
    "plasma": "SELECT CAST(c_custkey AS STRING) AS ref FROM {customer} WHERE c_acctbal < 0",
    "interferon": "SELECT CAST(c_custkey AS STRING) AS ref FROM {customer} WHERE c_nationkey = 7",
    "causes": """
        SELECT CAST(c_custkey AS STRING) AS ref,
               CASE c_custkey % 14 WHEN 0 THEN 'U071' WHEN 1 THEN 'A419' WHEN 2 THEN 'C349' WHEN 3 THEN 'D135'
                    WHEN 4 THEN 'E119' WHEN 5 THEN 'F03' WHEN 6 THEN 'I219' WHEN 7 THEN 'I269' WHEN 8 THEN 'I509'
                    WHEN 9 THEN 'I639' WHEN 10 THEN 'J189' WHEN 11 THEN 'N189' WHEN 12 THEN 'R571' END AS main_cause
        FROM {customer}""",
    "lifetable": """
        SELECT DISTINCT CAST(18 + (c_custkey * 7) % 85 AS INT) AS age,
               88.1 - 0.75 * (18 + (c_custkey * 7) % 85) AS female,
               82.4 - 0.72 * (18 + (c_custkey * 7) % 85) AS male
        FROM {customer}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table; its schema is read from the file once and then given to the scan."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A study view over the supplied tables, as Spark reads it."""
    text = VIEWS[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def views(*names: str) -> str:
    """The same views as leading SQL for the oracle."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ", ".join(parts) + " "


FOLLOWED = """
followed AS (
    SELECT p.ref, p.age, p.sex, p.segment, p.arm, p.w, g.fu, g.event FROM patients p JOIN (
        SELECT ref, CAST(COALESCE(nxt, DATE '2001-08-02') - first_day AS INT) AS fu,
               CASE WHEN nxt IS NULL THEN 0 ELSE 1 END AS event
        FROM (SELECT f.ref, f.first_day, MIN(s.admission_date) AS nxt
              FROM (SELECT ref, MIN(admission_date) AS first_day FROM stays GROUP BY ref) f
              LEFT JOIN stays s ON s.ref = f.ref AND s.admission_date > f.first_day
              GROUP BY f.ref, f.first_day)) g ON p.ref = g.ref)"""


def followed(spark: SparkSession, sf: str) -> DataFrame:
    """One row per patient: days from the first to the next admission day (event), else to the end."""
    days = gap_to_next(view(spark, sf, "stays"), "ref", "admission_date")
    firsts = days.groupBy("ref").agg(F.min_by(F.struct("admission_date", "gap"), "admission_date").alias("s"))
    fu = F.coalesce("s.gap", F.datediff(F.lit("2001-08-02").cast("date"), "s.admission_date"))
    spans = firsts.select("ref", fu.alias("fu"), F.when(F.col("s.gap").isNull(), 0).otherwise(1).alias("event"))
    people = view(spark, sf, "patients").select("ref", "age", "sex", "segment", "arm", "w")
    return people.join(spans, "ref")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n"))
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
