"""Plans: the cohort before the sums, one pass for steps and top lists, percentiles by selection."""

import random

import pytest
from pyspark.sql import functions as F
from wardline.operators.comorbidity import charlson
from wardline.operators.episodes import drug_courses
from wardline.operators.grouping import attrition, describe_num, flag_members, percentiles, top_n
from wardline.plans.deaths import SHOWN, cohort_death_causes, death_cause_table


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def depth(text, word):
    """Lines that hold the word, by how deep they stand in the tree."""
    return [(len(line) - len(line.lstrip(" :+-")), i) for i, line in enumerate(text.split("\n")) if word in line]


@pytest.mark.parametrize("rows", ["diagnoses", "dispensing"])
def test_cohort_stands_below_the_first_aggregate(spark, rows):
    cohort = spark.createDataFrame([("1", "2022-03-01")], "ref string, d string").select("ref", F.to_date("d").alias("start_episode"))
    if rows == "diagnoses":
        out = charlson(spark.createDataFrame([("1", "250.0"), ("2", "140")], "ref string, diagnosis_code string"), cohort=cohort)
        assert [r.ref for r in out.collect()] == ["1"]
    else:
        drugs = spark.createDataFrame([("1", "PAXLOVID", "2022-03-01", 4), ("2", "PAXLOVID", "2022-03-01", 4)],
                                      "ref string, drug_name string, d string, dispensing_duration int")
        out = drug_courses(drugs.withColumn("prescription_start", F.to_date("d")).drop("d"), cohort)
        assert [r.ref for r in out.collect()] == ["1"]
    text = plan(out)
    deepest = max(d for d, _ in depth(text, "Aggregate"))
    assert any(d > deepest for d, _ in depth(text, "Join LeftSemi"))


def test_attrition_reads_the_rows_once(spark, tmp_path):
    spark.createDataFrame([(f"p{i % 40}", i) for i in range(200)], "ref string, v int").write.parquet(str(tmp_path / "x"))
    rows = flag_members(spark.read.parquet(str(tmp_path / "x")), spark.createDataFrame([("p3",), ("p3",), (None,)], "ref string"), "out")
    got = attrition(rows, {"all": F.lit(True), "late": F.col("v") >= 190, "kept": (F.col("v") >= 190) & ~F.col("out"),
                           "none": F.col("v") > 999})
    assert [(r.step_no, r.step, r.patients) for r in got.collect()] == [(1, "all", 40), (2, "late", 10), (3, "kept", 10), (4, "none", 0)]
    assert plan(got).count("Relation") == 1


def test_top_list_in_one_pass(spark):
    df = spark.range(0, 1000, 1, 6).select((F.col("id") % 97).cast("int").alias("v"), "id")
    got = top_n(df, 3, "v")
    assert sorted((r.v, r.id) for r in got.collect()) == sorted((i % 97, i) for i in range(1000) if i % 97 >= 96)
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "WindowGroupLimit" in physical and plan(got).count("Range") == 1


@pytest.mark.parametrize("kinds", [1, 5, 4000])
def test_percentiles_by_selection(spark, kinds):
    rng = random.Random(kinds)
    values = [rng.randrange(kinds) if rng.random() > 0.1 else None for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    known = sorted(v for v in values if v is not None)

    def exact(q):
        h = q * (len(known) - 1)
        low = int(h)
        return known[low] + (h - low) * (known[min(low + 1, len(known) - 1)] - known[low])
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert percentiles(df, "v", at) == pytest.approx([exact(q) for q in at])
    row = describe_num(df, "v").first()
    assert (row.q1, row.median, row.q3, row.nulls) == pytest.approx((exact(.25), exact(.5), exact(.75), values.count(None)))
    assert describe_num(df.filter("v is null"), "v").first().median is None


def test_death_causes_of_a_cohort(spark):
    arms = ["Did not use", "Paxlovid only", "Molnupiravir only"]
    people = spark.createDataFrame([(f"p{i}", arms[i % 3] if i else None, 1) for i in range(30)], "ref string, antiviral string, dementia int")
    codes = ["U071", "C349", "I219", "E119", "K259", None]
    deaths = [(f"p{i}", codes[i % 6]) for i in range(24)] + [("p1", "I639"), ("stranger", "C349"), (None, "C349")]
    causes = cohort_death_causes(people, spark.createDataFrame(deaths, "ref string, main_cause string"))
    rows = causes.collect()
    assert len(rows) == 25 and {r["ref"] for r in rows} == {f"p{i}" for i in range(24)}
    assert {(r["covid"], r["cancer"], r["heart"], r["stroke"], r["diabetes"], r["others"], r["all"]) for r in rows if r["ref"] == "p1"} == {
        (0, 1, 0, 0, 0, 0, 1), (0, 0, 0, 1, 0, 0, 1)}
    assert all(r["others"] == 1 and r["dementia"] == 0 for r in rows if r["ref"] in ("p4", "p5"))
    got = {(r["variable"], r["level"], r["stratum"]): r for r in death_cause_table(causes).collect()}
    assert {k[0] for k in got} == set(SHOWN)
    assert got["heart", "1", "Overall"]["n"] == 4 and got["heart", "1", "Overall"]["p_value"] is None
    in_arm = [r for r in rows if r["antiviral"] == arms[1]]
    cell = got["cancer", "1", arms[1]]
    assert cell["n"] == sum(r["cancer"] for r in in_arm) and cell["percent"] == pytest.approx(100 * cell["n"] / len(in_arm))
    assert 0 < cell["p_value"] <= 1 and cell["smd"] > 0
    assert got["all", "1", arms[1]]["p_value"] is None
    none = cohort_death_causes(people, spark.createDataFrame([], "ref string, main_cause string"))
    assert none.count() == 0 and death_cause_table(none).count() == 0
