"""Hand-made and random frames for the episode operators."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from wardline import study
from wardline.functions.rules import eligible
from wardline.operators import episodes as ep
from wardline.operators.grouping import attrition, repeat_rows, top_n, with_index
from wardline.operators.lookup import exclude, hot_keys, in_cohort, lookup_first

D0 = date(2022, 3, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


def test_covered_days_equal_distinct_days(spark):
    rng = random.Random(7)
    rows = [(f"p{rng.randrange(20)}", rng.randrange(-300, 300), rng.choice([0, 1, 2, 5, 63, 64, 65, 130, 400]))
            for _ in range(600)] + [("p0", None, 4)]
    got = {r.ref: r.days for r in ep.covered_days(
        spark.createDataFrame(rows, "ref string, s int, n int"), "ref", "s", "n").collect()}
    want = {}
    for ref, s, n in rows:
        if s is not None and n > 0:
            want.setdefault(ref, set()).update(range(s, s + n))
    assert got == {k: len(v) for k, v in want.items()}


def test_covered_days_with_dates_before_1970(spark):
    df = spark.createDataFrame([("a", date(1969, 12, 20), 30), ("a", date(1970, 1, 1), 2)], "ref string, s date, n int")
    assert ep.covered_days(df, "ref", "s", "n").first().days == 30


def chain_by_hand(rows, passes=6):
    """The pruning passes on one patient's (start, end) list."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] is None, r[1] or 0))
    out = [list(r) for r in rows]
    for i in range(passes):
        out = [[s, e if e is not None else (out[j + 1][1] if j + 1 < len(out) else None)] for j, (s, e) in enumerate(out)]
        gaps = [None] + [None if out[j - 1][1] is None else out[j][0] - out[j - 1][1] for j in range(1, len(out))]
        if i < passes - 1:
            out = [r for r, g in zip(out, gaps) if g is None or g >= 0]
    return [(s, e, g, study.FIRST_ADMISSION if j == 0 else (j if g is not None else None))
            for j, ((s, e), g) in enumerate(zip(out, gaps))]


def test_readmission_chain_random(spark):
    rng = random.Random(3)
    rows = [(f"p{i % 25}", s := rng.randrange(60), None if rng.random() < .2 else s + rng.randrange(12)) for i in range(250)]
    got = {}
    for r in ep.readmission_chain(spark.createDataFrame(rows, "ref string, start_day int, end_day int")).collect():
        got.setdefault(r.ref, []).append((r.start_day, r.end_day, r.gap_time, r.gap_mark))
    for ref in {r[0] for r in rows}:
        want = chain_by_hand([(s, e) for p, s, e in rows if p == ref])
        assert sorted(got[ref], key=str) == sorted(want, key=str)


def test_readmission_chain_drops_both_overlapping_stays_at_once(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 30), ("a", 20, 25), ("a", 40, 41)], "ref string, start_day int, end_day int")
    kept = [(r.start_day, r.gap_time) for r in ep.readmission_chain(df).orderBy("start_day").collect()]
    assert kept == [(0, None), (40, 30)]


def test_chain_keeps_disjoint_stays(spark):
    df = spark.createDataFrame([("a", 10 * i, 10 * i + 3) for i in range(6)], "ref string, start_day int, end_day int")
    assert ep.readmission_chain(df).filter("gap_time = 7").count() == 5


def test_readmission_chain_has_one_sort(spark):
    df = spark.createDataFrame([("a", 0, 1)], "ref string, start_day int, end_day int")
    plan = ep.readmission_chain(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", day(1), "1")], "ref string, admission_date date, hn_number string")
    plan = ep.first_episode(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_merge_intervals_keeps_the_latest_end(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 30), ("a", 20, 25), ("a", 31, 33), ("b", 5, None)], "ref string, s int, e int")
    rows = [(r.ref, r.s, r.e) for r in ep.merge_intervals(df, "ref", "s", "e").orderBy("ref", "s").collect()]
    assert rows == [("a", 0, 30), ("a", 31, 33), ("b", 5, 5)]


STAYS = "ref string, hn_number string, admission_date date, discharge_date date, discharge_status string, length_of_stay int"


def test_length_of_stay(spark):
    stays = spark.createDataFrame([
        ("a", "1", day(0), day(3), "HOME", 3),       # 4 days
        ("a", "2", day(2), day(2), "HOME", 0),       # inside
        ("a", "3", day(10), None, None, None),       # to the cohort end: day 10..12
        ("b", "4", day(-5), day(4), "HOME", 9),      # before the index day
        ("c", "5", day(1), day(1), "HOME", 0)], STAYS)
    cohort = spark.createDataFrame([(r, day(0)) for r in "abcd"], "ref string, start_episode date")
    got = {r.ref: r.los for r in ep.length_of_stay(stays, cohort, str(day(12))).collect()}
    assert got == {"a": 7, "b": 0, "c": 1, "d": 0}


def test_effective_end(spark):
    stays = spark.createDataFrame([("a", "1", day(0), day(3), s, 3) for s in ("HOME", "ACUTE", "CONV.", None)], STAYS)
    assert [r.end_date for r in ep.effective_end(stays).collect()] == [day(3), None, None, day(3)]


def test_positive_tests(spark):
    df = spark.createDataFrame([("a", "xx PCR", "Detected  **"), ("b", "PCR", "Detected *"), ("c", "PCR", "Detected"),
                                ("d", "antigen", "Detected"), ("e", "PCR", "Not detected")], "ref string, test_description string, result string")
    assert sorted(r.ref for r in ep.positive_tests(df).collect()) == ["a", "c"]


def test_follow_up_modes(spark):
    cohort = spark.createDataFrame([(r, day(0)) for r in "abc"], "ref string, start_episode date")
    stays = spark.createDataFrame([("a", "1", day(0), day(6), "DEATH", 6), ("b", "2", day(1), None, "DEATH", None)], STAYS)
    deaths = ep.first_death(stays)
    by_date = {r.ref: (r.dead, r.fu) for r in ep.follow_up(cohort, deaths, str(day(20))).collect()}
    by_record = {r.ref: (r.dead, r.fu) for r in ep.follow_up(cohort, deaths, str(day(20)), dead_by="record").collect()}
    assert by_date == {"a": (1, 6), "b": (0, 20), "c": (0, 20)}
    assert by_record == {"a": (1, 6), "b": (1, 20), "c": (0, 20)}


def test_drug_courses_and_both_drugs(spark):
    cohort = spark.createDataFrame([(r, day(0)) for r in "ab"], "ref string, start_episode date")
    disp = spark.createDataFrame([
        ("a", "PAXLOVID X", day(1), 4), ("a", "PAXLOVID X", day(1), 2), ("a", "MOLNUPIRAVIR", day(3), 2),
        ("a", "PAXLOVID X", day(-1), 9), ("b", "ASPIRIN", day(1), 5)],
        "ref string, drug_name string, prescription_start date, dispensing_duration int")
    courses = ep.drug_courses(disp, cohort)
    got = {(r.paxlovid, r.molnupiravir): (r.duration, r.cost, r.antiviral_course, r.start_drug) for r in courses.collect()}
    assert got == {(True, False): (5, 529, 2, 1), (False, True): (3, 424, 1, 1)}
    people = {r.ref: (r.paxlovid, r.molnupiravir, r.antiviral_course, r.start_drug) for r in ep.with_courses(cohort, courses).collect()}
    assert people == {"a": (1, 1, 2, 1), "b": (0, 0, 0, 0)}


def test_eligibility_ages(spark):
    rows = [(9, 1), (9, 0), (60, 1), (60, None), (100, None), (100, 1), (59, None), (None, 0), (None, 1)]
    df = spark.createDataFrame(rows, "age int, no_disease int").filter(eligible())
    assert sorted((r.age or -1, r.no_disease if r.no_disease is not None else -1) for r in df.collect()) == sorted(
        [(9, 0), (60, 1), (60, -1), (100, -1), (100, 1), (-1, 0)])


def test_visit_course_cost(spark):
    v = spark.createDataFrame([("a", day(0), "PAXLOVID"), ("a", day(3), "PAXLOVID"), ("b", day(0), "MOLNUPIRAVIR"),
                               ("c", day(0), "MOLNUPIRAVIR"), ("c", day(9), "PAXLOVID"), ("d", day(0), "ASPIRIN"),
                               ("e", day(0), "PAXLOVID"), ("e", day(0), "PAXLOVID")],
                              "ref string, appointment_date date, active_medication string")
    got = {r.ref: round(r.dc_drug_cost, 6) for r in ep.visit_course_cost(v).collect()}
    assert got == {"a": 317.4, "b": 707.0, "c": 707.0, "e": 0.0}


def test_lookup_first_keeps_left_rows_and_null_of_first(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "ref string")
    right = spark.createDataFrame([("a", 2, "late"), ("a", 1, None), ("b", 5, "only")], "ref string, o int, v string")
    plain = sorted((r.ref, r.v or "") for r in lookup_first(left, right, "ref", ["v"], "o").collect())
    hot = sorted((r.ref, r.v or "") for r in lookup_first(left, right, "ref", ["v"], "o", hot=["a"]).collect())
    assert plain == hot == [("a", ""), ("a", ""), ("b", "only"), ("z", "")]


def test_hot_key_joins_give_the_same_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("ref"), "id")
    hot = hot_keys(df, "ref", 0.1)
    assert hot == ["hot"]
    out = spark.createDataFrame([("hot",), ("k1",)], "ref string")
    assert exclude(df, out, hot=hot).count() == exclude(df, out).count() == 1999
    assert in_cohort(df, out, hot=hot).count() == in_cohort(df, out).count() == 1001


def test_repeat_rows_and_top_n_ties(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 1, 7.0), ("b", 2, None)], "ref string, o int, v double")
    assert sorted((r.ref, r.o) for r in repeat_rows(df, "ref", "o").collect()) == [("a", 2), ("a", 3), ("b", 2)]
    assert top_n(df, 2, "v").count() == 3


def test_with_index_is_dense(spark):
    df = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("ref")).repartition(13)
    got = [(r["index"], r.ref) for r in with_index(df).orderBy("index").collect()]
    assert got == [(i + 1, f"{i:05d}") for i in range(5000)]


def test_attrition_never_grows(spark):
    a = spark.createDataFrame([(str(i), i) for i in range(9)], "ref string, v int")
    rows = attrition(a, {"all": F.lit(True), "some": F.expr("v > 3"), "few": F.expr("v > 6")}).orderBy("step_no").collect()
    assert [r.patients for r in rows] == [9, 5, 2]


@pytest.mark.parametrize("hi,want", [(7, 0), (8, 1)])
def test_within_flags_uses_the_smallest_gap(spark, hi, want):
    cohort = spark.createDataFrame([("a",), ("b",)], "ref string")
    gaps = spark.createDataFrame([("a", 8), ("a", 30), ("a", None)], "ref string, gap_time int")
    row = ep.within_flags(gaps, cohort, days=(hi,)).filter("ref = 'a'").first()
    assert row[f"unplan_{hi}d"] == want
