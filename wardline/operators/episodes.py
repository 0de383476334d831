"""Stays, drug courses, visits: covered days, readmissions, follow-up and costs.

Rows are brought to patient-day grain by combining aggregates before anything per-patient
happens, so the work per patient is bounded by the calendar and not by its row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.exprs import contains_any
from wardline.functions.rules import treatment_arm
from wardline.operators.grouping import first_per_key
from wardline.operators.lookup import events_after_index, first_rows, in_cohort, of_cohort


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


# --- covered days -----------------------------------------------------------------------------

def _day_number(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    return F.unix_date(c) if dict(df.dtypes)[col] == "date" else c.cast("int")


def covered_days(df: DataFrame, keys, start: str, length: str, name: str = "days",
                 first_name: str | None = None) -> DataFrame:
    """Distinct days covered by a key's (possibly overlapping) intervals.

    Each interval becomes one 64-day bitmap per calendar word it touches; words are OR-ed per
    (key, word), which combines map-side, and the set bits are counted.  No row per day, no
    sort and no per-patient window.  Intervals without a start or with no day are ignored.
    ``first_name`` adds the earliest start (as a day number) under that name.
    """
    keys = _list(keys)
    first, days = _day_number(df, start), F.col(length).cast("int")
    spans = df.select(*keys, first.alias("_lo"), (first + days - 1).alias("_hi")).filter(
        F.col("_lo").isNotNull() & (F.col("_hi") >= F.col("_lo")))
    # an arithmetic shift by six is the floor of a division by 64, also before 1970
    words = spans.select("*", F.explode(F.sequence(F.shiftright("_lo", 6), F.shiftright("_hi", 6))).alias("_word"))
    low_bit = F.greatest(F.col("_lo") - F.shiftleft("_word", 6), F.lit(0))
    high_bit = F.least(F.col("_hi") - F.shiftleft("_word", 6), F.lit(63))
    bits = words.select(*keys, "_lo", "_word", low_bit.alias("_a"), high_bit.alias("_b")).withColumn(
        "_mask", F.expr("shiftleft(-1L, _a) & shiftrightunsigned(-1L, 63 - _b)"))
    kept = [F.min("_lo").alias("_lo")] if first_name else []
    merged = bits.groupBy(*keys, "_word").agg(F.bit_or("_mask").alias("_mask"), *kept)
    kept = [F.min("_lo").alias(first_name)] if first_name else []
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("_mask")).alias(name), *kept)


def merge_intervals(df: DataFrame, key, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals joined into islands that keep the latest end.

    A missing end counts as a one-point interval.  The first step keeps one row per start.
    """
    keys = _list(key)
    longest = df.filter(F.col(start).isNotNull()).groupBy(*keys, start).agg(
        F.max(F.coalesce(F.col(end), F.col(start))).alias(end))
    w = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    islands = longest.withColumn("_open", opens).withColumn("island", F.sum("_open").over(w))
    return islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


# --- inpatient stays ----------------------------------------------------------------------------

def positive_tests(df: DataFrame, description: str = "test_description", result: str = "result") -> DataFrame:
    return df.filter(F.col(description).contains("PCR") & F.col(result).isin(*study.POSITIVE_RESULTS))


def effective_end(df: DataFrame, status: str = "discharge_status", end: str = "discharge_date",
                  name: str = "end_date") -> DataFrame:
    """Discharge date, but unknown for a transfer.  An unknown status leaves the date."""
    return df.withColumn(name, F.when(F.col(status).isin(*study.TRANSFER_STATUSES), F.lit(None).cast("date"))
                         .otherwise(F.col(end)))


def first_episode(stays: DataFrame, key: str = "ref", order=("admission_date", "hn_number")) -> DataFrame:
    return first_per_key(stays, key, list(order))


def index_date(first_stays: DataFrame, tests: DataFrame, floor: str = study.INDEX_FLOOR, key: str = "ref",
               test_date: str = "reference_datetime", admission: str = "admission_date",
               name: str = "start_episode") -> DataFrame:
    """First positive test day when there is one, else the admission day; at or after the floor."""
    tested = tests.groupBy(key).agg(F.min(test_date).alias("pcr_date"))
    return first_stays.join(tested, key, "left").withColumn(
        name, F.coalesce("pcr_date", admission)).filter(F.col(name) >= F.lit(floor).cast("date"))


def length_of_stay(stays: DataFrame, cohort: DataFrame, cohort_end: str = study.STAY_END, key: str = "ref",
                   admission: str = "admission_date", stay: str = "length_of_stay",
                   index: str = "start_episode", name: str = "los") -> DataFrame:
    """Days in hospital from the index day on, 0 without a stay.

    A missing length runs to the end of the cohort; admission day and discharge day both
    count.  Only the longest stay per admission day goes into the join, so a patient brings
    at most one row per calendar day.
    """
    end = F.lit(cohort_end).cast("date")
    held = F.coalesce(F.col(stay), F.datediff(end, admission)) + 1
    longest = stays.groupBy(key, admission).agg(F.max(held).alias("_held"))
    dated = longest.join(cohort.select(key, index), key).filter(F.col(admission) >= F.col(index))
    days = covered_days(dated, key, admission, "_held", name)
    return cohort.join(days, key, "left").fillna({name: 0})


def stay_offsets(stays: DataFrame, cohort: DataFrame, key: str = "ref", admission: str = "admission_date",
                 end: str = "end_date", index: str = "start_episode") -> DataFrame:
    """Distinct (patient, start day, end day) counted from the index day, starts at or after it.

    Rows are distinct before the join, and stay so: offsets move a patient's dates alike.
    """
    joined = stays.select(key, admission, end).distinct().join(cohort.select(key, index), key).select(
        key, F.datediff(admission, index).alias("start_day"), F.datediff(end, index).alias("end_day"))
    return joined.filter(F.col("start_day") >= 0)


def readmission_chain(stays: DataFrame, key: str = "ref", start: str = "start_day", end: str = "end_day",
                      passes: int = 6, unique: bool = False) -> DataFrame:
    """Gaps between successive stays after repeated pruning of overlapping ones.

    Each pass fills a missing end with the next stay's end and takes start minus previous end;
    all passes but the last drop stays that begin before the previous one ended.  The first
    admission carries the mark 9999999, later ones their ordinal where the gap is known.
    Rows are made distinct first (``unique`` says they are); equal starts are taken in order of
    their original end.  All passes share one exchange and one sort by patient, over at most
    one row per pair of days.
    """
    w = Window.partitionBy(key).orderBy(start, F.col("_end0").asc_nulls_last())
    rows = stays.select(key, start, end)
    out = (rows if unique else rows.distinct()).withColumn("_end0", F.col(end))
    for i in range(1, passes + 1):
        out = out.withColumn(end, F.coalesce(F.col(end), F.lead(end).over(w)))
        out = out.withColumn("gap_time", F.col(start) - F.lag(end).over(w))
        if i < passes:
            lost = (F.col(start).isNull() & F.col(end).isNull()) | F.coalesce(F.col("gap_time") < 0, F.lit(False))
            out = out.filter(~lost)
    seq = F.row_number().over(w)
    mark = F.when(seq == 1, study.FIRST_ADMISSION).when(F.col("gap_time").isNotNull(), seq - 1)
    return out.withColumn("gap_mark", mark).drop("_end0")


def within_flags(gaps: DataFrame, cohort: DataFrame, gap: str = "gap_time", days=study.FLAG_DAYS,
                 key: str = "ref", prefix: str = "unplan_") -> DataFrame:
    """0/1 per patient and threshold: is there a gap of at most X days?  All thresholds in one pass.

    The smallest gap decides every threshold, negative gaps of the last pass included.
    """
    smallest = gaps.filter(F.col(gap).isNotNull()).groupBy(key).agg(F.min(gap).alias("_gap"))
    out = cohort.join(smallest, key, "left")
    return out.withColumns({f"{prefix}{d}d": F.when(F.col("_gap") <= d, 1).otherwise(0) for d in days}).drop("_gap")


def readmission_count(gaps: DataFrame, cohort: DataFrame, key: str = "ref", name: str = "ane_times") -> DataFrame:
    """Readmissions per patient without a day limit, 0 when none."""
    counted = gaps.filter(F.col("gap_mark").isNotNull() & (F.col("gap_mark") != study.FIRST_ADMISSION))
    return cohort.join(counted.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna({name: 0})


def readmission_los(gaps: DataFrame, cohort: DataFrame, within: int = 28, key: str = "ref") -> DataFrame:
    """Stay of the first readmission inside the window; a missing end runs to the end of follow-up."""
    firsts = gaps.filter((F.col("gap_time") <= within) & (F.col("gap_mark") == 1))
    out = firsts.join(cohort.select(key, "fu"), key)
    return out.withColumn("old_end", F.col("end_day")).withColumn(
        "end_day", F.coalesce("end_day", "fu")).withColumn("los", F.col("end_day") - F.col("start_day"))


# --- follow-up -----------------------------------------------------------------------------------

def first_death(stays: DataFrame, key: str = "ref", status: str = "discharge_status",
                end: str = "discharge_date", order=None) -> DataFrame:
    """Discharge date of the first stay that ended in death (NULL when that date is missing)."""
    dead = stays.filter(F.col(status) == "DEATH")
    order = _list(order or ["admission_date", "hn_number"])
    return first_rows(dead, key, [end], order).select(key, F.col(end).alias("dead_date"), F.lit(1).alias("_died"))


def follow_up(cohort: DataFrame, deaths: DataFrame, end: str = study.INPATIENT_END, key: str = "ref",
              index: str = "start_episode", dead_by: str = "date") -> DataFrame:
    """Death flag, death day and follow-up days; survivors are followed to the study end.

    ``dead_by="date"`` takes a known death date as death (inpatient), ``"record"`` the death
    record itself (clinic), where follow-up still depends on the date.
    """
    last = F.lit(end).cast("date")
    out = cohort.join(deaths, key, "left")
    died = F.col("dead_date").isNotNull() if dead_by == "date" else F.col("_died").isNotNull()
    return out.withColumns({
        "end_episode": last,
        "dead": F.when(died, 1).otherwise(0),
        "dead_time": F.datediff("dead_date", index),
        "fu": F.when(F.col("dead_date").isNotNull(), F.datediff("dead_date", index))
              .otherwise(F.datediff(last, index)),
    }).drop("_died")


# --- drugs ----------------------------------------------------------------------------------------

def drug_courses(dispensing: DataFrame, cohort: DataFrame, key: str = "ref", index: str = "start_episode",
                 start: str = "prescription_start", duration: str = "dispensing_duration",
                 drug: str = "drug_name") -> DataFrame:
    """Per patient and drug: covered days, whole-currency cost, first start, and course flag.

    Only starts on or after the index day count; a duration covers its last day as well.
    Rows outside the cohort go first; of equal starts only the longest goes into the join.  The flag
    is 2 for exactly five days, else 1.
    """
    named = of_cohort(dispensing.filter(contains_any(drug, ["MOLNUPIRAVIR", "PAXLOVID"])), cohort, key, index).select(
        key, start, F.col(drug).contains("MOLNUPIRAVIR").alias("molnupiravir"),
        F.col(drug).contains("PAXLOVID").alias("paxlovid"), (F.col(duration) + 1).alias("_days"))
    longest = named.groupBy(key, "molnupiravir", "paxlovid", start).agg(F.max("_days").alias("_days"))
    dated = events_after_index(cohort, longest, start, 0, None, index, key, "start_drug")
    per_drug = covered_days(dated, [key, "molnupiravir", "paxlovid"], "start_drug", "_days", "duration", "start_drug")
    # at most three rows per patient are left here
    earliest = F.min("start_drug").over(Window.partitionBy(key))
    return course_cost(per_drug).withColumn("start_drug", earliest).withColumn("antiviral_course",
                          F.when(F.col("duration") == study.FULL_COURSE_DAYS, 2).otherwise(1))


def course_cost(courses: DataFrame) -> DataFrame:
    price = F.when(F.col("paxlovid"), study.PAXLOVID_DAY_PRICE).when(
        F.col("molnupiravir"), study.MOLNUPIRAVIR_DAY_PRICE)
    return courses.withColumn("cost", (F.col("duration") * price).cast("int"))


def with_courses(cohort: DataFrame, courses: DataFrame, key: str = "ref") -> DataFrame:
    """Drug flags, course flag, first start (0 when none) and summed cost, one row per patient."""
    per_patient = courses.groupBy(key).agg(
        F.max(F.col("molnupiravir").cast("int")).alias("molnupiravir"),
        F.max(F.col("paxlovid").cast("int")).alias("paxlovid"),
        F.max("antiviral_course").alias("antiviral_course"),
        F.min("start_drug").alias("start_drug"),
        F.sum("cost").alias("drug_cost"))
    zeros = {c: 0 for c in ("molnupiravir", "paxlovid", "antiviral_course", "start_drug")}
    return cohort.join(per_patient, key, "left").fillna(zeros)


def treatment_window(df: DataFrame, days: int = 7, start: str = "start_drug") -> DataFrame:
    """Treatment began within the window; people without the drug carry day 0."""
    return df.filter(F.col(start) <= days)


# --- clinic ------------------------------------------------------------------------------------------

def first_visit(visits: DataFrame, key: str = "ref", date: str = "appointment_date", order=()) -> DataFrame:
    return first_per_key(visits, key, [date, *order])


def visit_count(visits: DataFrame, key: str = "ref", date: str = "appointment_date") -> DataFrame:
    """Distinct visit days per patient, and the re-attendance flag for two or more."""
    out = visits.groupBy(key).agg(F.countDistinct(date).alias("dc_read"))
    return out.withColumn("reattended", F.when(F.col("dc_read") >= 2, 1).otherwise(0))


def reattendance_days(visits: DataFrame, cohort: DataFrame, key: str = "ref", date: str = "appointment_date",
                      index: str = "start_episode") -> DataFrame:
    """Distinct days from the index visit to each later visit, day 0 left out."""
    days = visits.select(key, date).distinct()
    joined = days.join(cohort.select(key, index), key)
    return joined.select(key, F.datediff(date, index).alias("days")).filter(F.col("days") != 0)


def admissions_within(admissions: DataFrame, cohort: DataFrame, within: int = 28, key: str = "ref",
                      date: str = "admission_date", index: str = "start_episode") -> DataFrame:
    """Count and flag of admissions 0..X days after the index day; both NULL when there is none."""
    per_day = admissions.groupBy(key, date).agg(F.count(F.lit(1)).alias("_rows"))
    hits = events_after_index(cohort, per_day, date, 0, within, index, key, "_offset")
    counts = hits.groupBy(key).agg(F.sum("_rows").alias("ane_times"))
    return cohort.join(counts, key, "left").withColumn("ane", F.when(F.col("ane_times") >= 1, 1))


def visit_course_cost(visits: DataFrame, cohort: DataFrame | None = None, key: str = "ref",
                      date: str = "appointment_date", drug: str = "active_medication") -> DataFrame:
    """Cost of each patient's first clinic course: days to the next drug visit, at most five.

    The last visit counts as a full course.  Two rows on the first day make the gap 0.  The
    gap of the first row needs only the first two visit positions, so it is an aggregate.
    """
    arm = treatment_arm(drug)
    drugged = visits.withColumn("_arm", arm).filter(F.col("_arm") != 0)
    if cohort is not None:
        drugged = in_cohort(drugged, cohort, key)
    # at day grain: how many rows, and the medication of the day's first row
    per_day = drugged.groupBy(key, date).agg(F.count(F.lit(1)).alias("_rows"), F.min(drug).alias("_drug"))
    w = Window.partitionBy(key).orderBy(date)
    per_day = per_day.withColumn("_next", F.lead(date).over(w)).withColumn("_nth", F.row_number().over(w))
    firsts = per_day.filter(F.col("_nth") == 1)
    gap = F.when(F.col("_rows") > 1, 0).otherwise(
        F.coalesce(F.datediff("_next", date), F.lit(study.FULL_COURSE_DAYS)))
    price = F.when(F.col("_drug").contains("MOLNUPIRAVIR"), study.MOLNUPIRAVIR_DAY_PRICE).when(
        F.col("_drug").contains("PAXLOVID"), study.PAXLOVID_DAY_PRICE)
    return firsts.select(key, F.col(date).alias("course_start"), gap.alias("gap"),
                         (F.least(gap, F.lit(study.FULL_COURSE_DAYS)) * price).alias("dc_drug_cost"))


def drug_offset(cohort: DataFrame, visits: DataFrame, key: str = "ref", date: str = "appointment_date",
                drug: str = "active_medication", end: str = "end_episode", order=()) -> DataFrame:
    """Arm and date of the first drug visit; the offset is what remains until the study end."""
    drugged = visits.withColumn("antiviral_code", treatment_arm(drug)).filter(F.col("antiviral_code") != 0)
    firsts = first_rows(drugged, key, ["antiviral_code", date], [date, *(order or [drug])]).withColumnRenamed(
        date, "antiviral_date")
    out = cohort.join(firsts, key, "left").fillna({"antiviral_code": 0})
    return out.withColumn("start_drug", F.datediff(end, "antiviral_date"))
