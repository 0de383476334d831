"""Charlson groups from ICD-9-CM codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import study
from wardline.functions.rules import no_disease
from wardline.operators.lookup import of_cohort


def _expand(item: str) -> list[str]:
    """A prefix, or an inclusive range of equally long numeric prefixes."""
    low, _, high = item.partition("-")
    return [str(i).zfill(len(low)) for i in range(int(low), int(high) + 1)] if high else [low]


def prefix_table(spark: SparkSession, length: int) -> DataFrame:
    """All prefixes of one length with their flags as bits: a code list of fixed size."""
    bits: dict[str, int] = {}
    for i, prefixes in enumerate(study.CHARLSON_PREFIXES.values()):
        for item in prefixes.split():
            for prefix in _expand(item):
                if len(prefix) == length:
                    bits[prefix] = bits.get(prefix, 0) | 1 << i
    return spark.createDataFrame(sorted(bits.items()), f"_p{length} string, _b{length} int")


def charlson(dx: DataFrame, ref: str = "ref", code: str = "diagnosis_code", cohort: DataFrame | None = None) -> DataFrame:
    """17 flags per patient (of ``cohort``, if given), without hierarchy, plus the no-disease flag.

    Prefixes have 3, 4 or 5 characters, so a diagnosis meets three fixed code lists by hash
    (broadcast: they never grow with the data).  Its flags are bits of one number, which one
    combining aggregate per patient ORs together.
    """
    dx = dx if cohort is None else of_cohort(dx, cohort, ref)
    plain = F.upper(F.replace(F.trim(F.col(code)), F.lit("."), F.lit("")))
    rows = dx.select(ref, plain.alias("_code"))
    bits = F.lit(0)
    for length in (3, 4, 5):
        rows = rows.withColumn(f"_p{length}", F.substring("_code", 1, length)).join(
            F.broadcast(prefix_table(dx.sparkSession, length)), f"_p{length}", "left")
        bits = bits.bitwiseOR(F.coalesce(f"_b{length}", F.lit(0)))
    out = rows.select(ref, bits.alias("_bits")).groupBy(ref).agg(F.bit_or("_bits").alias("_bits")).select(
        ref, *[F.getbit("_bits", F.lit(i)).cast("int").alias(name) for i, name in enumerate(study.CHARLSON)])
    return out.withColumn("no_disease", no_disease())
