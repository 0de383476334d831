"""Hand-over tables between the steps, and result export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.session import shared_dir


def stage_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    return f"{root or shared_dir(spark) + '/stages'}/{name}"


def save_stage(df: DataFrame, name: str, root: str | None = None, partition_by: list[str] | None = None) -> str:
    """Write a stage as Parquet in the shared folder; returns its path."""
    path = stage_path(df.sparkSession, name, root)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def load_stage(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    return spark.read.parquet(stage_path(spark, name, root))


def export_table(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Flat result table as CSV, written by all tasks; ``single_file`` makes one file of a small report table."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)
    return path
