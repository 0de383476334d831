"""Extract scans: folders of delimited or Parquet exports, every column as text."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = "_ord"


def list_files(spark: SparkSession, folder: str, name_regex: str) -> list[str]:
    """Paths in a folder (local or any Hadoop file system) whose file name matches, sorted by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)]
    rx = re.compile(name_regex)
    return sorted(p.toString() for p in found if rx.search(p.getName()))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of a file; the rest of it is not read."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([c.slice(0, 1).cast(pa.string()) for c in b.columns], names=["path", "line"])
            return


def headers(spark: SparkSession, paths: list[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by their column names; empty files are left out.

    One task opens each file through Hadoop (which unpacks compressed ones by their name) and stops after its first line; equal
    lines meet in an aggregate, so the driver gets a row for each distinct header with the paths it asked for.
    """
    whole = str(1 << 50)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", whole)
    own.conf.set("spark.sql.files.openCostInBytes", whole)  # a file never shares a task
    lines = own.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    found = lines.mapInArrow(_first_rows, "path string, line string").groupBy("line").agg(
        F.sort_array(F.collect_list("path")).alias("paths")).collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(found, key=lambda r: r.paths[0]):
        line = r.line.lstrip("\ufeff").rstrip("\r")
        if line:
            out.setdefault(tuple(next(csv.reader([line], delimiter=sep))), []).extend(r.paths)
    return out


def read_extract(spark: SparkSession, folder: str, name_regex: str, columns: list[str] | None = None,
                 format: str = "csv", sep: str = ",", with_order: bool = False, missing: str = "NA",
                 line_breaks: bool = False) -> DataFrame:
    """Union by name of all files whose name matches; absent columns are NULL, all columns text.

    Unquoted empty fields and the text ``missing`` are NULL.  With ``line_breaks`` a quoted field may hold line breaks (a file
    is then read by one task); a header is always one line.  Compressed files are read by their name.

    Files are read in one scan per distinct header, so the plan stays small however many files
    there are.  ``with_order`` adds ``_ord`` (file, block, row), since "first row" has a meaning
    in the study and Spark rows have no order of their own.
    """
    paths = list_files(spark, folder, name_regex)
    if not paths:
        raise FileNotFoundError(f"no file in {folder} matches {name_regex}")
    if format == "csv":
        groups = headers(spark, paths, sep)
        if not groups:
            raise ValueError(f"the files in {folder} that match {name_regex} are empty")
        frames = [
            spark.read.option("header", True).option("sep", sep).option("nullValue", missing).option("multiLine", line_breaks)
            .option("escape", '"').schema(", ".join(f"`{c}` STRING" for c in header)).csv(files)
            for header, files in groups.items()
        ]
    else:
        frames = [spark.read.option("mergeSchema", True).format(format).load(paths)]
    parts = []
    for frame in frames:
        names = [c for c in frame.columns if columns is None or c in columns]
        cols = [F.col(f"`{c}`").cast("string").alias(c) for c in names]
        if with_order:
            cols.append(F.struct(F.col("_metadata.file_name").alias("file"),
                                 F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("row")).alias(ORDER))
        parts.append(frame.select(*cols))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.lower())).strip("_")


def normalise_header(df: DataFrame, mapping: dict[str, str] | None = None, key: str = "ref") -> DataFrame:
    """First column becomes the patient key; the others follow the map, else snake case."""
    mapping = mapping or {}
    first = df.columns[0]
    names = {first: key}
    for c in df.columns[1:]:
        names[c] = c if c == ORDER else mapping.get(c, snake(c))
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def lookup_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A reference table written into the plan; meant for code lists and life tables."""
    if len(rows) > 5000:
        raise ValueError("a lookup frame is for small code lists; load bigger tables from files")
    return spark.createDataFrame(rows, schema)
