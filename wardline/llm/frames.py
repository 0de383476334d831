"""Helpers shared by the operators: tables, Arrow mapping, column names, fixed character classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so that other columns cannot clash."""
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain column names by place, since Arrow mapping resolves names and fails on dots and clashes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def append_struct(df: DataFrame, name: str, fields: T.StructType,
                  compute: Callable[[pa.RecordBatch], dict[str, object]]) -> DataFrame:
    """``df`` with one more struct column; ``compute`` gives its fields for each Arrow batch."""
    plain = numbered(df)
    schema = T.StructType(plain.schema.fields + [T.StructField(f"c{len(df.columns)}", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(fields)
        for b in batches:
            if not b.num_rows:
                continue
            got = compute(b)
            made = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in kinds], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)
            del b, made, got
            pa.default_memory_pool().release_unused()
    return plain.mapInArrow(run, schema).toDF(*df.columns, name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``n`` that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, size), -1)
    return np.cumsum(steps[:-1]) > 0
