"""Line deduplication: explode normalised lines, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import attach
from wardline.llm.frames import LOWER_BYTES, SPACES, as_bytes, fresh
from wardline.llm.tokens import slices
from wardline.session import cut_lineage

MIN_CHARS, MIN_DOCS = 20, 3
_SPACES = SPACES.encode()


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def count_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _without(lines: Column, drops: Column) -> Column:
    """``lines`` without the ascending positions ``drops``, as the slices between them."""
    before = F.transform(F.sequence(F.lit(0), F.size(drops)), lambda k: F.struct(
        (F.when(k == 0, F.lit(-1)).otherwise(F.get(drops, k - 1)) + 1).alias("start"),
        F.coalesce(F.get(drops, k), F.size(lines)).alias("end")))
    return F.flatten(F.transform(before, lambda s: F.slice(lines, s["start"] + 1, s["end"] - s["start"])))


def _long_enough(line: bytes, min_chars: int) -> bool:
    return len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each long enough line: id, hash of the whole text, position, and the key's 128-bit hash as two longs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for start, end in slices(b.column(2)):
                texts = as_bytes(b.column(2).slice(start, end - start))
                rows, places, keys = [], [], []
                for i, text in enumerate(texts, start):
                    for place, line in enumerate(text.translate(LOWER_BYTES).split(b"\n")):
                        line = line.strip(_SPACES)
                        if _long_enough(line, min_chars):
                            rows.append(i)
                            places.append(place)
                            keys.append(digest(line))
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(places, pa.int32()), pa.array(both[:, 0]),
                     pa.array(both[:, 1])], names=["doc", "body", "pos", "k1", "k2"])
                del texts, keys
            pa.default_memory_pool().release_unused()
    text = F.col(f"`{text_col}`")
    slim = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("body"),
                                                                text.alias("text"))
    return slim.mapInArrow(run, f"doc {kind}, body long, pos int, k1 long, k2 long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, dropped_col: str = "n_dropped") -> DataFrame:
    """``docs`` with common lines removed from the text, and the number of lines removed.

    A key is the line stripped at both ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points in at
    least ``min_docs`` distinct ids go everywhere but in the largest id.  Rows that share an id count as one
    document, and the largest id keeps the line in all its rows; a row without id is neither counted nor changed; null
    text is one empty line and comes back empty only if it had lines to lose, else as it was.  The added column
    gets ``_`` while its name is taken.

    Lines are hashed once, and only hashes and positions are shuffled by line; keys are counted by combining aggregates, and
    the rows of a hot key meet the common ones in a join that Spark may split.
    """
    name = fresh(docs, dropped_col)
    rows = cut_lineage(line_keys(docs, id_col, text_col, min_chars))
    common = (rows.select("k1", "k2", "doc").distinct().groupBy("k1", "k2")
              .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= min_docs)).drop("n")
    flagged = (attach(rows, common, "k1", "k2").filter(F.col("doc") != F.col("keeper")).groupBy("doc", "body")
               .agg(F.sort_array(F.collect_set("pos")).alias("drops")))
    a, b = docs.alias("a"), flagged.alias("b")
    drops, text = F.col("b.drops"), F.col(f"a.`{text_col}`")
    joined = a.join(b, (F.col(f"a.`{id_col}`") == F.col("b.doc")) & (F.xxhash64(text) == F.col("b.body")), "left")
    kept = F.when(drops.isNull(), text).otherwise(F.array_join(_without(lines_of(text), drops), "\n"))
    columns = [kept.alias(c) if c == text_col else F.col(f"a.`{c}`") for c in docs.columns]
    return joined.select(*columns, F.when(drops.isNull(), 0).otherwise(F.size(drops)).cast("long").alias(name))
