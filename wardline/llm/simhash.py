"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments; of two fingerprints that differ in three bits or fewer, one segment differs
in one bit at most.  So every fingerprint is indexed under each of its segments with each bit left out (64 keys), equal
keys are joined and the whole fingerprints compared.  A key that too many fingerprints share is cut again in
the same way in the bits it leaves open, so that no group of unbounded size is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import attach, components
from wardline.llm.frames import LOWER_BYTES, as_bytes, narrow
from wardline.llm.tokens import slices
from wardline.session import cut_lineage

BITS, SEED, DISTANCE, SHINGLE = 64, 42, 3, 3
# With eight bits left open (after the fourth cut) a group has 256 fingerprints at most.
GROUP = 256


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes (repeats included)."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    ways = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    n = max(len(words) - size + 1, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, ways), repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 14):
        part = hashes[a:a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in slices(b.column(1)):
                found = [fingerprint(t, size) for t in as_bytes(b.column(1).slice(start, end - start))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, end - start), pa.array(np.array(found, np.uint64).view(np.int64))],
                    names=["doc_id", "fp"])
    slim = narrow(docs, id_col, text_col)
    return slim.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(rows: DataFrame) -> DataFrame:
    """Each row once for each bit left out of each half of its open bits (``shift``, ``bits``); the other half stays open."""
    return rows.select("key", "fp", "shift", F.expr("bits div 2").cast("int").alias("half"),
                       F.explode(F.expr("sequence(0, cast(bits as int) - 1)")).alias("j")).selectExpr(
        "key", "fp", "j", "half", "cast(shift + (j div half) * half as int) as own",
        "cast(shift + (1 - j div half) * half as int) as shift").selectExpr(
        """xxhash64(key, j, shiftrightunsigned(fp, own) & (shiftleft(1L, half) - 1L) & ~shiftleft(1L, cast(j % half as int))) as key""",
        "fp", "shift", "half as bits")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that hold together what lies within ``distance``, one fewer than the members at most."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    left, out = np.ones(len(fps), bool), []
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def _compared(distance: int):
    """Groups of one key, in order, to the links within them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            a, b = [], []
            for group in np.split(fps, cuts) if len(fps) else []:
                found = _forest(group, distance)
                a += [group[i] for i, _ in found]
                b += [group[j] for _, j in found]
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(both, names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            whole = int(np.flatnonzero(keys == keys[-1])[0])  # the last group may go on
            yield links(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
        yield links(keys, fps)
    return run


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints (column ``fp``) within ``distance`` bits (3 at most).

    Counts, least and largest member of each key come from one combining aggregate; a key with two members is a pair already,
    one with up to 256 is compared whole by a task, and one with more is cut again (four cuts at most).
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments find distances up to 3")
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("shift"), F.lit(BITS).alias("bits"))
    out = None
    for _ in range(4):
        cells = variants(rows)
        keys = cut_lineage(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"),
                                                    F.max("fp").alias("b")).filter("n > 1"))
        pairs = keys.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
        shared = cut_lineage(attach(cells, keys.filter("n > 2").select("key", "n"), "key"))
        small = shared.filter(F.col("n") <= GROUP).select("key", "fp").repartition("key").sortWithinPartitions("key")
        found = pairs.unionByName(small.mapInArrow(_compared(distance), "a long, b long"))
        out = found if out is None else out.unionByName(found)
        rows = shared.filter(F.col("n") > GROUP).select("key", "fp", "shift", "bits")
        if rows.isEmpty():
            break
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    A-Z are lower-cased, shingles are ``size`` words with repeats, hashed by XXH64 (seed 42); a shorter text is one shingle.
    Null, empty and wordless texts have fingerprint zero and link like any other.  Rows of one fingerprint form a class, so
    copies never meet in pairs.  ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``distance`` bits; a row without id links but names no component (null where no row of it has an id).  Repeated
    ids and rows are judged by their own texts; an empty table gives an empty result; other columns are ignored.
    """
    made = cut_lineage(fingerprints(docs, id_col, text_col, size))
    classes = cut_lineage(made.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(classes.select("fp"), distance)).select(F.col("node").alias("fp"), "component")
    rooted = attach(classes, found, "fp", how="left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = attach(rooted.select("fp", "root"), least, "root").select("fp", "component_id")
    return attach(made, named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
