"""Near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.components import attach, components
from wardline.llm.frames import append_struct, as_bytes, mix64, narrow
from wardline.llm.shingles import shingle_set
from wardline.session import cut_lineage

# 32 bands of 4 minima: a pair at similarity 0.8 shares no band once in twenty million.
BANDS, ROWS = 32, 4
# Estimated similarity below which a pair is not confirmed: nearly six deviations under 0.8 with 128 minima.
LEAST_AGREEMENT = 0.6
BLOCK_ROWS, BLOCK_SHINGLES = 256, 2_000_000

_SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
                        T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
                        T.StructField("signature", T.BinaryType())])


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(2 * count))
    return seeds[:count] | np.uint64(1), seeds[count:]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` universal hash minima of each set, as one row for each set; no set may be empty."""
    multiply, add = hash_family(count)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    values, out = np.concatenate(sets), np.empty((len(sets), count), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(count):
            out[:, i] = np.minimum.reduceat((values * multiply[i] + add[i]) >> np.uint64(32), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(bands)), cells.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key ^ cells[:, :, i])
    return key.view(np.int64)


def _chunks(sets: list[np.ndarray], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sets):
        yield start, len(sets)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``body``, the set's size, its digest, band keys and low halves of the minima."""
    place = docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, size) for t in as_bytes(batch.column(place))]
        digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
        keys: list = [None] * len(sets)
        low: list = [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        for a, b in _chunks([sets[i] for i in full]):
            signature = minima([sets[i] for i in full[a:b]], bands * rows)
            for i, k, s in zip(full[a:b], band_keys(signature, bands, rows), signature.astype(np.uint16)):
                keys[i], low[i] = k, s.tobytes()
        return {"n": [len(s) for s in sets], "d1": [int(d[0]) for d in digests], "d2": [int(d[1]) for d in digests],
                "bands": keys, "signature": low}
    return append_struct(docs, "s", _SKETCH, compute).select("doc_id", "body", "s.*")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least this share of positions."""
    side = reps.select("doc_id", "signature")
    left = side.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    right = side.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                    for i in (2, 3))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select([0, 1])
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold; texts has one row for each doc_id."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if seen != b:
                    seen, last = b, shingle_set(y, size)
                keep.append(_similar(shingle_set(x, size), last, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different groups of one block, as few as connect what they connect.

    Shared counts are products of 0/1 matrices over slices of the hashes that at least two members have.
    """
    kinds, counts = np.unique(groups, return_counts=True)
    others = np.flatnonzero(groups != kinds[np.argmax(counts)])
    if not len(others):
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    hit = often[code]
    owner, code = owner[hit], column[code[hit]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    shared = np.zeros((len(others), len(sets)), np.float32)
    for start in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(code, [start, start + 8192])
        cells = np.zeros((len(sets), 8192), np.float32)
        cells[owner[a:b], code[a:b] - start] = 1
        shared += cells[others] @ cells.T
    n = np.array([len(s) for s in sets])
    shared = shared.astype(np.int64)
    near = 100 * shared >= percent * (n[others][:, None] + n[None, :] - shared)
    root = {g: g for g in kinds.tolist()}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g
    links = []
    for i, j in zip(*np.nonzero(near & (shared > 0))):
        x, y = top(int(groups[others[i]])), top(int(groups[j]))
        if x != y:
            root[x] = y
            links.append((int(ids[others[i]]), int(ids[j])))
    return links


def _left_over(shared: DataFrame, pivots: DataFrame, reps: DataFrame, found: DataFrame, texts: DataFrame, size: int,
               percent: int) -> DataFrame | None:
    """Links that the stars missed: members of one bucket in different components, compared block by block."""
    rest = attach(shared.select("key", "doc_id"), pivots, "key").filter("doc_id <> pivot")
    rest = attach(rest, found.select(F.col("node").alias("doc_id"), "component"), "doc_id", how="left")
    rest = rest.join(reps.select("doc_id", "n"), "doc_id")
    rest = cut_lineage(rest.select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("group")))
    mixed = (rest.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("k"),
                                     F.sum("n").alias("size"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("same"))
             .filter("lo <> hi"))
    # Buckets of several bands with the same members are looked at once.
    mixed = mixed.groupBy("k", "size", "same").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    rows = attach(rest, mixed.select("key", parts.alias("parts")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).select(
        "key", "doc_id", "group", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = cut_lineage(rows.select("key", "doc_id", "group", F.least("own", "other").alias("i"),
                                   F.greatest("own", "other").alias("j")))
    if rows.isEmpty():
        return None

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t.encode(), size) for t in part["text"]]
        return pd.DataFrame(block_links(part["doc_id"].to_numpy(), part["group"].to_numpy(), sets, percent),
                            columns=["a", "b"])
    full = rows.join(texts, "doc_id")
    return full.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; see ``judged``."""
    return judged(docs, id_col, text_col, **options).drop("body")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, body`` for every row of ``docs``; ``body`` is the hash of its text.

    Two texts are linked when their sets of ``size``-word shingles (A-Z lower-cased) share at least ``percent``
    of their union; components are transitive and named by their smallest id, the one row kept.  Equal sets form
    one class, so copies never meet in pairs.  Null, empty and wordless texts have no set, link with nothing and stay.
    Rows without an id are left alone (null component, kept).  Each row that repeats an id is judged by its own
    text, and rows kept under one id are all kept.  An empty table gives an empty result; other columns are ignored.

    Each bucket of a band is first compared with its busiest member only (the one in the largest buckets, which
    for edited copies of one text is that text).  Members of a bucket that still lie in different components are then
    compared exactly, in blocks of bounded size, so no bucket is cut and no pair is left out.
    """
    slim = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))
    made = cut_lineage(sketches(slim, size, bands, rows))
    classes = made.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = cut_lineage(attach(made.select("doc_id", "n", "d1", "d2", "body"), classes, "d1", "d2", how="left"))
    # One text speaks for each class; where rows share the smallest id, the smallest of their texts by digest does.
    speakers = member.filter("doc_id = rep").groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "body")).alias("s"))
    speakers = speakers.select("doc_id", "s.*")
    reps = made.join(speakers, ["doc_id", "d1", "d2", "body"], "left_semi")

    cells = reps.select(F.explode("bands").alias("key"), "doc_id")
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = cut_lineage(attach(cells, sizes, "key"))
    busy = shared.groupBy("doc_id").agg(F.sum("many").alias("score"))
    scored = attach(shared.select("key", "doc_id"), busy, "doc_id")
    pivots = cut_lineage(scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("back"))).alias("m"))
                         .select("key", (-F.col("m.back")).alias("pivot")))
    pairs = attach(shared.select("key", "doc_id"), pivots, "key").filter("doc_id <> pivot")
    pairs = pairs.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = cut_lineage(_agreeing(pairs, reps, LEAST_AGREEMENT))

    involved = speakers.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "body")
    texts = cut_lineage(slim.join(involved, ["doc_id", "body"], "left_semi").select("doc_id", "text")
                        .dropDuplicates(["doc_id"]))
    links = cut_lineage(confirmed(pairs, texts, size, percent))
    found = components(links)
    more = _left_over(shared, pivots, reps, found, texts, size, percent)
    if more is not None:
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = attach(member, found.select(F.col("node").alias("rep"), "component"), "rep", how="left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"), "body")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents kept, with their own columns; of rows that share an id, each goes or stays by its own text."""
    gone = judged(docs, id_col, text_col, **options).filter("not kept")
    a, b = docs.alias("a"), gone.select("doc_id", "body").alias("b")
    body = F.xxhash64(F.coalesce(F.col(f"a.`{text_col}`"), F.lit("")))
    return a.join(b, (F.col(f"a.`{id_col}`") == F.col("b.doc_id")) & (body == F.col("b.body")), "left_anti")
