"""Language identification by a bit-sliced Bloom filter of character n-grams.

A cell of the filter is a mask with one bit for each language.  An n-gram's languages are the bits set in all its cells;
counts of them over a text, corrected for each language's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.frames import append_struct, fresh, mix64, quoted
from wardline.llm.tokens import slices

SIZES, HASHES, CELLS = (3, 4), 4, 1 << 20
# An n-gram belongs to a language from this share of the language's n-grams, and this part of its share elsewhere.
LEAST_SHARE, LEAST_PART = 1e-5, 0.02
_BLOCK = 1 << 12
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of the lower-cased letters; what is between words counts as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    points = np.where(letter, points, 32)
    points = points[np.concatenate([[True], letter[1:] | letter[:-1]])].astype(np.uint64)
    out = []
    for size in SIZES:
        n = len(points) - size + 1
        if n > 0:
            code = np.full(n, size, np.uint64)
            for i in range(size):
                code = mix64(code ^ points[i:n + i])
            out.append(code)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def cells_of(codes: np.ndarray) -> np.ndarray:
    """The cells of each n-gram, one row for each hash."""
    step = mix64(codes) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(codes + np.uint64(i) * step) >> np.uint64(44) for i in range(HASHES)]).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all given rows (lang, text); each task adds up its rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
            if lang in held:
                codes, counts = np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], counts])
            kinds, inverse = np.unique(codes, return_inverse=True)
            held[lang] = kinds, np.bincount(inverse, counts, len(kinds)).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)),
                                                  pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                parts: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    parts.setdefault(lang, []).append(grams(text))
                for lang, codes in parts.items():
                    kinds, counts = np.unique(np.concatenate(codes), return_counts=True)
                    add(lang, kinds, counts)
            if sum(len(c) for c, _ in held.values()) > 1 << 20:
                yield from given()
        yield from given()
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """The filter: ``masks`` has one row of 64-bit words for each cell; ``rates`` are false positive rates."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        fill = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.rates = np.array(fill) ** HASHES

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """Masks of the languages that have each n-gram."""
        cells = cells_of(codes)
        found = self.masks[cells[0]]
        for row in cells[1:]:
            found = found & self.masks[row]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        found = self.languages_of(codes)
        kinds, counts = np.unique(found, axis=0, return_counts=True) if found.shape[1] > 1 else np.unique(found, return_counts=True)
        kinds = kinds.reshape(len(counts), -1)
        hits = np.array([counts[(kinds[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1].sum() for i in range(len(self.langs))])
        true = np.maximum(hits - self.rates * len(codes), 0) / (1 - np.minimum(self.rates, 0.999))
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum()) if true.sum() else 0.0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The filter learnt from every row whose id is not held out and whose language is known.

    N-grams are counted over all those rows, and the rare ones of each language left out.  Masks are OR-ed by cell on
    Spark; the driver gets the finished filter, whose size is fixed (``CELLS`` masks), and the language names.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"))
    known = gram_counts(rows.filter(F.col("id").isNotNull() & ~held_out(F.col("id"))))
    from wardline.session import cut_lineage
    known = cut_lineage(known)
    totals = {r[0]: r[1] for r in known.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    words = max(1, -(-len(langs) // 64))
    if not langs:
        return Model([], np.zeros((CELLS, 1), np.uint64))
    sizes = known.sparkSession.createDataFrame([(k, i, totals[k]) for i, k in enumerate(langs)], "lang string, i int, total long")
    shares = known.join(F.broadcast(sizes), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("share"))
    shares = shares.filter(F.col("share") >= LEAST_SHARE)
    best = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("i", "share")).alias("all"))
    # One entry for each language at most.
    kept = best.select("gram", F.explode(F.filter("all", lambda s: s["share"] >= LEAST_PART * F.col("top"))).alias("s"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells_of(batch.column(0).to_numpy().view(np.uint64)).ravel()
            i = np.tile(batch.column(1).to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(i // 64, pa.int32()),
                                              pa.array((np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64))],
                                             names=["cell", "word", "mask"])
    masks = (kept.select("gram", "s.i").mapInArrow(cells, "cell long, word int, mask long")
             .groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")))

    def dense(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((_BLOCK, words), np.int64)
        block[part["cell"] % _BLOCK, part["word"]] = part["mask"]
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "masks": [block.tobytes()]})
    blocks = (masks.withColumn("block", F.shiftright("cell", 12)).groupBy("block")
              .applyInPandas(dense, "block long, masks binary"))
    full = np.zeros((CELLS, words), np.uint64)
    for r in blocks.collect():
        full[r[0] * _BLOCK:(r[0] + 1) * _BLOCK] = np.frombuffer(bytes(r[1]), np.uint64).reshape(-1, words)
    return Model(langs, full)


_FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct of the predicted language and its score.

    Null text, text without a letter, or a model without languages gives ``und`` and 0; ties go to the first name.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))
    place = docs.columns.index(text_col)
    ready: list[Model] = []

    def compute(batch: pa.RecordBatch) -> dict:
        if not ready:
            ready.append(Model(*held.value))
        found = [ready[0].predict(t) for t in batch.column(place).to_pylist()]
        return {"lang_pred": [f[0] for f in found], "score": [min(1.0, f[1]) for f in found]}
    return append_struct(docs, fresh(docs, name), _FIELDS, compute)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, by a model learnt from the rows that are not held out.

    A row without id is neither held out nor learnt from; repeated rows are learnt from and judged each; other
    columns are ignored.
    """
    model = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return predicted(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
