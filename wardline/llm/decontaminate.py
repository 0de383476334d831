"""Benchmark decontamination by latent semantic retrieval.

TF-IDF vectors of benchmark passages get a randomised singular value decomposition on Spark; windows of every document
are folded into that latent space and compared by cosine; what comes near is checked word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.frames import append_struct, fresh, mix64, quoted
from wardline.llm.tokens import slices

# Words in a benchmark passage at most, in half a document window, and around a window when words are compared.
PASSAGE, STEP, MARGIN = 48, 32, 24
# Passages in one latent space; the rank is not below it, so the decomposition loses none of them.
BLOCK, RANK, SPACES_PER_SCAN = 192, 256, 8
COSINE = 0.4
# Share of a passage's words found in order: enough alone, or enough when its last quarter (the answer) is there too.
COPIED, PARAPHRASED, ANSWERED, SHORT = 0.8, 0.6, 0.8, 8
# So many words of an item in a row are a copy by themselves; below half a passage, so that each such run lies in some passage.
RUN = 13
# Bytes of texts laid out side by side, and windows compared at once.
SLICE_BYTES, WINDOWS = 1 << 18, 256
_BASE = np.uint64(0xD6E8FEB86659FD93)
# Every byte outside 0-9, a-z and beyond ASCII parts words.
_PARTS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


def passages_of(words: list[bytes]) -> list[tuple[int, int]]:
    """Starts and ends of passages of at most ``PASSAGE`` words, a new one at each half of them."""
    n = len(words)
    starts = [*range(0, n - PASSAGE, PASSAGE // 2), n - PASSAGE] if n > PASSAGE else [0] if n else []
    return [(a, min(n, a + PASSAGE)) for a in starts]


def answer_of(words: list[bytes]) -> list[bytes]:
    """The end of an item: its last quarter, of a long one that of a passage."""
    return words[-max(4, min(len(words), PASSAGE) // 4):]


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one integer."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@dataclass
class Passage:
    """Words of an item, the answer at that item's end, and how many words of the item come after the passage."""
    item: str
    words: list[bytes]
    answer: list[bytes]
    rest: int


def found_in(passage: Passage, kinds: frozenset[bytes], region: list[bytes], there: set[bytes], after: list[bytes]) -> float:
    """Share of the passage found in order if that makes the region a copy or a paraphrase, else 0.

    ``kinds`` and ``there`` are the words of both as sets: what is missing bounds the share, so most pairs end early.
    ``after`` is what follows the region, as far as the answer of the item may lie behind it.
    """
    n = len(passage.words)
    if n < SHORT:
        return float(any(region[i:i + n] == passage.words for i in range(len(region) - n + 1)))
    if n - len(kinds - there) < PARAPHRASED * n:
        return 0.0
    share = longest_common(passage.words, region) / n
    if share >= COPIED:
        return share
    answer = passage.answer
    return share if share >= PARAPHRASED and longest_common(answer, region + after) >= ANSWERED * len(answer) else 0.0


@dataclass
class Space:
    """One latent space: the words' rows (weight times singular vectors), the passages in it, and what they are."""
    passages: list[Passage]
    words: dict[bytes, int]
    project: np.ndarray
    targets: np.ndarray


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary stands, and how many documents there are: over all of them."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(held.value.intersection(words_of(text)))
                total += 1
        rows = [*seen.items(), (b"", total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                                         names=["word", "n"])
    sums = docs.select(quoted(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {bytes(r[0]): r[1] for r in sums.collect()}
    return got, got.pop(b"", 0)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Passage]]:
    """The benchmark's passages as lists of about ``BLOCK``, one list on the driver at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                rows += [(item, b" ".join(words[a:b]), b" ".join(answer_of(words)), len(words) - b) for a, b in passages_of(words)]
            kinds = {"item": pa.string(), "words": pa.binary(), "answer": pa.binary(), "rest": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
    parts = benchmark.select(F.col(quoted(item_col)).cast("string"), F.col(quoted(text_col)).alias("text"))
    parts = parts.mapInArrow(run, "item string, words binary, answer binary, rest int")
    parts = parts.groupBy("words", "answer", "rest").agg(F.min("item").alias("item"))
    blocks = max(1, -(-parts.count() // BLOCK))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for i in range(blocks):
        rows = sorted((r["item"], bytes(r["words"]), bytes(r["answer"]), r["rest"]) for r in parts.filter(F.col("block") == i).collect())
        if rows:
            yield [Passage(item, words.split(), answer.split(), rest) for item, words, answer, rest in rows]


def latent_space(spark, block: list[Passage], frequency: dict[bytes, int], total: int) -> Space:
    """Randomised decomposition of the block's TF-IDF rows: random range, one power step and its small Gram matrix.

    Rows are multiplied where they lie; tasks emit sums over slices of columns, which Spark adds.  The driver
    orthogonalises matrices of (words of the block) x rank and finds the rank x rank rotation.
    """
    words = {w: i for i, w in enumerate(sorted({w for p in block for w in p.words}))}
    idf = np.array([np.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in words])
    rank = min(RANK, len(words))
    rows = []
    for p in block:
        tf = Counter(words[w] for w in p.words)
        v = np.array([n * idf[c] for c, n in tf.items()])
        rows.append((list(map(int, tf)), (v / np.linalg.norm(v)).tolist()))
    # From an Arrow table, as rows would start further Python workers, which stay.
    cells = spark.createDataFrame(pa.table({"cols": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                            "vals": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})).repartition(8)

    def power(basis: np.ndarray) -> np.ndarray:
        """Transposed rows times (rows times basis)."""
        held = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(held.value.shape)
            for batch in batches:
                for cols, vals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    v = np.array(vals)
                    sums[cols] += np.outer(v, v @ held.value[cols])
            starts = list(range(0, len(sums), 1024))
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([sums[s:s + 1024].tobytes() for s in starts])],
                                             names=["at", "sums"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": part["at"][:1], "sums": [sum(np.frombuffer(x) for x in part["sums"]).tobytes()]})
        parts = cells.mapInArrow(run, "at int, sums binary").groupBy("at").applyInPandas(add, "at int, sums binary")
        return np.concatenate([np.frombuffer(bytes(r[1])) for r in sorted(parts.collect())]).reshape(len(words), -1)

    start = np.random.default_rng(7).standard_normal((len(words), rank))
    q = np.linalg.qr(power(start))[0]
    value, rotation = np.linalg.eigh(q.T @ power(q))
    basis = q @ rotation[:, value > 1e-9]
    project = (idf[:, None] * basis).astype(np.float32)
    targets = np.stack([project[[words[w] for w in p.words]].sum(axis=0) for p in block])
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    return Space(block, words, project, targets)


class Scan:
    """Latent spaces side by side, for one look at each word; a word's row is zero in the spaces that lack it."""

    def __init__(self, spaces: list[Space]):
        self.spaces = spaces
        self.kinds = [[frozenset(p.words) for p in s.passages] for s in spaces]
        self.words = {w: i for i, w in enumerate(sorted({w for s in spaces for w in s.words}))}
        self.parts, width = [], sum(s.project.shape[1] for s in spaces)
        self.project = np.zeros((len(self.words), width), np.float32)
        # The kinds of words of each passage by number, filled up with one that counts as standing everywhere; and all its words' number.
        self.codes = [np.full((len(s.passages), PASSAGE), len(self.words), np.int32) for s in spaces]
        self.sizes = [np.array([len(p.words) for p in s.passages]) for s in spaces]
        for codes, kinds in zip(self.codes, self.kinds):
            for row, own in zip(codes, kinds):
                row[:len(own)] = [self.words[w] for w in own]
        at = 0
        for s in spaces:
            end = at + s.project.shape[1]
            self.project[[self.words[w] for w in s.words], at:end] = s.project
            self.parts.append((at, end))
            at = end
        # Hashes of all runs of the passages in order, and the space and passage of each.
        code = [(k, j, np.array([self.words[w] for w in p.words])) for k, s in enumerate(spaces) for j, p in enumerate(s.passages)]
        grams = [run_hashes(c, np.arange(max(0, len(c) - RUN + 1))) for _, _, c in code]
        owners = np.repeat(np.array([(k, j) for k, j, _ in code], np.int64).reshape(-1, 2), [len(g) for g in grams], axis=0)
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.grams, self.owners = flat[order], owners[order]


def run_hashes(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``RUN`` words from each start."""
    word, h = mix64(code), np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            h = h * _BASE + word[starts + i]
    return h


def runs_in(code: np.ndarray, scan: Scan) -> list[tuple[int, int, int]]:
    """(start, space, passage) wherever ``RUN`` words in a row may be those of a passage; a code of -1 is in none."""
    if len(code) < RUN:
        return []
    misses = np.concatenate([[0], np.cumsum(code < 0)])
    starts = np.flatnonzero(misses[RUN:] == misses[:-RUN])
    if not len(starts):
        return []
    h = run_hashes(code, starts)
    first, last = np.searchsorted(scan.grams, h), np.searchsorted(scan.grams, h, "right")
    return [(int(starts[i]), *map(int, scan.owners[o])) for i in np.flatnonzero(first < last) for o in range(first[i], last[i])]


def laid_out(texts: list[list[bytes]], scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of texts one after another (-1: in no passage), and where each text starts.

    A text starts at a whole step and two empty steps follow it, so that no run and no region has words of two texts.
    """
    sizes = np.array([len(w) for w in texts], np.int64)
    room = (-(-sizes // STEP) + 2) * STEP
    firsts = np.cumsum(room) - room
    code = np.full(room.sum(), -1, np.int64)
    flat = np.fromiter(map(scan.words.get, chain.from_iterable(texts), repeat(-1)), np.int64, sizes.sum())
    code[np.arange(len(flat)) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)] = flat
    return code, firsts


def step_sums(code: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The sum of the words' rows in each step: the first known word of all steps, then the second, and so on."""
    at = np.flatnonzero(code >= 0)
    step, begin, many = np.unique(at // STEP, return_index=True, return_counts=True)
    order = np.argsort(-many, kind="stable")
    begin, many = begin[order], many[order]
    known, sums = code[at], np.zeros((len(step), project.shape[1]), np.float32)
    for i in range(many[0] if len(many) else 0):
        n = np.searchsorted(-many, -i)
        sums[:n] += project[known[begin[:n] + i]]
    out = np.zeros((-(-len(code) // STEP), project.shape[1]), np.float32)
    out[step[order]] = sums
    return out


def standing(code: np.ndarray, starts: np.ndarray, kinds: int) -> np.ndarray:
    """Which of the scan's words stand in the region around each window; number ``kinds`` stands everywhere."""
    before, after = np.full(MARGIN, -1), np.full(2 * STEP + MARGIN, -1)
    around = np.concatenate([before, code, after])[starts[:, None] + np.arange(2 * STEP + 2 * MARGIN)]
    there = np.zeros((len(starts), kinds + 2), bool)
    there[np.arange(len(starts))[:, None], around] = True
    there[:, kinds] = True
    return there


def enough_words(there: np.ndarray, rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where ``found_in`` looks at more than words as sets: the passage is short, or not too many of its words are missing."""
    missing = codes.shape[1] - np.count_nonzero(there.ravel()[rows[:, None] * there.shape[1] + codes], axis=1)
    return (sizes < SHORT) | (sizes - missing >= PARAPHRASED * sizes)


def near_windows(code: np.ndarray, scan: Scan, cosine: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start of the window, space, passage) wherever the latent cosine reaches ``cosine`` and the region around the window has
    the words that ``found_in`` asks for; a window is two steps long.

    And the same for the starts of runs; neighbouring blocks share a step, so none is cut.
    """
    out, runs = [], []
    for first in range(0, len(code), STEP * WINDOWS):
        part = code[first:first + STEP * (WINDOWS + 1)]
        runs += [(first + i, k, j) for i, k, j in runs_in(part, scan)]
        sums = step_sums(part, scan.project)
        windows = sums[:WINDOWS].copy()
        windows[:len(sums) - 1] += sums[1:]
        low = max(0, first - MARGIN)
        region = code[low:first + STEP * (len(windows) + 1) + MARGIN]
        there = standing(region, first - low + STEP * np.arange(len(windows)), len(scan.words))
        for k, (a, b) in enumerate(scan.parts):
            size = np.linalg.norm(windows[:, a:b], axis=1, keepdims=True)
            near = windows[:, a:b] @ scan.spaces[k].targets.T >= cosine * np.maximum(size, 1e-12)
            rows, passages = np.nonzero(near & (size > 0))
            for s in range(0, len(rows), 4096):
                i, j = rows[s:s + 4096], passages[s:s + 4096]
                kept = enough_words(there, i, scan.codes[k][j], scan.sizes[k][j])
                out += [(first + STEP * x, k, y) for x, y in zip(i[kept].tolist(), j[kept].tolist())]
    return out, runs


def items_in(texts: list[list[bytes]], scan: Scan, cosine: float) -> list[dict[str, float]]:
    """For each text, given as its words, the items whose passages it holds, with the largest share found in order."""
    code, firsts = laid_out(texts, scan)
    near, runs = near_windows(code, scan, cosine)
    out: list[dict[str, float]] = [{} for _ in texts]

    def placed(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """Text, place in it, space and passage, in order; a window that starts behind a text is none."""
        found = sorted(found)
        owners = np.searchsorted(firsts, [f[0] for f in found], "right") - 1
        for t, (at, k, j) in zip(owners.tolist(), found):
            if at - firsts[t] < len(texts[t]):
                yield t, int(at - firsts[t]), k, j
    last, there = (-1, -1), set()
    for t, start, k, j in placed(near):
        words, end = texts[t], start + 2 * STEP + MARGIN
        region = words[max(0, start - MARGIN):end]
        if (t, start) != last:
            last, there = (t, start), set(region)
        passage = scan.spaces[k].passages[j]
        share = found_in(passage, scan.kinds[k][j], region, there, words[end:end + passage.rest])
        if share:
            out[t][passage.item] = max(share, out[t].get(passage.item, 0.0))
    seen: dict = {}
    for t, at, k, j in placed(runs):
        words, passage = texts[t], scan.spaces[k].passages[j]
        mine, run = passage.words, words[at:at + RUN]
        # One look at each copy: its other runs lie within the same region.
        if at > seen.get((t, k, j), -1) and any(mine[i:i + RUN] == run for i in range(len(mine) - RUN + 1)):
            seen[t, k, j] = at + PASSAGE - RUN
            share = longest_common(mine, words[max(0, at - PASSAGE):at + 2 * PASSAGE]) / len(mine)
            out[t][passage.item] = max(share, out[t].get(passage.item, 0.0))
    return out


_FIELDS = T.StructType([T.StructField("contaminated", T.BooleanType()), T.StructField("n_items", T.LongType()),
                        T.StructField("items", T.StringType()), T.StructField("share", T.DoubleType())])


def _flag(docs: DataFrame, text_col: str, spaces: list[Space], cosine: float, name: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Scan(spaces))
    place = docs.columns.index(text_col)

    def compute(batch: pa.RecordBatch) -> dict:
        out, column = [], batch.column(place)
        for a, b in slices(column, SLICE_BYTES):
            texts = [words_of(t) for t in column.slice(a, b - a).to_pylist()]
            for hits in items_in(texts, held.value, cosine):
                out.append((bool(hits), len(hits), ",".join(sorted(hits, key=lambda x: (len(x), x))), max(hits.values(), default=0.0)))
        return dict(zip(_FIELDS.fieldNames(), zip(*out)))
    return append_struct(docs, name, _FIELDS, compute)


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", cosine: float = COSINE) -> tuple[DataFrame, list[str]]:
    """``docs`` with struct columns (one for each scan of up to ``BLOCK * SPACES_PER_SCAN`` passages), and their names.

    Every window of every whole text is compared with every benchmark passage.  Null and empty texts and items hold
    nothing and match nothing; equal passages count once, for the smallest item; ``RUN`` words of an item in a row are
    enough wherever they stand, also without the item's end (then the share may be small); passages under ``SHORT`` words must stand
    there as they are; repeated documents are judged each; an empty benchmark flags nothing; names taken get ``_``.
    """
    spark, names, held = docs.sparkSession, [], []

    def scan(df: DataFrame) -> DataFrame:
        frequency, total = document_frequencies(docs, text_col, {w for b in held for p in b for w in p.words})
        names.append(fresh(df, "leak"))
        return _flag(df, text_col, [latent_space(spark, b, frequency, total) for b in held], cosine, names[-1])
    out = docs
    for block in benchmark_blocks(benchmark, item_col, item_text_col):
        held.append(block)
        if len(held) == SPACES_PER_SCAN:
            out, held = scan(out), []
    return (scan(out) if held else out), names


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document that holds benchmark passages: ``doc_id, n_items, items, share``.

    ``items`` are the comma-joined items, shorter ones first, ``share`` the largest part of a passage found in order.  Each row
    is judged by its own text, also where rows share an id, and however many scans the benchmark takes.
    """
    slim = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    out, names = flagged(slim, benchmark, **options)
    if not names:
        return slim.filter(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"),
                                                F.lit(0.0).alias("share"))
    leaks = F.filter(F.array(*names), lambda x: x["contaminated"])
    rows = out.select("doc_id", leaks.alias("leaks")).filter(F.size("leaks") > 0)
    every = F.array_distinct(F.flatten(F.transform("leaks", lambda x: F.split(x["items"], ","))))
    shorter = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
    share = F.array_max(F.transform("leaks", lambda x: x["share"]))
    return rows.select("doc_id", F.array_sort(every, shorter).alias("all"), share.alias("share")).select(
        "doc_id", F.size("all").cast("long").alias("n_items"), F.array_join("all", ",").alias("items"), "share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark passage, with their own columns."""
    out, names = flagged(docs, benchmark, **options)
    for name in names:
        out = out.filter(~F.col(f"`{name}`")["contaminated"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
