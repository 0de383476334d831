"""Repeated passages by content-defined chunks.

A gear rolling hash over the last 16 bytes decides where chunks end, so equal passages get equal chunks wherever they
stand, and an insertion changes only the chunks it touches.  Every window of neighbouring chunks is digested whole; digests
found in several documents mark passages, so every mark is a stretch that one other document has byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.components import attach
from wardline.llm.frames import SPACES, as_bytes, mix64, narrow, quoted
from wardline.llm.tokens import slices
from wardline.session import cut_lineage

# A chunk ends after one in WORDS_PER_CUT white-space bytes; in text that has had none for BARE_BYTES (scripts that write
# without blanks, codes), after one in LETTERS_PER_CUT letters.
WORDS_PER_CUT, LETTERS_PER_CUT, BARE_BYTES = 4, 8, 32
# A window of chunks, and so a passage, has this many bytes at least.
PASSAGE_BYTES = 120
# Bits of a window's digest in the first pass, which may take different windows for equal (one in 600 at two billion windows), and
# the compression level of texts on their way.
KEY_BITS, LEVEL = 40, 1
_GEAR = (mix64(np.arange(256)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte."""
    h, reach = _GEAR[raw], 1
    while reach < 16:
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] << np.uint16(reach)
        h, reach = h + shifted, 2 * reach
    return h


def _ends(raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    letter = np.ones(len(raw), bool)
    letter[:-1] = (raw[1:] & 0xC0) != 0x80
    space, at = _SPACE[raw], np.arange(len(raw))
    bare = at - np.maximum.accumulate(np.where(space, at, -1)) >= BARE_BYTES
    # Inside a run of one byte the hash stands still, and the run stays one chunk.
    moved = np.ones(len(raw), bool)
    moved[1:] = h[1:] != h[:-1]
    cut = moved & ((space & (h < 65536 // WORDS_PER_CUT)) | (bare & letter & (h < 65536 // LETTERS_PER_CUT)))
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def chunk_ends(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, in bytes; they depend on the 32 bytes before them only and never split a letter."""
    raw = np.frombuffer(text, np.uint8)
    return _ends(raw, gear(raw)) if len(raw) else np.empty(0, np.int64)


def windows(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows: from each chunk on as many whole chunks as have ``least`` bytes, the last up to the end."""
    if len(text) < max(1, least):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bounds = np.concatenate([[0], chunk_ends(text)])
    start = bounds[:-1][bounds[:-1] <= len(text) - least]
    end = bounds[np.searchsorted(bounds, start + least)]
    if end[-1] < len(text):
        start, end = np.append(start, start[-1]), np.append(end, len(text))
    return start, end


def spots(start: np.ndarray) -> np.ndarray:
    """Twice the start of each window; one more for a second window from the same start, which goes up to the text's end."""
    return 2 * start + np.concatenate([[0], start[1:] == start[:-1]]).astype(np.int64)[:len(start)]


def stretches(text: bytes, spot: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the windows of a text that stand at these spots."""
    begin, end = windows(text, least)
    at = np.searchsorted(spots(begin), spot)
    return list(zip(begin[at].tolist(), end[at].tolist()))


def cells_of(docs: DataFrame, passage_bytes: int, places: bool = True) -> DataFrame:
    """``d1, spot, doc, body`` for each window, or ``key`` alone, once a text; white space of any kind counts as a blank.

    docs has doc_id, body and text.  The digest has 64 bits in ``d1`` and 32 more in the upper half of ``spot``; the lower half
    says where the window stands (see ``spots``).  ``key`` is the upper ``KEY_BITS`` of ``d1``, so that fewer bytes are shuffled.
    """
    blank = bytes.maketrans(SPACES.encode(), b" " * len(SPACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places_of, digests = [], [], []
            for r, text in enumerate(as_bytes(batch.column(2))):
                text = text.translate(blank)
                begin, end = windows(text, passage_bytes)
                rows.append(np.full(len(begin), r))
                places_of.append(spots(begin))
                found = [xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
                digests += found if places else set(found)
            if not digests:
                continue
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            if not places:
                made = {"key": (d[:, 0].view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)}
            else:
                r = np.concatenate(rows)
                made = {"d1": d[:, 0].copy(), "spot": (d[:, 1] << 32) | np.concatenate(places_of),
                        "doc": batch.column(0).to_numpy()[r], "body": batch.column(1).to_numpy()[r]}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made.values()], names=list(made))
    return docs.mapInArrow(run, "d1 long, spot long, doc long, body long" if places else "key long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, body, packed``: the texts as zstandard frames, which are smaller in a shuffle than its own compression makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                frames = pa.array([squeeze(x) for x in as_bytes(part.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), frames], names=["doc_id", "body", "packed"])
    return docs.mapInArrow(run, "doc_id long, body long, packed binary")


def runs(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Marked stretches in ascending order, those that touch as one."""
    out: list[list[int]] = []
    for start, end in marks:
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without(stretches: list[tuple[int, int]], held: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """What of the stretches lies outside ``held`` (both ascending), if at least ``least`` long."""
    out, i = [], 0
    for start, end in stretches:
        while i < len(held) and held[i][1] <= start:
            i += 1
        k = i
        while k < len(held) and held[k][0] < end:
            out.append((start, held[k][0]))
            start = max(start, held[k][1])
            k += 1
        out.append((start, end))
    return [(a, b) for a, b in out if b - a >= max(1, least)]


FIELDS = ("n_passages long, passage_chars long, n_removed_chars long, spans string, keepers array<long>, kept_text string")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """One row for each document that shares a passage with another one: ``doc_id``, the counts, the passages' spans
    (``start:end`` in code points, comma-joined), the documents that keep them and the text without what those keep.

    A passage is made of windows of neighbouring chunks, each of at least ``passage_bytes`` and each standing whole in some
    other document; windows that touch form one passage (it loses the ends that do not fill a chunk).
    Each window stays in the smallest id that has it.  A document loses the bytes of windows that others keep, unless
    a window that it keeps itself covers them: so every window lost stands whole in the text that its keeper keeps.
    Null and empty text has no chunks; rows without id are left
    out; rows of one id are one document, so what repeats only among them is no passage, and each such row with
    passages gives a row; identical rows of one id give one row; no passage or an empty table gives no row.
    """
    slim = narrow(docs.filter(F.col(quoted(id_col)).isNotNull()), id_col, text_col)
    slim = slim.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), "text")
    # The key alone says which windows several texts can have; only those are compared by the whole digest and by document.
    # It is taken from ``d1`` in the join (not reusing the aggregate's partitioning, see ``attach``) and is no column of the cells.
    twice = cells_of(slim, passage_bytes, places=False).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = twice.select(F.bitwise_not(F.bitwise_not("key")).alias("key"))
    cells = cells_of(slim, passage_bytes)
    cells = cut_lineage(cells.join(twice, F.shiftrightunsigned("d1", 64 - KEY_BITS) == F.col("key")).drop("key"))
    cells = cells.select("d1", F.shiftright("spot", 32).alias("d2"), F.col("spot").bitwiseAND(0xFFFFFFFF).alias("spot"), "doc", "body")
    common = (cells.groupBy("d1", "d2").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"))
              .filter("keeper <> last").select("d1", "d2", "keeper"))
    marks = attach(cells, common, "d1", "d2").groupBy("doc", "body").agg(
        F.sort_array(F.collect_set(F.struct("spot", "keeper"))).alias("marks"))
    marks = marks.select(F.col("doc").alias("doc_id"), "body", "marks")
    joined = packed_texts(slim).join(marks, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"]).select(
        "doc_id", "packed", F.col("marks.spot").alias("spot"), F.col("marks.keeper").alias("keeper"))
    blank = bytes.maketrans(SPACES.encode(), b" " * len(SPACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, text, spot, keeper in zip(batch.column(0).to_pylist(), map(unpack, batch.column(1).to_pylist()),
                                               *(batch.column(i).to_pylist() for i in (2, 3))):
                marks = stretches(text.translate(blank), np.array(spot), passage_bytes)
                found = runs(marks)
                gone = without(runs([m for m, k in zip(marks, keeper) if k != doc]),
                               runs([m for m, k in zip(marks, keeper) if k == doc]), passage_bytes)
                letters = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                kept, last = [], 0
                for a, b in gone:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out.append((doc, len(found), int(sum(letters[b] - letters[a] for a, b in found)),
                            int(sum(letters[b] - letters[a] for a, b in gone)),
                            ",".join(f"{letters[a]}:{letters[b]}" for a, b in found),
                            sorted(set(keeper)),
                            b"".join(kept).decode("utf-8")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
            names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    return joined.mapInArrow(run, f"doc_id long, {FIELDS}")
