"""Quality rules by repetition coverage.

Words get 64-bit hashes, windows of several lengths get polynomial rolling hashes, and the share of
characters inside windows (or lines) that the text already had decides.  One pass, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.frames import SPACES, append_struct, as_bytes, covered, fresh, mix64, quoted

# Largest share of word characters in repeated windows of so many words, and in repeated lines.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))

FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
       T.StructField("line_share", T.DoubleType()), T.StructField("worst_share", T.DoubleType())])


def windows_seen_before(hashes: np.ndarray) -> np.ndarray:
    """Positions of windows whose hash an earlier position has."""
    _, first = np.unique(hashes, return_index=True)
    later = np.ones(len(hashes), bool)
    later[first] = False
    return np.flatnonzero(later)


def _repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that the text has at least twice, by exact codes."""
    if len(ids) < 4:
        return 0
    code = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 21:
        code = np.unique(code, return_inverse=True)[1]
    code = code * kinds + ids[2:]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    return int(covered(np.flatnonzero(counts[inverse] > 1), 3, len(ids)).sum())


def measure_text(text: bytes, limits: dict[int, float], line_limit: float) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~space)])
    edges = np.diff(np.concatenate([[1], space, [1]]).astype(np.int8))
    chars = before[np.flatnonzero(edges == 1)] - before[np.flatnonzero(edges == -1)]
    words, n, total = text.split(), len(chars), int(before[-1])
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)

    lines: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if line in lines:
            dup_lines += 1
            dup_chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        elif line.strip():
            lines.add(line)

    repeats = _repeat_words(ids, len(codes))
    failed = n < 50 or 100 * repeats > 50 * n
    line_share = dup_chars / total if total else 0.0
    worst = line_share / line_limit
    hashed = mix64(ids)
    rolled, length = hashed, 1
    with np.errstate(over="ignore"):
        for size in sorted(limits):
            if n <= size:
                break
            while length < size:
                rolled = rolled[:-1] * _BASE + hashed[length:]
                length += 1
            later = windows_seen_before(rolled)
            if len(later):
                share = chars[covered(later, size, n)].sum() / total
                worst = max(worst, share / limits[size])
    return (n, total, int(_SYMBOL[raw].sum()), dup_lines, repeats, failed, not failed and worst <= 1, line_share,
            float(worst))


def measured(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None,
             line_limit: float = LINE_LIMIT, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column of the counts and the verdict of every whole text.

    Null and empty text has no words and fails; repeated rows are judged one by one, each alike; an empty table
    stays empty; other columns pass through, and a column called ``name`` makes the new one longer by ``_``.
    A text shorter than a window has no share at that length.  ``worst_share`` is the largest share over its limit.
    """
    limits = WINDOW_LIMITS if limits is None else limits
    place = docs.columns.index(text_col)

    def compute(batch: pa.RecordBatch) -> dict:
        rows = [measure_text(x, limits, line_limit) for x in as_bytes(batch.column(place))]
        return dict(zip(FIELDS.fieldNames(), zip(*rows)))
    return append_struct(docs, fresh(docs, name), FIELDS, compute)


def keep_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents that pass, with their own columns."""
    out = measured(docs, text_col, **rules)
    return out.filter(F.col(out.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept`` and the shares behind it."""
    slim = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return measured(slim, **rules).select("doc_id", "quality.*")
