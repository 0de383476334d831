"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames with cumulative counts of bytes, units and code points.  A cut after
a number of units is found by the counts and needs one frame decompressed; what lies between the cuts is passed on as
compressed frames, and only the cut frames are compressed anew.  Digests read the frames in order, one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wardline.llm.frames import SPACES, as_bytes, narrow
from wardline.llm.tokens import slices

FRAME_BYTES, SEED, RATE, SPM_RATE = 1 << 15, 42, 50, 80
# Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
STORE = "doc_id long, frames array<binary>, bytes array<long>, units array<long>, chars array<long>, marked boolean"


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cut_text(text: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Frames of about ``frame_bytes`` (whole code points) and the cumulative bytes, ended units and code points after each."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return [], [], [], []
    space = _SPACE[data]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    if space[-1]:
        ends = np.append(ends, len(data))
    cuts = []
    for at in range(frame_bytes, len(data), frame_bytes):
        while data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    cuts.append(len(data))
    starts = [0, *cuts[:-1]]
    chars = np.cumsum([_chars(data[a:b]) for a, b in zip(starts, cuts)])
    frames = [_compressor().compress(text[a:b]) for a, b in zip(starts, cuts)]
    return frames, cuts, np.searchsorted(ends, cuts, "right").tolist(), chars.tolist()


class Frames:
    """A text as frames with their cumulative sizes; the frame read last is kept."""

    def __init__(self, frames: list[bytes], sizes: list[int]):
        self.frames, self.sizes, self._last = frames, sizes, (-1, b"")

    def read(self, i: int) -> bytes:
        if self._last[0] != i:
            self._last = (i, _decompressor().decompress(self.frames[i]))
        return self._last[1]

    def start(self, i: int) -> int:
        return self.sizes[i - 1] if i else 0

    def stream(self, a: int, b: int) -> Iterator[bytes]:
        """The bytes from ``a`` to ``b``, frame by frame."""
        i = bisect_right(self.sizes, a)
        while a < b:
            start = self.start(i)
            yield self.read(i)[a - start:b - start]
            a = self.sizes[i]
            i += 1

    def cut(self, units: list[int], chars: list[int], k: int) -> tuple[int, int]:
        """Bytes and code points before the end of unit ``k``; one frame is decompressed."""
        if not k:
            return 0, 0
        i = bisect_left(units, k)
        data = np.frombuffer(self.read(i), np.uint8)
        space = _SPACE[data]
        inner = np.flatnonzero(~space[:-1] & space[1:]) + 1
        j = k - (units[i - 1] if i else 0) - 1
        at = int(inner[j]) if j < len(inner) else len(data)  # a unit may end with its frame
        return self.start(i) + at, (chars[i - 1] if i else 0) + _chars(data[:at])

    def part(self, a: int, b: int) -> Iterator[bytes]:
        """Frames that hold the bytes from ``a`` to ``b``: whole ones as they are, cut ones compressed anew."""
        i = bisect_right(self.sizes, a)
        while a < b:
            start, end = self.start(i), self.sizes[i]
            if a == start and end <= b:
                yield self.frames[i]
            else:
                yield _compressor().compress(self.read(i)[a - start:min(end, b) - start])
            a, i = end, i + 1


def choose(doc_id: int | None, n: int, marked: bool, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE
           ) -> tuple[str, int, int]:
    """Form and the units before the first and the second cut."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or marked or h3 % 100 >= rate:
        return "plain", first, second
    return ("spm" if h4 % 100 < spm_rate else "psm"), first, second


def arranged(text: Frames, form: str, a: int, b: int) -> list[bytes]:
    """The output as frames; ``a`` and ``b`` are the cuts in bytes."""
    size = text.sizes[-1] if text.sizes else 0
    if form == "plain":
        return text.frames
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, size)}
    return [f for mark in ORDERS[form] for f in (_compressor().compress(mark), *text.part(*parts[mark]))]


def digests(frames: list[bytes], form: str) -> tuple[str, str]:
    """SHA-256 of the output, and of the text rebuilt from output and form alone."""
    output, sizes, marks, tail, total = hashlib.sha256(), [], [], b"", 0
    order = ORDERS.get(form, ())
    for f in frames:
        data = _decompressor().decompress(f)
        output.update(data)
        window, base = tail + data, total - len(tail)
        at = 0
        while len(marks) < len(order):  # the text holds no mark, so the first one of each kind is the one put in
            at = window.find(order[len(marks)], at)
            if at < 0:
                break
            marks.append(base + at)
            at += 3
        total += len(data)
        sizes.append(total)
        tail = window[-2:]
        if marks:
            tail = tail[max(0, marks[-1] + 3 - (total - len(tail))):]
    if form == "plain":
        return output.hexdigest(), output.hexdigest()
    ends = [*marks[1:], total]
    parts = {mark: (a + 3, b) for mark, a, b in zip(order, marks, ends)}
    rebuilt, whole = hashlib.sha256(), Frames(frames, sizes)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        for data in whole.stream(*parts[mark]):
            rebuilt.update(data)
    return output.hexdigest(), rebuilt.hexdigest()


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, second, third = (m.decode() for m in ORDERS[form])
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(third, 1)
    return two + middle + one if form == "spm" else one + middle + two


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: its frames, their cumulative bytes, units and code points, and whether it holds a mark.

    Units are white space and the word after it, or white space at the end.  Null and empty texts have no frames.  Write it as
    a table (without a second compression) to read from it again and again.  A null id stays null, repeated rows are
    stored each by itself, an empty table gives an empty result, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in slices(b.column(1)):
                texts = as_bytes(b.column(1).slice(start, end - start))
                frames, sizes, units, chars = zip(*(cut_text(t, frame_bytes) for t in texts))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, end - start), pa.array(frames, pa.list_(pa.binary())), pa.array(sizes, longs),
                     pa.array(units, longs), pa.array(chars, longs),
                     pa.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts])],
                    names=["doc_id", "frames", "bytes", "units", "chars", "marked"])
                del texts, frames
            pa.default_memory_pool().release_unused()
    slim = narrow(docs, id_col, text_col)
    return slim.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORE)


OUTPUT = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
          ("middle_chars", pa.int64())]


def _each(store: DataFrame, finish, texts: list[str], seed: int, rate: int, spm_rate: int) -> DataFrame:
    schema = pa.schema(OUTPUT + [(name, pa.string()) for name in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                rows = []
                for doc_id, frames, sizes, units, chars, marked in zip(*(x.to_pylist() for x in b.slice(a, 256).columns)):
                    text, n = Frames(frames, sizes), units[-1] if units else 0
                    form, first, second = choose(doc_id, n, marked, seed, rate, spm_rate)
                    if form == "plain":
                        rows.append((doc_id, n, form, None, None, *finish(frames, form)))
                        continue
                    one, two = text.cut(units, chars, first), text.cut(units, chars, second)
                    rows.append((doc_id, n, form, one[1], two[1] - one[1], *finish(arranged(text, form, one[0], two[0]), form)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            pa.default_memory_pool().release_unused()
    return store.select("doc_id", "frames", "bytes", "units", "chars", "marked").mapInArrow(
        run, from_arrow_schema(schema))


def fill_in_middle(store: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of a store of frames.

    The cuts are two numbers of units drawn by the SHA-256 of seed and id.  A text that is empty, holds a mark, or is not drawn
    stays plain (null ``prefix_chars`` and ``middle_chars``); the others come as suffix, prefix, middle in ``spm_rate`` percent
    and else as prefix, suffix, middle.  Rows that share an id get the same draws; a null id draws as an empty one.
    """
    def finish(frames: list[bytes], form: str) -> tuple[str]:
        return (b"".join(map(_decompressor().decompress, frames)).decode(),)
    return _each(store, finish, ["output"], seed, rate, spm_rate)


def output_digests(store: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As ``fill_in_middle``, with SHA-256 of the output and of the text rebuilt from it; no text is held whole."""
    return _each(store, digests, ["output_sha256", "restored_sha256"], seed, rate, spm_rate)
