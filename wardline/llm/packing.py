"""Packing by minimum bin slack.

Documents become ids, whole sequences of a long document are cut off first, and the remaining lengths fill each
sequence as closely as a bitset subset-sum can.  One pass without a shuffle: each partition packs its own documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wardline.llm.frames import narrow
from wardline.llm.tokens import encoder, slices

CAPACITY, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, {}, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take: the longest one, and what brings the sum closest to ``capacity``.

    Bit s of a bitset tells that sum s can be reached; each step adds a power of two of one length, and the steps are
    walked back from the best sum.
    """
    order = sorted(counts, reverse=True)
    first = next(x for x in order if x <= capacity)
    target = capacity - first
    within = (1 << target + 1) - 1
    reach, steps = 1, []
    for length in order:
        left = min(counts[length] - (length == first), target // length)
        take = 1
        while left > 0 and not reach >> target & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & within
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int, {first: 1})
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            used[length] += take
            best -= length * take
    return dict(used)


class Packer:
    """Pieces of documents laid into sequences; holds at most ``held`` ids and what one batch adds."""

    def __init__(self, capacity: int, first_sequence: int, held: int = 1 << 21, digest: bool = False):
        self.capacity, self.next, self.held, self.digest = capacity, first_sequence, held, digest
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.size, self.rows = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        whole = total - total % cap
        for start in range(0, whole, cap):
            self._emit([(doc_id, start, ids[start:start + cap], total)])
        if total > whole:
            self.waiting[total - whole].append((doc_id, whole, ids[whole:].copy(), total))
            self.size += total - whole
        if self.size > self.held:
            self._fill(self.held // 8)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            shown = crc32(ids) if self.digest else ids.tobytes()
            self.rows.append((doc_id, start, len(ids), shown, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _fill(self, leave: int) -> None:
        while self.size > leave:
            counts = {n: len(p) for n, p in self.waiting.items()}
            used = best_fill(counts, self.capacity)
            filled = sum(n * k for n, k in used.items())
            slack = self.capacity - filled
            if self.size < self.capacity:
                return
            for _ in range(1 if slack else min(counts[n] // k for n, k in used.items())):
                pieces = [self._take(n) for n, k in used.items() for _ in range(k)]
                if slack:
                    pieces += self._cut(slack)
                self._emit(pieces)

    def _take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.size -= length
        return piece

    def _cut(self, room: int) -> list[tuple]:
        """Pieces of exactly ``room`` ids together, the last one cut from the longest that waits."""
        out = []
        while room:
            doc_id, start, ids, total = self._take(max(self.waiting))
            if len(ids) > room:
                self.waiting[len(ids) - room].append((doc_id, start + room, ids[room:], total))
                self.size += len(ids) - room
                ids = ids[:room]
            out.append((doc_id, start, ids, total))
            room -= len(ids)
        return out

    def finish(self) -> None:
        """What no longer fills a sequence is cut: full sequences first, then lengths that are powers of two."""
        self._fill(0)
        pieces = [p for n in sorted(self.waiting, reverse=True) for p in self.waiting[n]][::-1]
        left = self.size
        while left:
            room, taken = min(self.capacity, 1 << left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                taken.append((doc_id, start, ids, total))
                room -= len(ids)
            self._emit(taken)
        self.waiting, self.size = defaultdict(list), 0

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if self.digest else pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids_crc32" if self.digest else "ids", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, keep_space: bool = True, digest: bool = False) -> DataFrame:
    """One row per piece: document, place in its ids, the ids (little-endian 32 bit), sequence and offset there.

    With ``digest`` the column is ``ids_crc32``, the CRC-32 of those bytes, and the ids do not leave the task.

    Null and empty text is the end id alone; a null id stays null; repeated rows are packed each by itself; an empty
    table gives an empty result; other columns are ignored.  Sequences are full, or (at most eleven at the end of
    a partition) a power of two long, so none is padded.  Sequence ids grow within a partition and start with its number.
    The tokenizer file must lie at the same path on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keep_space)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, digest=digest)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, counts = enc.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4", copy=False)
                ends = np.cumsum(counts + 1)
                for doc_id, start, end in zip(batch.column(0).slice(a, b - a).to_pylist(), (ends - counts - 1).tolist(), ends.tolist()):
                    packer.add(doc_id, ids[start:end])
                yield packer.taken()
            del batch, flat, ids
            pa.default_memory_pool().release_unused()
        packer.finish()
        yield packer.taken()
    slim = narrow(docs, id_col, text_col)
    return slim.select(slim["doc_id"].cast("long"), "text").mapInArrow(
        run, SCHEMA.format("ids_crc32 long" if digest else "ids binary"))
