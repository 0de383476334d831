"""Token ids in directly addressable codes.

Each id is split into byte levels.  A level holds one byte of every id that reaches it, a bitmap that tells which go on,
and a directory of how many went on before every 512th; so the i-th token is read by one rank for each level.
A store is a Parquet table of blocks, in ascending order of document, written and read by executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.frames import narrow
from wardline.llm.tokens import encoder, slices

END_ID, BLOCK_TOKENS, RANK_BITS = 2, 1 << 18, 512
STORE = ("shard int, block int, shard_start long, n_tokens long, doc_ids array<long>, counts array<long>, payload binary")
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_codes(ids: np.ndarray) -> bytes:
    values, levels = ids.astype(np.uint32), []
    while len(values):
        low, values = (values & 255).astype(np.uint8), values >> 8
        on = values > 0
        bitmap = np.packbits(on, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(_BITS[bitmap], dtype=np.int64)])[:len(bitmap):RANK_BITS // 8].astype("<u4")
        levels.append((low, bitmap, ranks))
        values = values[on]
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", len(low)) for low, _, _ in levels)
    return head + b"".join(part.tobytes() for level in levels for part in level)


class Codes:
    """Reads a payload, all of it or any one token, without copying it."""

    def __init__(self, payload: bytes):
        (count,) = struct.unpack_from("<I", payload)
        at, self.levels = 4 + 8 * count, []
        for n in struct.unpack_from(f"<{count}Q", payload, 4):
            bits = -(-n // 8)
            ranks = -(-bits // (RANK_BITS // 8))
            self.levels.append((np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, np.uint8, bits, at + n),
                                np.frombuffer(payload, "<u4", ranks, at + n + bits)))
            at += n + bits + 4 * ranks

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS
            whole = int(_BITS[bitmap[first * RANK_BITS // 8:i >> 3]].sum())
            i = int(ranks[first]) + whole + int(_BITS[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        values = np.empty(0, np.uint32)
        for low, bitmap, _ in reversed(self.levels):
            out = low.astype(np.uint32)
            out[np.unpackbits(bitmap, count=len(low), bitorder="little").view(bool)] |= values << np.uint32(8)
            values = out
        return values


def _block(shard: int, block: int, start: int, docs: list[tuple]) -> tuple:
    ids = np.concatenate([d[1] for d in docs])
    return shard, block, start, len(ids), [d[0] for d in docs], [len(d[1]) for d in docs], encode_codes(ids)


_LONGS = pa.list_(pa.int64())
_STORE_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), _LONGS, _LONGS, pa.binary())
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"
_DOCUMENT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _rows(rows: list[tuple], schema: str, kinds: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID, keep_space: bool = False, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode every text, with ``end_id`` after it, into a store at ``path``; shards are ranges of ascending ids.

    Null ids come first and equal ids follow each other by text; null text is empty; other columns are ignored;
    an empty table makes an empty store.  A block holds whole documents and is closed at ``block_tokens``.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path, keep_space), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = block = start = 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, counts = enc.encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                for doc_id, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), ends - counts, ends):
                    held.append((doc_id, np.append(flat[i:j], np.uint32(end_id))))
                    size += j - i + 1
                    if size >= block_tokens:
                        yield _rows([_block(shard, block, start, held)], STORE, _STORE_KINDS)
                        held, size, block, start = [], 0, block + 1, start + size
        if held:
            yield _rows([_block(shard, block, start, held)], STORE, _STORE_KINDS)
    slim = narrow(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    ordered = slim.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, STORE).write.mode("overwrite").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the store: id, ids of all documents before, number of ids, ids (little-endian 32 bit)."""
    blocks = spark.read.schema(STORE).parquet(path)
    total, before = 0, []
    for shard, n in sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        before.append((shard, total))
        total += n
    starts = spark.createDataFrame(before, "shard int, shards_before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                start, ids, counts, payload = (batch.column(i)[r].as_py() for i in range(4))
                flat = Codes(payload).all().astype("<u4")
                ends = np.cumsum(counts)
                yield _rows([(d, start + int(e) - n, n, flat[e - n:e].tobytes()) for d, n, e in zip(ids, counts, ends)],
                            DOCUMENT, _DOCUMENT_KINDS)
    # One row for each shard: their number is a setting and does not grow with the data.
    placed = blocks.join(F.broadcast(starts), "shard").select(
        (F.col("shard_start") + F.col("shards_before")).alias("start"), "doc_ids", "counts", "payload")
    return placed.mapInArrow(run, DOCUMENT)
