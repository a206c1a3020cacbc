"""Bloom filters built on executors from bounded pieces.

A partition sets bits in local bitmaps of a fixed size and sends only their non-empty
blocks, sparse ones as positions.  Blocks are merged on executors in two levels; the
driver receives the merged bitmap, whose size is the ``bits`` parameter, never the data's.
A filter that is too small for its keys passes more of them on; it never loses one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.textkit import mix64

BLOCK_BYTES = 1 << 17
HASHES = 3
SCHEMA = "block long, task long, once binary, twice binary"


def positions(keys: np.ndarray, bits: int, hashes: int = HASHES) -> Iterator[np.ndarray]:
    """The bit positions of 64-bit keys, one array for each hash function; ``bits`` is a power of two."""
    step = mix64(keys) | np.uint64(1)
    for i in range(hashes):
        yield ((keys + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _bits_of(where: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes with these positions set."""
    out = np.zeros(size, dtype=np.uint8)
    np.bitwise_or.at(out, where >> 3, np.uint8(1) << (where & 7).astype(np.uint8))
    return out


def _pack(block: np.ndarray) -> bytes:
    at = np.flatnonzero(block)
    if 5 * len(at) >= len(block):
        return b"\0" + block.tobytes()
    return b"\1" + at.astype("<u4").tobytes() + block[at].tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, dtype=np.uint8, offset=1).copy()
    out, n = np.zeros(size, dtype=np.uint8), (len(data) - 1) // 5
    out[np.frombuffer(data, dtype="<u4", count=n, offset=1)] = np.frombuffer(data, dtype=np.uint8, offset=1 + 4 * n)
    return out


class OnceTwice:
    """Two bitmaps: keys seen, and keys seen again.  A key is told apart only by its bits, so ``twice`` has no false negatives."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once = np.zeros(bits // 8, dtype=np.uint8)
        self.twice = np.zeros(bits // 8, dtype=np.uint8)

    def add(self, keys: np.ndarray) -> None:
        """Keys of one or more documents, each document's keys distinct."""
        for where in positions(keys, self.bits):
            order = np.sort(where)
            again = order[1:][order[1:] == order[:-1]]
            bit = np.uint8(1) << (order & 7).astype(np.uint8)
            old = order[(self.once[order >> 3] & bit) != 0]
            for hit in (again, old):
                np.bitwise_or.at(self.twice, hit >> 3, np.uint8(1) << (hit & 7).astype(np.uint8))
            np.bitwise_or.at(self.once, order >> 3, bit)

    def blocks(self, task: int) -> Iterator[pa.RecordBatch]:
        size = min(BLOCK_BYTES, self.bits // 8)
        rows: list[tuple[int, int, bytes, bytes]] = []
        for b in range(self.bits // 8 // size):
            part = slice(b * size, (b + 1) * size)
            if self.once[part].any():
                rows.append((b, task, _pack(self.once[part]), _pack(self.twice[part])))
            if len(rows) == 16 or rows and b == self.bits // 8 // size - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["block", "task", "once", "twice"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["block", "task", "once", "twice"])


def bitmap_builder(keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """A ``mapInArrow`` function that adds ``keys_of(batch)`` to one pair of bitmaps for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = OnceTwice(bits)
        for batch in batches:
            for keys in keys_of(batch):
                pair.add(keys)
        yield from pair.blocks(TaskContext.get().partitionId())

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
        for a, b in zip(table["once"], table["twice"], strict=True):
            x = _unpack(a.as_py(), size)
            twice |= _unpack(b.as_py(), size) | (once & x)
            once |= x
        return pa.table({"block": [table["block"][0].as_py()], "task": [table["task"][0].as_py() >> 8], "once": [_pack(once)], "twice": [_pack(twice)]}, schema=pa.schema([("block", pa.int64()), ("task", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]))

    return run


def collect_bitmap(parts: DataFrame, bits: int, which: str) -> np.ndarray:
    """Merge the tasks' blocks and bring bitmap ``which`` ("once" or "twice"), ``bits / 8`` bytes, to the driver."""
    size = min(BLOCK_BYTES, bits // 8)
    for key in (("block", "task"), ("block",)):
        if key == ("block", "task"):
            from pyspark.sql import functions as F

            grouped = parts.groupBy("block", F.shiftright("task", 8).alias("group"))
        else:
            grouped = parts.groupBy("block")
        parts = grouped.applyInArrow(_merge(size), SCHEMA)
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.select("block", which).collect():
        out[row["block"] * size : (row["block"] + 1) * size] = _unpack(bytes(row[which]), size)
    return out


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may be in the set; true for every key that is."""
    hit = np.ones(len(keys), dtype=bool)
    for where in positions(keys, len(bitmap) * 8):
        hit &= (bitmap[where >> 3] >> (where & 7).astype(np.uint8)) & 1 != 0
    return hit
