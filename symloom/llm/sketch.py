"""Count-min sketches of any width, as tables: which cells were hit at least twice, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 14
#: Odd factors, one for each row of a sketch.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LOW = (1 << BLOCK_BITS) - 1


def blocks_for(keys: int, cells_per_key: float) -> int:
    """Blocks of 2**BLOCK_BITS cells a row, so that a row has about ``cells_per_key`` cells for each key."""
    return max(1, int(np.ceil(keys * cells_per_key / (1 << BLOCK_BITS))))


def placed(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, the cells of all rows within it, packed into one number) of every 64-bit key."""
    block = (keys >> np.uint64(1)) % np.uint64(blocks)
    cells = np.zeros(len(keys), dtype=np.uint64)
    for row, factor in enumerate(FACTORS):
        cells |= (keys * factor) >> np.uint64(64 - BLOCK_BITS) << np.uint64(BLOCK_BITS * row)
    return block.view(np.int64), cells.view(np.int64)


def merged(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], blocks: int, flush: int = 1_000_000) -> DataFrame:
    """(block, bits): a bit for each cell of a block's rows that keys hit twice or more over all of ``df``.

    Each task sketches its own partition (counts saturate at 2) and emits the cells it hit; these are dealt by block
    and merged as a stream, one block at a time. The table grows with ``blocks``; no task or driver holds it whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            key = np.concatenate(held)
            held.clear()
            block, cells = placed(key, blocks)
            every = [(block << (BLOCK_BITS + 2)) | (row << BLOCK_BITS) | ((cells >> (BLOCK_BITS * row)) & _LOW) for row in range(len(FACTORS))]
            cell, often = np.unique(np.concatenate(every), return_counts=True)
            packed = (((cell & ((1 << (BLOCK_BITS + 2)) - 1)) << 1) | (often > 1)).astype(np.int32)
            block, first = np.unique(cell >> (BLOCK_BITS + 2), return_index=True)
            offsets = pa.array(np.append(first, len(packed)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(block), pa.ListArray.from_arrays(offsets, pa.array(packed))], ["block", "cells"])

        for batch in batches:
            for key in keys(batch):
                if len(key):
                    held.append(key)
                if sum(map(len, held)) >= flush:
                    yield emit()
        if held:
            yield emit()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(FACTORS) << BLOCK_BITS
        now, seen, twice, out = None, np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), []

        def batch_of() -> pa.RecordBatch:
            bits = np.packbits(np.array([b for _, b in out]), axis=1, bitorder="little").view(np.int64)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * bits.shape[1])
            made = pa.RecordBatch.from_arrays([pa.array([b for b, _ in out]), pa.ListArray.from_arrays(offsets, pa.array(bits.reshape(-1)))], ["block", "bits"])
            out.clear()
            return made

        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            every = batch.column(1).values.to_numpy()
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != now:
                    if now is not None and twice.any():
                        out.append((now, twice.copy()))
                        if len(out) == 64:
                            yield batch_of()
                    now = block
                    seen[:], twice[:] = False, False
                packed = every[ends[i] : ends[i + 1]]
                cell = packed >> 1
                twice[cell[seen[cell] | (packed & 1 == 1)]] = True
                seen[cell] = True
        if now is not None and twice.any():
            out.append((now, twice))
        if out:
            yield batch_of()

    parts = df.mapInArrow(count, "block long, cells array<int>").repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(merge, "block long, bits array<long>")


def hit_twice(bits: str, cells: str) -> Column:
    """Whether all cells of a key are set: its estimated count is two or more."""
    tests = []
    for row in range(len(FACTORS)):
        cell = f"(shiftright({cells}, {BLOCK_BITS * row}) & {_LOW})"
        word = f"get({bits}, cast({(row << BLOCK_BITS) // 64} + shiftright({cell}, 6) as int))"
        tests.append(f"(shiftright({word}, cast({cell} & 63 as int)) & 1) = 1")
    return F.expr(" AND ".join(tests))
