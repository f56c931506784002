"""Shared helpers: Arrow text buffers, vectorised word and n-gram hashes, held-out folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.plans.lineage import cut  # noqa: F401  (the operators take it from here)

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: True for the bytes that separate words: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def unused_names(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    before = "_"
    while any((before + name).lower() in taken for name in names):
        before += "_"
    return [before + name for name in names]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets into them; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8), places


def row_slices(offsets: np.ndarray, limit: int = 1 << 18):
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone and stays whole."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        kept = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            kept.append(np.cumprod(steps, dtype=np.uint64))
        kept = (kept[0], kept[1])
        if size <= 1 << 21:
            _POWERS[base] = kept
    return kept


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """s with s[j] - s[i] = sum of values[k] * base**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def pack(raw: bytes) -> bytes:
    """``raw`` compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some rows: byte places, the row of each, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin = int(offsets[0])
        self.bytes = data[begin : int(offsets[-1])]
        self.offsets = offsets - begin
        n = len(self.bytes)
        inside = ~IS_SPACE[self.bytes]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.rows, minlength=len(offsets) - 1)
        self.row_starts = np.concatenate(([0], np.cumsum(self.counts)))
        sums = prefix_hash(self.bytes.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * powers(_BYTE_BASE, n + 1)[1][self.starts])
        self._sums = prefix_hash(self.hashes, _WORD_BASE)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within one row, and the index of each run's first word."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.rows[: total - n + 1] == self.rows[n - 1 :])
        return self.span(at, at + n), at

    def span(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [first, last)."""
        return mix((self._sums[last] - self._sums[first]) * powers(_WORD_BASE, len(self.hashes) + 1)[1][first])


def words_of(column: pa.Array, limit: int = 1 << 18):
    """(first row, last row, Words) for slices of a text column."""
    data, offsets = text_buffers(column)
    for first, last in row_slices(offsets, limit):
        yield first, last, Words(data, offsets[first : last + 1])
