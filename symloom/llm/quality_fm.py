"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import Words, fold, row_slices, text_buffers

WORD_BITS, BINS = 13, 12
_FLAGS = {
    "upper": lambda b: (b >= 65) & (b <= 90),
    "lower": lambda b: (b >= 97) & (b <= 122),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "mark": lambda b: ((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126)),
    "stop": lambda b: (b == 46) | (b == 44),
    "line": lambda b: b == 10,
    "wide": lambda b: b >= 128,
}
STATISTICS = (*_FLAGS, "word_length", "distinct", "common_word", "size", "declared")
SIZE = (1 << WORD_BITS) + len(STATISTICS) * BINS


@dataclass
class Factors:
    bias: float
    linear: np.ndarray
    pairs: np.ndarray


def features(texts: pa.Array, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and where each row begins in them (with the end).

    Words: each distinct hashed word of the whole text, values of length 1 together. Statistics: shares of kinds of
    bytes, mean word length, share of distinct words, share of the commonest word, size, and the size that the
    metadata declares against the real one; each falls into one of BINS bins.
    """
    data, offsets = text_buffers(texts)
    ids, values, counts = [], [], []
    for first, last in row_slices(offsets):
        words = Words(data, offsets[first : last + 1])
        n = last - first
        size = np.diff(words.offsets)
        some = np.maximum(size, 1)
        shares = []
        for flag in _FLAGS.values():
            sums = np.concatenate(([0], np.cumsum(flag(words.bytes))))
            shares.append((sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / some)
        buckets = (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        distinct, often = np.unique((words.rows << WORD_BITS) | buckets, return_counts=True)
        row = distinct >> WORD_BITS
        per_row = np.bincount(row, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, row, often)
        total = np.maximum(words.counts, 1)
        stats = np.column_stack(
            [
                *(np.sqrt(s) for s in shares),
                np.minimum((words.ends - words.starts).sum() and np.bincount(words.rows, words.ends - words.starts, n) / total / 16, 1),
                per_row / total,
                np.sqrt(most / total),
                np.log1p(size) / 16,
                np.clip(declared[first:last] / some, 0, 2) / 2,
            ]
        )
        bins = np.clip((stats * BINS).astype(np.int64), 0, BINS - 1) + np.arange(len(STATISTICS)) * BINS + (1 << WORD_BITS)
        at = np.concatenate((row, np.repeat(np.arange(n), len(STATISTICS))))
        order = np.argsort(at, kind="stable")
        ids.append(np.concatenate((distinct & ((1 << WORD_BITS) - 1), bins.reshape(-1)))[order])
        values.append(np.concatenate((1 / np.sqrt(np.maximum(per_row, 1))[row], np.full(bins.size, 1 / np.sqrt(len(STATISTICS)))))[order].astype(np.float32))
        counts.append(per_row + len(STATISTICS))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate(values), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def raw_scores(model: Factors, ids: np.ndarray, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each row, and the sums of its factors: half of (sum of v x) squared less sum of (v x) squared."""
    starts = begins[:-1]
    vx = model.pairs[ids] * values[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
    return model.bias + np.add.reduceat(model.linear[ids] * values, starts) + pairs, sums


def train(ids: np.ndarray, values: np.ndarray, begins: np.ndarray, labels: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, steps: int = 600) -> Factors:
    """Adagrad on the logistic loss, over rows in an order fixed by a seed; few rows are passed more often, for ``steps`` steps."""
    random = np.random.default_rng(7)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Factors(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), random.normal(0, 0.05, (SIZE, rank)).astype(np.float32))
    past_linear, past_pairs, past_bias = np.full(SIZE, 1e-2), np.full((SIZE, rank), 1e-2), 1e-2
    epochs = max(epochs, -(-steps // max(1, -(-len(labels) // batch))))
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for first in range(0, len(order), batch):
            part = order[first : first + batch]
            lengths = begins[part + 1] - begins[part]
            ends = np.cumsum(lengths)
            take = np.repeat(begins[part] - ends + lengths, lengths) + np.arange(ends[-1])
            i, x = ids[take], values[take]
            z, sums = raw_scores(model, i, x, np.concatenate(([0], ends)))
            error = (1 / (1 + np.exp(-z)) - labels[part]) / len(part)
            owner = np.repeat(np.arange(len(part)), lengths)
            used, place = np.unique(i, return_inverse=True)
            e = (error[owner] * x)[:, None]
            each = np.column_stack((e, e * (sums[owner] - model.pairs[i] * x[:, None])))
            grad = np.column_stack([np.bincount(place, weights=each[:, c], minlength=len(used)) for c in range(each.shape[1])])
            g_linear, g_pairs = grad[:, 0] + decay * model.linear[used], grad[:, 1:] + decay * model.pairs[used]
            past_linear[used] += g_linear**2
            past_pairs[used] += g_pairs**2
            past_bias += error.sum() ** 2
            model.linear[used] -= rate * g_linear / np.sqrt(past_linear[used])
            model.pairs[used] -= rate * g_pairs / np.sqrt(past_pairs[used])
            model.bias -= rate * error.sum() / np.sqrt(past_bias)
    return model


def _declared(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)


def _with_size(docs: DataFrame) -> DataFrame:
    declared = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", declared.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, **settings) -> Factors:
    """Learn quality from labelled rows whose fold is not 0: about ``sample`` of them, chosen by a hash of the id.

    Executors make the features; only those of the sample are collected. Null and repeated labels: rows without a
    quality are left out, and an id with several labels counts with the least. Of an id with several rows one is read,
    that of the least hash, so that no more rows than ids leave the executors.
    """
    marked = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = marked.count()
    if not count:
        return Factors(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, 1), np.float32))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.filter(drawn < min(1.0, sample / count))
    # about `sample` ids of 16 bytes: bounded by the parameter
    rows = _with_size(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars", "quality"), F.struct(F.xxhash64("text"), "n_chars")).alias("one")).select("doc_id", "one.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, begins = features(batch.column(1), _declared(batch.column(2)))
            cuts = begins.tolist()
            made = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (ids.astype(np.int16), values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *(pa.array(m, pa.binary()) for m in made)], ["doc_id", "quality", "ids", "values"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc_id long, quality int, ids binary, values binary").collect())
    if not got:  # labels of other documents only
        return Factors(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, 1), np.float32))
    ids = np.frombuffer(b"".join(bytes(r[2]) for r in got), dtype=np.int16).astype(np.int64)
    values = np.frombuffer(b"".join(bytes(r[3]) for r in got), dtype=np.float32)
    begins = np.concatenate(([0], np.cumsum([len(r[2]) // 2 for r in got])))
    return train(ids, values, begins, np.array([float(r[1]) for r in got]), **settings)


def score(docs: DataFrame, model: Factors) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score of 0.3 or more) of every whole text; null counts as empty.

    No shuffle. Texts, and n_chars where there is one, are all that a score depends on. Null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x rank numbers
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, values, begins = features(part.column(2), _declared(part.column(3)))
                z, _ = raw_scores(shared.value, ids, values, begins)
                found[first : first + part.num_rows] = 1 / (1 + np.exp(-z.astype(np.float64)))
            found = np.round(found, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = _with_size(docs).select("doc_id", held, "text", "n_chars")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
