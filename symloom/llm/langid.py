"""Language identification: n-gram presence kernels, Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from symloom.llm.text import cut, fold, unused_names

#: n-grams are told apart by so many bits of their hash: enough for the distinct ones of texts of any length.
BITS = 22


@dataclass
class LanguageModel:
    """grams: hashes of the n-grams of all landmarks, in order; landmarks: presence rows over them, each divided by its
    text's norm; weights: landmarks x languages. No part exceeds landmarks x 2**BITS bits or landmarks x languages."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    longest: int


class Presence:
    """Distinct hashed character n-grams of whole texts."""

    def __init__(self, longest: int):
        self.longest, self.last = longest, np.zeros(1 << BITS, dtype=np.int32)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        h, found = np.zeros(len(points), dtype=np.uint32), []
        for n in range(1, self.longest + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] if n == 1 else h[:-1]) * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
        every = np.concatenate(found) if found else np.zeros(0, np.uint32)
        number = np.arange(len(every), dtype=np.int32)
        self.last[every] = number  # of equal hashes the last one written remains
        return every[self.last[every] == number]


class Kernel:
    """Rows of the normalised n-gram presence kernel between texts and landmarks."""

    def __init__(self, grams: np.ndarray, landmarks: np.ndarray, longest: int):
        self.presence, self.width = Presence(longest), len(grams)
        self.column = np.full(1 << BITS, self.width, dtype=np.int32)  # the last column is for all other n-grams
        self.column[grams] = np.arange(self.width)
        self.landmarks = np.ascontiguousarray(landmarks.T)

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows, norms = np.zeros((len(texts), self.width + 1), dtype=np.float32), np.ones((len(texts), 1), dtype=np.float32)
        for i, text in enumerate(texts):
            own = self.presence(text)
            rows[i, self.column[own]] = 1
            norms[i] = np.sqrt(max(1, len(own)))
        return (rows[:, :-1] @ self.landmarks) / norms


def fit(docs: DataFrame, per_language: int = 400, landmarks: int = 160, longest: int = 3, ridge: float = 1e-3, most_languages: int = 160) -> LanguageModel:
    """Learn from text and non-null lang of rows whose fold is not 0.

    The sample is bounded: of each of the ``most_languages`` most frequent languages about ``per_language`` rows,
    chosen by a hash of id and text at a rate set by the exact count of the language, the row of the least hash in any
    case; equal rows count once. Texts of rarer languages are named by the nearest of those. ``landmarks`` rows in all,
    as many of each language as can be, become the landmarks; executors compute the sample's kernel rows with them,
    and only these numbers are collected. Without labelled rows no language is known.
    """
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40))
    learned = docs.filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", drawn.alias("drawn"))
    known = learned.groupBy("lang").agg(F.count("*").alias("n"), F.min("drawn").alias("least")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    counts = {r["lang"]: r["n"] for r in known}
    if not counts:
        return LanguageModel([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), longest)
    below = {r["lang"]: max(r["least"] + 1, int(min(1.0, per_language / r["n"]) * (1 << 40))) for r in known}
    rate = F.create_map(*[F.lit(x) for item in sorted(below.items()) for x in item])
    sample = learned.filter(F.col("lang").isin(list(counts)) & (F.col("drawn") < F.element_at(rate, F.col("lang"))))
    sample = cut(sample.dropDuplicates(["doc_id", "text", "lang"]))
    each = -(-landmarks // len(counts))
    order = Window.partitionBy("lang").orderBy("drawn", "doc_id", "text")
    chosen = sample.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= each).orderBy("nth", "lang").limit(landmarks)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(longest)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(presence(t)).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["grams"])

    sets = [np.frombuffer(g, dtype=np.uint32) for g in sorted(bytes(r[0]) for r in chosen.select("text").mapInArrow(listed, "grams binary").collect())]
    grams = np.unique(np.concatenate(sets))
    marks = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for row, own in zip(marks, sets, strict=True):
        row[np.searchsorted(grams, own)] = 1 / np.sqrt(max(1, len(own)))
    shared = docs.sparkSession.sparkContext.broadcast((grams, marks, longest))

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(*shared.value)
        for batch in batches:
            k = [kernel([t])[0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k, pa.binary())], ["doc_id", "lang", "kernel"])

    got = sorted(tuple(r) for r in sample.select("doc_id", "text", "lang").mapInArrow(kernel_rows, "doc_id long, lang string, kernel binary").collect())
    languages = sorted(counts)
    k = np.frombuffer(b"".join(bytes(r[2]) for r in got), dtype=np.float32).reshape(len(got), -1).astype(np.float64)
    names = np.array([r[1] for r in got])
    y = (names[:, None] == np.array(languages)[None, :]).astype(np.float64)
    among = (marks @ marks.T).astype(np.float64)
    # rows of rare languages weigh as much in all as those of common ones
    weight = (1 / np.maximum(1, (names[:, None] == names[None, :]).sum(axis=1)))[:, None]
    left = k.T @ (weight * k) + ridge * among + 1e-8 * np.eye(len(among))
    return LanguageModel(languages, grams, marks, np.linalg.solve(left, k.T @ (weight * y)).astype(np.float32), longest)


def predict(docs: DataFrame, model: LanguageModel, block: int = 64) -> DataFrame:
    """``docs`` with lang_pred and score: a batch's kernel rows with the landmarks, times the weights.

    Texts that are null or have no letter, and all texts if no language was learned, get ``und`` and 0. Only the
    text is an input. No shuffle. Null ids, repeated rows and texts of any length are kept and read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kernel = Kernel(model.grams, model.landmarks, model.longest) if model.languages else None
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(at).to_pylist()
            live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if kernel else []
            for first in range(0, len(live), block):
                part = live[first : first + block]
                decided = kernel([texts[i] for i in part]) @ model.weights
                best = decided.argmax(axis=1)
                scores[part] = np.clip(decided.max(axis=1), 0, 1)
                for i, b in zip(part, best.tolist(), strict=True):
                    names[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(run, schema)


def predicted_languages(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out (its fold is 0), lang_pred, score of every document; a null id is not held out."""
    model = fit(docs, **settings)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least_score: float = 0.05, **settings) -> DataFrame:
    """``docs`` without those whose language is undetermined: no letter, or hardly an n-gram in common with any landmark
    (a score under ``least_score``; texts of one short word have three times that, and texts in two languages stay).

    Columns of ``docs`` named lang_pred or score stay as they are.
    """
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    aside = dict(zip(clash, unused_names(docs.columns, *clash), strict=True))
    found = predict(docs.withColumnsRenamed(aside), fit(docs, **settings))
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
