"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into errors + 1 pieces; with at most so many errors, one piece stays whole."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` closest to ``pattern``, the earliest end; (most + 1, -1) if none.

    Myers' column update: one machine word (a Python integer) holds a whole column of the edit table.
    """
    m = len(pattern)
    high, full = 1 << (m - 1), (1 << m) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(across | plus) & full), plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


class Finder:
    """All items' pieces in one keyword automaton, and the items to verify against."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.budgets = [budget(text, rate) for _, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budgets[k]):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of each item within its budget of some stretch of the normalised text."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, []).append(end + 1 - length - offset)
        out = []
        for k, found in starts.items():
            ident, item = self.items[k]
            errors = self.budgets[k]
            best, place, past = errors + 1, -1, -1
            stretches: list[list[int]] = []
            for s in sorted(set(found)):  # hits of one passage fall together and are verified once
                low, high = max(0, s - errors), min(len(text), s + len(item) + errors)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], high)
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                distance, past = myers(item, text[low:high], errors)
                if distance < best:
                    best, place = distance, low + past
            if place >= 0:
                out.append((ident, best, place))
        return out


def _prepared(rows: list) -> list[tuple[int | None, str]]:
    return sorted(((r[0], normal(r[1])) for r in rows if normal(r[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_items(docs: DataFrame, items: DataFrame, error_rate: float = 0.06, block: int = 5_000) -> DataFrame:
    """(doc_id, item_id, distance, end) for every document with a stretch within an item's error budget.

    Texts are compared in lower case with white space collapsed. An item's budget is ``error_rate`` of its length
    in edits. Whole texts are searched. Items with null or empty text match nothing, equal items count
    each. Benchmarks are read in blocks of ``block`` items, each of which is sent to all tasks (a bound on what is
    sent); a larger benchmark takes as many passes. Null ids are kept; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    ranked = items.select("item_id", "text").filter(F.length(F.trim(F.col("text"))) > 0)
    blocks = max(1, -(-ranked.count() // block))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    out = None
    for b in range(blocks):
        part = ranked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(_prepared(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, error_rate)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in finder.find(normal(t))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc_id", "item_id", "distance", "end"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance int, end int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, error_rate: float = 0.06, block: int = 5_000) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; one narrow pass for each block of items."""
    spark = docs.sparkSession
    ranked = items.select("item_id", "text").filter(F.length(F.trim(F.col("text"))) > 0)
    blocks = max(1, -(-ranked.count() // block))
    at = docs.columns.index("text")
    for b in range(blocks):
        part = ranked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(_prepared(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
