"""Spelling variants: words one edit apart, met through their spellings in a reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import cut, powers

_BASE = 0x9E3779B97F4A7C15
#: Longer words, whose neighbourhoods would grow with the square of their length, meet by halves.
LONGEST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): runs `[A-Za-z\\u00C0-\\u00FF]+` of the whole texts, A-Z lower-cased, at least ``letters`` long and ``least`` frequent.

    Where ``slip`` divides h, the crc32 of `<doc_id>:<run>`, the run's letter h % length is left out first. Null texts
    have no runs; a null doc_id is written as the empty text. Counts cover all documents, pre-aggregated in each task.
    """
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]{%d,}" % letters), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "owner", "run").cast("binary")).alias("h"))
    word = F.expr(f"CASE WHEN h % {slip} = 0 THEN concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)) ELSE run END")
    words = runs.select(word.alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def symbols_for(words: int, letters: int = 8) -> int:
    """The fewest symbols, four at least, of which words of ``letters`` symbols can be as many as ``words``."""
    symbols = 4
    while symbols**letters < words:
        symbols += 1
    return symbols


class Reduced:
    """Words of some rows in an alphabet of a few symbols, each word hashed to 64 bits so that an edit costs one step."""

    def __init__(self, words: list[str], symbols: int):
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.symbols, self.lengths = symbols, np.array([len(w) for w in words], dtype=np.int64)
        self.rows = np.repeat(np.arange(len(words)), self.lengths)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.letter = ((code.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)) % np.uint64(symbols)
        up = powers(_BASE, max(1, int(self.lengths.max(initial=0)) + 1))
        self.power, self.inverse = up[0][np.arange(len(code)) - self.starts[self.rows]], up[1][1]
        self.term = (self.letter + np.uint64(1)) * self.power
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(self.term, out=sums[1:])
        self.before = sums[:-1] - sums[self.starts[self.rows]]
        self.whole = sums[self.starts[1:]] - sums[self.starts[:-1]]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the reduced words one deletion, or one replacement by a later symbol, away; each once.

        What an insertion, or a replacement by an earlier symbol, leads to is the same pair seen from its other word:
        together the words of a vocabulary generate their full neighbourhoods, and every pair of them meets once.
        """
        whole = self.whole[self.rows]
        # of equal symbols in a row, the first is deleted
        single = np.ones(len(self.rows), dtype=bool)
        single[1:] = (self.letter[1:] != self.letter[:-1]) | (self.rows[1:] != self.rows[:-1])
        rows, hashes = [self.rows[single]], [(self.before + (whole - self.before - self.term) * self.inverse)[single]]
        for symbol in range(1, self.symbols):
            lower = self.letter < symbol
            rows.append(self.rows[lower])
            hashes.append((whole - self.term + np.uint64(symbol + 1) * self.power)[lower])
        return np.concatenate(rows), np.concatenate(hashes)


def _reduced_keys(words: DataFrame, symbols: int, widened: bool) -> DataFrame:
    """(key, same, word, n): the hash of each reduced word (same), and those of its neighbours if ``widened``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                reduced = Reduced(part.column(0).to_pylist(), symbols)
                rows, hashes, same = np.arange(part.num_rows), reduced.whole, np.ones(part.num_rows, dtype=bool)
                if widened:
                    near, theirs = reduced.neighbours()
                    rows, hashes, same = np.concatenate((rows, near)), np.concatenate((hashes, theirs)), np.concatenate((same, np.zeros(len(near), dtype=bool)))
                owner = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(same), owner.column(0), owner.column(1)], ["key", "same", "word", "n"])

    return words.filter(F.length("word") <= LONGEST).select("word", "n").mapInArrow(keys, "key long, same boolean, word string, n long")


def _half_keys(words: DataFrame) -> DataFrame:
    """(key, word, n): a pair whose longer word has m letters shares its first m / 2 letters, or its last m - m / 2."""
    m = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    long = words.filter(F.length("word") >= LONGEST).select("word", "n", m).filter(F.col("m") > LONGEST)
    half = F.expr("array(named_struct('m', m, 'last', false, 'part', sha2(substring(word, 1, m div 2), 256)), named_struct('m', m, 'last', true, 'part', sha2(right(word, m - m div 2), 256)))")
    return long.select(F.explode(half).alias("key"), "word", "n")


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, near, near_n): both orders of every two words that differ by one inserted, deleted or replaced letter.

    Words are hashed into an alphabet of ``symbols`` letters; the neighbours of each reduced word meet the reduced
    vocabulary by equality, and what meets is compared as it is spelt. The number of symbols decides how many meet for
    nothing, never what is found. Words over 64 letters meet by equal halves instead.
    """
    right = lambda df: df.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    apart = F.levenshtein("word", "near", 1) == 1
    short = _reduced_keys(words, symbols, True).join(right(_reduced_keys(words, symbols, False)), "key")
    short = short.filter((~F.col("same") | (F.col("word") < F.col("near"))) & apart).select("word", "n", "near", "near_n")
    halves = _half_keys(words)
    longer = F.greatest(F.length("word"), F.length("near")) == F.col("key.m")  # pairs of short words met before
    long = halves.join(right(halves), "key").filter((F.col("word") < F.col("near")) & longer & apart).select("word", "n", "near", "near_n").distinct()
    once = cut(short.unionByName(long))
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_forms(words: DataFrame, times: int = 10, symbols: int | None = None) -> DataFrame:
    """The usual form of every word of ``words`` (word, n; a word once).

    A word's form is the most frequent word one edit away (ties: the least in code-point order) if it is ``times`` as
    frequent at least, else null; its root is the last of the forms that follow from it, or the word itself. n_near
    counts the words one edit away, form_n is the form's n. Every step multiplies n by ``times``, so that the greatest
    n bounds the steps; roots double their reach in each round of joins. Without ``symbols`` their number follows the
    size of the vocabulary. Rows without a word or n are left out; an empty table gives no rows.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent: times > 1")
    words = cut(words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", "n"))
    total, most = words.agg(F.count("*"), F.max("n")).first()
    best = near_pairs(words, symbols or symbols_for(total)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    usual = -F.col("best.less") >= times * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))
    told = cut(told)
    steps = told.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach, longest = 1, 0
    while times ** (longest + 1) <= (most or 0):
        longest += 1
    while reach < longest:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps, reach = cut(steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))), 2 * reach
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
