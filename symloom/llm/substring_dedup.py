"""Substring deduplication over windows of words, with a count-min sketch before the exact grouping."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.sketch import blocks_for, hit_twice, merged, placed
from symloom.llm.text import Words, cut, mix, pack, text_buffers, unpack, words_of


def window_anchors(words: Words, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each window's first word, its anchor): the least hash among the window's shingles.

    The anchor depends on the window's words only, so a window occurs no more often than its anchor does, and
    neighbouring windows mostly share one.
    """
    total = len(words.hashes)
    if total < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.rows[: total - window + 1] == words.rows[window - 1 :])
    first = np.arange(total - shingle + 1)
    least, reach, want = words.span(first, first + shingle), 1, window - shingle + 1
    while reach < want:
        step = min(reach, want - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return at, least[at]


def _runs(at: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where, among windows in order, a new anchor or a new row begins."""
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    return fresh


_TAG_BITS = 23


def _place_and_tag(place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A word's place with some bits of its row's key, which part rows that have one id and different texts."""
    return (place.astype(np.int64) << _TAG_BITS) | (row & ((1 << _TAG_BITS) - 1))


def _profiled(rows: DataFrame, window: int, shingle: int) -> DataFrame:
    """(doc_id, row, n_words, words_id, kept_sha256, anchors) of every row, from one pass over the texts.

    words_id names the words of rows that have an id and a window; anchors are those of its windows. kept_sha256 is
    the digest that holds if nothing is removed.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in words_of(batch.column(2)):
                part = batch.slice(first, last - first)
                valid = np.array(part.column(0).is_valid())
                at, anchor = window_anchors(words, window, shingle)
                fresh = _runs(at, words.rows[at], anchor) & valid[words.rows[at]]
                owner = words.rows[at][fresh]
                ends = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(anchor[fresh].view(np.int64)))
                names, digests = [], []
                for r in range(last - first):
                    joined = b" ".join(words.bytes[words.offsets[r] : words.offsets[r + 1]].tobytes().split())
                    names.append(hashlib.blake2b(joined, digest_size=16).digest() if valid[r] and words.counts[r] >= window else None)
                    digests.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(words.counts.astype(np.int64)), pa.array(names, pa.binary()), pa.array(digests, pa.string()), anchors],
                    ["doc_id", "row", "n_words", "words_id", "kept_sha256", "anchors"],
                )

    return rows.mapInArrow(profile, "doc_id long, row long, n_words long, words_id binary, kept_sha256 string, anchors array<long>")


def _flagged(compared: DataFrame, cells_per_key: float) -> DataFrame:
    """(row, anchors): the anchors of each row that the sketch of all rows estimates to occur twice."""

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("anchors").flatten().to_numpy().view(np.uint64)

    total = compared.agg(F.sum(F.size("anchors"))).first()[0] or 0
    blocks = blocks_for(total, cells_per_key)
    sketch = cut(merged(compared.select("anchors"), lambda batch: iter([keys_of(batch)]), blocks))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column("anchors"), keys_of(batch)
            block, cells = placed(keys, blocks)
            owner = batch.column("row").take(pc.list_parent_indices(lists))
            yield pa.RecordBatch.from_arrays([owner, pa.array(keys.view(np.int64)), pa.array(block), pa.array(cells)], ["row", "anchor", "block", "cells"])

    anchors = compared.select("row", "anchors").mapInArrow(spread, "row long, anchor long, block long, cells long")
    hits = anchors.join(sketch, "block").filter(hit_twice("bits", "cells")).select("row", "anchor")
    return hits.groupBy("row").agg(F.collect_set("anchor").alias("anchors"))  # no more than the anchors of one text


def remove_repeated(docs: DataFrame, window: int = 50, shingle: int = 16, cells_per_key: float = 4) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document of a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, for rows with removals, kept (the remaining words joined by
    one space, zlib; null where nothing was removed).

    1. One pass over the texts writes a narrow profile of each: a name of its words, and the anchors of its windows.
    2. Rows whose words are all those of a smaller id's row are done: all their words go.
    3. Every partition counts the anchors of the others in a count-min sketch; merged, it overestimates in how many
       places a window occurs. Its width follows the number of anchors (``cells_per_key`` cells a row for each) and it
       stays a table of blocks, which anchors meet by a join: a narrower sketch lets more windows through, and no
       width loses one.
    4. Rows without a flagged anchor are done. Only windows estimated to occur twice are emitted, and grouped exactly
       by a 96-bit hash of their words; rows meet their removed windows by id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged, of the whole text. Null and empty texts have none. Windows of a row
    with a null id are not compared: nothing is removed from it, or because of it. Rows with one id are compared
    with other ids only; repeated rows give repeated results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    profile = cut(_profiled(rows, window, shingle))
    first = profile.filter(F.col("words_id").isNotNull()).groupBy("words_id").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = first.filter(F.col("first_id") < F.col("last_id")).select("words_id", "first_id")
    named = profile.filter(F.col("words_id").isNotNull()).join(first, "words_id", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    named = cut(named.select("doc_id", "row", "n_words", "kept_sha256", "anchors", "copy"))
    flagged = cut(_flagged(named.filter(~F.col("copy")), cells_per_key))

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            packed = [pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "row", "packed"])

    met = rows.filter(F.col("doc_id").isNotNull()).mapInArrow(packing, "doc_id long, row long, packed binary").join(flagged, "row")
    met = cut(met.select("doc_id", "row", "packed", "anchors"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.array([unpack(p) for p in part.column(2).to_pylist()], pa.binary()).cast(pa.string())
                for first, last, words in words_of(texts):
                    at, anchor = window_anchors(words, window, shingle)
                    lists = part.column(3).slice(first, last - first)
                    own = lambda anchor, row: mix(anchor ^ ((row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))  # noqa: E731  an anchor in a row
                    listed = own(lists.flatten().to_numpy().view(np.uint64), pc.list_parent_indices(lists).to_numpy())
                    fresh = _runs(at, words.rows[at], anchor)
                    at = at[np.isin(own(anchor[fresh], words.rows[at][fresh]), listed)[np.cumsum(fresh) - 1]]
                    if not len(at):
                        continue
                    owner = pa.array(words.rows[at] + first)
                    h = words.span(at, at + window)
                    # a second hash from the window's two halves
                    check = words.span(at, at + window // 2) * np.uint64(3) + words.span(at + window // 2, at + window)
                    place = _place_and_tag(at - words.row_starts[words.rows[at]], part.column(1).take(owner).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column(0).take(owner), pa.array(place)], ["window", "proof", "doc_id", "place"])

    windows = met.mapInArrow(candidates, "window long, proof int, doc_id long, place long")
    first_ids = windows.groupBy("window", "proof").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first_ids = cut(first_ids.filter(F.col("first_id") < F.col("last_id")).select("window", "proof", "first_id"))
    # an exchange of its own on either side, so that Spark can split a window that very many documents share
    covered = windows.join(first_ids, ["window", "proof"]).filter(F.col("doc_id") > F.col("first_id"))
    tag = lambda c: F.col(c).bitwiseAND((1 << _TAG_BITS) - 1).alias("tag")
    covered = covered.groupBy("doc_id", tag("place")).agg(F.collect_set(F.shiftright("place", _TAG_BITS).cast("int")).alias("places"))  # no more than the words of one text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            for packed, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpack(packed).split()
                counts.append(len(words))
                if places:
                    edges = np.zeros(len(words) + window + 1, dtype=np.int32)
                    starts = np.array(places)
                    edges[starts] += 1
                    edges[starts + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[: len(words)] == 0)]
                joined = b" ".join(words)
                removed.append(counts[-1] - len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(zlib.compress(joined, 1) if places else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    compared = met.select("doc_id", tag("row"), "packed").join(covered, ["doc_id", "tag"], "left").select("doc_id", "packed", "places")
    compared = compared.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    whole = F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept")
    short = profile.filter(F.col("words_id").isNull()).select("doc_id", "n_words", *whole)
    unique = named.filter(~F.col("copy")).join(flagged.select("row"), "row", "left_anti").select("doc_id", "n_words", *whole)
    nothing = F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")
    copies = named.filter("copy").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), nothing, F.lit(zlib.compress(b"", 1)).alias("kept"))
    return compared.unionByName(unique).unionByName(short).unionByName(copies)
