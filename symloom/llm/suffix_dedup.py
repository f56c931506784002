"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.text import cut, mix, pack, powers, prefix_hash, row_slices, text_buffers, unpack

_BASE = 0xD6E8FEB86659FD93
_LOW = np.uint64(0xFFFFFFFF)


class Suffixes:
    """The suffixes of some texts of at least ``depth`` bytes, and hashes of any byte string in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        begin = int(offsets[0])
        self.bytes, self.offsets, self.depth = data[begin : int(offsets[-1])], offsets - begin, depth
        self._sums = prefix_hash(self.bytes.astype(np.uint64) + np.uint64(1), _BASE)
        self._inverse = powers(_BASE, len(self.bytes) + 1)[1]

    def span(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the bytes [first, last)."""
        return mix((self._sums[last] - self._sums[first]) * self._inverse[first])

    def digits(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, place, digit) of each suffix of at least ``depth`` bytes.

        The digit is the string of ``gram`` bytes with the least hash (the leftmost of such) among those within the
        first ``depth``, and place is where it begins: suffixes that agree so far have one digit, at one distance.
        """
        n, reach = len(self.bytes), self.depth - gram + 1
        if n < self.depth:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        rows = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        at = np.arange(n - gram + 1)
        hashes = self.span(at, at + gram)
        least, have = (hashes & ~_LOW) | at.astype(np.uint64), 1
        while have < reach:
            step = min(have, reach - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        start = np.flatnonzero(rows[: n - self.depth + 1] == rows[self.depth - 1 :])
        place = (least[start] & _LOW).astype(np.int64)
        return rows[start], start, place, hashes[place]

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, last, digit, again) of each run of suffixes with one digit; again: it is at two places there."""
        row, start, place, digit = self.digits(gram)
        head, tail = edges(row, digit)
        return row[head], start[head], start[tail], digit[head], place[head] != place[tail]


def edges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs in which none of ``keys`` changes."""
    fresh = np.ones(len(keys[0]), dtype=bool)
    fresh[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    head = np.flatnonzero(fresh)
    return head, (np.append(head[1:], len(fresh)) - 1 if len(head) else head)


def _profiled(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """Size and digest of every text, and its runs of suffixes: digit, whole (all bytes that its suffixes cover), ends."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in row_slices(offsets):
                texts = Suffixes(data, offsets[a : b + 1], depth)
                row, first, last, digit, again = texts.runs(gram)
                whole = texts.span(first, last + depth)
                start = texts.offsets[row]
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (digit.view(np.int64), whole.view(np.int64), (first - start).astype(np.int32), (last - start).astype(np.int32), again)]
                digests = [hashlib.sha256(texts.bytes[x:y]).hexdigest() for x, y in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(texts.offsets)), pa.array(digests, pa.string()), *lists],
                    ["doc_id", "row", "n_bytes", "sha256", "digit", "whole", "first", "last", "again"],
                )

    schema = "doc_id long, row long, n_bytes long, sha256 string, digit array<long>, whole array<long>, first array<int>, last array<int>, again array<boolean>"
    return rows.mapInArrow(profile, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """(row, packed): every text compressed; of equal texts in one task only the first."""

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            fresh = [i for i, name in enumerate(names) if not (name in seen or seen.add(name))]
            data, offsets = text_buffers(batch.column(1))
            packed = [pack(data[offsets[i] : offsets[i + 1]].tobytes()) for i in fresh]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in fresh], pa.int64()), pa.array(packed, pa.binary())], ["row", "packed"])

    return rows.select("row", "text").mapInArrow(packing, "row long, packed binary")


def _joined(pieces: pa.Array, depth: int) -> Suffixes:
    """The suffixes of all ``pieces``."""
    offsets = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy())))
    return Suffixes(np.frombuffer(b"".join(pieces.to_pylist()), np.uint8), offsets, depth)


PIECE = "digit long, row long, first int, known boolean, wide boolean, bytes binary"


def _pieces(met: DataFrame, depth: int, at_once: int = 1 << 21) -> DataFrame:
    """The bytes of each of the runs in ``met`` (row, packed, runs)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = unpack(packed.as_py())
                for run in runs:
                    out.append((run["digit"], row, run["first"], run["known"], run["wide"], text[run["first"] : run["last"] + depth]))
                    held += len(out[-1][-1])
                    if held > at_once:
                        yield made(out)
                        out, held = [], 0
        if out:
            yield made(out)

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digit", "row", "first", "known", "wide", "bytes"])

    return met.mapInArrow(cutting, PIECE)


def _split(pieces: DataFrame, depth: int, gram: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` suffixes of ``pieces``: a digit of what all suffixes in such a block share.

    (digit, whole, row, first, last, known, bytes). Blocks begin at multiples of ``size`` before the place of the first
    digit, so that equal suffixes are in blocks that correspond. Of equal blocks in one piece one is emitted, as known;
    the spans of all of them follow without a digit.
    """
    names = ["digit", "whole", "row", "first", "last", "known", "bytes"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())))):
                part = batch.slice(a, b - a)
                texts = _joined(part.column("bytes"), depth)
                owner, start, place, gramhash = texts.digits(gram)
                block = (place - start) // size
                head, tail = edges(owner, place, block)
                owner, first, last, block = owner[head], start[head], start[tail], block[head]
                inner = place[head] - size * block  # the last suffix of a full block
                digit = mix(texts.span(inner, inner - size + 1 + depth) ^ mix(gramhash[head] + block.astype(np.uint64)))
                whole = texts.span(first, last + depth)
                _, kind, often = np.unique(np.stack((owner.astype(np.uint64), digit, whole)), axis=1, return_inverse=True, return_counts=True)
                kind = kind.reshape(-1)
                twice = often[kind] > 1
                once = ~twice
                once[np.unique(kind, return_index=True)[1]] = True
                row, base, known = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "first", "known"))
                base = base - texts.offsets[:-1]
                bytes_of = [texts.bytes[x : y + depth].tobytes() for x, y in zip(first[once].tolist(), last[once].tolist(), strict=True)]
                o = owner[once]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digit[once].view(np.int64), whole[once].view(np.int64), row[o], (first[once] + base[o]).astype(np.int32), (last[once] + base[o]).astype(np.int32), known[o] | twice[once])] + [pa.array(bytes_of, pa.binary())], names)
                told = np.flatnonzero(twice & ~known[owner])
                if len(told):
                    head, tail = edges(owner[told], np.cumsum(np.append(0, np.diff(told) != 1)))
                    o = owner[told[head]]
                    nothing = pa.nulls(len(head), pa.int64())
                    yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(row[o]), pa.array((first[told[head]] + base[o]).astype(np.int32)), pa.array((last[told[tail]] + base[o]).astype(np.int32)), pa.array(np.zeros(len(head), bool)), pa.nulls(len(head), pa.binary())], names)

    return pieces.select("row", "first", "known", "bytes").mapInArrow(split, "digit long, whole long, row long, first int, last int, known boolean, bytes binary")


def sorted_groups(group: np.ndarray, digits: list[Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, group) of what shares its group with another after a pass for each digit, most significant first.

    ``digits`` are functions of places; what is alone after a pass takes no part in later ones.
    """
    place = np.arange(len(group))
    for digit in digits:
        value = digit(place)
        order = np.lexsort((value, group))
        place, group, value = place[order], group[order], value[order]
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        alone = fresh & np.append(fresh[1:], True)
        group = np.cumsum(fresh)[~alone]
        place = place[~alone]
    return place, group


def _sort_buckets(pieces: DataFrame, depth: int, digit_bytes: int, at_once: int = 100_000) -> DataFrame:
    """(row, first, last): runs of suffixes in ``pieces`` whose first ``depth`` bytes occur twice, but for known ones."""

    def repeated(part: pa.RecordBatch) -> pa.RecordBatch:
        """Sorts the suffixes of whole buckets."""
        digit, row, first, known = (part.column(c).to_numpy(zero_copy_only=False) for c in ("digit", "row", "first", "known"))
        texts = _joined(part.column("bytes"), depth)
        counts = np.diff(texts.offsets) - depth + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = texts.offsets[owner] + at
        cuts = [(d, min(depth, d + digit_bytes)) for d in range(0, depth, digit_bytes)]
        found, group = sorted_groups(digit[owner], [lambda p, a=a, b=b: texts.span(place[p] + a, place[p] + b) for a, b in cuts])
        found = np.sort(found[~known[owner[found]]])
        head, tail = edges(owner[found], found - np.arange(len(found)))
        a, b = found[head], found[tail]
        return pa.RecordBatch.from_arrays([pa.array(row[owner[a]]), pa.array((first[owner[a]] + at[a]).astype(np.int32)), pa.array((first[owner[b]] + at[b]).astype(np.int32))], ["row", "first", "last"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a bucket that may go on in the next batch
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            digit = held.column("digit").to_numpy()
            if len(digit) and held.column("bytes").nbytes > at_once:
                whole = int(np.argmax(digit == digit[-1]))
                done, held = held.slice(0, whole), held.slice(whole)
                yield from sort_all(done)
        if held is not None:
            yield from sort_all(held)

    def sort_all(done: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digit = done.column("digit").to_numpy()
        ends = edges(digit)[1] + 1
        size = np.cumsum(pc.binary_length(done.column("bytes")).to_numpy())
        start = 0
        while start < len(digit):
            reach = np.searchsorted(size, (size[start - 1] if start else 0) + at_once)
            stop = int(ends[min(len(ends) - 1, np.searchsorted(ends, max(reach, start + 1)))])
            yield repeated(done.slice(start, stop - start))
            start = stop

    dealt = pieces.select("digit", "row", "first", "known", "bytes").repartition("digit").sortWithinPartitions("digit")
    return dealt.mapInArrow(sort, "row long, first int, last int")


def _wide(pieces: DataFrame, depth: int, gram: int, digit_bytes: int, bucket: int) -> DataFrame | None:
    """(row, first, last) like ``_sort_buckets``, for buckets too large to sort in one task; None if there are none.

    Passes over blocks of 64, 16, 4 and 1 suffixes, whose digit is what the suffixes of a block share: a block alone
    in its group leaves, blocks that are equal as a whole are done, small groups are sorted, the others are split.
    """
    spans, size = [], 64
    while pieces.limit(1).count():
        blocks = cut(_split(pieces, depth, gram, size))
        spans.append(blocks.filter(F.col("digit").isNull()).select("row", "first", "last"))
        blocks = blocks.filter(F.col("digit").isNotNull())
        weight = F.sum(F.when(F.col("known"), 2).otherwise(1))
        same = cut(blocks.groupBy("digit", "whole").agg(weight.alias("n"), F.min(F.struct("row", "first")).alias("one"), F.max(F.col("last") - F.col("first") + 1).alias("size")))
        groups = same.groupBy("digit").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"), F.sum("size").alias("size"))
        told = blocks.join(same.select("digit", "whole", "n", "one"), ["digit", "whole"])
        spans.append(told.filter((F.col("n") > 1) & ~F.col("known")).select("row", "first", "last"))
        told = told.filter((F.col("n") == 1) | (F.col("one") == F.struct("row", "first")))
        told = told.join(groups.filter((F.col("kinds") > 1) & (F.col("fewest") == 1)), "digit")
        told = cut(told.select("digit", "row", "first", (F.col("n") > 1).alias("known"), (F.col("size") > bucket).alias("wide"), "bytes"))
        spans.append(_sort_buckets(told.filter(~F.col("wide")), depth, digit_bytes))
        pieces, size = told.filter("wide"), size // 4
    if not spans:
        return None
    every = spans[0]
    for span in spans[1:]:
        every = every.union(span)
    return every


def _finished(met: DataFrame, depth: int) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256, kept) of texts and the runs of their suffixes that occur twice."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = np.frombuffer(unpack(packed.as_py()), np.uint8)
                edges = np.zeros(len(text) + 1, dtype=np.int32)
                ends = runs.values
                np.add.at(edges, ends.field(0).to_numpy(), 1)
                np.add.at(edges, ends.field(1).to_numpy() + depth, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = text[~gone].tobytes()
                out.append((row, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), zlib.compress(kept, 1)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    return met.mapInArrow(finish, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeated_bytes(docs: DataFrame, depth: int = 200, gram: int = 32, digit_bytes: int = 50, bucket: int = 1 << 14) -> DataFrame:
    """Remove each byte covered by a string of ``depth`` bytes that also starts anywhere else, in this text or another.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, for rows with removals, kept
    (the remaining bytes, zlib; null where nothing was removed).

    The suffixes of all texts are sorted as far as ``depth`` bytes, by passes over digits, the most significant first;
    a suffix that is alone in its group leaves, and the groups that are left hold the strings that occur twice.

    1. The first digit of a suffix is the string of ``gram`` bytes with the least hash among its first ``depth``, which
       neighbouring suffixes mostly share: they go through the passes as one run. Runs alone under their digit leave.
    2. The second is all that the suffixes of a run cover. Runs equal in that have repeated suffixes only and are done;
       one of them stays as a known witness where other runs share the first digit.
    3. Spark deals what is left by the first digit; the suffixes in a bucket are sorted by digits of ``digit_bytes``
       bytes. Buckets of more than ``bucket`` suffixes are never held: passes over smaller and smaller blocks of
       suffixes split them by what the suffixes of a block share, until buckets are small or blocks equal.

    Digits are compared by 64-bit hashes, at least two of which must agree; a text is named by one of 64 bits. Texts
    are taken as UTF-8 bytes, whole; null and empty ones have no bytes. Results depend on the text only, so that rows
    with a null id and repeated rows have theirs too (a repeated row is a copy). A task holds one text at a time, at
    about 60 bytes for each of its bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    profile = cut(_profiled(rows, depth, gram))
    runs = profile.select("row", F.inline(F.arrays_zip("digit", "whole", "first", "last", "again")))
    shared = runs.groupBy("digit").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"), F.max("again").alias("within"))
    shared = shared.filter((F.col("n") > 1) | F.col("within")).select("digit", (F.col("within") | (F.col("least") != F.col("most"))).alias("mixed"))
    live = cut(runs.join(shared, "digit").select("row", "digit", "whole", "first", "last", "mixed"))

    same = live.filter("mixed").groupBy("digit", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("one"))
    same = cut(same)
    buckets = same.groupBy("digit").agg(F.sum(F.expr("cast(one.last as long) - one.first + 1")).alias("size"), F.min("n").alias("fewest"))
    asked = same.join(buckets.filter(F.col("fewest") == 1), "digit").select("one.*", "digit", (F.col("n") > 1).alias("known"), (F.col("size") > bucket).alias("wide"))
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("digit", "first", "last", "known", "wide")).alias("runs"))  # no more than the runs of one text
    texts = _packed(rows)
    met = texts.join(asked, "row").groupBy("row").agg(F.first("packed").alias("packed"), F.first("runs").alias("runs"))
    pieces = cut(_pieces(met, depth))
    found, wide = _sort_buckets(pieces.filter(~F.col("wide")), depth, digit_bytes), _wide(pieces.filter("wide"), depth, gram, digit_bytes, bucket)
    found = found if wide is None else found.union(wide)

    copies = profile.filter(F.col("n_bytes") >= depth).groupBy("row").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("row")
    equal = live.filter(~F.col("mixed")).select("row", "first", "last")
    equal = equal.union(live.filter("mixed").join(same.filter(F.col("n") > 1), ["digit", "whole"], "left_semi").select("row", "first", "last"))
    spans = equal.join(copies, "row", "left_anti").union(found)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # no more than the suffixes of one text
    changed = _finished(texts.join(spans, "row"), depth).withColumn("copy", F.lit(False))
    nothing = copies.select("row", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(zlib.compress(b"", 1)).alias("kept"), F.lit(True).alias("copy"))
    told = profile.select("doc_id", "row", "n_bytes", "sha256").join(changed.unionByName(nothing), "row", "left")
    removed = F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return told.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept")
