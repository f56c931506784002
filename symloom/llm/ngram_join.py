"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.graph import connected_components
from symloom.llm.text import Words, cut, unused_names, words_of


#: Steps of the allowed distance, and pivots tried, in a bucket of many blocks.
STEPS, PIVOTS = 10, 4


def choose_bands(similarity: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band that still find a pair at ``similarity`` with the wanted recall.

    A pair shares a given band with chance s**rows, and none of b bands with (1 - s**rows)**b. More rows keep pairs
    of lower similarity apart, so the largest number that fits ``most_hashes`` is taken.
    """
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no band and row counts reach this recall with so few hashes")


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram, in row order; a row of 1 to n - 1 words has one, of all its words."""
    h, at = words.ngrams(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if not len(short):
        return h, words.rows[at]
    whole = words.span(words.row_starts[short], words.row_starts[short + 1]) ^ np.uint64(n)
    rows = np.concatenate((words.rows[at], short))
    order = np.argsort(rows, kind="stable")
    return np.concatenate((h, whole))[order], rows[order]


def _links(sets: list[np.ndarray], above: list[list[int]], similarity: float) -> np.ndarray:
    """Which pairs have n-gram sets of the wanted Jaccard similarity and no greater unit in common, as a symmetric matrix."""
    n = len(sets)
    wanted = np.triu(np.ones((n, n), dtype=bool), 1)
    in_unit = defaultdict(list)
    for i, others in enumerate(above):
        for other in others:
            in_unit[other].append(i)
    for both in in_unit.values():  # decided there
        if len(both) > 1:
            wanted[np.ix_(both, both)] = False
    sizes = np.array([len(s) for s in sets])
    # sets of very different sizes cannot be similar
    wanted &= np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    linked = np.zeros((n, n), dtype=bool)
    left, right = np.nonzero(wanted)
    if not len(left):
        return linked
    if len(left) <= 4 * n:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    else:
        # n-grams held by one set only add nothing; the others are counted by a matrix product, some columns at a time
        grams, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        shared = often > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), dtype=np.float32)
        for first in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, [first, first + 2048])
            block = np.zeros((n, 2048), dtype=np.float32)
            block[owner[a:b], column[a:b] - first] = 1
            both += block @ block.T
        common = both[left, right]
    union = sizes[left] + sizes[right] - common
    good = common >= similarity * union - 1e-9
    linked[left[good], right[good]] = True
    return linked | linked.T


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first row that links lead to, for every row."""
    root = np.arange(len(linked))
    for a in range(len(linked)):
        if root[a] == a:
            todo = [a]
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & (root > a))
                root[near] = a
                todo += near.tolist()
    return root


def _verified(unit: tuple, held: dict, similarity: float) -> list[tuple]:
    """(rep, key, links, to_rep, to_key) of one block, or of two blocks against each other.

    A block by itself counts the links within it and ties every member to its root there. Two blocks count the links
    across, and tie the roots that these join, each to the first of those that hang together: the edges of a large
    group stay few, at most one a member.
    """
    nodes = sorted(held)
    side = np.array([held[x][0] for x in nodes])
    weights = np.array([held[x][1] for x in nodes])
    linked = _links([held[x][3] for x in nodes], [held[x][2] for x in nodes], similarity)
    across = side[:, None] != side[None, :]
    root = _roots(linked & ~across)
    if unit[1] == unit[2]:
        counts = linked @ weights
        return [(*nodes[i], int(counts[i]), *nodes[root[i]]) for i in np.flatnonzero(counts).tolist()]
    linked &= across
    counts = linked @ weights
    a, b = np.nonzero(linked)
    joined = np.zeros_like(linked)
    joined[root[a], root[b]] = True
    first = _roots(joined)
    return [(*nodes[i], int(counts[i]), *nodes[first[i]]) for i in np.flatnonzero((counts > 0) | (first != np.arange(len(first)))).tolist()]


def _units(classes: DataFrame, block: int) -> DataFrame:
    """(rep, key, n_copies, n_words, unit, best, above, parts): the buckets in which a class is to be compared, of those with two or more classes.

    A unit is a band bucket. Buckets with the same members are one unit, and a unit whose members all have one and
    the same largest unit lies within that and is left out. ``above`` lists the member's greater units: a pair is
    decided in the greatest that both are in, which is never one that was left out. ``best`` is the member's greatest.
    """
    banded = classes.select("rep", "key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = cut(banded.join(shared, "bucket"))
    name, check = F.bit_xor(F.xxhash64("rep", "key")).alias("name"), F.bit_xor(F.xxhash64("key", "rep", F.lit(1))).alias("check")
    units = members.groupBy("bucket", "size").agg(name, check).groupBy("size", "name", "check").agg(F.min("bucket").alias("bucket"))
    own = members.select("rep", "key", "bucket").join(units.select("bucket", "size"), "bucket").groupBy("rep", "key").agg(F.collect_list(F.struct("size", F.col("bucket").alias("unit"))).alias("own"))  # a bucket a band at most
    own = cut(own.join(classes.select("rep", "key", "n_copies", "n_words"), ["rep", "key"]))
    placed = own.select("*", F.explode("own").alias("at")).withColumn("best", F.array_max("own"))
    least, most = F.min("best").alias("least"), F.max("best").alias("most")
    parts = _parts(block)
    kept = placed.groupBy("at").agg(least, most, parts).filter((F.col("least") != F.col("most")) | (F.col("least") == F.col("at"))).select("at", "parts")
    above = F.transform(F.filter("own", lambda x: x > F.col("at")), lambda x: x["unit"])
    return placed.join(kept, "at").select("rep", "key", "n_copies", "n_words", F.col("at.unit").alias("unit"), F.col("best.unit").alias("best"), above.alias("above"), "parts")


def _parts(block: int) -> Column:
    """Blocks for some members: of ``block`` texts, fewer if they are long."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_words") / (block * 8192))).cast("int").alias("parts")


def _with_texts(placed: DataFrame, texts: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(members: rep, key, n_copies, text, unit, part, parts, pivot_of), (wide: unit, parts, pivots).

    The texts of all members, met once. ``unit`` is the member's greatest one if that has several blocks, ``part``
    its block there, and ``pivot_of`` the numbers of the pivots that it is. PIVOTS of them are drawn by hash.
    """
    top = F.col("best") == F.col("unit")
    draws = [F.min(F.struct(F.xxhash64("rep", "key", F.lit(i)).alias("draw"), "rep", "key")).alias(f"pivot{i}") for i in range(PIVOTS)]
    wide = cut(placed.filter(top & (F.col("parts") > 1)).groupBy("unit").agg(_parts(block), *draws).filter(F.col("parts") > 1))
    drawn = wide.select("unit", F.posexplode(F.array(*[f"pivot{i}" for i in range(PIVOTS)])).alias("pivot", "at"))
    drawn = drawn.groupBy("unit", "at.rep", "at.key").agg(F.collect_list("pivot").alias("pivot_of"))
    members = placed.groupBy("rep", "key", "n_copies").agg(F.max(F.when(top, F.col("unit"))).alias("unit"))
    part = F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int")
    members = members.join(wide.select("unit", "parts"), "unit", "left").withColumn("part", part).join(drawn, ["unit", "rep", "key"], "left")
    return cut(members.join(texts, ["rep", "key"]).select("rep", "key", "n_copies", "text", "unit", "part", "parts", "pivot_of")), wide


def _measured(members: DataFrame, wide: DataFrame, n: int, similarity: float) -> DataFrame:
    """(unit, rep, key, n_copies, near, to_rep, to_key): how far members are from a pivot of their unit, in steps.

    Measured are members of a wide unit that are in no greater one. The distance 1 - Jaccard obeys the triangle
    inequality: with ``near`` the distance in STEPS-ths of the allowed one, rounded up, two members whose steps add
    up to STEPS at most are linked, and any with STEPS at most is linked with the pivot. The pivot with most members
    within half the allowed distance is taken. Each block meets the pivots' texts; nothing is compared with all members.
    """
    own = members.filter(F.col("part").isNotNull())
    pivots = own.filter(F.col("pivot_of").isNotNull()).select("rep", "key", "n_copies", "text", "unit", "parts", F.explode("pivot_of").alias("pivot"))
    pivots = pivots.select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivot", "rep", "key", "n_copies", "text")
    together = own.select("unit", "part", F.lit(-1).alias("pivot"), "rep", "key", "n_copies", "text").unionByName(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, before = None, {}, None
        for batch in batches:
            for first, last, words in words_of(batch.column(6)):
                h, row = shingles(words, n)
                at = np.searchsorted(row, np.arange(last - first + 1)).tolist()
                found = []
                for i, (unit, part, pivot, rep, key, copies) in enumerate(zip(*(c.to_pylist() for c in batch.slice(first, last - first).columns[:6]), strict=True)):
                    if now != (unit, part):
                        now, held, before = (unit, part), {}, None
                    if before == (pivot, rep, key):
                        continue
                    before = (pivot, rep, key)
                    grams = np.unique(h[at[i] : at[i + 1]])
                    if pivot >= 0:
                        held[pivot] = grams
                        continue
                    steps = []
                    for p in range(PIVOTS):
                        common = len(np.intersect1d(grams, held[p], assume_unique=True))
                        union = len(grams) + len(held[p]) - common
                        steps.append(min(int(np.ceil((union - common) / union / (1 - similarity) * STEPS)), STEPS + 1) if similarity < 1 else (STEPS + 1) * (common < union))
                    found.append((unit, rep, key, copies, steps))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [*[pa.int64()] * 4, pa.list_(pa.int32())], strict=True)], ["unit", "rep", "key", "n_copies", "steps"])

    order = ["unit", "part", F.col("pivot").desc(), "rep", "key"]  # rows repeated with one id lie side by side
    steps = cut(together.repartition("unit", "part").sortWithinPartitions(*order).mapInArrow(measure, "unit long, rep long, key long, n_copies long, steps array<int>"))
    within = [F.struct(F.count_if(F.get("steps", F.lit(i)) * 2 <= STEPS).alias("within"), F.lit(-i).alias("less")) for i in range(PIVOTS)]
    chosen = steps.groupBy("unit").agg((-F.greatest(*within)["less"]).alias("chosen"))
    pivot = F.get(F.array(*[f"pivot{i}" for i in range(PIVOTS)]), F.col("chosen"))
    chosen = wide.join(chosen, "unit").select("unit", "chosen", pivot["rep"].alias("to_rep"), pivot["key"].alias("to_key"))
    return cut(steps.join(chosen, "unit").select("unit", "rep", "key", "n_copies", F.get("steps", F.col("chosen")).alias("near"), "to_rep", "to_key"))


def _certain(measured: DataFrame) -> DataFrame:
    """(rep, key, links, to_rep, to_key): the links that the distances to a pivot prove, and the tie to that pivot."""
    sizes = measured.groupBy("unit", "near").agg(F.sum("n_copies").alias("copies"))
    sizes = sizes.groupBy("unit").agg(F.collect_list(F.struct("near", "copies")).alias("sizes"))  # STEPS + 2 at most
    others = F.aggregate(F.filter("sizes", lambda s: s["near"] + F.col("near") <= STEPS), F.lit(0).cast("long"), lambda total, s: total + s["copies"])
    itself = F.when(F.col("near") * 2 <= STEPS, F.col("n_copies")).otherwise(0)
    return measured.filter(F.col("near") <= STEPS).join(sizes, "unit").select("rep", "key", (others - itself).alias("links"), "to_rep", "to_key")


def _compared(placed: DataFrame, measured: DataFrame, block: int) -> DataFrame:
    """(rep, key, n_copies, above, unit, side, low, high): the pairs of blocks of each unit in which its members meet.

    Members of one unit are grouped: those of no greater unit by their step (STEPS + 1 without one), those that share
    their greatest unit with many others by that, and the rest. A group of the second kind is not compared within
    itself (all its pairs are decided in that greater unit), nor are two steps that add up to STEPS at most (their
    pairs are known to be linked). Members that meet nobody leave no row, so that their texts do not travel.
    """
    one = F.array(F.lit("0"))
    small = placed.filter(F.col("parts") == 1).select("rep", "key", "n_copies", "above", "unit", F.lit("0").alias("side"), F.explode(one).alias("other"))
    large = placed.filter(F.col("parts") > 1).drop("parts")
    large = large.join(measured.select("unit", "rep", "key", "near"), ["unit", "rep", "key"], "left").withColumn("near", F.coalesce("near", F.lit(STEPS + 1)))
    many = large.filter(F.col("best") != F.col("unit")).groupBy("unit", "best").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= block).drop("members").withColumn("many", F.lit(True))
    top = F.col("best") == F.col("unit")
    kind = F.when(top, 1).when(F.col("many"), 2).otherwise(0)
    named = F.when(top, F.col("near").cast("long")).when(F.col("many"), F.col("best")).otherwise(0)
    large = large.join(many, ["unit", "best"], "left").withColumn("group", F.struct(kind.alias("kind"), named.alias("named")))
    groups = large.groupBy("unit", "group").agg(_parts(block))
    groups = groups.groupBy("unit").agg(F.collect_list(F.struct("group", "parts")).alias("groups"))  # one for each ``block`` members, and STEPS + 3
    own = F.col("group")

    def meets(other: Column) -> Column:
        same_best = (own["kind"] == 2) & (other == own)
        linked = (own["kind"] == 1) & (other["kind"] == 1) & (own["named"] + other["named"] <= STEPS)
        return ~(same_best | linked)

    def names(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), g["parts"] - 1), lambda i: F.concat_ws(":", g["group"]["kind"], g["group"]["named"], i))

    others = F.flatten(F.transform(F.filter("groups", lambda g: meets(g["group"])), names))
    parts = F.element_at(F.filter("groups", lambda g: g["group"] == own), 1)["parts"]
    side = F.concat_ws(":", own["kind"], own["named"], F.pmod(F.xxhash64("rep", "key"), parts))
    large = large.join(groups, "unit").select("rep", "key", "n_copies", "above", "unit", side.alias("side"), F.explode(others).alias("other"))
    return small.unionByName(large).select("rep", "key", "n_copies", "above", "unit", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))


def _classified(docs: DataFrame, n: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, words_id), (classes: words_id, root (rep, key), n_copies, n_links); key is a hash of the text."""
    bands, width = choose_bands(similarity, recall)
    random = np.random.default_rng(11)
    factors = random.integers(1, 1 << 32, bands * width, dtype=np.uint32) | np.uint32(1)
    salts = random.integers(0, 1 << 32, bands * width, dtype=np.uint32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in words_of(batch.column(1)):
                h, row = shingles(words, n)
                own, starts = np.unique(row, return_index=True)
                folded = (h ^ (h >> np.uint64(32))).astype(np.uint32)
                least = np.empty((len(own), bands * width), dtype=np.uint32)
                for k in range(bands * width if len(own) else 0):
                    least[:, k] = np.minimum.reduceat((folded ^ salts[k]) * factors[k], starts)
                bucket = np.tile(np.arange(bands, dtype=np.uint64), (len(own), 1))
                for k in range(width):
                    bucket = (bucket ^ least[:, k::width][:, :bands]) * np.uint64(0x9E3779B97F4A7C15)
                    bucket ^= bucket >> np.uint64(29)
                flat = pa.array(bucket.view(np.int64).reshape(-1))
                signed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), flat)
                names = []
                for r in own.tolist():
                    raw = words.bytes[words.offsets[r] : words.offsets[r + 1]].tobytes()
                    names.append(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest())
                where = np.full(last - first, -1)
                where[own] = np.arange(len(own))
                take = pa.array(where, mask=where < 0)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.binary()).take(take), pa.array(words.counts.astype(np.int64)), signed.take(take)], ["doc_id", "key", "words_id", "n_words", "bands"])

    signed = cut(rows.mapInArrow(sign, "doc_id long, key long, words_id binary, n_words long, bands array<long>"))
    known = signed.filter(F.col("doc_id").isNotNull() & F.col("words_id").isNotNull())
    classes = known.groupBy("words_id").agg(
        F.min(F.struct("doc_id", "key")).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")
    )
    classes = cut(classes.select("words_id", F.col("rep.doc_id").alias("rep"), F.col("rep.key").alias("key"), "n_copies", "bands", "n_words"))

    placed = cut(_units(classes, block))
    texts = rows.select(F.col("doc_id").alias("rep"), "key", "text")
    members, wide = _with_texts(placed, texts, block)
    measured = _measured(members, wide, n, similarity)
    together = _compared(placed, measured, block).join(members.select("rep", "key", "text"), ["rep", "key"])
    unit = ["unit", "low", "high"]
    together = together.select("unit", "low", "high", "side", "rep", "key", "n_copies", "above", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, {}, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["rep", "key", "links", "to_rep", "to_key"])

        for batch in batches:
            for first, last, words in words_of(batch.column(8)):
                h, row = shingles(words, n)
                at = np.searchsorted(row, np.arange(last - first + 1)).tolist()
                part = batch.slice(first, last - first)
                for i, (u, low, high, side, rep, key, copies, above) in enumerate(zip(*(c.to_pylist() for c in part.columns[:8]), strict=True)):
                    if now != (u, low, high):
                        found += _verified(now, held, similarity) if len(held) > 1 else []
                        now, held = (u, low, high), {}
                    held[rep, key] = (side, copies, above, np.unique(h[at[i] : at[i + 1]]))
                if found:
                    yield batch_of(found)
                    found = []
        found += _verified(now, held, similarity) if len(held) > 1 else []
        if found:
            yield batch_of(found)

    verified = cut(together.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(verify, "rep long, key long, links long, to_rep long, to_key long"))
    verified = verified.unionByName(_certain(measured))
    links = verified.groupBy("rep", "key").agg(F.sum("links").alias("links"))
    edges = verified.select(F.struct("rep", "key").alias("a"), F.struct(F.col("to_rep").alias("rep"), F.col("to_key").alias("key")).alias("b"))
    trees = connected_components(edges.filter(F.col("a") != F.col("b"))).select("node.rep", "node.key", F.col("component").alias("root"))
    decided = classes.select("words_id", "rep", "key", "n_copies").join(links, ["rep", "key"], "left").join(trees, ["rep", "key"], "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    decided = decided.select("words_id", F.coalesce("root", F.struct("rep", "key")).alias("root"), "n_copies", n_links)
    return signed.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("words_id")).alias("words_id")), decided


def similar_documents(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, block: int = 256) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of every document.

    A link joins two rows whose sets of word n-grams have a Jaccard similarity of ``similarity`` or more; class_id
    is the least id of all that links lead to, n_copies the rows with the same words, n_links the rows linked with.

    Rows of equal words are one class with one text (their links are counted, not listed). Classes are shuffled on
    their band hashes, and those that share one meet in that bucket, where every pair is decided once on its full sets.
    In a large bucket all members are compared with a pivot first: pairs that both lie close enough to it are linked
    by the triangle inequality and only counted; the others are compared as blocks against blocks. Counts and tree edges leave that place, so no list of pairs is
    ever made. Texts that share no band never meet, whatever chains of collisions lie between them.

    Words are runs of other characters than ASCII white space; texts of fewer than n words have one n-gram, of all
    of them. Null and empty texts, and rows with a null id, have no links and are their own class (null for a null
    id). Rows repeated with one id count as copies; one id may have several texts, each with links of its own.
    """
    rows, decided = _classified(docs, n, similarity, recall, block)
    joined = rows.select("doc_id", "words_id").join(decided, "words_id", "left")
    return joined.select("doc_id", F.coalesce("root.rep", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, block: int = 256) -> DataFrame:
    """``docs`` with one row of each class: that of the least id.

    Of one id with several texts each text is judged by itself. Rows repeated with one id and one text stay once;
    rows without words stay, and so do all rows with a null id.
    """
    rows, decided = _classified(docs, n, similarity, recall, block)
    itself = F.col("root").isNull() | ((F.col("root.rep") == F.col("doc_id")) & (F.col("root.key") == F.col("key")))
    own_id, own_key = unused_names(docs.columns, "id", "key")
    kept = rows.filter(F.col("doc_id").isNotNull()).join(decided.select("words_id", "root"), "words_id", "left").filter(itself).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).distinct()
    numbered = docs.filter(F.col("doc_id").isNotNull()).withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.xxhash64("text")})
    numbered = numbered.join(kept, [own_id, own_key], "left_semi").dropDuplicates([own_id, own_key])
    return numbered.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
