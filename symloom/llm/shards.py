"""Sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symloom.llm.text import cut

#: Range boundaries drawn for each shard; parts into which each range is divided by its own key span; rows numbered together.
RANGES_PER_SHARD, PARTS, ROWS_PER_PART = 8, 32, 1_000_000


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are <= key: a step over every 16th bound, then one over the 16 beneath it."""
    step = 16
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    if not blocks:
        return F.lit(0)
    at = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= key))
    within = F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(at, F.lit(1)))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(within, lambda x: x <= key)))


def _rooms(large: list, share: float, shards: int) -> tuple[dict[int, int], list[float]]:
    """(shard of each range that is kept whole, where the room that is left in each shard ends, in bytes of the rest)."""
    load, whole = [0.0] * shards, {}
    for span, size in large:
        least = min(range(shards), key=lambda s: load[s])
        if load[least] + size <= share:
            load[least] += size
            whole[span] = least
    left = [share - x for x in load]
    return whole, [sum(left[: s + 1]) for s in range(shards)]


def shard(docs: DataFrame, shards: int = 16, samples_per_range: int = 32, rows_per_part: int = ROWS_PER_PART, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes (law ``bytes``).

    A row's key is the 64-bit hash of its text, so equal texts are neighbours. Rows are sampled with a chance in
    proportion to their size, the sample's weighted quantiles become range boundaries, and every range is cut
    again into parts of its key span; a range well over its share gets more parts in proportion. A range that is
    one key alone (copies of one text) stays in one part, and the large ones of those, the largest first, go to the
    shard with the most room; one that fits in none, as it is larger than a shard's share or than what is left, is cut
    by the hash of the id, so a text that fills several shards can still be spread. The other parts are laid in key
    order into the room that is left and go to the shard that holds their middle byte; exact sums, not the sample,
    decide that, so that shards differ by about a hundredth of their share. Parts of a range with
    more than ``rows_per_part`` rows are numbered in slices by the hash of the id, so that a key with very many
    small rows (null or empty texts) is no one task's work. slot is the row number in the slice plus the rows of
    earlier slices of the shard, so no window spans a shard.

    Null text has size 1 and crc32 0; null ids are kept; repeated rows take slots of their own; an empty table
    gives an empty result. Other columns are ignored.
    """
    text, ident = F.col(text_column), F.col(id_column)
    keyed = docs.select(
        ident.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(ident, F.lit("row")).alias("minor"),
    )
    keyed = cut(keyed)
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, ranges = total or 0, shards * RANGES_PER_SHARD
    step = max(1.0, total / (ranges * samples_per_range))

    # a row stands for `step` bytes in the sample, or for its own if it is larger
    chance = F.col("size") / F.lit(step)
    drawn = F.pmod(F.xxhash64("minor", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keyed.filter(drawn < chance).groupBy("key").agg(F.sum(F.greatest(F.lit(step), F.col("size").cast("double"))).alias("weight"))
    before = F.sum("weight").over(Window.orderBy("key")) - F.col("weight")
    width = F.lit(max(1.0, total / ranges))
    quantile = sample.select("key", "weight", F.floor(before / width).alias("q"))
    heavy = quantile.filter(F.col("weight") >= width).select(F.explode(F.array("key", F.col("key") + F.lit(1))).alias("bound"))
    bounds = [r[0] for r in quantile.groupBy("q").agg(F.min("key").alias("bound")).select("bound").union(heavy).distinct().orderBy("bound").collect()]

    ranged = keyed.withColumn("range", _range_of(F.col("key"), bounds))
    spans = ranged.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    spans = cut(spans.withColumn("single", F.col("low") == F.col("high")))
    # keys that take room of their own: no more than `ranges` times 8, as each has that share of all bytes
    large = spans.filter(F.col("single") & (F.col("bytes") * 8 >= width)).orderBy(F.desc("bytes"), "range").select("range", "bytes").collect()
    whole, room = _rooms(large, total / shards, shards)
    share = F.greatest(F.lit(1.0), F.col("bytes") / width)
    cuts = F.when(F.col("single") & (F.col("range").isin(list(whole)) | (F.col("bytes") * 8 < width)), 1).otherwise(F.ceil(PARTS * share).cast("int"))
    spans = spans.select("range", "low", "high", cuts.alias("parts"), F.ceil(F.col("n") / rows_per_part).cast("int").alias("slices"))
    spread = (F.col("high").cast("double") - F.col("low").cast("double"))
    place = F.when(F.col("low") == F.col("high"), F.col("minor").cast("double") / 2.0**64 + 0.5).otherwise(
        (F.col("key").cast("double") - F.col("low").cast("double")) / F.greatest(spread, F.lit(1.0))
    )
    parted = ranged.join(F.broadcast(spans), "range")  # one row for each range: at most ranges + 2 for each heavy key of the sample
    parted = parted.withColumn("part", F.least(F.floor(place * F.col("parts")).cast("int"), F.col("parts") - 1)).withColumn("slice", F.pmod(F.xxhash64("minor", F.lit("slice")), F.col("slices")).cast("int")).drop("low", "high", "parts", "slices")

    sums = cut(parted.groupBy("range", "part", "slice").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    by_part = sums.groupBy("range", "part").agg(F.sum("bytes").alias("bytes"))
    until = F.sum("bytes").over(Window.orderBy("range", "part"))
    middle = until - F.col("bytes") / 2
    ends = F.array(*[F.lit(float(x)) for x in room[:-1]]).cast("array<double>")
    laid = by_part.filter(~F.col("range").isin(list(whole))).select("range", "part", F.size(F.filter(ends, lambda x: x <= middle)).alias("shard"))
    placed = F.element_at(F.create_map(*[F.lit(x) for item in sorted(whole.items()) for x in item]), F.col("range")) if whole else F.lit(0)
    laid = laid.unionByName(by_part.filter(F.col("range").isin(list(whole))).select("range", "part", placed.alias("shard")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part", "slice")) - F.col("n")
    laid = cut(sums.join(laid, ["range", "part"]).select("range", "part", "slice", "shard", before.alias("offset")))

    number = F.row_number().over(Window.partitionBy("range", "part", "slice").orderBy("key", "minor", "doc_id", "size", "text_crc32"))
    return (
        parted.withColumn("number", number)
        .join(laid, ["range", "part", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard"),
            (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        )
    )
