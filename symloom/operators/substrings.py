"""Which names hold which: a substring join by the rarest part of the shorter name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions import names as N

#: Parts of the names that are looked up, up to which they are broadcast.
FEW = 50_000


def holding(held: DataFrame, holders: DataFrame, group: list[str], least_share: float = 0.0) -> DataFrame:
    """(*group, held, holder): all pairs of distinct names of one group in which the holder contains the held one.

    ``held`` and ``holders`` have the group's columns and a column of that name. What contains a name has all its
    parts of one length, the greatest of a few steps that the name reaches: the longer a name, the rarer its parts,
    however many names there are. Of those each name is looked up by the one that the fewest holders have, as counted,
    and not at all if one of them is nowhere. Holders are cut into parts of the lengths that are asked for, as hashes;
    whether one holds the name is then seen from the texts. Postings are names, not rows; a part that most names share
    brings names together only if all parts of one are as common. Null names hold nothing and are not held; rows of a
    null group are left out.

    Spark takes exploded parts for as few as their names, so no join of theirs is left to it: few parts, as counted,
    are broadcast and postings of others dropped where they are made; all else is merged. Postings are never broadcast.
    """
    hashed = lambda parts: F.explode(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))
    names = held.select(*group, "held").distinct()
    own = N.own_parts(F.col("held"))
    steps = names.filter("held IS NOT NULL").groupBy(N.part_length(F.col("held"))).agg(F.sum(F.size(own))).collect()
    lengths, looked_up = [r[0] for r in steps], sum(r[1] for r in steps)
    inside = holders.select(*group, "holder").distinct()
    postings = inside.withColumn("part", hashed(N.name_parts(F.col("holder"), tuple(sorted(lengths)) or (0,))))
    asked = names.withColumn("part", hashed(own))
    if looked_up <= FEW:
        postings = postings.join(F.broadcast(asked.select(*group, "part").distinct()), [*group, "part"], "left_semi")
    uses = postings.groupBy(*group, "part").agg(F.count("*").alias("uses"))
    counted = asked.join(uses.hint("merge"), [*group, "part"], "left")
    keyed = counted.groupBy(*group, "held").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "part")).alias("rarest"))
    keyed = keyed.filter("rarest.uses > 0").select(*group, "held", F.col("rarest.part").alias("part"))
    return keyed.join(postings.hint("merge"), [*group, "part"]).filter((F.length("held") >= least_share * F.length("holder")) & F.contains("holder", "held")).select(*group, "held", "holder")
