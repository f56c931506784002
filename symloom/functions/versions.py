"""One order of versions, as a text that sorts bytewise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers, then an optional prerelease and build part.
READABLE = r"^(\d+(?:\.\d+)*)(?:-([0-9A-Za-z_.-]+))?(?:\+[0-9A-Za-z_.-]*)?\z"


def _number(digits: Column) -> Column:
    """Digits behind their count, so that shorter numbers come first."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def version_key(version: Column | str, ties: bool = True) -> Column:
    """A text whose bytewise order is that of semantic versions; null for null.

    Numbers compare as such and missing ones count as 0, whatever their number; a prerelease comes before its release,
    its identifiers compare one by one (numbers as such and before words, words by their bytes, fewer first); the
    build part does not count. What cannot be read comes last, by its text. With ``ties``, versions that are equal in
    all that come in the order of their texts, else they have one key.
    """
    version = F.col(version) if isinstance(version, str) else version
    numbers = F.split(F.regexp_replace(F.regexp_extract(version, READABLE, 1), r"(\.0+)+$", ""), r"\.")
    words = F.regexp_extract(version, READABLE, 2)
    word = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x))
    early = F.when(words == "", "1").otherwise(F.concat(F.lit("0"), F.array_join(F.transform(F.split(words, r"\."), word), "!")))
    key = F.when(version.rlike(READABLE), F.concat(F.array_join(F.transform(numbers, _number), ""), F.lit("!"), early)).otherwise(F.concat(F.lit("~"), version))
    return F.concat(key, F.lit(" "), version) if ties else key
