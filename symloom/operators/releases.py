"""Release selection: versions parsed from tags, kept by rules over semantic versions. Order is always numeric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions.versions import version_key
from symloom.plans.lineage import cut

#: A semantic version: three numbers without leading zeros, then an optional prerelease and build part.
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?\z"
NUMBERS = ("major", "minor", "patch")


def pattern_prefixes(pattern: Column) -> Column:
    """What stands before the version under ``pkg@*`` (separators @, ==, -), ``pkg==*``, ``pkg-v*`` and ``v*``; ``*`` itself."""
    scoped, exact = F.regexp_replace(pattern, r"@\*$", ""), F.regexp_replace(pattern, r"\*$", "")
    return (
        F.when(pattern.endswith("@*"), F.array(*[F.concat(scoped, F.lit(s)) for s in ("@", "==", "-")]))
        .when(pattern.endswith("==*") | pattern.endswith("-v*") | (pattern == "v*"), F.array(exact))
        .when(pattern == "*", F.array(F.lit("*")))
    )


def tag_readings(tag: Column) -> Column:
    """(prefix, version): every way to read a tag as a prefix and a version, and as a bare version under ``*``."""
    bare = F.regexp_replace(tag, r"^[v=\s]+", "")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(tag), F.lit(1))), lambda i: tag.substr(i, F.lit(1)).isin("@", "=", "-", "v"))  # as prefixes do
    cuts = F.transform(ends, lambda i: F.struct(tag.substr(F.lit(1), i).alias("prefix"), tag.substr(i + 1, F.length(tag)).alias("version")))
    ways = F.concat(F.array(F.struct(F.lit("*").alias("prefix"), bare.alias("version"))), cuts)
    return F.filter(ways, lambda x: x["version"].rlike(SEMVER))


def with_numbers(df: DataFrame) -> DataFrame:
    """Add major, minor, patch and prerelease (null for a release)."""
    numbers = {name: F.regexp_extract("version", SEMVER, i + 1).cast("int") for i, name in enumerate(NUMBERS)}
    return df.withColumns(numbers | {"prerelease": F.nullif(F.regexp_extract("version", SEMVER, 4), F.lit(""))})


def parse_release_tags(tags: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, version, numbers, tag, sha): every tag under every pattern of its repository that it fits.

    The literal beginnings of the patterns are a dictionary; a tag meets the entries that it begins with, by equality,
    and never those of the repository's other packages.
    """
    prefixes = packages.select("repo", "package_id", F.explode(pattern_prefixes(F.col("tag_pattern"))).alias("prefix"))
    read = tags.select("repo", "tag", "sha", F.inline(tag_readings(F.col("tag"))))
    return with_numbers(read.join(prefixes, ["repo", "prefix"]).select("package_id", "version", "tag", "sha"))


def drop_prereleases(releases: DataFrame) -> DataFrame:
    return releases.filter(F.col("prerelease").isNull())


def _first(releases: DataFrame, keys: list, order: list) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order, "sha", "tag")
    return releases.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def latest_per_minor(releases: DataFrame) -> DataFrame:
    return _first(releases, ["package_id", "major", "minor"], [F.desc("patch")])


def first_last_per_minor(releases: DataFrame) -> DataFrame:
    """Newest and oldest patch of every minor; of 0.0.x the newest only."""
    minor = Window.partitionBy("package_id", "major", "minor")
    ends = releases.withColumns({"_newest": F.row_number().over(minor.orderBy(F.desc("patch"), "sha", "tag")), "_oldest": F.row_number().over(minor.orderBy("patch", "sha", "tag"))})
    early = (F.col("major") == 0) & (F.col("minor") == 0)
    return ends.filter((F.col("_newest") == 1) | ((F.col("_oldest") == 1) & ~early)).drop("_newest", "_oldest").dropDuplicates(["package_id", "version"])


def collapse_v0(releases: DataFrame) -> DataFrame:
    """All of 1.0 and later, and the highest 0.x."""
    early = _first(releases.filter("major = 0"), ["package_id"], [F.desc("minor"), F.desc("patch")])
    return releases.filter("major > 0").unionByName(early)


def limit_minors(releases: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("package_id").orderBy(F.desc("major"), F.desc("minor"))
    return releases.withColumn("_n", F.dense_rank().over(window)).filter(F.col("_n") <= n).drop("_n")


def limit_versions(releases: DataFrame, n: int) -> DataFrame:
    window = Window.partitionBy("package_id").orderBy(*[F.desc(c) for c in NUMBERS], "sha", "tag")
    return releases.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def min_version(releases: DataFrame, least: str) -> DataFrame:
    return releases.filter(F.struct(*NUMBERS) >= F.struct(*[F.lit(int(x)).alias(n) for x, n in zip(least.split("."), NUMBERS, strict=True)]))


def always_include(kept: DataFrame, discovered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the wanted (package_id, version) rows that were discovered and are not kept."""
    named = discovered.join(wanted.select("package_id", "version").distinct(), ["package_id", "version"], "left_semi")
    missing = named.join(kept, ["package_id", "version"], "left_anti")
    return kept.unionByName(_first(missing, ["package_id", "version"], []).select(*kept.columns))


def discover_releases(tags: DataFrame, packages: DataFrame, wanted: DataFrame, least: str = "0.0.0", most: int = 10) -> DataFrame:
    """Tags to releases: no prereleases, a least version, ends of every minor, the newest ``most`` minors, wanted ones added."""
    found = cut(drop_prereleases(parse_release_tags(tags, packages)))  # tags are parsed once
    kept = limit_minors(first_last_per_minor(min_version(found, least)), most)
    return always_include(kept, found, wanted)


def sync_releases(existing: DataFrame, discovered: DataFrame, force: bool = False) -> DataFrame:
    """The discovered versions, each with its existing row if there is one; packages without any keep their old list."""
    columns = existing.columns
    fresh = discovered.select(*columns)
    if not force:
        old = existing.join(discovered.select("package_id", "version").distinct(), ["package_id", "version"], "left_semi").select(*columns)
        fresh = old.unionByName(fresh.join(existing, ["package_id", "version"], "left_anti").select(*columns))
    lost = existing.join(discovered.select("package_id").distinct(), "package_id", "left_anti").select(*columns)
    return fresh.unionByName(lost)


def resolve_tag_commits(tags: DataFrame, tag_objects: DataFrame, commits: DataFrame) -> DataFrame:
    """Annotated tags get their target's sha and the tagger's date, others the commit's date."""
    known = tags.join(tag_objects, "sha", "left").join(commits, "sha", "left")
    return known.select(*[c for c in tags.columns if c != "sha"], F.coalesce("target_sha", "sha").alias("sha"), F.coalesce("tagger_date", "commit_date").alias("release_date"))


def release_pairs(releases: DataFrame) -> DataFrame:
    """Every version with the one before it (null for the first)."""
    window = Window.partitionBy("package_id").orderBy(version_key("version"))
    return releases.select("package_id", "version", F.lag("version").over(window).alias("previous_version"))


def newest_in_series(history: DataFrame, prefix: str) -> DataFrame:
    series = history.filter(F.col("version").startswith(prefix))
    return series.groupBy("package_id").agg(F.max_by("version", version_key("version")).alias("version"))
