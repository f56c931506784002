"""Queries for release selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import releases as R
from symloom.plans.bindings import bound, with_tables
from symloom.plans.registry import query

OUT = ("package_id", "version", "tag", "sha")
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
PARSED = with_tables("tags", "tag_patterns") + rf""",
cut AS (SELECT package_id, tag, sha, CASE
    WHEN ends_with(tag_pattern, '@*') THEN CASE WHEN starts_with(tag, replace(tag_pattern, '@*', '@')) THEN replace(tag, replace(tag_pattern, '@*', '@'), '')
      WHEN starts_with(tag, replace(tag_pattern, '@*', '==')) THEN replace(tag, replace(tag_pattern, '@*', '=='), '')
      WHEN starts_with(tag, replace(tag_pattern, '@*', '-')) THEN replace(tag, replace(tag_pattern, '@*', '-'), '') END
    WHEN tag_pattern = '*' THEN regexp_replace(tag, '^[v=\s]+', '')
    WHEN starts_with(tag, replace(tag_pattern, '*', '')) THEN substr(tag, length(tag_pattern)) END AS version
  FROM tags JOIN tag_patterns USING (repo)),
parsed AS (SELECT *, TRY_CAST(regexp_extract(version, '{SEMVER}', 1) AS INT) AS major, TRY_CAST(regexp_extract(version, '{SEMVER}', 2) AS INT) AS minor, TRY_CAST(regexp_extract(version, '{SEMVER}', 3) AS INT) AS patch,
    nullif(regexp_extract(version, '{SEMVER}', 4), '') AS prerelease FROM cut WHERE regexp_matches(version, '{SEMVER}')),
final AS (SELECT * FROM parsed WHERE prerelease IS NULL)"""
COLUMNS = "package_id, version, tag, sha"
NEWEST = "row_number() OVER (PARTITION BY package_id, major, minor ORDER BY patch DESC, sha, tag)"
OLDEST = "row_number() OVER (PARTITION BY package_id, major, minor ORDER BY patch, sha, tag)"
ENDS = f"""ends AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY package_id, version) AS r FROM (
    SELECT package_id, tag, sha, version, major, minor, patch FROM (SELECT *, {NEWEST} AS n FROM final) WHERE n = 1
    UNION SELECT package_id, tag, sha, version, major, minor, patch FROM (SELECT *, {OLDEST} AS n FROM final) WHERE n = 1 AND NOT (major = 0 AND minor = 0))) WHERE r = 1)"""


def parsed(spark, sf):
    return R.parse_release_tags(bound(spark, sf, "tags"), bound(spark, sf, "tag_patterns"))


def final(spark, sf):
    return R.drop_prereleases(parsed(spark, sf))


def wanted(spark, sf):
    return final(spark, sf).filter("minor = 1 AND patch = 1").select("package_id", "version").distinct()


query("parse_release_tags", f"{PARSED} SELECT {COLUMNS}, major, minor, patch, prerelease FROM parsed")(lambda s, d: parsed(s, d))
query("drop_prereleases", f"{PARSED} SELECT {COLUMNS} FROM final")(lambda s, d: final(s, d).select(*OUT))
query("latest_per_minor", f"{PARSED} SELECT {COLUMNS} FROM (SELECT *, {NEWEST} AS n FROM final) WHERE n = 1")(lambda s, d: R.latest_per_minor(final(s, d)).select(*OUT))
query("first_last_per_minor", f"{PARSED}, {ENDS} SELECT package_id, version FROM ends")(lambda s, d: R.first_last_per_minor(final(s, d)).select("package_id", "version"))
query("collapse_v0", f"""{PARSED} SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY package_id, major = 0 ORDER BY minor DESC, patch DESC, sha, tag) AS n FROM final) WHERE major > 0 OR n = 1""")(lambda s, d: R.collapse_v0(final(s, d)).select(*OUT))
query("limit_minors", f"{PARSED} SELECT {COLUMNS} FROM (SELECT *, dense_rank() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC) AS n FROM final) WHERE n <= 5")(lambda s, d: R.limit_minors(final(s, d), 5).select(*OUT))
query("limit_versions", f"{PARSED} SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC, patch DESC, sha, tag) AS n FROM final) WHERE n <= 7")(lambda s, d: R.limit_versions(final(s, d), 7).select(*OUT))
query("min_version", f"{PARSED} SELECT {COLUMNS} FROM final WHERE (major, minor, patch) >= (3, 6, 2)")(lambda s, d: R.min_version(final(s, d), "3.6.2").select(*OUT))
KEPT = f"kept AS (SELECT package_id, version FROM (SELECT *, dense_rank() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC) AS n FROM final) WHERE n <= 3)"
query("always_include", f"{PARSED}, {KEPT} SELECT DISTINCT package_id, version FROM (SELECT * FROM kept UNION SELECT package_id, version FROM final WHERE minor = 1 AND patch = 1)")(
    lambda s, d: R.always_include(R.limit_minors(final(s, d), 3), final(s, d), wanted(s, d)).select("package_id", "version").distinct()
)
query("discover_releases", f"""{PARSED.replace("prerelease IS NULL", "prerelease IS NULL AND (major, minor, patch) >= (2, 0, 0)")}, {ENDS}, plain AS (SELECT * FROM parsed WHERE prerelease IS NULL),
  lim AS (SELECT package_id, version FROM (SELECT *, dense_rank() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC) AS n FROM ends) WHERE n <= 10)
  SELECT package_id, version FROM lim UNION SELECT package_id, version FROM plain WHERE minor = 1 AND patch = 1""")(
    lambda s, d: R.discover_releases(bound(s, d, "tags"), bound(s, d, "tag_patterns"), wanted(s, d), "2.0.0").select("package_id", "version")
)
SYNC = f"""{PARSED}, disc AS (SELECT {COLUMNS} FROM (SELECT *, {NEWEST} AS n FROM final) WHERE n = 1 AND NOT ends_with(package_id, 'a')),
  exi AS (SELECT package_id, version, 'old-' || tag AS tag, sha FROM (SELECT *, {OLDEST} AS n FROM final) WHERE n = 1)"""
query("sync_releases", f"""{SYNC} SELECT d.package_id, d.version, coalesce(e.tag, d.tag) AS tag, coalesce(e.sha, d.sha) AS sha FROM disc d LEFT JOIN exi e USING (package_id, version)
  UNION ALL SELECT * FROM exi WHERE package_id NOT IN (SELECT package_id FROM disc)""")(
    lambda s, d: R.sync_releases(
        R._first(final(s, d), ["package_id", "major", "minor"], ["patch"]).select("package_id", "version", F.concat(F.lit("old-"), "tag").alias("tag"), "sha"),
        R.latest_per_minor(final(s, d)).filter("NOT endswith(package_id, 'a')").select(*OUT),
    )
)
query("resolve_tag_commits", with_tables("tags") + """ SELECT repo, tag, CASE WHEN tag_ord % 3 = 0 THEN md5(sha) ELSE sha END AS sha, CASE WHEN tag_ord % 3 = 0 THEN '2020-' || CAST(tag_ord AS VARCHAR) WHEN tag_ord % 2 = 0 THEN '2021-' || CAST(tag_ord AS VARCHAR) END AS release_date FROM tags""")(
    lambda s, d: R.resolve_tag_commits(
        bound(s, d, "tags").select("repo", "tag", "sha"),
        bound(s, d, "tags").filter("tag_ord % 3 = 0").select("sha", F.md5("sha").alias("target_sha"), F.concat(F.lit("2020-"), "tag_ord").alias("tagger_date")),
        bound(s, d, "tags").filter("tag_ord % 2 = 0").select("sha", F.concat(F.lit("2021-"), "tag_ord").alias("commit_date")),
    )
)
query("release_pairs", with_tables("releases") + " SELECT package_id, version, lag(version) OVER (PARTITION BY package_id ORDER BY major, minor, patch) AS previous_version FROM releases")(lambda s, d: R.release_pairs(bound(s, d, "releases")))
query("newest_in_series", f"{PARSED} SELECT package_id, arg_max(version, major * 1000000 + minor * 1000 + patch) AS version FROM final WHERE starts_with(version, '3.1') GROUP BY package_id")(lambda s, d: R.newest_in_series(final(s, d), "3.1"))
MANY = """SELECT DISTINCT 'pkg' || CAST(o_custkey % 20 AS STRING) AS package_id, CAST(o_custkey % 3 AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) % 3 AS STRING)
    || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-rc.2' WHEN 2 THEN '-rc.10' WHEN 3 THEN '-alpha' ELSE '+b1' END AS version FROM {orders}"""
query("release_pairs_prerelease", f"""WITH r AS ({MANY.format(orders="orders")}), n AS (SELECT *, string_split(regexp_replace(version, '[-+].*', ''), '.')::INT[] AS n, CASE WHEN contains(version, '-a') THEN 0 WHEN contains(version, '-rc.2') THEN 1 WHEN contains(version, '-rc') THEN 2 ELSE 3 END AS stage FROM r)
  SELECT package_id, version, lag(version) OVER (PARTITION BY package_id ORDER BY n, stage, version) AS previous_version FROM n""")(lambda s, d: R.release_pairs(s.sql(MANY, orders=bound(s, d, "orders"))))
