"""Queries that write derived tables as files in the session's shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import artifacts as A
from symloom.plans.artifact_queries import LATEST
from symloom.plans.bindings import bound, symbols, with_tables
from symloom.plans.history_queries import B, ROW, deltas, shown
from symloom.plans.lineage import kept, shared_folder
from symloom.plans.registry import query
from symloom.sources import io
from symloom.streaming.history import read_history, stream_history

c = F.col
#: Most files in one folder of pages.
FOLDER = 8192


def scratch(spark: SparkSession) -> str:
    """A folder of its own below the one that all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _named(folder: str, ending: str):
    """A path of its own for each row."""
    return F.concat(F.lit(folder), F.monotonically_increasing_id(), F.lit(ending))


def _one_each(df: DataFrame, folder: str) -> None:
    """Every row as a JSON file of its own."""
    io.write_files(df.select(_named("", ".json").alias("path"), F.to_json(F.struct("*")).alias("content")), folder)


@query("read_configs", with_tables("packages") + " SELECT project, language, published_name AS name, 'libs/' || published_name AS path, row_number() OVER (PARTITION BY project ORDER BY published_name) - 1 AS position, 'v*' AS tag_pattern FROM packages")
def _configs(s, d):
    folder = scratch(s)
    entry = F.struct(c("published_name").alias("name"), F.concat(F.lit("libs/"), "published_name").alias("path"))
    _one_each(bound(s, d, "packages").groupBy("project", "language").agg(F.sort_array(F.collect_list(entry)).alias("p")).select("project", "language", F.lit("acme/repo").alias("repo"), F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["path"].alias("path"), F.struct(F.lit("v*").alias("tagPattern")).alias("versioning"))).alias("packages")), folder)
    return io.read_configs(s, folder).select("project", "language", "name", "path", "position", c("versioning.tagPattern").alias("tag_pattern"))


@query("read_releases", with_tables("releases") + " SELECT package_id AS package_name, row_number() OVER (PARTITION BY package_id ORDER BY minor DESC) - 1 AS position, version, sha, CAST(release_date AS TIMESTAMP) AS release_date FROM releases")
def _releases(s, d):
    folder = scratch(s)
    entry = F.struct((-c("minor")).alias("o"), "version", "sha", F.concat(F.lit("v"), "version").alias("tag"), c("release_date").alias("releaseDate"))
    lists = bound(s, d, "releases").groupBy("package_id").agg(F.sort_array(F.collect_list(entry)).alias("v")).withColumn("v", F.transform("v", lambda x: x.dropFields("o")))
    _one_each(lists.select(F.lit("core").alias("project"), F.lit("python").alias("language"), F.array(F.struct(c("package_id").alias("packageName"), F.lit("v*").alias("tagPattern"), c("v").alias("versions"))).alias("packages")), folder)
    return io.read_releases(s, folder, "*.json").select("package_name", "position", "version", "sha", "release_date")


@query("read_symbols", f"""{LATEST} SELECT package_id, row_number() OVER (PARTITION BY package_id, floor(ord / 500) ORDER BY ord) - 1 AS ord, id, kind, name, qualified_name, signature, visibility, summary, deprecated, returns_type, extends_name AS extends, n_params FROM latest""")
def _symbols(s, d):
    """Files of the symbols of one package and one range of 500 parts each."""
    folder = scratch(s)
    record = F.struct(
        "ord", "id", c("package_id").alias("packageId"), "language", "kind", "name", c("qualified_name").alias("qualifiedName"), "signature", F.struct("summary", F.struct(c("deprecated").alias("isDeprecated")).alias("deprecated")).alias("docs"),
        "params", F.struct(c("returns_type").alias("type")).alias("returns"), F.struct("extends").alias("relations"), F.struct("visibility").alias("tags"),
    )
    files = symbols(s, d, "latest").groupBy("package_id", F.floor(c("ord") / 500).alias("range")).agg(F.array_sort(F.collect_list(record), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("symbols"))
    _one_each(files.select(F.struct(c("package_id").alias("packageId")).alias("package"), "symbols"), folder)
    read = io.read_symbols(s, folder)
    return read.select("package_id", "ord", "id", "kind", "name", "qualified_name", "signature", "visibility", "summary", "deprecated", "returns_type", F.array_join("extends", ",").alias("extends"), F.size("params").alias("n_params"))


def _docs(s, d):
    """Every page as a file of its own, in eight folders that its path names, each dealt into folders that one task can list."""
    folder = scratch(s)
    part = F.coalesce((c("doc_id") % 8).cast("string"), F.lit("none"))
    ended = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"))
    pages = bound(s, d, "doc_files").select(part.alias("part"), ended.alias("content"), F.monotonically_increasing_id().alias("n"))
    io.write_files(pages.select(F.concat(F.lit("part="), "part", F.lit("/"), F.expr(f"n div {FOLDER}"), F.lit("/"), "n", F.lit(".txt")).alias("path"), "content"), folder)
    read = io.read_docs(s, folder, "*.txt")
    return read.select(F.regexp_extract("path", r"/part=(\d+)/[^/]+/[^/]+\.txt$", 1).cast("long").alias("part"), F.md5("content").alias("content"))


for name in ("read_docs", "read_docs_whole"):
    query(name, with_tables("doc_files") + " SELECT doc_id % 8 AS part, md5(content || chr(10)) AS content FROM doc_files")(_docs)


@query("write_symbol_shards", with_tables("flat") + " SELECT package_id, version, qualified_name, substr(md5(qualified_name), 1, 1) AS shard FROM flat")
def _shards(s, d):
    folder = scratch(s)
    io.write_symbol_shards(symbols(s, d), folder, digits=1)
    return s.read.schema("package_id string, version string, qualified_name string, shard string").parquet(folder).select("package_id", "version", "qualified_name", "shard")


@query("write_history_shards", f"{B} SELECT {ROW} FROM hist")
def _history(s, d):
    folder = scratch(s)
    io.write_history_shards(deltas(s, d), folder, digits=1)
    read = s.read.parquet(folder + "/shards")
    indexed = s.read.parquet(folder + "/index").select("package_id", F.explode("versions").alias("version"))
    return shown(read.join(indexed, ["package_id", "version"], "left_semi"))


@query("write_package_artifacts", f"{LATEST} SELECT 'lookup' AS artifact, 'b1' AS build_id, package_id, count(*) AS n FROM latest GROUP BY package_id UNION ALL SELECT 'stats', 'b1', package_id, 1 FROM latest GROUP BY package_id")
def _artifacts(s, d):
    folder, latest = scratch(s), symbols(s, d, "latest")
    io.write_package_artifacts({"lookup": A.lookup_index(latest), "stats": A.package_stats(latest)}, folder, "b1")
    read = lambda name: s.read.json(f"{folder}/{name}").groupBy("build_id", "package_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "build_id", "package_id", "n")
    return read("lookup").unionByName(read("stats"))


@query("stream_history", f"{B} SELECT {ROW} FROM hist")
def _stream(s, d):
    """Two arrivals: the versions up to 1.3.0, then the others with 1.3.0 again, which adds nothing."""
    folder = scratch(s)
    table = symbols(s, d).select("package_id", "version", "ord", "qualified_name", "kind", "signature", "returns_type", "deprecated", "extends", "implements", "members", "params")
    table = kept(table)  # told apart twice
    for part in ("version <= '1.3.0'", "version >= '1.3.0'"):
        table.filter(part).write.mode("append").parquet(folder + "/in")
        stream_history(s, folder + "/in", folder + "/out", folder + "/state", table.schema)
    return shown(read_history(s, folder + "/out"))
