"""Readers for configurations, releases, symbols and pages; writers for symbols, histories and package artefacts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.plans.lineage import kept

PACKAGE = (
    "struct<name:string,index:int,path:string,displayName:string,excludePatterns:array<string>,"
    "versioning:struct<tagPattern:string,maxVersions:int,alwaysInclude:array<string>,minVersion:string,enabled:boolean,pathOverrides:map<string,string>>,"
    "subpages:array<struct<slug:string,title:string,source:string>>>"
)
CONFIG = f"project string, language string, repo string, packages array<{PACKAGE}>, externalPackages array<{PACKAGE}>"
RELEASES = "project string, language string, repo string, packages array<struct<packageName:string,tagPattern:string,versions:array<struct<version:string,sha:string,tag:string,releaseDate:string>>>>"
MEMBER = "struct<name:string,refId:string,id:string,kind:string,visibility:string,type:string,signature:string>"
SYMBOL = (
    "struct<id:string,packageId:string,language:string,kind:string,name:string,qualifiedName:string,signature:string,"
    "docs:struct<summary:string,description:string,deprecated:struct<isDeprecated:boolean,message:string,since:string,replacement:string>>,"
    "params:array<struct<name:string,type:string,description:string,default:string,required:boolean>>,returns:struct<type:string,description:string>,"
    f"members:array<{MEMBER}>,relations:struct<extends:array<string>,implements:array<string>>,source:struct<repo:string,sha:string,path:string,line:int,endLine:int>,"
    "tags:struct<stability:string,visibility:string,isStatic:boolean>>"
)

#: Folders that one task lists, and files in one batch of a list.
FOLDERS, LISTED = 256, 10_000
#: Bytes of contents in one batch, bytes in a task, and bytes that opening a file counts for.
SLICE, TASK, OPENING = 1 << 20, 32 << 20, 16 << 10
#: What stands unquoted in a path of Spark's file metadata, as in Java's URIs.
QUOTED = re.compile(r"[^\w\-!.~'()*,;:$&+=@/\u00a1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", re.ASCII)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """(file, project, language, repo, position, name, ...): one row for each package, external ones last.

    ``*-versions.json`` and schema files in the folder are passed over.
    """
    files = spark.read.schema(CONFIG).json(path, multiLine=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
    files = files.filter(~F.col("file").rlike(r"-versions\.json$|schema\.json$"))
    none = F.array().cast(files.schema["packages"].dataType)
    everything = F.concat(F.coalesce("packages", none), F.coalesce("externalPackages", none))
    return files.select("file", "project", "language", "repo", F.posexplode(everything).alias("position", "p")).select("file", "project", "language", "repo", "position", "p.*")


def read_releases(spark: SparkSession, path: str, names: str = "*-versions.json") -> DataFrame:
    """(project, language, repo, package_name, tag_pattern, position, version, sha, tag, release_date), newest first."""
    files = spark.read.schema(RELEASES).json(path, multiLine=True, pathGlobFilter=names)
    packages = files.select("project", "language", "repo", F.explode("packages").alias("p"))
    each = packages.select("project", "language", "repo", F.col("p.packageName").alias("package_name"), F.col("p.tagPattern").alias("tag_pattern"), F.posexplode("p.versions").alias("position", "v"))
    return each.select("project", "language", "repo", "package_name", "tag_pattern", "position", "v.version", "v.sha", "v.tag", F.col("v.releaseDate").cast("timestamp").alias("release_date"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbol files, bare arrays or objects with ``symbols``, as rows in file order (``ord``); members' refId or id."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("file"))
    array = F.coalesce(F.from_json(F.get_json_object("value", "$.symbols"), f"array<{SYMBOL}>"), F.from_json("value", f"array<{SYMBOL}>"))
    each = text.select("file", F.posexplode(array).alias("ord", "s")).select("file", F.col("ord").cast("long"), "s.*")
    member = lambda m: F.struct(m["name"].alias("name"), F.coalesce(m["refId"], m["id"]).alias("ref_id"), m["kind"].alias("kind"), m["visibility"].alias("visibility"), m["type"].alias("type"))
    return each.select(
        "file", F.col("packageId").alias("package_id"), "ord", "id", "language", "kind", "name", F.col("qualifiedName").alias("qualified_name"), "signature", F.col("tags.visibility").alias("visibility"), F.col("tags.isStatic").alias("is_static"),
        F.col("docs.summary").alias("summary"), F.coalesce("docs.deprecated.isDeprecated", F.lit(False)).alias("deprecated"), "params", F.col("returns.type").alias("returns_type"), F.transform("members", member).alias("members"),
        F.col("relations.extends").alias("extends"), F.col("relations.implements").alias("implements"), F.col("source.path").alias("source_path"),
    )


def read_docs(spark: SparkSession, path: str, names: str = "*.{md,mdx}") -> DataFrame:
    """(path, content): one row for each ``.md`` and ``.mdx`` file below the folder, but those of installed packages.

    Tasks list the folders and read the files, so that no list of files passes through the driver. Hidden and empty files
    are passed over, as by Spark's readers. What is no folder that Arrow opens (a single file, a pattern, a store that only
    Spark knows) is listed by Spark, in the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    named = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)
    if _is_folder(named.toString()) and "\\" not in names:
        read = _read_below(spark, named.toString(), re.sub("^file:/+", "file:/", named.toUri().toString()), names)
    else:
        read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return read.filter(~F.col("path").rlike("/(node_modules|\\.git)/"))


def _is_folder(path: str) -> bool:
    try:
        system, base = _opened(path)
        return system.get_file_info(base).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _alternatives(pattern: str) -> list[str]:
    """A pattern without its braces: one for each choice in them."""
    braces = re.search(r"\{([^{}]*)\}", pattern)
    if not braces:
        return [pattern.replace("[^", "[!")]
    return [x for choice in braces[1].split(",") for x in _alternatives(pattern[: braces.start()] + choice + pattern[braces.end() :])]


def _files_below(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """(inside, bytes): all files of these names, by their path in the folder; one job for each level of folders."""
    patterns = _alternatives(names)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for outer in (x for batch in batches for x in batch.column(0).to_pylist()):
            inner = system.get_file_info(pafs.FileSelector(base.rstrip("/") + outer))
            for at in range(0, len(inner), LISTED):
                rows = [(f"{outer}/{x.base_name}", x.type == pafs.FileType.Directory, x.size or 0) for x in inner[at : at + LISTED] if not _hidden(x.base_name)]
                rows = [r for r in rows if (r[0].rpartition("/")[2] != "node_modules" if r[1] else r[2] and any(fnmatchcase(r[0].rpartition("/")[2], p) for p in patterns))]
                yield pa.RecordBatch.from_pydict({"inside": pa.array([r[0] for r in rows], pa.string()), "folder": pa.array([r[1] for r in rows], pa.bool_()), "bytes": pa.array([r[2] for r in rows], pa.int64())})

    level, folders, found = spark.createDataFrame([("",)], "inside string"), 1, []
    while folders:
        tasks = min(folders, max(spark.sparkContext.defaultParallelism, folders // FOLDERS))
        each = kept(level.repartition(tasks).mapInArrow(told, "inside string, folder boolean, bytes long"))
        found.append(each.filter("NOT folder").select("inside", "bytes"))
        level = each.filter("folder").select("inside")
        folders = level.count()
    return reduce(DataFrame.unionByName, found)


def _read_below(spark: SparkSession, folder: str, uri: str, names: str) -> DataFrame:
    """(path, content) of all files of these names below the folder, dealt to tasks by their number and bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), paths, contents, size = _opened(folder), [], [], 0
        made = lambda: pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})
        for inside in (x for batch in batches for x in batch.column(0).to_pylist()):
            with system.open_input_stream(base.rstrip("/") + inside) as file:
                content = file.read()
            if paths and size + len(content) > SLICE:
                yield made()
                paths, contents, size = [], [], 0
            paths.append(uri.rstrip("/") + QUOTED.sub(lambda m: quote(m[0], safe=""), inside))
            contents.append(content)
            size += len(content)
        yield made()

    files = _files_below(spark, folder, names)
    whole = files.agg(F.coalesce(F.sum(F.col("bytes") + OPENING), F.lit(0))).first()[0]
    dealt = files.select("inside").repartition(max(spark.sparkContext.defaultParallelism, -(-whole // TASK)))
    return dealt.mapInArrow(read, "path string, content binary").select("path", F.col("content").cast("string").alias("content"))


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, named as Spark names it, and the folder's path there."""
    scheme, colon, rest = folder.partition(":")
    if colon and "/" not in scheme:
        return (pafs.LocalFileSystem(), re.sub("^//[^/]*", "", rest)) if scheme == "file" else pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def write_files(files: DataFrame, folder: str) -> None:
    """Every row (path, content) as a file of its own below the folder, which its path names; the contents as they are.

    Tasks open the files and nothing else: a writer of rows changes the permissions of every file by a command of
    its own and renames it twice. A task that runs again writes the same files anew.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, base), made, n = _opened(folder), set(), 0
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                parent, _, name = path.as_py().rpartition("/")
                if parent not in made:
                    system.create_dir(f"{base}/{parent}", recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{base}/{parent}/{name}") as out:
                    out.write(content.as_buffer())
                n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]})

    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def name_shard(name: Column, digits: int = 2) -> Column:
    """Leading hexadecimal digits of the name's MD5: two make 256 even shards."""
    return F.substring(F.md5(name), 1, digits)


def write_symbol_shards(df: DataFrame, path: str, by_id: bool = False, digits: int = 2) -> None:
    """Parquet by package and shard, one file for each task and shard; ``by_id`` takes the id's first two characters."""
    shard = F.substring("id", 1, 2) if by_id else name_shard(F.col("qualified_name"), digits)
    df.withColumn("shard", shard).repartition("package_id", "shard").write.mode("overwrite").partitionBy("package_id", "shard").parquet(path)


def write_history_shards(history: DataFrame, path: str, digits: int = 2) -> None:
    """Histories by name shard below ``shards``, and each package's versions and shards in ``index``."""
    sharded = history.withColumn("shard", name_shard(F.col("qualified_name"), digits))
    sharded.repartition("package_id", "shard").write.mode("overwrite").partitionBy("package_id", "shard").parquet(f"{path}/shards")
    written = history.sparkSession.read.schema(sharded.select("version", "package_id", "shard").schema).parquet(f"{path}/shards")  # the history is not told again
    index = written.groupBy("package_id").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("shard")).alias("shards"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def write_package_artifacts(tables: dict[str, DataFrame], path: str, build_id: str) -> None:
    """Each table (with package_id) below its name, by build and package, as JSON lines."""
    for name, df in tables.items():
        df.withColumn("build_id", F.lit(build_id)).repartition("package_id").write.mode("overwrite").partitionBy("build_id", "package_id").json(f"{path}/{name}")
