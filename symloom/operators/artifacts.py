"""Routing, lookup, catalog, listing and manifest tables built from symbols, packages and builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import names as N

# Kinds that have pages, catalog kinds, kinds of static routes, and the order of member sections.
ROUTABLE = ("class", "function", "interface", "module", "typeAlias", "enum", "method", "variable", "attribute", "alias")
CATALOG = ("class", "function", "interface", "module", "typeAlias", "enum")
STATIC = ("class", "function")
SECTIONS = ("constructor", "property", "attribute", "method", "function")


def first_row(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def routing_map(symbols: DataFrame) -> DataFrame:
    """Routable symbols whose visibility is public or missing; of equal names the last in file order."""
    public = symbols.filter(F.col("kind").isin(*ROUTABLE) & (F.coalesce("visibility", F.lit("public")) == "public"))
    last = first_row(public, ["package_id", "qualified_name"], F.desc("ord"))
    return last.select("package_id", "qualified_name", F.col("id").alias("ref_id"), "kind", N.page_type(F.col("kind")).alias("page_type"), F.col("name").alias("title"), "ord")


def routing_by_title(routing: DataFrame) -> DataFrame:
    return routing.groupBy("package_id", "title").agg(F.max_by("qualified_name", F.struct("ord", "qualified_name")).alias("qualified_name"))


def routing_by_kind(routing: DataFrame) -> DataFrame:
    """Names of each kind as a sorted list, in blocks of a package."""
    return routing.groupBy("package_id", "kind").agg(F.array_sort(F.collect_list("qualified_name")).alias("names"))


def lookup_index(symbols: DataFrame) -> DataFrame:
    return first_row(symbols, ["package_id", "qualified_name"], F.desc("ord")).select("package_id", "qualified_name", "id", "kind", "name")


def known_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin("class", "interface", "typeAlias", "enum")).select("package_id", "name").distinct()


def catalog(symbols: DataFrame) -> DataFrame:
    public = symbols.filter((F.col("visibility") == "public") & F.col("kind").isin(*CATALOG))
    return public.select("package_id", "id", "kind", "name", "qualified_name", F.substring("signature", 1, 300).alias("signature"), F.substring("summary", 1, 200).alias("summary"), "ord")


def search_keywords(name: Column, language: Column) -> Column:
    """The name, its parts, its bare form and its form in the other naming convention, each once."""
    camel = F.transform(N.camel_parts(name), F.lower)
    other = F.when(language == "python", N.snake_to_camel(name)).otherwise(N.camel_to_snake(name))
    words = F.concat(F.array(name), camel, F.split(name, "_"), F.array(N.normalized_name(name), other))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def search_records(symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """Search records of all symbols that are not private; one for each (package, id), the first in file order."""
    kept = symbols.filter((F.coalesce("visibility", F.lit("public")) != "private") & ~F.col("kind").isin("parameter", "enumMember"))
    first = first_row(kept, ["package_id", "id"], "ord")
    joined = first.drop("language").join(packages.select("package_id", "published_name", "display_name", "language"), "package_id")
    prefixed = (F.col("language") == "python") & F.col("qualified_name").contains("_")
    path = F.concat(F.lit("/"), F.when(F.col("language") == "python", "python").otherwise("javascript"), F.lit("/"), N.slug_package(F.col("published_name")), F.lit("/"), N.slug_symbol_path(F.col("qualified_name"), prefixed))
    return joined.select(
        F.concat_ws(":", "package_id", "id").alias("id"), path.alias("url"), F.col("name").alias("title"), N.breadcrumbs(F.col("display_name"), F.col("qualified_name")).alias("breadcrumbs"),
        F.coalesce(F.substring("summary", 1, 150), F.lit("")).alias("excerpt"), search_keywords(F.col("name"), F.col("language")).alias("keywords"), "kind", "language", "package_id",
    )


def package_stats(symbols: DataFrame) -> DataFrame:
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return symbols.groupBy("package_id").agg(
        count("class").alias("classes"), count("function").alias("functions"), count("module").alias("modules"), count("interface", "typeAlias", "enum").alias("types"), F.count(F.lit(1)).alias("total")
    )


def module_nav(routing: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, name, path) of each package's own modules, without nested and index modules."""
    modules = routing.filter("kind = 'module'").join(packages.select("package_id", "published_name", "language"), "package_id")
    name = F.when(F.col("language") == "javascript", F.regexp_replace("qualified_name", "^modules/", "")).otherwise(F.element_at(F.split("qualified_name", r"\."), -1))
    named = modules.withColumn("name", name).filter(~F.col("name").rlike("[/.]") & (F.col("name") != "index"))
    path = F.concat(F.lit("/"), F.col("language"), F.lit("/"), N.slug_package(F.col("published_name")), F.lit("/"), F.col("name"))
    return named.select("package_id", "name", path.alias("path")).distinct()


def member_sections(symbols: DataFrame) -> DataFrame:
    """(package_id, version, qualified_name, place, kind, members): members of each kind, kinds in their fixed order."""
    order = F.array(*map(F.lit, SECTIONS))
    each = symbols.select("package_id", "version", "qualified_name", F.posexplode("members").alias("pos", "m"))
    grouped = each.groupBy("package_id", "version", "qualified_name", F.col("m.kind").alias("kind")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("m.name").alias("name")))).alias("members"))
    return grouped.withColumns({"place": F.array_position(order, F.col("kind")), "members": F.transform("members", lambda m: m["name"])})


def static_routes(packages: DataFrame, subpages: DataFrame, routing: DataFrame) -> DataFrame:
    """(language, slug array): packages, their subpages, and class and function pages."""
    own = packages.select("package_id", "language", N.slug_package(F.col("published_name")).alias("slug"))
    parts = F.split("qualified_name", r"\.")
    python = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    other = F.when(F.col("qualified_name").contains("/"), F.split("qualified_name", "/")).otherwise(parts)
    pages = own.join(routing.filter(F.col("kind").isin(*STATIC)), "package_id")
    route = F.when(F.col("language") == "python", python).otherwise(other)
    symbols = pages.select("language", F.concat(F.array("slug"), route).alias("slug"), F.get(route, F.lit(0)).alias("head")).filter("head <> ''").drop("head")
    sub = own.join(subpages.select("package_id", "subpage"), "package_id").select("language", F.array("slug", "subpage").alias("slug"))
    return own.select("language", F.array("slug").alias("slug")).unionByName(sub).unionByName(symbols)


def sitemap(routes: DataFrame, base: str) -> DataFrame:
    """(url, priority): home 1.0, language pages 0.9, packages 0.8, everything below 0.6."""
    pages = routes.select(F.concat_ws("/", F.lit(base), "language", F.array_join("slug", "/")).alias("url"), F.when(F.size("slug") == 1, 0.8).otherwise(0.6).alias("priority"))
    languages = routes.select(F.concat_ws("/", F.lit(base), "language").alias("url"), F.lit(0.9).alias("priority")).distinct()
    home = routes.sparkSession.range(1).select(F.lit(base).alias("url"), F.lit(1.0).alias("priority"))
    return home.unionByName(languages).unionByName(pages)


def export_paths(manifests: DataFrame) -> DataFrame:
    """(package_id, path, slug, title) of the importable entries of ``exports`` in package manifests (JSON text)."""
    entries = manifests.select("package_id", F.explode(F.from_json(F.get_json_object("manifest", "$.exports"), "map<string,string>")).alias("path", "config"))
    text = F.col("config")
    fields = F.from_json(text, "map<string,string>")
    nested = F.exists(F.map_values(fields), lambda v: F.get_json_object(v, "$.default").isNotNull() | F.get_json_object(v, "$.types").isNotNull())
    direct = F.exists(F.map_keys(fields), lambda k: k.isin("import", "require", "input"))
    valid = F.when(text.startswith("{"), F.coalesce(direct | nested, F.lit(False))).otherwise(text.rlike(r"\.(js|ts)$"))
    slug = F.regexp_replace("path", r"^\./", "")
    title = F.initcap(F.regexp_replace(F.element_at(F.split(slug, "/"), -1), "[_-]", " "))
    return entries.filter(~F.col("path").isin(".", "./package.json") & valid).select("package_id", "path", slug.alias("slug"), title.alias("title"))


def validate_export_paths(exports: DataFrame, routing: DataFrame) -> DataFrame:
    """Exports whose slug, slug with dots, or last segment is a routed name of the package."""
    tries = F.array_distinct(F.array("slug", F.replace(F.col("slug"), F.lit("/"), F.lit(".")), F.element_at(F.split("slug", "/"), -1)))
    hits = exports.select("package_id", "slug", F.explode(tries).alias("qualified_name")).join(routing.select("package_id", "qualified_name"), ["package_id", "qualified_name"], "left_semi")
    return exports.join(hits.select("package_id", "slug").distinct(), ["package_id", "slug"], "left_semi").select(*exports.columns)


def package_order(configs: DataFrame, present: DataFrame) -> DataFrame:
    """(project, package_id, place): explicit indexes first, then by position; packages that are not present go."""
    kept = configs.join(present.select("package_id").distinct(), "package_id", "left_semi")
    window = Window.partitionBy("project").orderBy(F.col("idx").asc_nulls_last(), "position", "package_id")
    return kept.select("project", "package_id", F.row_number().over(window).alias("place"))


def latest_builds(builds: DataFrame) -> DataFrame:
    """The newest build of each package."""
    best = builds.groupBy("package_id").agg(F.max_by(F.struct("project", "language", "build_id", "version", "sha", "created_at"), F.struct("created_at", "build_id")).alias("b"))
    return best.select("package_id", "b.*")


def latest_project_builds(builds: DataFrame) -> DataFrame:
    """The newest build of each project and language, with the number of packages."""
    return builds.groupBy("project", "language").agg(F.max_by("build_id", F.struct("created_at", "build_id")).alias("build_id"), F.count_distinct("package_id").alias("packages"))


def recent_builds(builds: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` different builds."""
    return builds.groupBy("build_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "build_id").limit(n)


def global_manifest(pointers: DataFrame, packages: DataFrame) -> DataFrame:
    """Pointers of all indexes with their package's data; unknown packages go, project and build fall back on it."""
    return pointers.alias("p").join(packages.alias("k"), "package_id").select(
        "package_id", F.coalesce("k.published_name", "package_id").alias("published_name"), F.coalesce("p.project", "k.project").alias("project"), F.coalesce("p.build_id", "k.build_id").alias("build_id"), "p.version", "p.language"
    )


def project_index(packages: DataFrame, pointers: DataFrame) -> DataFrame:
    """Every package with its pointer's build; ``missing`` where there is none."""
    return packages.select("project", "package_id").join(pointers.select("package_id", "build_id", "version"), "package_id", "left").withColumn("missing", F.col("build_id").isNull())


def stale_builds(artifacts: DataFrame, keep: DataFrame) -> DataFrame:
    """Artefact rows (path) whose build id, the segment below ``builds/``, is not kept."""
    found = artifacts.withColumn("build_id", F.regexp_extract("path", r"(?:^|/)builds/([^/]+)/", 1)).filter("build_id <> ''")
    return found.join(keep.select("build_id").distinct(), "build_id", "left_anti")


def needs_update(configs: DataFrame, releases: DataFrame, builds: DataFrame) -> DataFrame:
    """(package_id, needs_update, reason) of each configured package.

    Up to date if the build is of the latest release's sha or not older than it; without a sha to compare, versions
    decide; no release list or no build means an update.
    """
    latest = releases.groupBy("package_id").agg(F.max_by(F.struct(F.col("version").alias("version"), F.col("sha").alias("sha"), F.col("release_date").alias("date")), F.struct("major", "minor", "patch")).alias("r"))
    joined = configs.join(latest, "package_id", "left").join(builds.select("package_id", F.struct("version", "sha", "created_date").alias("b")), "package_id", "left")
    both = F.col("r.sha").isNotNull() & F.col("b.sha").isNotNull()
    reason = (
        F.when(F.col("r").isNull(), "no releases")
        .when(F.col("b").isNull(), "no build")
        .when(both & (F.col("r.sha") == F.col("b.sha")), "latest release")
        .when(both & (F.col("b.created_date") >= F.col("r.date")), "newer build")
        .when(both, "new release")
        .when(F.col("r.version") == F.col("b.version"), "same version")
        .otherwise("other version")
    )
    return joined.select("package_id", reason.alias("reason")).withColumn("needs_update", F.col("reason").isin("no releases", "no build", "new release", "other version"))


def dedupe_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each id: the first, unless it has no source path and a later one has."""
    return first_row(symbols, ["package_id", "id"], F.coalesce("source_path", F.lit("")) == "", "ord")


def attach_methods(types: DataFrame, functions: DataFrame) -> DataFrame:
    """Types (file, name) with the methods whose receiver they are, and free functions, as rows (file, name, kind, methods)."""
    owned = functions.filter(F.col("receiver").isNotNull()).groupBy("file", "receiver").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("m"))
    with_methods = types.join(owned.withColumnRenamed("receiver", "name"), ["file", "name"], "left").select("file", "name", F.lit("type").alias("kind"), F.coalesce(F.transform("m", lambda x: x["name"]), F.array().cast("array<string>")).alias("methods"))
    none = F.array().cast("array<string>").alias("methods")
    free = functions.filter(F.col("receiver").isNull()).select("file", "name", F.lit("function").alias("kind"), none)
    methods = functions.join(types.select("file", F.col("name").alias("receiver")), ["file", "receiver"]).select("file", F.concat_ws(".", "receiver", "name").alias("name"), F.lit("method").alias("kind"), none)
    return with_methods.unionByName(free).unionByName(methods)
