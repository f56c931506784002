"""Queries for symbol operators and artefact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import artifacts as A
from symloom.operators import symbols as S
from symloom.plans.bindings import bound, symbols, with_tables
from symloom.plans.registry import query

FLAT, LATEST, c = with_tables("flat"), with_tables("latest"), F.col
latest = lambda s, d: symbols(s, d, "latest")
NAME = ("package_id", "version", "qualified_name")


def raw(s, d):
    return symbols(s, d).select("package_id", "version", F.when(c("ord") % 13 != 0, c("name")).otherwise("").alias("name"), F.when(c("ord") % 11 == 0, "unknown").otherwise(c("kind")).alias("kind"), c("qualified_name").alias("path"), "signature", "members", c("source_path").alias("file"), c("ord").cast("int").alias("line"))


query("normalize_raw_symbols", FLAT + """ SELECT package_id, 'sym_py_' || kind || '_' || replace(qualified_name, '.', '_') || '_' || substr(md5(qualified_name), 1, 8) AS id, name, kind, signature, 'public' AS visibility,
  CASE WHEN kind IN ('class', 'module') THEN CASE WHEN m1_name = m2_name THEN 1 ELSE 2 END ELSE 0 END AS members, CAST(ord AS INT) AS line FROM flat WHERE ord % 13 <> 0 AND ord % 11 <> 0""")(
    lambda s, d: S.normalize_raw_symbols(raw(s, d), c("package_id"), "acme/repo", "abc").select("package_id", "id", "name", "kind", "signature", "visibility", F.when(c("members").isNotNull(), F.size("members")).otherwise(0).alias("members"), "source.line")
)


def sections(s, d):
    item = lambda *xs: F.struct(*[F.lit(x).cast("string").alias(n) if not hasattr(x, "alias") else x.cast("string").alias(n) for n, x in zip(("name", "type", "description", "default"), xs, strict=True)])
    none = F.array().cast("array<struct<name:string,type:string,description:string,default:string>>")
    sec = lambda kind, value, items=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), (none if items is None else F.array(*items)).alias("items"))
    code = F.concat(c("name"), F.lit("()"))
    params = [item("first", F.when(c("ord") % 2 == 0, c("p1_type")), "the first", None), item("second", c("p2_type"), None, "0")]
    made = [sec("text", c("summary")), sec("text", F.concat(F.lit("More on "), c("name"))), sec("examples", code), sec("text", F.lit("End.")), sec("examples", code), sec("args", F.lit(None).cast("string"), params), sec("returns", F.lit(None).cast("string"), [item("", c("returns_type"), "what comes back", None)])]
    return symbols(s, d).withColumn("sections", F.array_compact(F.array(*made, F.when(c("deprecated"), sec("deprecated", F.lit("gone soon"))))))


query("assemble_docs", FLAT + """ SELECT package_id, version, qualified_name, 'More on ' || name || chr(10) || chr(10) || 'End.' AS description, name || '()' AS examples, CASE WHEN deprecated THEN 'gone soon' END AS deprecated FROM flat""")(
    lambda s, d: sections(s, d).withColumn("x", S.assemble_docs(c("sections"), c("summary"))).select(*NAME, "x.description", F.array_join("x.examples", ",").alias("examples"), "x.deprecated")
)
query("params_and_returns", FLAT + """ SELECT package_id, version, qualified_name, 'first:' || CASE WHEN ord % 2 = 0 THEN p1_type ELSE 'Any' END || ':true,second:' || p2_type || ':false' AS params, returns_type AS returns FROM flat""")(
    lambda s, d: sections(s, d).withColumn("x", S.params_and_returns(c("sections"))).select(*NAME, F.array_join(F.transform("x.params", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))), ",").alias("params"), c("x.returns.type").alias("returns"))
)


def odd_names(s, d):
    return symbols(s, d).withColumn("name", F.when(c("ord") % 4 == 0, F.concat(F.lit("_"), "name")).when(c("ord") % 4 == 1, F.concat(F.lit("__"), "name", F.lit("__"))).otherwise(c("name")))


query("filter_included", FLAT + " SELECT package_id, version, qualified_name FROM flat WHERE ord % 4 <> 0 AND NOT contains(qualified_name, 'economy')")(lambda s, d: S.filter_included(odd_names(s, d), False, True, ("economy",)).select(*NAME))
query("filter_excluded_files", FLAT + r" SELECT package_id, version, source_path AS path FROM flat WHERE NOT regexp_matches('/' || source_path, '/(opt|lib)') AND NOT regexp_matches(source_path, '/red[^/]*$')")(
    lambda s, d: S.filter_excluded_files(symbols(s, d).select("package_id", "version", c("source_path").alias("path")), ("opt", "lib", "red"))
)
query("drop_external", FLAT + " SELECT package_id, version, qualified_name FROM flat WHERE ord % 6 <> 3")(lambda s, d: S.drop_external(symbols(s, d)).select(*NAME))
query("snapshot", FLAT + """ SELECT package_id, version, qualified_name, signature, returns_type, extends_name AS extends,
  concat_ws(',', CASE WHEN m1_vis = 'public' THEN m1_name END, CASE WHEN m2_name <> m1_name AND m2_vis = 'public' THEN m2_name END) AS members, n_params, source_path, CAST(ord % 100 + 1 AS INT) AS source_line, CASE WHEN kind IN ('class', 'interface') THEN 'T:' || p1_type END AS type_params FROM flat""")(
    lambda s, d: S.snapshot(symbols(s, d)).select(*NAME, "signature", "returns_type", F.array_join("extends", ",").alias("extends"), F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("members"), F.size("params").alias("n_params"), "source_path", "source_line", F.array_join(F.transform("type_params", lambda t: F.concat_ws(":", t["name"], t["constraint"])), ",").alias("type_params"))
)


def members(s, d):
    """Two members of each class: the symbols with the next numbers, if there are such."""
    base = bound(s, d, "latest").filter("kind IN ('class', 'module')")
    return base.select(c("package_id"), c("qualified_name").alias("owner"), F.posexplode(F.array(c("ord") + 25, c("ord") + 50)).alias("pos", "target")).select("package_id", "owner", "pos", F.concat(F.lit("mem"), "target").alias("name"), c("target").cast("string").alias("ref_id"), F.lit("public").alias("visibility"))


def member_targets(s, d):
    return bound(s, d, "latest").select("package_id", c("ord").cast("string").alias("id"), F.when(c("ord") % 3 == 0, F.concat(F.lit("readonly "), "signature")).when(c("ord") % 3 == 1, F.concat("name", F.lit("?: x"))).otherwise(c("signature")).alias("signature"), (c("ord") % 2 == 0).alias("is_static"))


query("member_snapshot", LATEST + """, m AS (SELECT package_id, qualified_name AS owner, unnest([0, 1]) AS pos, unnest([ord + 25, ord + 50]) AS target FROM latest WHERE kind IN ('class', 'module')),
  j AS (SELECT m.*, coalesce(CASE WHEN l.ord % 3 = 0 THEN 'readonly ' || l.signature WHEN l.ord % 3 = 1 THEN l.name || '?: x' ELSE l.signature END, 'mem' || CAST(target AS VARCHAR)) AS sig, coalesce(l.ord % 2 = 0, false) AS st FROM m LEFT JOIN latest l ON m.package_id = l.package_id AND m.target = l.ord)
  SELECT package_id, owner, string_agg('mem' || CAST(target AS VARCHAR) || ':' || sig || ':' || contains(sig, '?:')::VARCHAR || ':' || starts_with(sig, 'readonly ')::VARCHAR || ':' || st::VARCHAR, ',' ORDER BY pos) AS members FROM j GROUP BY ALL""")(
    lambda s, d: S.member_snapshot(members(s, d), member_targets(s, d)).withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["name"], m["signature"], m["optional"].cast("string"), m["readonly"].cast("string"), m["static"].cast("string"))), ","))
)

ROUTABLE = "kind IN ('class','function','interface','module','typeAlias','enum','method','variable','attribute','alias') AND coalesce(visibility, 'public') = 'public'"
PAGE = "CASE kind WHEN 'method' THEN 'function' WHEN 'typeAlias' THEN 'type' ELSE kind END"
ROUTES = f"{LATEST}, routing AS (SELECT package_id, language, package, qualified_name, id AS ref_id, kind, {PAGE} AS page_type, name AS title, ord FROM latest WHERE {ROUTABLE})"
routing = lambda s, d: A.routing_map(latest(s, d))
query("routing_map", f"{ROUTES} SELECT package_id, qualified_name, ref_id, kind, page_type, title FROM routing")(lambda s, d: routing(s, d).drop("ord"))
query("routing_by_title", f"{ROUTES} SELECT package_id, title, arg_max(qualified_name, ord) AS qualified_name FROM routing GROUP BY ALL")(lambda s, d: A.routing_by_title(routing(s, d)))
query("routing_by_kind", f"{ROUTES} SELECT package_id, kind, string_agg(qualified_name, ',' ORDER BY qualified_name) AS names FROM routing GROUP BY ALL")(lambda s, d: A.routing_by_kind(routing(s, d)).withColumn("names", F.array_join("names", ",")))
query("lookup_index", f"{LATEST} SELECT package_id, qualified_name, id, kind, name FROM latest")(lambda s, d: A.lookup_index(latest(s, d)))
query("known_symbols", f"{LATEST} SELECT DISTINCT package_id, name FROM latest WHERE kind IN ('class', 'interface', 'typeAlias', 'enum')")(lambda s, d: A.known_symbols(latest(s, d)))
CATALOG = f"{LATEST}, cat AS (SELECT package_id, id, kind, name, qualified_name, substr(signature, 1, 300) AS signature, substr(summary, 1, 200) AS summary, ord, language FROM latest WHERE visibility = 'public' AND kind IN ('class','function','interface','module','typeAlias','enum'))"
query("catalog", f"{CATALOG} SELECT * EXCLUDE (ord, language) FROM cat")(lambda s, d: A.catalog(latest(s, d)).drop("ord"))
PARTS = r"string_split(lower(regexp_replace(name, '([A-Z])', '~\1', 'g')), '~')"
KEYWORDS = rf"""list_sort(list_distinct(list_filter(list_concat(list_concat([name], {PARTS}), list_concat(string_split(name, '_'), [lower(replace(name, '_', '')), CASE WHEN language = 'python'
  THEN split_part(name, '_', 1) || upper(substr(split_part(name, '_', 2), 1, 1)) || substr(split_part(name, '_', 2), 2) || '_' || split_part(name, '_', 3) ELSE lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')) END])), lambda w: w <> '')))"""
PREFIXLESS = r"replace(CASE WHEN language = 'python' AND contains(qualified_name, '_') THEN regexp_replace(qualified_name, '^[^.]*\.', '') ELSE qualified_name END, '.', '/')"
RECORDS = f"""{LATEST}, rec AS (SELECT package_id || ':' || id AS id, '/' || language || '/' || replace(package, '_', '-') || '/' || {PREFIXLESS} AS url, name AS title, substr(summary, 1, 150) AS excerpt, {KEYWORDS} AS keywords, kind, language, package_id
  FROM latest WHERE coalesce(visibility, 'public') <> 'private' AND kind NOT IN ('parameter', 'enumMember'))"""
records = lambda s, d: A.search_records(latest(s, d), bound(s, d, "packages"))
query("search_records", f"{RECORDS} SELECT id, url, title, excerpt, array_to_string(keywords, ',') AS keywords, kind, language, package_id FROM rec")(lambda s, d: records(s, d).drop("breadcrumbs").withColumn("keywords", F.array_join(F.array_sort("keywords"), ",")))
query("package_stats", f"{LATEST} SELECT package_id, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'module') AS modules, count(*) FILTER (kind IN ('interface', 'typeAlias', 'enum')) AS types, count(*) AS total FROM latest GROUP BY package_id")(lambda s, d: A.package_stats(latest(s, d)))
NAV = r"CASE WHEN language = 'javascript' THEN qualified_name ELSE split_part(qualified_name, '.', -1) END"
query("module_nav", f"{ROUTES} SELECT DISTINCT package_id, {NAV} AS name, '/' || language || '/' || replace(package, '_', '-') || '/' || {NAV} AS path FROM routing WHERE kind = 'module' AND NOT regexp_matches({NAV}, '[/.]')")(lambda s, d: A.module_nav(routing(s, d), bound(s, d, "packages")))
query("member_sections", FLAT + """, m AS (SELECT package_id, version, qualified_name, unnest(CASE WHEN m1_name = m2_name THEN [{'p': 1, 'n': m1_name, 'k': m1_kind}] ELSE [{'p': 1, 'n': m1_name, 'k': m1_kind}, {'p': 2, 'n': m2_name, 'k': m2_kind}] END) AS x FROM flat)
  SELECT package_id, version, qualified_name, x.k AS kind, CASE x.k WHEN 'property' THEN 2 ELSE 4 END AS place, string_agg(x.n, ',' ORDER BY x.p) AS members FROM m GROUP BY ALL""")(lambda s, d: A.member_sections(symbols(s, d)).withColumn("members", F.array_join("members", ",")))
ROUTED = f"""{ROUTES}, pk AS (SELECT DISTINCT package_id, language, replace(package, '_', '-') AS slug FROM flat), routes AS (SELECT language, slug FROM pk UNION ALL SELECT language, slug || '/intro' FROM pk
  UNION ALL SELECT language, replace(package, '_', '-') || '/' || replace(CASE WHEN language = 'python' THEN regexp_replace(qualified_name, '^[^.]*\\.', '') ELSE qualified_name END, '.', '/') FROM routing WHERE kind IN ('class', 'function'))"""
routes = lambda s, d: A.static_routes(bound(s, d, "packages"), bound(s, d, "packages").select("package_id", F.lit("intro").alias("subpage")), routing(s, d))
query("static_routes", f"{ROUTED} SELECT language, slug FROM routes")(lambda s, d: routes(s, d).withColumn("slug", F.array_join("slug", "/")))
query("sitemap", f"""{ROUTED} SELECT 'https://x.org' AS url, 1.0 AS priority UNION ALL SELECT DISTINCT 'https://x.org/' || language, 0.9 FROM routes
  UNION ALL SELECT 'https://x.org/' || language || '/' || slug, CASE WHEN contains(slug, '/') THEN 0.6 ELSE 0.8 END FROM routes""")(lambda s, d: A.sitemap(routes(s, d), "https://x.org"))


def manifests(s, d):
    ref = c("qualified_name")
    body = F.concat(
        F.lit('{"exports": {".": "./index.js", "./package.json": "./package.json", "./'), F.replace(ref, F.lit("."), F.lit("/")), F.lit('": {"import": "./a.js"}, "./sub/'), ref, F.lit('": "./b.ts", "./no_such-'), c("name"), F.lit('": {"node": {"types": "./c.d.ts"}}, "./style": "./x.css", "./bad": {"node": {"browser": "x"}}}}'),
    )
    return bound(s, d, "latest").select(F.concat_ws("#", "package_id", "ord").alias("key"), "package_id", "ord", body.alias("manifest"))


EXPORTS = f"""{ROUTES}, ex AS (SELECT package_id, ord, unnest([replace(qualified_name, '.', '/'), 'sub/' || qualified_name, 'no_such-' || name]) AS slug FROM latest)"""
query("export_paths", f"""{EXPORTS} SELECT package_id || '#' || CAST(ord AS VARCHAR) AS package_id, './' || slug AS path, slug FROM ex""")(
    lambda s, d: A.export_paths(manifests(s, d).select(c("key").alias("package_id"), "manifest")).drop("title")
)
query("validate_export_paths", f"""{EXPORTS} SELECT DISTINCT e.package_id, e.slug FROM ex e WHERE EXISTS (SELECT 1 FROM routing r WHERE r.package_id = e.package_id AND r.qualified_name IN (e.slug, replace(e.slug, '/', '.'), split_part(e.slug, '/', -1)))""")(
    lambda s, d: A.validate_export_paths(A.export_paths(manifests(s, d).select("package_id", "manifest")), routing(s, d)).select("package_id", "slug").distinct()
)

BUILDS = with_tables("builds")
PACKS = f"{BUILDS}, nat AS (SELECT 'nation_' || CAST(n_nationkey AS VARCHAR) AS package_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 5 END AS idx, n_nationkey AS position, 'p' || CAST(n_regionkey AS VARCHAR) AS project FROM nation)"
nat = lambda s, d: bound(s, d, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("package_id"), F.when(c("n_nationkey") % 4 != 0, c("n_nationkey") % 5).alias("idx"), c("n_nationkey").alias("position"), F.concat(F.lit("p"), "n_regionkey").alias("project"))
builds = lambda s, d: bound(s, d, "builds")
query("package_order", f"{PACKS} SELECT project, package_id, row_number() OVER (PARTITION BY project ORDER BY idx NULLS LAST, position) AS place FROM nat WHERE package_id IN (SELECT package_id FROM builds)")(lambda s, d: A.package_order(nat(s, d), builds(s, d)))
BEST = "best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY created_at DESC, build_id DESC) AS n FROM builds) WHERE n = 1)"
query("latest_builds", f"{BUILDS}, {BEST} SELECT * FROM best")(lambda s, d: A.latest_builds(builds(s, d)))
query("latest_project_builds", f"{BUILDS} SELECT project, language, arg_max(build_id, created_at) AS build_id, count(DISTINCT package_id) AS packages FROM builds GROUP BY ALL")(lambda s, d: A.latest_project_builds(builds(s, d)))
query("recent_builds", f"{BUILDS} SELECT build_id, max(created_at) AS created_at FROM builds GROUP BY build_id ORDER BY 2 DESC, 1 LIMIT 10")(lambda s, d: A.recent_builds(builds(s, d)))
some = lambda s, d: A.latest_builds(builds(s, d).filter("created_at % 3 <> 0"))
SOME = "best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY created_at DESC, build_id DESC) AS n FROM builds WHERE created_at % 3 <> 0) WHERE n = 1)"
query("global_manifest", f"{PACKS}, {BEST} SELECT b.package_id, b.package_id AS published_name, CASE WHEN b.created_at % 2 = 0 THEN b.project ELSE nat.project END AS project, b.build_id, b.version, b.language FROM best b JOIN nat USING (package_id) WHERE nat.idx IS NOT NULL")(
    lambda s, d: A.global_manifest(A.latest_builds(builds(s, d)).withColumn("project", F.when(c("created_at") % 2 == 0, c("project"))), nat(s, d).filter("idx IS NOT NULL").select("package_id", F.lit(None).cast("string").alias("published_name"), "project", F.lit("none").alias("build_id")))
)
query("project_index", f"{PACKS}, {SOME} SELECT nat.project, package_id, build_id, version, build_id IS NULL AS missing FROM nat LEFT JOIN best USING (package_id)")(lambda s, d: A.project_index(nat(s, d), some(s, d)))
query("stale_builds", f"{BUILDS}, {BEST} SELECT build_id, 'ir/builds/' || build_id || '/x.json' AS path FROM builds WHERE build_id NOT IN (SELECT build_id FROM best)")(
    lambda s, d: A.stale_builds(builds(s, d).select(F.concat(F.lit("ir/builds/"), "build_id", F.lit("/x.json")).alias("path")), A.latest_builds(builds(s, d)))
)
query("needs_update", with_tables("releases", "packages") + """, lr AS (SELECT * FROM releases WHERE minor = 6), cfg AS (SELECT package_id, ord FROM packages)
  SELECT package_id, CASE WHEN lr.sha IS NULL THEN 'no releases' WHEN ord % 5 = 0 THEN 'no build' WHEN ord % 5 = 1 THEN 'latest release' WHEN ord % 5 = 2 THEN 'newer build' WHEN ord % 5 = 3 THEN 'new release' ELSE CASE WHEN ord % 2 = 0 THEN 'same version' ELSE 'other version' END END AS reason,
    lr.sha IS NULL OR ord % 5 IN (0, 3) OR (ord % 5 = 4 AND ord % 2 = 1) AS needs_update FROM cfg LEFT JOIN lr USING (package_id)""")(
    lambda s, d: A.needs_update(
        bound(s, d, "packages").select("package_id"),
        bound(s, d, "releases"),
        bound(s, d, "packages").filter("ord % 5 <> 0").select("package_id", F.when(c("ord") % 2 == 0, "1.6.0").otherwise("1.0.0").alias("version"),
            F.when(c("ord") % 5 == 1, F.md5(F.concat("package_id", F.lit("1.6.0")))).when(c("ord") % 5 != 4, "zz").alias("sha"), F.when(c("ord") % 5 == 2, "2030-01-01").otherwise("1990-01-01").alias("created_date")),
    )
)
DUPS = "dup AS (SELECT package_id, version, p AS id, CASE WHEN ord % 2 = 0 THEN source_path ELSE '' END AS source_path, ord FROM (SELECT *, CAST(ord % 40 AS VARCHAR) AS p FROM latest))"
query("dedupe_symbols", f"{LATEST}, {DUPS} SELECT package_id, id, ord FROM (SELECT *, row_number() OVER (PARTITION BY package_id, id ORDER BY source_path = '', ord) AS n FROM dup) WHERE n = 1")(
    lambda s, d: A.dedupe_symbols(latest(s, d).select("package_id", (c("ord") % 40).cast("string").alias("id"), F.when(c("ord") % 2 == 0, c("source_path")).otherwise("").alias("source_path"), "ord")).select("package_id", "id", "ord")
)
query("attach_methods", f"""{LATEST}, t AS (SELECT package_id AS file, name FROM latest WHERE kind = 'class'), f AS (SELECT package_id AS file, 'f' || CAST(ord AS VARCHAR) AS name, ord, CASE WHEN ord % 2 = 0 THEN (SELECT min(name) FROM t WHERE t.file = latest.package_id) END AS receiver FROM latest WHERE kind IN ('method', 'function'))
  SELECT t.file, t.name, 'type' AS kind, coalesce(string_agg(f.name, ',' ORDER BY ord), '') AS methods FROM t LEFT JOIN f ON t.file = f.file AND t.name = f.receiver GROUP BY ALL
  UNION ALL SELECT file, name, 'function', '' FROM f WHERE receiver IS NULL UNION ALL SELECT file, receiver || '.' || name, 'method', '' FROM f WHERE receiver IS NOT NULL""")(lambda s, d: _attached(s, d))


def _attached(s, d):
    types = bound(s, d, "latest").filter("kind = 'class'").select(c("package_id").alias("file"), "name")
    first = types.groupBy("file").agg(F.min("name").alias("receiver"))
    functions = bound(s, d, "latest").filter("kind IN ('method', 'function')").select(c("package_id").alias("file"), F.concat(F.lit("f"), "ord").alias("name"), "ord").join(first, "file", "left").withColumn("receiver", F.when(c("ord") % 2 == 0, c("receiver")))
    return A.attach_methods(types, functions).withColumn("methods", F.array_join("methods", ","))
