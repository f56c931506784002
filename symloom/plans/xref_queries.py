"""Queries for cross-reference joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import artifacts as A
from symloom.operators import xref as X
from symloom.plans.artifact_queries import CATALOG, LATEST, PREFIXLESS, ROUTES, routing
from symloom.plans.bindings import bound, symbols, with_tables
from symloom.plans.registry import query

c = F.col
latest = lambda s, d: symbols(s, d, "latest")
packages = lambda s, d: bound(s, d, "packages")

# routing titles are unique to a package, so the query shortens them: names shared by several packages
SHARED = ROUTES.replace("name AS title", "split_part(regexp_replace(regexp_replace(name, '([A-Z])', '_\\1'), '[0-9]+$', ''), '_', 1) || '_' || CAST(ord % 7 AS VARCHAR) AS title").replace("regexp_replace(regexp_replace(name, '([A-Z])', '_\\1'), '[0-9]+$', '')", "regexp_replace(name, '[A-Z0-9_].*$', '')")
shared = lambda s, d: routing(s, d).withColumn("title", F.concat(F.regexp_replace("title", "[A-Z0-9_].*$", ""), F.lit("_"), (c("ord") % 7).cast("string")))
URL = f"'/' || language || '/' || replace(package, '_', '-') || '/' || {PREFIXLESS}"
ORDER = "CAST(regexp_extract(package, '[0-9]+') AS BIGINT) * 1000000 + ord"
URLS = f"{SHARED}, urls AS (SELECT language, title AS name, arg_min({URL}, {ORDER}) AS url FROM routing WHERE kind NOT IN ('module', 'parameter', 'constructor') GROUP BY ALL)"
query("type_url_map", f"{URLS} SELECT * FROM urls")(lambda s, d: X.type_url_map(shared(s, d), packages(s, d)))
query("type_url_map_excluding", f"{URLS} SELECT * FROM urls WHERE NOT starts_with(url, '/' || language || '/brand-1/') AND name NOT LIKE '%\\_3' ESCAPE '\\'")(
    lambda s, d: X.type_url_map_excluding(X.type_url_map(shared(s, d), packages(s, d)), F.lit("brand-1"), shared(s, d).filter("title LIKE '%3'").select(c("title").alias("name")))
)
prefixed = lambda s, d: packages(s, d).withColumn("published_name", F.concat(F.lit("acme_"), "published_name"))
query("resolve_type_refs", f"""{ROUTES}, refs AS (SELECT package_id || '#' || CAST(ord AS VARCHAR) AS ref_id, name, qualified_name, ord FROM latest)
  SELECT refs.ref_id, refs.name, refs.qualified_name, CASE WHEN language = 'python' THEN '/python/acme-' || replace(package, '_', '-') || '/' || {PREFIXLESS.replace('qualified_name', 'r.qualified_name')} END AS url FROM refs LEFT JOIN routing r ON refs.ord = r.ord""")(
    lambda s, d: X.resolve_type_refs(bound(s, d, "latest").select(F.concat_ws("#", "package_id", "ord").alias("ref_id"), "name", "qualified_name"), prefixed(s, d), routing(s, d))
)
query("extract_type_refs", f"""{LATEST}, t AS (SELECT package_id, version, qualified_name AS symbol, unnest(list_distinct(list_filter([p1_type, CASE WHEN n_params = 2 THEN p2_type END, returns_type, extends_name], lambda x: x IS NOT NULL))) AS name FROM latest)
  SELECT package_id, version, symbol, name, CAST(NULL AS VARCHAR) AS qualified_name FROM t""")(lambda s, d: X.extract_type_refs(latest(s, d)))


def bases(s, d):
    """Every class and interface extends one numbered 25 lower in its package, or 1 lower in another."""
    own = bound(s, d, "latest").filter("kind IN ('class', 'interface')")
    everyone = bound(s, d, "latest").select((c("ord") + 25).alias("ord"), c("name").alias("base_name"))
    return own.join(everyone, "ord", "left").select("package_id", c("qualified_name").alias("class_name"), F.concat(F.lit("x.y."), F.coalesce("base_name", F.lit("None")), F.lit("<T[]>")).alias("base"))


query("resolve_bases", f"""{LATEST}, b AS (SELECT l.package_id, l.qualified_name AS class_name, 'x.y.' || coalesce(e.name, 'None') || '<T[]>' AS base, e.name AS simple FROM latest l LEFT JOIN latest e ON e.ord + 25 = l.ord WHERE l.kind IN ('class', 'interface')),
  ty AS (SELECT package_id, qualified_name, name FROM latest WHERE kind IN ('class', 'interface'))
  SELECT b.package_id, class_name, base, coalesce(o.package_id, x.package_id) AS base_package, coalesce(o.qualified_name, x.qualified_name) AS base_name FROM b LEFT JOIN ty o ON o.package_id = b.package_id AND o.name = simple
  LEFT JOIN ty x ON x.name = simple AND x.package_id IN (SELECT package_id FROM latest WHERE eco = 'py')""")(
    lambda s, d: X.resolve_bases(bases(s, d), latest(s, d), packages(s, d).filter("language = 'python'").select("package_id", c("ord").alias("rank")))
)
EDGES = with_tables("edges") + ", up AS (SELECT child, base, 1 AS depth FROM edges UNION SELECT up.child, edges.base, depth + 1 FROM up JOIN edges ON up.base = edges.child)"
query("ancestors", f"{EDGES} SELECT * FROM up")(lambda s, d: X.ancestors(bound(s, d, "edges")))


def owned(s, d):
    return bound(s, d, "part").select(c("p_partkey").alias("owner"), F.explode(F.array(F.struct(F.concat(F.lit("run"), c("p_size") % 5).alias("name"), F.lit("method").alias("kind"), F.when(c("p_partkey") % 3 == 0, "private").alias("visibility")),
        F.struct(F.lit("init").alias("name"), F.lit("constructor").alias("kind"), F.lit(None).cast("string").alias("visibility")), F.struct(F.concat(F.lit("[get"), c("p_partkey") % 4).alias("name"), F.lit("method").alias("kind"), F.lit("public").alias("visibility")))).alias("m")).select("owner", "m.*")


query("inherited_members", f"{EDGES} SELECT child AS class_name, 'run' || CAST(b.p_size % 5 AS VARCHAR) AS name, base, depth FROM up JOIN part b ON b.p_partkey = base JOIN part a ON a.p_partkey = child WHERE base % 3 <> 0 AND a.p_size % 5 <> b.p_size % 5")(
    lambda s, d: X.inherited_members(bound(s, d, "edges"), owned(s, d))
)
query("member_details", f"""{LATEST} SELECT package_id, qualified_name AS owner, name, kind, CASE WHEN ord % 2 = 0 THEN id ELSE 'lost' END AS ref_id, signature FROM latest""")(
    lambda s, d: X.member_details(bound(s, d, "latest").select("package_id", c("qualified_name").alias("owner"), "name", "kind", F.when(c("ord") % 2 == 0, c("id")).otherwise("lost").alias("ref_id")), latest(s, d))
)
WRITTEN = "CASE ord % 5 WHEN 0 THEN qualified_name WHEN 1 THEN 'classes.' || qualified_name WHEN 2 THEN regexp_replace(qualified_name, '^acme_[^.]*\\.', '') WHEN 3 THEN 'nothing.here' ELSE replace(qualified_name, '.', '/') END"
query("find_symbols", f"""{ROUTES}, p AS (SELECT package_id, {WRITTEN} AS path, ord, language, package FROM latest)
  SELECT p.package_id, path, r.ref_id, r.qualified_name FROM p LEFT JOIN routing r ON r.package_id = p.package_id AND r.ord = p.ord AND (p.ord % 5 IN (0, 1) OR (p.ord % 5 = 2))""")(
    lambda s, d: X.find_symbols(bound(s, d, "latest").select("package_id", F.expr(WRITTEN.replace("\\", "\\\\")).alias("path")), routing(s, d), prefixed(s, d))
)
query("symbol_by_name", f"""{LATEST} SELECT replace(package, '_', '-') AS package, CASE WHEN ord % 2 = 0 THEN name WHEN ord % 3 = 0 THEN qualified_name ELSE 'none' || CAST(ord AS VARCHAR) END AS name, CASE WHEN ord % 2 = 0 OR ord % 3 = 0 THEN id END AS id FROM latest""")(
    lambda s, d: X.symbol_by_name(bound(s, d, "latest").select(F.replace(c("package"), F.lit("_"), F.lit("-")).alias("package"), F.when(c("ord") % 2 == 0, c("name")).when(c("ord") % 3 == 0, c("qualified_name")).otherwise(F.concat(F.lit("none"), "ord")).alias("name")), latest(s, d), packages(s, d))
)


def subpage_refs(s, d):
    table = bound(s, d, "latest")
    ref = F.when(c("ord") % 4 == 0, c("qualified_name")).when(c("ord") % 4 == 1, F.regexp_replace("qualified_name", r"^[^.]*\.", "")).when(c("ord") % 4 == 2, F.concat(F.lit("other."), c("name"))).otherwise(F.concat(F.lit("gone"), "ord"))
    return table.select((c("ord") % 50).alias("page"), "package_id", c("ord").alias("pos"), ref.alias("ref"))


query("resolve_subpage_refs", f"""{CATALOG} SELECT ord % 50 AS page, ord AS pos, CASE ord % 4 WHEN 0 THEN qualified_name WHEN 1 THEN regexp_replace(qualified_name, '^[^.]*\\.', '') ELSE 'other.' || name END AS ref, id, qualified_name FROM cat WHERE ord % 4 <> 3""")(
    lambda s, d: X.resolve_subpage_refs(subpage_refs(s, d), A.catalog(latest(s, d)))
)
DOCS = with_tables("doc_files")
query("anchor_links", f"""{DOCS} SELECT doc_id AS page, 'acme.core.Item' || CAST(doc_id % 50 AS VARCHAR) AS target, CASE WHEN doc_id % 50 < 20 THEN 'acme_lib.x.Item' || CAST(doc_id % 50 AS VARCHAR) ELSE 'acme.core.Item' || CAST(doc_id % 50 AS VARCHAR) END AS qualified_name,
  CASE WHEN doc_id % 50 < 20 THEN '/python/acme-lib/x/Item' || CAST(doc_id % 50 AS VARCHAR) ELSE '/python/acme/core/Item' || CAST(doc_id % 50 AS VARCHAR) END AS url FROM doc_files""")(
    lambda s, d: X.anchor_links(
        bound(s, d, "doc_files").select(c("doc_id").alias("page"), "content"),
        bound(s, d, "documents").select((c("doc_id") % 40).alias("id")).distinct().select(F.concat(F.lit("Item"), c("id") % 20).alias("name"), F.when(c("id") < 20, F.concat(F.lit("acme_lib.x.Item"), c("id") % 20)).otherwise(F.concat(F.lit("other_lib.Item"), c("id") % 20)).alias("qualified_name"), (c("id") < 20).alias("own"), c("id").alias("ord")),
        "python", F.lit("acme"),
    )
)

REQUEST = """SELECT ord AS request_id, package || '/' || name AS path, name || 'q' AS name, package, language AS source_language, CASE WHEN ord % 10 = 0 THEN 'go' WHEN eco = 'py' THEN 'javascript' ELSE 'python' END AS target_language, kind FROM {latest}"""


def requests(s, d):
    return s.sql(REQUEST, latest=bound(s, d, "latest"))


def mappings(s, d):
    r = requests(s, d)
    table = lambda kind, source, cond, target: r.filter(cond).select("source_language", "target_language", F.lit(kind).alias("kind"), c(source).alias("source"), target.alias("target"))
    paths = table("path", "path", "request_id % 11 = 0", F.concat(F.lit("mapped/"), "request_id"))
    aliases = table("alias", "name", "request_id % 7 = 0", F.concat(F.lit("Alias"), "request_id"))
    packs = table("package", "package", "package > 'brand_2'", F.concat(F.lit("eq-"), "package"))
    return paths.unionByName(aliases).unionByName(packs).distinct()


def targets(s, d):
    """Pages in the other language: the same words in the other convention, longer names, and aliases."""
    r = requests(s, d).filter("request_id % 3 <> 0")
    other = F.when(c("source_language") == "python", F.replace(c("name"), F.lit("_"), F.lit(""))).otherwise(F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1_$2")))
    title = F.when(c("request_id") % 3 == 1, other).otherwise(F.concat(other, F.lit("_x")))
    same = r.select(c("target_language").alias("language"), F.lit("p").alias("package"), title.alias("title"), F.concat(F.lit("/t/"), "request_id").alias("url"))
    alias = requests(s, d).filter("request_id % 14 = 0").select(c("target_language").alias("language"), F.lit("p").alias("package"), F.concat(F.lit("Alias"), "request_id").alias("title"), F.concat(F.lit("/a/"), "request_id").alias("url"))
    return same.unionByName(alias)


REQ = f"{LATEST}, req AS ({REQUEST.format(latest='latest')})"
query("explicit_mapping", f"{REQ} SELECT request_id, CASE WHEN request_id % 11 = 0 THEN 'mapped/' || CAST(request_id AS VARCHAR) END AS mapped FROM req")(lambda s, d: X.explicit_mapping(requests(s, d), mappings(s, d)).select("request_id", "mapped"))
query("symbol_alias", f"{REQ} SELECT request_id, CASE WHEN request_id % 7 = 0 THEN 'Alias' || CAST(request_id AS VARCHAR) END AS alias FROM req")(lambda s, d: X.symbol_alias(requests(s, d), mappings(s, d)).select("request_id", "alias"))
query("equivalent_package", f"{REQ} SELECT request_id, CASE WHEN package > 'brand_2' THEN 'eq-' || package END AS equivalent FROM req")(lambda s, d: X.equivalent_package(requests(s, d), mappings(s, d)).select("request_id", "equivalent"))
LEN = "length(replace(name, '_', ''))"  # of a name that ends in q, so that no number is the beginning of another
query("resolve_cross_language", f"""{REQ}, j AS (SELECT *, request_id % 3 <> 0 AND (request_id % 3 = 1 OR 0.5 + 0.2 * {LEN} / ({LEN} + 1.0) >= 0.6) AS hit FROM req)
  SELECT request_id, CASE WHEN target_language = 'go' THEN 'language' WHEN request_id % 11 = 0 THEN 'explicit' WHEN request_id % 14 = 0 THEN 'alias' WHEN hit THEN CASE WHEN request_id % 3 = 1 THEN 'normalized' ELSE 'fuzzy' END WHEN package > 'brand_2' THEN 'package' ELSE 'language' END AS match_type,
    CASE WHEN target_language = 'go' THEN '/go' WHEN request_id % 11 = 0 THEN '/' || target_language || '/mapped/' || CAST(request_id AS VARCHAR) WHEN request_id % 14 = 0 THEN '/a/' || CAST(request_id AS VARCHAR) WHEN hit THEN '/t/' || CAST(request_id AS VARCHAR)
      WHEN package > 'brand_2' THEN '/' || target_language || '/eq-' || package ELSE '/' || target_language END AS url,
    CASE WHEN target_language = 'go' THEN 0 WHEN request_id % 11 = 0 THEN 1 WHEN request_id % 14 = 0 THEN 0.98 WHEN hit THEN CASE WHEN request_id % 3 = 1 THEN 0.95 ELSE round(0.5 + 0.2 * {LEN} / ({LEN} + 1.0), 6) END ELSE 0 END::DOUBLE AS score FROM j""")(
    lambda s, d: X.resolve_cross_language(requests(s, d), targets(s, d), mappings(s, d)).withColumn("score", F.round("score", 6))
)
