"""Queries for column functions on names, paths and URLs, each over a whole bound table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.functions import names as N
from symloom.plans.bindings import bound, with_tables
from symloom.plans.registry import query


def scalar(name: str, table: str, key: str, make: Callable[[], Column], sql: str | None) -> None:
    """Register key and value of a column function over a bound table."""
    oracle = None if sql is None else f"{with_tables(table)} SELECT {key} AS k, {sql} AS value FROM {table}"
    query(name, oracle)(lambda spark, sf: bound(spark, sf, table).select(F.expr(key).alias("k"), make().alias("value")))


c = F.col
FLAT = "package_id || '/' || version || '/' || qualified_name"
URLS = "CAST(event_id AS STRING)"

scalar("symbol_id", "flat", FLAT, lambda: N.symbol_id(F.when(c("ord") % 5 == 0, "go").otherwise(c("language")), c("kind"), c("qualified_name"), c("package_id")),
    """CASE WHEN ord % 5 = 0 THEN package_id || ':' || replace(qualified_name, '.', '_')
       WHEN language = 'python' THEN 'sym_py_' || kind || '_' || replace(qualified_name, '.', '_') || '_' || substr(md5(qualified_name), 1, 8)
       ELSE 'sym_ts_' || kind || '_' || regexp_replace(qualified_name, '[^a-zA-Z0-9]', '_', 'g') END""")
scalar("package_id", "flat", FLAT, lambda: N.package_id(F.concat(F.lit("@acme/"), c("package"), F.lit(".x-y")), c("language")),
    "CASE WHEN language = 'python' THEN 'pkg_py_' ELSE 'pkg_js_' END || regexp_replace('acme/' || package || '.x-y', '[./-]', '_', 'g')")
scalar("package_name_from_id", "flat", FLAT, lambda: N.package_name_from_id(c("package_id"), ("brand",)),
    "CASE WHEN eco = 'js' THEN '@brand/' || replace(substr(package, 7), '_', '-') ELSE replace(package, '_', '-') END")
scalar("ecosystem_from_id", "flat", FLAT, lambda: N.ecosystem_from_id(F.when(c("ord") % 3 == 0, F.lit("other")).otherwise(c("package_id"))), "CASE WHEN ord % 3 = 0 THEN 'javascript' ELSE language END")
scalar("infer_stability", "flat", FLAT, lambda: N.infer_stability(F.when(c("ord") % 3 == 0, F.concat(F.lit("Experimental "), c("summary"))).when(c("ord") % 3 == 1, F.concat(F.lit("In BETA. "), c("summary"))), c("deprecated")),
    "CASE WHEN deprecated THEN 'deprecated' WHEN ord % 3 = 0 THEN 'experimental' WHEN ord % 3 = 1 THEN 'beta' ELSE 'stable' END")
scalar("infer_stability_tags", "flat", FLAT, lambda: N.infer_stability(c("summary"), c("deprecated"), F.when(c("ord") % 4 == 0, F.array(F.lit("@beta"), F.lit("@experimental"))).when(c("ord") % 4 == 1, F.array(F.lit("@deprecated"), F.lit("@beta"))).when(c("ord") % 4 == 2, F.array(F.lit("@beta")))),
    "CASE ord % 4 WHEN 0 THEN 'experimental' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'beta' ELSE 'stable' END")
scalar("normalize_source_path", "flat", FLAT, lambda: N.normalize_source_path(c("source_path")),
    r"""CASE WHEN regexp_matches(source_path, '/extracted/(?:libs/)?([^/]+)/(.+)$') THEN regexp_extract(source_path, '/extracted/(?:libs/)?([^/]+)/(.+)$', 2)
        WHEN regexp_matches(source_path, '^(?:\.\./)*src/(.+)$') THEN 'src/' || regexp_extract(source_path, '^(?:\.\./)*src/(.+)$', 1)
        WHEN regexp_matches(source_path, '/src/(.+)$') THEN 'src/' || regexp_extract(source_path, '/src/(.+)$', 1)
        WHEN substr(source_path, 1, 1) <> '/' AND substr(source_path, 1, 2) <> '..' THEN source_path ELSE split_part(source_path, '/', -1) END""")
scalar("clean_source_path", "flat", FLAT, lambda: N.clean_source_path(F.concat(F.lit("/b/extracted/"), c("eco"), F.lit("/"), c("eco"), F.lit("/./"), c("name")), F.when(c("ord") % 2 == 0, "libs/x/")),
    "CASE WHEN ord % 2 = 0 THEN 'libs/x/' ELSE '' END || eco || '/./' || name")
scalar("effective_version", "flat", FLAT,
    lambda: N.effective_version(F.when(c("ord") % 4 == 0, "metadata.version(__package__)").when(c("ord") % 4 == 1, F.lit(None)).when(c("ord") % 4 == 2, F.concat(c("version"), F.lit("-beta.1"))).otherwise(c("version")), F.when(c("ord") % 3 != 0, "9.9.9")),
    "CASE ord % 4 WHEN 2 THEN version || '-beta.1' WHEN 3 THEN version ELSE CASE WHEN ord % 3 <> 0 THEN '9.9.9' ELSE 'unknown' END END")
scalar("type_from_signature", "flat", FLAT, lambda: N.type_from_signature(c("signature"), c("kind")),
    r"nullif(CASE WHEN kind IN ('function', 'method', 'constructor') THEN regexp_extract(signature, '\):\s*(.+)$', 1) ELSE regexp_extract(signature, ':\s*(.+)$', 1) END, '')")
scalar("slug_package", "flat", FLAT, lambda: N.slug_package(F.concat(F.lit("@Acme/"), c("package"))), "'acme-' || replace(package, '_', '-')")
scalar("unslug_package", "flat", FLAT, lambda: N.unslug_package(F.concat(F.lit("acme-"), F.replace(c("package"), F.lit("_"), F.lit("-"))), c("language"), ("acme",)),
    "CASE WHEN eco = 'js' THEN '@acme/' || replace(package, '_', '-') ELSE 'acme_' || package END")
scalar("slug_symbol_path", "flat", FLAT, lambda: N.slug_symbol_path(F.concat(c("qualified_name"), F.lit("<T[]>")), c("language") == "python"),
    r"replace(CASE WHEN language = 'python' THEN regexp_replace(qualified_name, '^[^.]*\.', '') ELSE qualified_name END, '.', '/') || 'T'")
scalar("symbol_url", "flat", FLAT, lambda: N.symbol_url(c("language"), c("package"), c("qualified_name")),
    r"""'/' || language || '/' || replace(package, '_', '-') || '/' || replace(CASE WHEN language = 'python' AND contains(split_part(qualified_name, '.', 1), '_') OR split_part(qualified_name, '.', 1) = package
        THEN regexp_replace(qualified_name, '^[^.]*\.', '') ELSE qualified_name END, '.', '/')""")
scalar("parse_symbol_url", "requests", URLS, lambda: F.concat_ws("|", *[N.parse_symbol_url(c("path"))[f] for f in ("language", "package_slug", "symbol_path", "symbol_name", "parent_path")]),
    "split_part(path, '/', 2) || '|' || split_part(path, '/', 3) || '|' || split_part(path, '/', 4) || '|' || split_part(path, '/', 4) || '|'")
scalar("breadcrumbs", "flat", FLAT, lambda: F.array_join(N.breadcrumbs(c("package"), c("qualified_name")), ">"), r"regexp_replace(package || '>' || replace(qualified_name, '.', '>'), '>[^>]*$', '')")
scalar("url_language", "flat", FLAT, lambda: N.url_language(F.when(c("eco") == "js", "typescript").otherwise("python")), "language")
scalar("source_language", "flat", FLAT, lambda: N.source_language(c("language")), "CASE WHEN eco = 'js' THEN 'typescript' ELSE language END")
scalar("page_type", "flat", FLAT, lambda: N.page_type(c("kind")), "CASE kind WHEN 'method' THEN 'function' WHEN 'typeAlias' THEN 'type' WHEN 'parameter' THEN 'module' ELSE kind END")
scalar("kind_label", "flat", FLAT, lambda: N.kind_label(c("kind")), "CASE kind WHEN 'typeAlias' THEN 'Type' ELSE upper(substr(kind, 1, 1)) || substr(kind, 2) END")
scalar("source_link", "flat", FLAT, lambda: N.source_link(F.lit("acme/repo"), F.md5("package_id"), c("source_path"), F.when(c("ord") % 2 == 0, c("ord"))),
    "CASE WHEN contains(source_path, 'node_modules/') THEN NULL ELSE 'https://github.com/acme/repo/blob/' || md5(package_id) || '/' || source_path || CASE WHEN ord % 2 = 0 THEN '#L' || CAST(ord AS VARCHAR) ELSE '' END END")
scalar("path_for_version", "flat", FLAT, lambda: N.path_for_version(F.lit("libs/main"), F.create_map(F.lit("1.2.x"), F.lit("old/two"), F.lit("1.5.0"), F.lit("old/five"), F.lit("0.x"), F.lit("old/zero")), c("version")),
    "CASE minor WHEN 2 THEN 'old/two' WHEN 5 THEN 'old/five' ELSE 'libs/main' END")
scalar("build_id", "flat", FLAT, lambda: N.build_id(F.lit("acme/repo"), F.md5("version"), c("package")), """substr(sha256('{"repo":"acme/repo","sha":"' || md5(version) || '","packageName":"' || package || '"}'), 1, 16)""")
scalar("camel_to_snake", "flat", FLAT, lambda: N.camel_to_snake(c("name")), r"lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'))")
scalar("snake_to_camel", "flat", FLAT, lambda: N.snake_to_camel(c("name")),
    "CASE WHEN eco = 'js' THEN name ELSE split_part(name, '_', 1) || upper(substr(split_part(name, '_', 2), 1, 1)) || substr(split_part(name, '_', 2), 2) || '_' || split_part(name, '_', 3) END")
scalar("word_parts", "flat", FLAT, lambda: F.array_join(N.word_parts(c("name")), ","), r"array_to_string(list_filter(string_split(lower(regexp_replace(name, '([A-Z])', '_\1', 'g')), '_'), lambda p: p <> ''), ',')")
TERMS = r"list_sort(list_distinct(list_concat([lower({0})], list_filter(list_concat(string_split(lower(regexp_replace({0}, '([A-Z])', '~\1', 'g')), '~'), string_split(lower({0}), '_')), lambda p: p <> ''))))"
scalar("normalize_name", "flat", FLAT, lambda: F.concat_ws("|", N.normalized_name(c("name")), F.array_join(F.sort_array(N.search_terms(c("name"))), ",")), f"lower(replace(name, '_', '')) || '|' || array_to_string({TERMS.format('name')}, ',')")
scalar("match_score", "flat", FLAT,
    lambda: F.round(N.match_score(c("name"), F.when(c("ord") % 4 == 0, c("name")).when(c("ord") % 4 == 1, F.upper("name")).when(c("ord") % 4 == 2, F.concat(c("name"), F.lit("_more"))).otherwise("small_gear_x")), 6),
    f"""round(CASE ord % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.5 + 0.2 * length(replace(name, '_', '')) / (length(replace(name, '_', '')) + 4.0)
        ELSE CASE WHEN contains(lower(replace(name, '_', '')), 'smallgearx') THEN 0 ELSE 0.5 * len(list_intersect({TERMS.format('name')}, ['small_gear_x', 'small', 'gear', 'x'])) / greatest(len({TERMS.format('name')}), 4) END END, 6)""")
scalar("project_of_package", "flat", FLAT, lambda: N.project_of_package(c("package"), [("brand_1[0-4]$", "special"), ("brand_1", "teen"), ("^brand_2", "twenty")], "base"),
    "CASE WHEN regexp_matches(package, 'brand_1[0-4]$') THEN 'special' WHEN contains(package, 'brand_1') THEN 'teen' WHEN contains(package, 'brand_2') THEN 'twenty' ELSE 'base' END")
scalar("package_of_qualified_name", "flat", FLAT, lambda: N.package_of_qualified_name(c("qualified_name"), c("language"), F.lit("fallback")), "CASE WHEN language = 'python' THEN split_part(qualified_name, '.', 1) ELSE 'fallback' END")
scalar("js_to_python_package", "flat", FLAT, lambda: N.js_to_python_package(F.concat(F.lit("@acme/"), c("package"), F.lit("-x"))), "'acme_' || package || '_x'")
scalar("slug_heading", "documents", "CAST(doc_id AS STRING)", lambda: N.slug_heading(c("text")),
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')")
scalar("slug_heading_whole", "documents", "CAST(doc_id AS STRING)", lambda: N.slug_heading(c("text")),
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')")
scalar("first_sentence", "flat", FLAT, lambda: N.first_sentence(c("summary")), "regexp_extract(summary, '^(.*?[.!?])\\s', 1)")
scalar("first_sentence_listing", "documents", "CAST(doc_id AS STRING)", lambda: N.first_sentence(c("text"), "listing"),
    r"""(SELECT CASE WHEN length(w) > 150 THEN substr(w, 1, 147) || '...' ELSE w END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(text, '\.\s[\s\S]*$', '.'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS w))""")
scalar("doc_url", "doc_files", "CAST(doc_id AS STRING)", lambda: N.doc_url(c("path"), F.lit("python"), ("acme",)),
    r"""(SELECT '/' || CASE WHEN starts_with(p, 'oss/acme/') THEN 'oss/python/' || substr(p, 5) WHEN p = 'oss/acme' THEN 'oss/python/acme' ELSE p END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\.mdx?$', ''), '/index$', '') AS p))""")
