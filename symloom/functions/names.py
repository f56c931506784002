"""Column functions on symbol names, package ids, paths and URLs. Null in, null out unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names in URLs and in sources, id prefixes, page types and labels of symbol kinds.
ECOSYSTEMS = {"python": "py", "javascript": "js", "typescript": "js", "java": "java", "go": "go"}
PAGE_TYPES = {"class": "class", "function": "function", "method": "function", "interface": "interface", "typeAlias": "type", "alias": "type", "enum": "enum", "variable": "variable", "attribute": "variable"}
KIND_LABELS = {
    "module": "Module", "class": "Class", "function": "Function", "method": "Method", "property": "Property", "attribute": "Attribute", "variable": "Variable", "interface": "Interface",
    "typeAlias": "Type", "enum": "Enum", "namespace": "Namespace", "constructor": "Constructor", "enumMember": "Enum Member", "parameter": "Parameter",
}


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def _matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def symbol_id(language: Column, kind: Column, path: Column, package: Column) -> Column:
    dotted = F.replace(path, F.lit("."), F.lit("_"))
    return (
        F.when(language == "python", F.concat(F.lit("sym_py_"), kind, F.lit("_"), dotted, F.lit("_"), F.substring(F.md5(path), 1, 8)))
        .when(language.isin("javascript", "typescript"), F.concat(F.lit("sym_ts_"), kind, F.lit("_"), F.regexp_replace(path, "[^a-zA-Z0-9]", "_")))
        .otherwise(F.concat(package, F.lit(":"), dotted))
    )


def package_id(name: Column, language: Column) -> Column:
    prefix = _lookup(ECOSYSTEMS, language, language)
    return F.concat(F.lit("pkg_"), prefix, F.lit("_"), F.regexp_replace(F.regexp_replace(name, "^@", ""), "[./-]", "_"))


def ecosystem_from_id(ident: Column) -> Column:
    code = F.regexp_extract(ident, "^pkg_(py|js|java|go)_", 1)
    return F.when(code == "py", "python").when(code == "java", "java").when(code == "go", "go").otherwise("javascript")


def package_name_from_id(ident: Column, scopes: tuple[str, ...] = ()) -> Column:
    """Published name of an id; JavaScript names of the given scopes get their @scope/ back."""
    base = F.regexp_replace(ident, "^pkg_(py|js|java|go)_", "")
    plain = F.replace(base, F.lit("_"), F.lit("-"))
    scope = F.substring_index(base, "_", 1)
    rest = F.replace(F.regexp_replace(base, "^[^_]*_", ""), F.lit("_"), F.lit("-"))
    scoped = ident.startswith("pkg_js_") & scope.isin(*scopes) & base.contains("_")
    return F.when(scoped, F.concat(F.lit("@"), scope, F.lit("/"), rest)).otherwise(plain)


def infer_stability(text: Column, deprecated: Column, tags: Column | None = None) -> Column:
    """deprecated, experimental, beta or stable; with block tags (array of names like ``@beta``) by these alone."""
    if tags is not None:
        has = lambda name: F.coalesce(F.array_contains(tags, F.lit(f"@{name}")), F.lit(False))
        return F.when(has("deprecated"), "deprecated").when(has("experimental"), "experimental").when(has("beta"), "beta").otherwise("stable")
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(deprecated, "deprecated").when(low.contains("experimental"), "experimental").when(low.contains("beta"), "beta").otherwise("stable")


def normalize_source_path(path: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    within = F.concat(F.lit("src/"), _matched(p, r"^(?:\.\./)*src/(.+)$"))
    inside = F.concat(F.lit("src/"), _matched(p, r"/src/(.+)$"))
    relative = F.when(~p.startswith("/") & ~p.startswith(".."), p)
    return F.coalesce(_matched(p, r"/extracted/(?:libs/)?([^/]+)/(.+)$", 2), within, inside, relative, F.regexp_replace(p, "^.*/", ""))


def clean_source_path(path: Column, prefix: Column) -> Column:
    """Path below the extraction folder, without a doubled package folder or leading ``./``, joined to ``prefix``."""
    below = F.regexp_replace(path, "^.*/extracted/", "")
    once = F.regexp_replace(F.regexp_replace(below, r"^([^/]+)/\1/", "$1/"), r"^(\./)+", "")
    return F.when(F.coalesce(prefix, F.lit("")) == "", once).otherwise(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), once))


def effective_version(version: Column, latest: Column) -> Column:
    code = version.rlike(r"(?i)metadata\.version|importlib|get_distribution") | version.rlike(r"\(__\w+__\)|VERSION\b|pkg_resources")
    valid = version.rlike(r"^\d+(\.\d+)*(-[\w.]+)?(\+[\w.]+)?\z") & ~code
    return F.coalesce(F.when(valid, version), latest, F.lit("unknown"))


def type_from_signature(signature: Column, kind: Column) -> Column:
    call = kind.isin("function", "method", "constructor")
    return F.nullif(F.when(call, F.regexp_extract(signature, r"\):\s*(.+)$", 1)).otherwise(F.regexp_extract(signature, r":\s*(.+)$", 1)), F.lit(""))


def slug_package(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^@", ""), "[/_]", "-"))


def unslug_package(slug: Column, language: Column, scopes: tuple[str, ...] = ()) -> Column:
    scope = F.substring_index(slug, "-", 1)
    scoped = language.isin("javascript", "typescript") & scope.isin(*scopes) & slug.contains("-")
    return (
        F.when(scoped, F.concat(F.lit("@"), scope, F.lit("/"), F.regexp_replace(slug, "^[^-]*-", "")))
        .when(language.isin("javascript", "typescript", "java", "go"), slug)
        .otherwise(F.replace(slug, F.lit("-"), F.lit("_")))
    )


def slug_symbol_path(name: Column, has_prefix: Column) -> Column:
    clean = F.regexp_replace(name, r"[\[\]<>]", "")
    drop = has_prefix & clean.contains(".")
    return F.replace(F.when(drop, F.regexp_replace(clean, r"^[^.]*\.", "")).otherwise(clean), F.lit("."), F.lit("/"))


def url_language(language: Column) -> Column:
    return F.when(language == "typescript", "javascript").otherwise(language)


def source_language(language: Column) -> Column:
    return F.when(language == "javascript", "typescript").otherwise(language)


def symbol_url(language: Column, package: Column, name: Column) -> Column:
    head = F.concat(F.lit("/"), url_language(language), F.lit("/"), slug_package(package))
    first = F.substring_index(name, ".", 1)
    own = F.lower(F.regexp_replace(F.regexp_replace(package, "^@", ""), "[/-]", "_"))
    prefixed = (F.lower(F.replace(first, F.lit("-"), F.lit("_"))) == own) | ((language == "python") & first.contains("_"))
    path = slug_symbol_path(name, prefixed)
    return F.when(F.coalesce(path, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("/"), path))


def parse_symbol_url(url: Column) -> Column:
    """Struct: language (javascript if unknown), package_slug, symbol_path, symbol_name, parent_path."""
    parts = F.split(F.regexp_replace(url, "^/", ""), "/")
    path = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    first = F.get(parts, F.lit(0))
    return F.struct(
        F.when(first.isin("python", "java", "go"), first).otherwise("javascript").alias("language"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("package_slug"),
        F.array_join(path, "/").alias("symbol_path"),
        F.coalesce(F.get(path, F.size(path) - 1), F.lit("")).alias("symbol_name"),
        F.array_join(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), "/").alias("parent_path"),
    )


def breadcrumbs(display: Column, name: Column) -> Column:
    parts = F.split(name, "[./]")
    return F.concat(F.array(display), F.slice(parts, 1, F.size(parts) - 1))


def page_type(kind: Column) -> Column:
    return _lookup(PAGE_TYPES, kind, F.lit("module"))


def kind_label(kind: Column) -> Column:
    return _lookup(KIND_LABELS, kind, kind)


def source_link(repo: Column, sha: Column, path: Column, line: Column) -> Column:
    """Link to a file at a commit on the code host; null for paths that are empty or of installed packages."""
    link = F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), sha, F.lit("/"), path)
    shown = F.when(line.isNotNull(), F.concat(link, F.lit("#L"), line.cast("string"))).otherwise(link)
    return F.when((F.coalesce(path, F.lit("")) != "") & ~path.contains("node_modules/"), shown)


def path_for_version(path: Column, overrides: Column, version: Column) -> Column:
    """First override in order: ``0.x`` and ``0.1.x`` match as prefixes, others exactly; else ``path``."""
    fits = lambda e: F.when(e["key"].endswith(".x"), version.startswith(F.regexp_replace(e["key"], "x$", ""))).otherwise(version == e["key"])
    return F.coalesce(F.get(F.filter(F.map_entries(overrides), fits), F.lit(0))["value"], path)


def build_id(repo: Column, sha: Column, package: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(repo.alias("repo"), sha.alias("sha"), package.alias("packageName"))), 256), 1, 16)


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def snake_to_camel(name: Column) -> Column:
    parts = F.split(name, "_")
    joined = lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(F.concat(F.lit("_"), p))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), joined), ""))


def camel_parts(name: Column) -> Column:
    return F.split(name, "(?=[A-Z])")


def word_parts(name: Column) -> Column:
    lowered = F.transform(F.split(F.regexp_replace(name, "([A-Z])", "_$1"), "_"), F.lower)
    return F.filter(lowered, lambda p: p != "")


def normalized_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def search_terms(name: Column) -> Column:
    parts = F.transform(F.array_union(camel_parts(name), F.split(name, "_")), F.lower)
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.filter(parts, lambda p: p != "")))


def match_score(source: Column, target: Column) -> Column:
    """1 if equal, 0.95 if equal but for case and underscores, 0.5 to 0.7 if one holds the other, else word overlap."""
    a, b = normalized_name(source), normalized_name(target)
    x, y = search_terms(source), search_terms(target)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    overlap = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when(source == target, 1.0).when(a == b, 0.95).when(F.contains(a, b) | F.contains(b, a), 0.5 + ratio * 0.2).otherwise(overlap * 0.5)


def project_of_package(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The project of the first rule (regular expression, project) that fits."""
    return reduce(lambda rest, rule: F.when(name.rlike(rule[0]), rule[1]).otherwise(rest), reversed(rules), F.lit(default))


def package_of_qualified_name(name: Column, language: Column, fallback: Column, known: tuple[str, ...] = ()) -> Column:
    first = F.substring_index(name, ".", 1)
    return F.when((language == "python") & (first.contains("_") | first.isin(*known)), first).otherwise(fallback)


def js_to_python_package(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("@"), F.lit("")), "[/-]", "_")


def slug_heading(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def first_sentence(doc: Column, style: str = "go") -> Column:
    """go: the first line's first sentence; java: tags go first; listing: squeezed, at most 150 characters."""
    if style == "listing":
        whole = trim_all(F.regexp_replace(F.regexp_replace(doc, r"\.\s[\s\S]*$", "."), r"\s+", " "))
        return F.when(F.length(whole) > 150, F.concat(F.substring(whole, 1, 147), F.lit("..."))).otherwise(whole)
    text = F.regexp_replace(doc, "<[^>]*>", "") if style == "java" else doc
    line = F.substring_index(text, "\n", 1)
    return F.coalesce(_matched(line, r"^(.*?[.!?])\s"), line)


def doc_url(path: Column, language: Column, products: tuple[str, ...] = ()) -> Column:
    """Page URL of a file: without src/, extension and /index; the language is put after oss/ for the products."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.mdx?$", ""), "/index$", "")
    product = F.regexp_extract(p, "^oss/([^/]+)", 1)
    return F.concat(F.lit("/"), F.when(product.isin(*products), F.concat(F.lit("oss/"), language, F.lit("/"), F.regexp_replace(p, "^oss/", ""))).otherwise(p))


#: Lengths of the parts by which names meet: a name's own parts have the greatest of these that it reaches.
PART_LENGTHS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def _parts(name: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: name.substr(i, n))
    return F.when(F.length(name) >= n, every).otherwise(F.array().cast("array<string>"))


def name_parts(name: Column, lengths: tuple[int, ...] = PART_LENGTHS) -> Column:
    """All distinct substrings of these lengths."""
    return F.array_distinct(F.concat(*[_parts(name, n) if n else F.array(F.lit("")) for n in lengths]))


def part_length(name: Column) -> Column:
    """The length of a name's own parts; null for a null name."""
    return F.when(name.isNotNull(), F.greatest(*[F.when(F.length(name) >= n, n) for n in PART_LENGTHS], F.lit(0)))


def own_parts(name: Column) -> Column:
    """The parts that any name holding this one has: all of the greatest length of ``PART_LENGTHS`` that it reaches."""
    return F.when(name == "", F.array(F.lit(""))).otherwise(F.array_distinct(_parts(name, part_length(name))))
