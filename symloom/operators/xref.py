"""Cross-reference joins: type links, base classes, inherited members, path lookups, equivalents in other languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import names as N
from symloom.operators.artifacts import first_row
from symloom.operators.substrings import holding
from symloom.plans.lineage import cut

# Folders named by symbol kind that may begin a path, and names that are no links in type annotations.
KIND_PREFIXES = ("modules", "classes", "functions", "interfaces", "types", "enums", "variables", "methods", "properties", "namespaces")
BUILTIN_TYPES = ("str", "int", "float", "bool", "bytes", "list", "dict", "set", "tuple", "None", "Any", "Optional", "Union", "List", "Dict", "string", "number", "boolean", "void", "null", "undefined", "any", "unknown", "never", "object", "Promise", "Array", "Record")


def _page_url(language: Column, package: Column, name: Column) -> Column:
    prefixed = (language == "python") & name.contains("_")
    return F.concat(F.lit("/"), language, F.lit("/"), N.slug_package(package), F.lit("/"), N.slug_symbol_path(name, prefixed))


def type_url_map(routing: DataFrame, packages: DataFrame) -> DataFrame:
    """(language, name, url): each name's page in the first package, by package order and file order, that has it."""
    linked = routing.filter(~F.col("kind").isin("module", "parameter", "constructor")).join(packages.select("package_id", "published_name", "language", F.col("ord").alias("package_ord")), "package_id")
    url = _page_url(F.col("language"), F.col("published_name"), F.col("qualified_name"))
    return linked.groupBy("language", F.col("title").alias("name")).agg(F.min_by(url, F.struct("package_ord", "ord", "qualified_name")).alias("url"))


def type_url_map_excluding(urls: DataFrame, package_slug: Column, local_names: DataFrame) -> DataFrame:
    """The map without names of the own package and without its pages."""
    own = F.concat(F.lit("/"), F.col("language"), F.lit("/"), package_slug, F.lit("/"))
    return urls.join(local_names.select("name").distinct(), "name", "left_anti").filter(~F.startswith(F.col("url"), own))


def resolve_type_refs(refs: DataFrame, packages: DataFrame, routing: DataFrame) -> DataFrame:
    """refs (ref_id, name, qualified_name) with the page of the first package, by prefix length 1 to 3, that knows the name."""
    parts = F.split("qualified_name", r"\.")
    longest = F.least(F.size(parts) - 1, F.lit(3))
    lengths = F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda i: i <= longest)
    tries = refs.select("ref_id", "name", F.explode(F.transform(lengths, lambda i: F.struct(i.alias("length"), F.array_join(F.slice(parts, 1, i), "_").alias("prefix")))).alias("t")).select("ref_id", "name", "t.*")
    module = F.regexp_replace(F.regexp_replace("published_name", "^@", ""), "[/-]", "_")
    known = routing.join(packages.select("package_id", "published_name", "language", module.alias("prefix")), "package_id")
    known = known.groupBy("prefix", F.col("title").alias("name")).agg(F.max_by(_page_url(F.col("language"), F.col("prefix"), F.col("qualified_name")), F.struct("ord", "qualified_name")).alias("url"))
    found = tries.join(known, ["prefix", "name"]).groupBy("ref_id").agg(F.min_by("url", "length").alias("url"))
    return refs.join(found, "ref_id", "left")


def extract_type_refs(symbols: DataFrame, builtins: tuple[str, ...] = BUILTIN_TYPES) -> DataFrame:
    """(package_id, version, symbol, name, qualified_name): type names in parameters, return and bases, each once.

    The qualified name is that of the last member of that name in the nearest scope that encloses the symbol.
    """
    texts = F.concat(F.transform("params", lambda p: F.coalesce(p["type"], F.lit(""))), F.array(F.coalesce("returns_type", F.lit(""))), F.coalesce("extends", F.array()))
    found = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1))))
    kept = F.filter(found, lambda n: ~n.isin(*builtins) & ~(n.startswith("_") & (F.col("language") != "python")))
    refs = symbols.select("package_id", "version", F.col("qualified_name").alias("symbol"), F.explode(kept).alias("name"))
    scope = symbols.select("package_id", "version", F.regexp_replace("qualified_name", r"\.?[^.]*$", "").alias("scope"), "name", "qualified_name")
    parts = F.split("symbol", r"\.")
    scopes = refs.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    near = scopes.join(scope, ["package_id", "version", "scope", "name"]).groupBy("package_id", "version", "symbol", "name").agg(F.max_by("qualified_name", F.length("scope")).alias("qualified_name"))
    return refs.join(near, ["package_id", "version", "symbol", "name"], "left")


def simple_base(base: Column) -> Column:
    """A base's bare name: without generics and path."""
    return F.element_at(F.split(F.regexp_replace(base, r"[<\[(][\s\S]*$", ""), "[./]"), -1)


def resolve_bases(bases: DataFrame, symbols: DataFrame, candidates: DataFrame) -> DataFrame:
    """bases (package_id, class_name, base) with the class or interface meant: of the own package, else of a candidate's.

    Names and last segments of qualified names are compared; candidates (package_id, rank) come in their order. The
    best type of each name, in each package and over all candidates, is found before any class meets it.
    """
    wanted = bases.withColumn("simple", simple_base(F.col("base")))
    types = symbols.filter(F.col("kind").isin("class", "interface")).select("package_id", "qualified_name", "ord", F.explode(F.array_distinct(F.array("name", simple_base(F.col("qualified_name"))))).alias("simple"))
    first = lambda *order: F.min(F.struct(*order, "qualified_name", "package_id"))
    own = types.groupBy("package_id", "simple").agg(first("ord").alias("own"))
    other = types.join(candidates.select("package_id", "rank"), "package_id").groupBy("simple").agg(first("rank", "ord").alias("other"))
    met = wanted.join(own, ["package_id", "simple"], "left").join(other, "simple", "left")
    pick = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"other.{c}"))
    return met.select(*bases.columns, pick("package_id").alias("base_package"), pick("qualified_name").alias("base_name"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(child, base, depth) of all direct and indirect bases, each once at its least depth; cycles end by themselves.

    Paths double: each round joins the pairs known so far, all of depth up to n, with those of depth n exactly, and
    keeps the least depth of each pair, so that chains of n levels take about log n rounds. An edge to itself, or with
    a null end, stays as it is and leads nowhere.
    """
    known = edges.select("child", "base").distinct().withColumn("depth", F.lit(1))
    known, reach = cut(known), 1
    while True:
        far = known.filter(F.col("depth") == reach).select("child", F.col("base").alias("via"), F.col("depth").alias("first"))
        if far.isEmpty():
            return known
        near = known.select(F.col("child").alias("via"), "base", F.col("depth").alias("rest"))
        longer = far.join(near, "via").filter(F.col("child") != F.col("base")).select("child", "base", (F.col("first") + F.col("rest")).alias("depth"))
        known, reach = cut(known.unionByName(longer).groupBy("child", "base").agg(F.min("depth").alias("depth"))), 2 * reach


def inherited_members(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(class_name, base, depth, name): members (owner, name, kind, visibility) of all bases but own, private and constructor ones."""
    taken = members.filter((F.col("kind") != "constructor") & (F.coalesce("visibility", F.lit("public")) != "private") & ~F.col("name").rlike(r"[\[\]]"))
    joined = ancestors(edges).select(F.col("child").alias("class_name"), "base", "depth").join(taken.select(F.col("owner").alias("base"), "name"), "base")
    return joined.join(members.select(F.col("owner").alias("class_name"), "name").distinct(), ["class_name", "name"], "left_anti")


def member_details(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """members (package_id, owner, name, kind, ref_id) with the symbol of that id, else of that name and kind in the package."""
    by_id = symbols.select("package_id", F.col("id").alias("ref_id"), F.col("signature").alias("by_id"))
    by_name = symbols.groupBy("package_id", "name", "kind").agg(F.max_by("signature", "ord").alias("by_name"))
    return members.join(by_id, ["package_id", "ref_id"], "left").join(by_name, ["package_id", "name", "kind"], "left").withColumn("signature", F.coalesce("by_id", "by_name")).drop("by_id", "by_name")


def path_variations(path: Column, prefix: Column, python: Column) -> Column:
    """Array of keys to try, in order: the path, without a kind folder, with slashes, underscores, as module/path.Name; each also below the package."""
    dots = lambda p, to: F.replace(p, F.lit("."), F.lit(to))
    bare = F.regexp_extract(path, f"^(?:{'|'.join(KIND_PREFIXES)})\\.(.*)$", 1)
    last = F.concat(dots(F.regexp_replace(path, r"\.[^.]*$", ""), "/"), F.lit("."), F.element_at(F.split(path, r"\."), -1))
    tries = F.array_compact(F.array(path, F.nullif(bare, F.lit("")), F.nullif(dots(bare, "/"), F.lit("")), dots(path, "/"), F.when(python, dots(path, "_")), F.when(path.contains("."), last)))
    return F.flatten(F.transform(tries, lambda p: F.array(p, F.concat(prefix, F.lit("."), p), dots(p, "/"))))


def find_symbols(paths: DataFrame, routing: DataFrame, packages: DataFrame) -> DataFrame:
    """paths (package_id, path) with the id of the first variation that is a routed name."""
    wanted = paths.select("package_id", "path").distinct().join(packages.select("package_id", "published_name"), "package_id")
    tries = wanted.select("package_id", "path", F.posexplode(path_variations(F.col("path"), F.col("published_name"), F.col("package_id").startswith("pkg_py_"))).alias("rank", "qualified_name"))
    hits = tries.join(routing.select("package_id", "qualified_name", "ref_id"), ["package_id", "qualified_name"]).groupBy("package_id", "path").agg(F.min_by(F.struct("ref_id", "qualified_name"), "rank").alias("h"))
    return paths.join(hits.select("package_id", "path", "h.*"), ["package_id", "path"], "left")


def symbol_by_name(requests: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """requests (package, name) with the symbol: by qualified name, then name; packages by published or unslugged name."""
    names = F.array_distinct(F.array("published_name", N.slug_package(F.col("published_name"))))
    known = packages.select("package_id", F.explode(names).alias("package")).distinct()
    wanted = requests.select("package", "name").distinct().join(known, "package")
    keys = symbols.select("package_id", "id", "ord", F.explode(F.array(F.struct(F.col("qualified_name").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("name").alias("key"), F.lit(1).alias("rank")))).alias("k"))
    met = wanted.join(keys.select("package_id", "id", "ord", F.col("k.key").alias("name"), F.col("k.rank").alias("rank")), ["package_id", "name"])
    best = met.groupBy("package", "name").agg(F.min_by("id", F.struct("rank", "ord", "id")).alias("id"))
    return requests.join(best, ["package", "name"], "left")


def resolve_subpage_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """refs (page, package_id, pos, ref) to catalog entries (page, pos, id): exact, suffix, last name, other packages; ids once a page."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    parts = F.split("ref", r"\.")
    wanted = refs.withColumns({"last": last(F.col("ref")), "module": F.when(F.size(parts) > 2, F.get(parts, F.size(parts) - 2))})
    entries = catalog.select(F.col("package_id").alias("entry_package"), "id", "qualified_name", "name", "ord", F.explode(F.array_distinct(F.array(last(F.col("qualified_name")), F.col("name")))).alias("last"))
    met = wanted.join(entries, "last")
    own = F.col("entry_package") == F.col("package_id")
    named = F.col("name") == F.col("last")
    rank = (
        F.when(own & (F.col("qualified_name") == F.col("ref")), 0)
        .when(own & F.endswith(F.col("qualified_name"), F.col("ref")), 1)
        .when(own & named, 2)
        .when(~own & named & F.contains(F.col("qualified_name"), F.concat(F.lit("."), F.col("module"), F.lit("."))), 3)
        .when(~own & named, 4)
    )
    best = first_row(met.withColumn("rank", rank).filter("rank IS NOT NULL"), ["page", "pos"], "rank", "entry_package", "ord", "id")
    return first_row(best, ["page", "id"], "pos").select("page", "pos", "ref", "id", "qualified_name")


def anchor_links(pages: DataFrame, catalog: DataFrame, language: str, package: Column) -> DataFrame:
    """(page, target, qualified_name, url) of every ``[text](#a.b.Name)``: the catalog's entry of that last name, else the target."""
    targets = F.regexp_extract_all("content", F.lit(r"\[[^\]]+\]\(#([a-zA-Z_][a-zA-Z0-9_.]*)\)"), 1)
    links = pages.select("page", package.alias("package"), F.explode(F.filter(targets, lambda t: t.contains("."))).alias("target")).withColumn("name", F.element_at(F.split("target", r"\."), -1))
    entries = catalog.groupBy("name").agg(F.max_by("qualified_name", F.struct("own", "ord")).alias("entry"))
    resolved = links.join(entries, "name", "left").withColumn("qualified_name", F.coalesce("entry", "target"))
    owner = N.package_of_qualified_name(F.col("qualified_name"), F.lit(language), F.col("package"))
    return resolved.select("page", "target", "qualified_name", N.symbol_url(F.lit(language), owner, F.col("qualified_name")).alias("url"))


def _mapped(requests: DataFrame, mappings: DataFrame, kind: str, key: str, out: str) -> DataFrame:
    table = mappings.filter(F.col("kind") == kind).select("source_language", "target_language", F.col("source").alias(key), F.col("target").alias(out))
    return requests.join(table, ["source_language", "target_language", key], "left")


def explicit_mapping(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """requests with ``mapped``: the given equivalent of their path in the target language; null within one language."""
    return _mapped(requests, mappings.filter("source_language <> target_language"), "path", "path", "mapped")


def symbol_alias(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    return _mapped(requests, mappings.filter("source_language <> target_language"), "alias", "name", "alias")


def equivalent_package(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """requests with ``equivalent``: the given equivalent of their package; the package itself within one language."""
    found = _mapped(requests, mappings, "package", "package", "equivalent")
    return found.withColumn("equivalent", F.when(F.col("source_language") == F.col("target_language"), F.col("package")).otherwise(F.col("equivalent")))


def _sharing_words(asked: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(target_language, name, title): names and titles of which at least the share ``least`` of search terms agree.

    In an order of all terms by their number of titles, two such names share one of the first n - ceil(least * n) + 1
    of either; so these prefixes meet, and common terms only where a name has few others.
    """
    terms = lambda df, c: df.select("target_language", c, F.explode(N.search_terms(F.col(c))).alias("term"))
    uses = terms(titles, "title").groupBy("target_language", "term").agg(F.count("*").alias("uses"))

    def prefix(df: DataFrame, c: str) -> DataFrame:
        ranked = terms(df, c).join(uses, ["target_language", "term"], "left").groupBy("target_language", c).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "term"))).alias("terms"))  # the terms of one name
        n = F.size("terms")
        kept = F.slice("terms", F.lit(1), F.greatest(F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int")))
        return ranked.select("target_language", c, F.explode(F.transform(kept, lambda t: t["term"])).alias("term"))

    return prefix(asked, "name").join(prefix(titles, "title"), ["target_language", "term"]).select("target_language", "name", "title").distinct()


def resolve_cross_language(requests: DataFrame, targets: DataFrame, mappings: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Best equivalent of each request (request_id, path, name, package, source_language, target_language).

    In order: a mapped path (1.0), an alias (0.98), the best scored target (language, package, title, url) of the
    threshold or more, in the equivalent package if it has one, the equivalent package's page, the language's page.

    Every target whose score reaches the threshold (above 0) counts, as if all pairs were scored: bare names of which
    one holds the other, even within a word, meet in both directions by the rarest part of the shorter (``holding``);
    equal names are among them, and below a threshold of 0.5 names that share words meet by their rarest terms.
    Equal questions are answered once, and of the targets of one name, in all packages and in the equivalent one,
    only the best reaches the join.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    open_ = ~(F.col("source_language").isin("java", "go") | F.col("target_language").isin("java", "go"))
    named = equivalent_package(symbol_alias(explicit_mapping(requests, mappings), mappings), mappings)
    there = targets.select(F.col("language").alias("target_language"), F.col("package").alias("equivalent"), "title", "url", N.normalized_name(F.col("title")).alias("other"))
    there = cut(there.groupBy("target_language", "equivalent", "title", "other").agg(F.max("url").alias("url")))
    asked = cut(named.filter(open_ & F.col("mapped").isNull()).select("target_language", "name", "equivalent").distinct().withColumn("bare", N.normalized_name(F.col("name"))))

    best_of = F.max(F.struct("url", "title")).alias("t")
    anywhere = lambda key: there.groupBy("target_language", key).agg(best_of)
    within = lambda key: there.groupBy("target_language", key, "equivalent").agg(best_of)

    short, long = F.least(F.length("bare"), F.length("other")), F.greatest(F.length("bare"), F.length("other"), F.lit(1))
    held = F.when(F.col("bare") == F.col("other"), 0.95).otherwise(0.5 + short / long * 0.2)
    names, titles = asked.select("target_language", F.col("bare").alias("held")), there.select("target_language", F.col("other").alias("holder"))
    share = max(0.0, (threshold - 0.5) / 0.2 - 1e-9)
    pairs = holding(names, titles, ["target_language"], share).select("target_language", F.col("held").alias("bare"), F.col("holder").alias("other"))
    back = holding(titles.withColumnRenamed("holder", "held"), names.withColumnRenamed("held", "holder"), ["target_language"], share).select("target_language", F.col("holder").alias("bare"), F.col("held").alias("other"))
    pairs = pairs.unionByName(back).distinct().withColumn("score", held).filter(F.col("score") >= threshold)
    pairs = cut(pairs)
    met = asked.join(pairs, ["target_language", "bare"])
    exact = asked.withColumn("title_is", F.col("name")).withColumn("score", F.lit(1.0))
    looked_up = [(met, "other", anywhere("other"), within("other")), (exact, "title_is", anywhere(F.col("title").alias("title_is")), within(F.col("title").alias("title_is")))]
    if threshold <= 0.5:
        words = _sharing_words(asked, there, 2 * threshold).withColumn("score", N.match_score(F.col("name"), F.col("title"))).filter(F.col("score") >= threshold)
        words = asked.join(words, ["target_language", "name"]).withColumnRenamed("title", "title_is")
        looked_up.append((words, "title_is", *looked_up[1][2:]))
    found = []
    for rows, key, any_, own in looked_up:
        rows = rows.select("target_language", "name", "equivalent", key, "score")
        found += [rows.join(any_, ["target_language", key]).withColumn("preferred", F.lit(False)), rows.join(own, ["target_language", key, "equivalent"]).withColumn("preferred", F.lit(True))]
    good = reduce(DataFrame.unionByName, [f.select("target_language", "name", "equivalent", "t.url", "t.title", "score", "preferred") for f in found])
    best = good.groupBy("target_language", "name", "equivalent").agg(F.max_by(F.struct("url", "title", "score", "preferred"), F.struct("preferred", "score", "url")).alias("m"))
    same = (F.col("name") == F.col("name_")) & (F.col("target_language") == F.col("target_language_")) & F.col("equivalent").eqNullSafe(F.col("equivalent_"))
    best = best.select(*[F.col(c).alias(c + "_") for c in ("target_language", "name", "equivalent")], "m")
    titles = targets.groupBy(F.col("language").alias("target_language"), F.col("title").alias("alias")).agg(F.min("url").alias("alias_url"))
    out = named.join(best, same & F.col("mapped").isNull(), "left").join(titles, ["target_language", "alias"], "left")
    home = F.concat(F.lit("/"), F.col("target_language"))
    match = F.when((F.col("m.score") == 1.0), "exact").when(F.col("m.preferred") | (F.col("m.score") >= 0.9), "normalized").otherwise("fuzzy")
    pick = lambda kind, url, score: F.struct(F.lit(kind).alias("match_type") if isinstance(kind, str) else kind.alias("match_type"), url.alias("url"), (F.lit(score) if isinstance(score, float) else score).alias("score"))
    steps = [
        (~open_, pick("language", home, 0.0)),
        (F.col("mapped").isNotNull(), pick("explicit", F.concat(home, F.lit("/"), F.col("mapped")), 1.0)),
        (F.col("alias_url").isNotNull(), pick("alias", F.col("alias_url"), 0.98)),
        (F.col("m").isNotNull(), pick(match, F.col("m.url"), F.col("m.score"))),
        (F.col("equivalent").isNotNull(), pick("package", F.concat(home, F.lit("/"), F.col("equivalent")), 0.0)),
    ]
    chosen = reduce(lambda rest, step: F.when(step[0], step[1]).otherwise(rest), reversed(steps), pick("language", home, 0.0))
    return out.select("request_id", chosen.alias("c")).select("request_id", "c.*")
