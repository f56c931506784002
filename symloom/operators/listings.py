"""Listings, markdown pages of symbols, URL jobs over request paths, and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import names as N
from symloom.plans.lineage import cut

# Parts of user agents of language-model services and of command-line tools, folders of symbol kinds.
LLM_AGENTS = ("gptbot", "chatgpt-user", "claude-web", "anthropic-ai", "perplexitybot", "google-extended", "ccbot", "youbot", "cohere-ai", "bytespider", "amazonbot", "cursor", "copilot", "aider", "continue", "codeium", "tabnine")
CLI_AGENTS = ("curl", "wget", "httpie", "axios", "node-fetch", "python-requests", "go-http-client")
KIND_FOLDERS = ("modules", "classes", "interfaces", "functions", "type-aliases", "enumerations", "variables", "namespaces")


def package_listing(packages: DataFrame, stats: DataFrame, base: str) -> DataFrame:
    """(section, ord, line): one line for each package, Python before JavaScript."""
    joined = packages.join(stats.select("package_id", "total"), "package_id", "left")
    url = F.concat_ws("/", F.lit(base), "language", N.slug_package(F.col("published_name")))
    line = F.concat(F.lit("- ["), "published_name", F.lit("]("), url, F.lit("): "), F.coalesce("total", F.lit(0)).cast("string"), F.lit(" symbols"))
    return joined.select(F.when(F.col("language") == "python", 0).otherwise(1).alias("section"), "ord", line.alias("line"))


def symbol_lines(symbols: DataFrame, packages: DataFrame, base: str) -> DataFrame:
    """Every symbol's line, with what lines are sorted by: section, package, kind, name."""
    joined = symbols.drop("language").join(packages.select("package_id", "published_name", "language", F.col("ord").alias("package_ord")), "package_id")
    name = F.replace(F.replace(F.col("qualified_name"), F.lit("::"), F.lit(".")), F.lit("#"), F.lit("."))
    prefixed = (F.col("language") == "python") & name.contains("_")
    url = F.concat_ws("/", F.lit(base), "language", N.slug_package(F.col("published_name")), N.slug_symbol_path(name, prefixed))
    first = F.regexp_replace(N.trim_all(F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\.\s[\s\S]*$", ""), r"\s+", " ")), r"^\s+", "")
    said = F.when(F.length(first) > 150, F.concat(F.substring(first, 1, 147), F.lit("..."))).otherwise(first)
    line = F.concat(F.lit("- ["), "name", F.lit("]("), url, F.lit(") ("), "kind", F.lit(")"), F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))
    return joined.select(F.when(F.col("language") == "python", 0).otherwise(1).alias("section"), "package_ord", "kind", "name", F.col("ord").alias("ord"), line.alias("line"))


def symbol_listing(lines: DataFrame, max_bytes: int = 500 * 1024) -> DataFrame:
    """The sorted lines whose running UTF-8 bytes (and a line end each) stay within ``max_bytes``.

    Lines are dealt into ranges of their order, whatever blocks these cut; one sum for each range gives its beginning
    (the driver gets a number for each shuffle partition), and only ranges that begin within the bound are summed
    line by line, each by itself. Equal lines share a sum.
    """
    size = F.octet_length("line") + 1
    order = ["section", "package_ord", "kind", "name", "ord"]
    dealt = cut(lines.select(*order, "line").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    begins, until = {}, 0
    for part, total in sorted(tuple(r) for r in dealt.groupBy("range").agg(F.sum(size)).collect()):
        if until < max_bytes:
            begins[part] = until
        until += total
    before = F.element_at(F.create_map(*[F.lit(x) for item in begins.items() for x in item]), F.col("range")) if begins else F.lit(0)
    running = F.sum(size).over(Window.partitionBy("range").orderBy(*order)) + before
    within = dealt.filter(F.col("range").isin(list(begins))).withColumn("until", running)
    return within.filter(F.col("until") <= max_bytes).select(*order, "line", "until")


def _part(condition: Column, *lines) -> Column:
    """Lines if the condition holds, as one element of an array of lines."""
    return F.when(condition, F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]))


def _cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def symbol_markdown(symbols: DataFrame, base: str) -> DataFrame:
    """(package_id, version, qualified_name, markdown): a page of every symbol; columns as in the symbol table."""
    code = F.when(F.col("language") == "python", "python").otherwise("typescript")
    prefixed = (F.col("language") == "python") & F.col("qualified_name").contains("_")
    url = F.concat_ws("/", F.lit(base), "language", N.slug_package(F.col("package")), N.slug_symbol_path(F.col("qualified_name"), prefixed))
    rows = F.transform("params", lambda p: F.concat(F.lit("| `"), p["name"], F.lit("` | `"), _cell(F.coalesce(p["type"], F.lit("unknown"))), F.lit("` | "), F.when(p["required"], "Yes").otherwise("No"), F.lit(" |  |")))
    of = lambda *kinds: F.filter("members", lambda m: m["kind"].isin(*kinds))
    listed = lambda xs, text: F.array_join(F.transform(xs, text), "\n")
    properties, methods = of("property", "attribute"), of("method", "function")
    parts = F.array(
        F.concat(F.lit("# "), "name", F.lit("\n\n> **"), N.kind_label(F.col("kind")), F.lit("** in `"), "package", F.lit("`\n\n[View in docs]("), url, F.lit(")")),
        F.col("summary"),
        _part(F.col("signature").isNotNull(), "## Signature\n", F.concat(F.lit("```"), code), F.col("signature"), "```"),
        _part(F.size("params") > 0, "## Parameters\n", "| Name | Type | Required | Description |", "|------|------|----------|-------------|", F.array_join(rows, "\n")),
        _part(F.col("returns_type").isNotNull(), "## Returns\n", F.concat(F.lit("`"), "returns_type", F.lit("`"))),
        _part(F.size("extends") > 0, "## Extends\n", listed(F.col("extends"), lambda b: F.concat(F.lit("- `"), b, F.lit("`")))),
        _part(F.size(properties) > 0, "## Properties\n", listed(properties, lambda m: F.concat(F.lit("- `"), m["name"], F.lit("`")))),
        _part(F.size(methods) > 0, "## Methods\n", listed(methods, lambda m: F.concat(F.lit("- [`"), m["name"], F.lit("()`]("), url, F.lit("/"), m["name"], F.lit(")")))),
        _part(F.col("deprecated"), "## Deprecated"),
    )
    return symbols.select("package_id", "version", "qualified_name", F.array_join(parts, "\n\n").alias("markdown"))


def compact_markdown(symbols: DataFrame) -> DataFrame:
    code = F.when(F.col("language") == "python", "python").otherwise("typescript")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### "), "name"),
        F.concat(F.lit("**"), N.kind_label(F.col("kind")), F.lit("** in `"), "package", F.lit("`")),
        F.nullif(F.col("summary"), F.lit("")),
        F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("```"), code, F.lit("\n"), "signature", F.lit("\n```"))),
    )
    return symbols.select("package_id", "version", "qualified_name", text.alias("markdown"))


def package_markdown(symbols: DataFrame, base: str) -> DataFrame:
    """(package_id, markdown): a package page with its symbols by kind; symbols in file order."""
    kinds = {"class": "Classes", "function": "Functions", "interface": "Interfaces", "typeAlias": "Types", "enum": "Enums"}
    line = F.concat(F.lit("- `"), "name", F.when(F.col("kind") == "function", "()`").otherwise("`"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" - "), "summary")).otherwise(""))
    listed = symbols.filter(F.col("kind").isin(*kinds)).groupBy("package_id", "package", "language", "kind").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    block = F.concat(F.lit("## "), F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind")), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    pages = listed.groupBy("package_id", "package", "language").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("b"))
    head = F.concat(
        F.lit("# "), "package", F.lit("\n\n> "), F.when(F.col("language") == "python", "Python").otherwise("JavaScript/TypeScript"), F.lit(" package\n\n[View in docs]("), F.concat_ws("/", F.lit(base), "language", N.slug_package(F.col("package"))), F.lit(")"),
    )
    return pages.select("package_id", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["b"]), "\n\n")).alias("markdown"))


def legacy_redirects(paths: DataFrame, sections: dict[str, str], short_modules: dict[str, str]) -> DataFrame:
    """(path, target, package_id): where old paths lead; null targets stay where they are.

    ``sections`` names the package of each section of the old 0.3 pages, ``short_modules`` that of short module pages.
    """
    path = F.col("path")
    plain = F.regexp_replace(F.regexp_replace(path, r"/index\.html$", ""), "(?<=.)/+$", "")
    parts = F.filter(F.split(plain, "/"), lambda s: s != "")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in (table or {"": ""}).items() for x in kv]), key)
    slug = lambda p: F.lower(F.replace(p, F.lit("_"), F.lit("-")))
    rest = lambda i: F.slice(parts, i, F.greatest(F.size(parts) - (i - 1), F.lit(0)))
    join = lambda head, tail: F.when(F.size(tail) > 0, F.concat(head, F.lit("/"), F.array_join(tail, "/"))).otherwise(head)

    old = path.startswith("/v0.3/python/") | (plain == "/v0.3/python")
    package = lookup(sections, at(2))
    last = F.regexp_replace(F.coalesce(F.element_at(F.filter(parts, lambda s: F.lit(True)), -1), F.lit("")), r"\.html$", "")
    dotted = F.filter(F.split(F.when(F.startswith(last, F.concat(F.replace(package, F.lit("-"), F.lit("_")), F.lit("."))), F.substr(last, F.length(package) + 2)).otherwise(last), r"\."), lambda s: s != "")
    v03 = F.when(package.isNull(), F.lit("/python")).otherwise(join(F.concat(F.lit("/python/"), package), F.when(last.contains("."), dotted).otherwise(rest(4))))

    py = F.regexp_replace(plain, r"\.html$", "")
    py_parts = F.filter(F.split(py, "/"), lambda s: s != "")
    py_at = lambda i: F.coalesce(F.get(py_parts, F.lit(i)), F.lit(""))
    py_rest = lambda i: F.slice(py_parts, i, F.greatest(F.size(py_parts) - (i - 1), F.lit(0)))
    canonical = join(F.concat(F.lit("/python/"), slug(py_at(1))), py_rest(3))
    python = (
        F.when(py.isin("/python", "/python/api_reference"), F.lit("/python"))
        .when(py_at(1) == "integrations", F.when(py_at(2) == "", F.lit("/python")).otherwise(join(F.concat(F.lit("/python/"), slug(py_at(2))), py_rest(4))))
        .when(canonical != path, canonical)
    )
    reflection = F.regexp_replace(F.array_join(rest(3), "/"), r"\.html$", "")
    tokens = F.split(reflection, r"\.")
    token = F.regexp_replace(F.get(tokens, F.lit(0)), "^_", "")
    tail = F.filter(F.flatten(F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.split(t, "_"))), lambda s: s != "")
    short = F.when((at(1) == "modules") & (F.size(tokens) == 1), lookup(short_modules, F.lower(token)))
    typedoc = (
        F.when((plain == "/javascript") | F.regexp_replace(plain, r"^/javascript/([^/]+)\.html$", "$1").isin(*KIND_FOLDERS), F.lit("/javascript"))
        .when(at(1).isin(*KIND_FOLDERS), F.when(reflection == "", F.lit("/javascript")).when(short.isNotNull(), F.concat(F.lit("/javascript/"), short)).otherwise(join(F.concat(F.lit("/javascript/"), slug(token)), tail)))
    )
    target = F.when(old, v03).when(at(0) == "python", python).when(at(0) == "javascript", typedoc)
    return paths.select("path", target.alias("target"), F.when(old & package.isNotNull(), F.concat(F.lit("pkg_py_"), F.replace(package, F.lit("-"), F.lit("_")))).alias("package_id"))


def expand_dotted_paths(paths: DataFrame) -> DataFrame:
    """(path, target): dots below the package become slashes if the last segment has one; null if nothing changes."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    last = F.element_at(parts, -1)
    tail = F.flatten(F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: F.split(s, r"\.")))
    fits = (F.size(parts) >= 3) & ~F.get(parts, F.lit(1)).isin(*KIND_FOLDERS, "integrations") & last.contains(".") & ~last.contains("%")
    return paths.select("path", F.when(fits, F.concat(F.lit("/"), F.array_join(F.concat(F.slice(parts, 1, 2), tail), "/"))).alias("target"))


def requested_format(requests: DataFrame) -> DataFrame:
    """requests (format, accept, user_agent) with the content format: parameter, Accept, model agents, tools, else html."""
    wanted, accept, agent = F.lower("format"), F.coalesce("accept", F.lit("")), F.lower(F.coalesce("user_agent", F.lit("")))
    page = accept.contains("text/html")
    return requests.withColumn(
        "content_format",
        F.when(wanted.isin("md", "markdown"), "markdown").when(wanted == "json", "json").when(accept.contains("text/markdown"), "markdown").when(accept.contains("application/json") & ~page, "json")
        .when(agent.rlike("|".join(LLM_AGENTS)), "markdown").when(agent.rlike("|".join(CLI_AGENTS)) & ~page, "markdown").otherwise("html"),
    )


def latency_percentiles(logs: DataFrame, by: str) -> DataFrame:
    """P50, P90 and P99 of whole durations (the sorted value at floor(n * p)) and the error rate of each group.

    Equal durations are counted first, so only the different ones are sorted: running counts give the values.
    """
    whole = logs.filter(F.col("duration_ms").isNotNull() & (F.col("duration_ms") == F.floor("duration_ms")))
    counted = whole.groupBy(by, "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(Window.partitionBy(by).orderBy("duration_ms"))
    ranked = counted.withColumns({"until": until, "total": F.sum("n").over(Window.partitionBy(by))})
    at = lambda p: F.min(F.when(F.col("until") > F.floor(F.col("total") * p), F.col("duration_ms")))
    found = ranked.groupBy(by).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    errors = logs.groupBy(by).agg((F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("error_rate"))
    return errors.join(found, by, "left")
