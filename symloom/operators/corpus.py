"""Markdown corpus: blocks, sections, imports, links, and the pages that use a symbol. Pages are (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import lines as L
from symloom.functions import names as N
from symloom.plans.lineage import cut

# Fence languages of each parser, image and file endings that links are told by.
PYTHON_FENCES = ("python", "py", "python3")
JAVASCRIPT_FENCES = ("javascript", "js", "typescript", "ts", "jsx", "tsx")
IMAGES = "png|jpg|jpeg|gif|svg|webp|avif"
FILES = (
    "java|kt|kts|scala|groovy|go|rs|py|pyx|pxd|ts|tsx|js|jsx|mjs|cjs|rb|php|swift|m|mm|c|cpp|cc|cxx|h|hpp|hxx|cs|fs|vb|json|yaml|yml|toml|xml|gradle|properties|ini|cfg|md|mdx|rst|txt|adoc|html|css|scss|sass|less|sql|sh|bash|zsh|ps1|dockerfile|makefile|mod|sum"
)


def code_blocks(docs: DataFrame) -> DataFrame:
    """(path, language, start_line, code) of the closed, non-empty fences of every page."""
    return docs.select("path", "content").mapInArrow(L.line_blocks, "path string, language string, start_line int, code string")


def frontmatter(content: Column) -> Column:
    return F.regexp_extract(content, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, r"^---\n[\s\S]*?\n---(?:\n|$)", "")


def sections(docs: DataFrame, line_base: str = "reference") -> DataFrame:
    """(path, level, title, anchor, start_line) of the headings, also inside fences.

    line_base ``reference`` counts lines below the front matter, ``file`` those of the whole file.
    """
    head = r"^(#{1,6})\s+(.+)$"
    each = docs.select("path", F.posexplode(F.split(body(F.col("content")) if line_base == "reference" else F.col("content"), "\n")).alias("pos", "line")).filter(F.col("line").rlike(head))
    title = N.trim_all(F.regexp_extract("line", head, 2))
    return each.select("path", F.length(F.regexp_extract("line", head, 1)).alias("level"), title.alias("title"), N.slug_heading(title).alias("anchor"), (F.col("pos") + 1).alias("start_line"))


def page_metadata(docs: DataFrame, language: str = "python", products: tuple[str, ...] = ()) -> DataFrame:
    """(path, title, description, url): title from the front matter, else the first heading, else Untitled."""
    field = lambda name: F.nullif(F.regexp_extract(frontmatter(F.col("content")), rf"(?m)^{name}:\s*[\"']?(.*?)[\"']?\s*$", 1), F.lit(""))
    first = F.nullif(N.trim_all(F.regexp_extract(body(F.col("content")), r"(?m)^#{1,6}[ \t]+(.+)$", 1)), F.lit(""))
    return docs.select("path", F.coalesce(field("title"), first, F.lit("Untitled")).alias("title"), field("description").alias("description"), N.doc_url(F.col("path"), F.lit(language), products).alias("url"))


def containing_section(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """blocks with the anchor of the last section that starts at or before their line: one sort of each page, no pairs."""
    marks = headings.select("path", F.col("start_line").alias("line"), F.lit(0).alias("kind"), "anchor")
    asked = blocks.select("path", F.col("start_line").alias("line"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("anchor"))
    window = Window.partitionBy("path").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked.distinct()).withColumn("section", F.last("anchor", ignorenulls=True).over(window)).filter("kind = 1")
    return blocks.join(found.select("path", F.col("line").alias("start_line"), "section"), ["path", "start_line"], "left")


def _names(clause: Column) -> Column:
    """Original names of a comma-separated import list."""
    return F.filter(F.transform(F.split(clause, ","), lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1)), lambda n: n != "")


def _python_found(code: Column) -> Column:
    """(package, symbols) of each ``from package import ...``; line ends inside parentheses are spaces by now."""
    pattern = F.lit(r"from\s+([\w_.]+)\s+import\s+(.+)")
    zipped = F.arrays_zip(F.regexp_extract_all(code, pattern, 1).alias("package"), F.regexp_extract_all(code, pattern, 2).alias("clause"))
    named = F.transform(zipped, lambda i: F.struct(i["package"].alias("package"), _names(F.regexp_replace(i["clause"], r"^\(|\)$", "")).alias("symbols")))
    return F.filter(named, lambda i: ~i["package"].startswith(".") & (F.size(i["symbols"]) > 0))


def _script_found(code: Column) -> Column:
    """(package, symbols, default_name, is_type) of each ES import of a package."""
    pattern = F.lit(r"import\s+(type\s+)?(?:(\*\s+as\s+\w+)|(\w+)(?:\s*,\s*\{([^}]*)\})?|(?:\{([^}]*)\}))\s+from\s+[\"']([^\"']+)[\"']")
    group = {"type": 1, "space": 2, "default_name": 3, "with_default": 4, "alone": 5, "package": 6}
    zipped = F.arrays_zip(*[F.regexp_extract_all(code, pattern, i).alias(n) for n, i in group.items()])
    text = lambda i, name: F.coalesce(i[name], F.lit(""))
    own = F.filter(zipped, lambda i: ~i["package"].rlike("^[./]") & (text(i, "space") == ""))
    named = F.transform(
        own,
        lambda i: F.struct(
            i["package"].alias("package"),
            _names(F.concat(text(i, "with_default"), text(i, "alone"))).alias("symbols"),
            F.nullif(i["default_name"], F.lit("")).alias("default_name"),
            (text(i, "type") != "").alias("is_type"),
        ),
    )
    return F.filter(named, lambda i: i["default_name"].isNotNull() | (F.size(i["symbols"]) > 0))


def python_imports(blocks: DataFrame) -> DataFrame:
    """blocks with one row for each ``from package import ...``: package, symbols (array)."""
    return blocks.withColumn("_i", F.explode(_python_found(L.join_paren_lines(F.col("code"))))).select(*blocks.columns, "_i.*")


def javascript_imports(blocks: DataFrame) -> DataFrame:
    """blocks with one row for each ES import: package, symbols (named ones), default_name, is_type."""
    return blocks.withColumn("_i", F.explode(_script_found(F.col("code")))).select(*blocks.columns, "_i.*")


def _heads(package: Column, separator: Column) -> Column:
    """Every leading part of a package name, the name itself last."""
    parts = F.split(package, F.concat(F.lit("["), separator, F.lit("]")))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("array_join", F.slice(parts, 1, i), separator))


def _joined_to_known(imports: DataFrame, packages: DataFrame, separator: Column, on: list[str]) -> DataFrame:
    """Imports at or below a known package, in one pass over them.

    Known packages below another known one are left out first, so that an import meets one at most.
    """
    own = packages.select("name", *on).withColumn("_head", F.explode(_heads(F.col("name"), separator)))
    itself = F.col("_head") == F.col("name")
    below = ~itself & F.max(itself).over(Window.partitionBy("_head", *on))
    roots = own.withColumn("_below", below).groupBy("name", *on).agg(F.max("_below").alias("_below")).filter(~F.col("_below")).select(F.col("name").alias("_head"), *on)
    return imports.withColumn("_head", F.explode(_heads(F.col("package"), separator))).join(roots, ["_head", *on]).select(*imports.columns)


def known_package_imports(imports: DataFrame, packages: DataFrame, separator: str = ".") -> DataFrame:
    """Imports whose package is a known one (name) or below one; met by equality on every leading part."""
    return _joined_to_known(imports, packages, F.lit(separator), [])


def scan_imports(docs: DataFrame, packages: DataFrame) -> DataFrame:
    """(symbol, package, path, section, language): every imported symbol of known packages; packages (name, language).

    Pages are read once: their fences come with the heading above them, and nothing but the join with the packages
    follows. Of pages with one path each is read by itself.
    """
    blocks = docs.select("path", "content").mapInPandas(L.headed_blocks(PYTHON_FENCES, JAVASCRIPT_FENCES), "path string, language string, start_line int, code string, heading string")
    python = F.col("language").isin(*PYTHON_FENCES)
    script = F.transform(_script_found(F.col("code")), lambda i: F.struct(i["package"].alias("package"), F.concat(i["symbols"], F.array_compact(F.array(i["default_name"]))).alias("symbols")))
    section = N.slug_heading(N.trim_all(F.col("heading"))).alias("section")
    language = F.when(python, "python").otherwise("javascript").alias("language")
    found = blocks.select("path", "start_line", section, language, F.explode(F.when(python, _python_found(F.col("code"))).otherwise(script)).alias("_i"))
    found = found.select("path", "start_line", "section", "language", "_i.*")
    separator = F.when(F.col("language") == "python", ".").otherwise("/")
    known = packages.filter(F.col("language").isin("python", "javascript"))
    return _joined_to_known(found, known, separator, ["language"]).select(F.explode("symbols").alias("symbol"), "package", "path", "section", "language", "start_line")


def related_docs(matches: DataFrame, pages: DataFrame, most: int = 20) -> DataFrame:
    """(symbol, rank, title, path, language, section, total): of each symbol its first ``most`` pages by title, and their number.

    One entry for each page and language: equal ones are dropped by a partial aggregation before any sort.
    """
    once = matches.groupBy("symbol", "path", "language").agg(F.min_by("section", F.struct("start_line", "package")).alias("section"))
    titled = cut(once.join(pages.select("path", "title"), "path"))  # pages are read once
    totals = titled.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    window = Window.partitionBy("symbol").orderBy("title", "path", "language")
    best = titled.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)
    return best.join(totals, "symbol").select("symbol", "rank", "title", "path", "language", "section", "total")


def related_docs_for(symbols: DataFrame, related: DataFrame, limit: int = 5) -> DataFrame:
    """symbols (symbol) with their first entries and total; an empty list and 0 where there is none."""
    few = related.filter(F.col("rank") <= min(limit, 20)).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "path"))).alias("entries"), F.max("total").alias("total"))
    joined = symbols.join(few, "symbol", "left")
    return joined.select("symbol", F.coalesce(F.transform("entries", lambda e: e["path"]), F.array().cast("array<string>")).alias("paths"), F.coalesce("total", F.lit(0)).alias("total"))


def parse_subpages(docs: DataFrame) -> DataFrame:
    """(path, markdown, symbol_refs): the text above the first ``:::`` directive, and the names that directives show."""
    return docs.select("path", L.subpage(F.col("content")).alias("s")).select("path", "s.markdown", "s.symbol_refs")


def page_links(docs: DataFrame, repo: str, ref: str, image_base: str, package_path: str = "") -> DataFrame:
    """(path, text, target, is_image, url) of every markdown link and image and every ``<img>``.

    Relative images join the base; other relative links become file or folder pages of the repository.
    """
    zipped = lambda pattern, image, text, target: F.transform(
        F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), text).alias("x"), F.regexp_extract_all("content", F.lit(pattern), target).alias("t")),
        lambda z: F.struct(z["x"].alias("text"), N.trim_all(z["t"]).alias("target"), F.lit(image).alias("is_image")),
    )
    found = F.concat(
        zipped(r"(?:^|[^!])\[([^\]]+)\]\(([^)]+)\)", False, 1, 2),
        zipped(r"!\[([^\]]*)\]\(([^)]+)\)", True, 1, 2),
        zipped(r"(?i)<img\s+[^>]*?src=([\"'])([^\"']+)[\"'][^>]*?/?>", True, 1, 2),
    )
    links = docs.select("path", F.explode(found).alias("l")).select("path", "l.*")
    bare = F.regexp_replace("target", r"^\./", "")
    image = ~F.col("target").rlike("^(http|data:|#)") & F.col("target").rlike(rf"(?i)\.({IMAGES})(\?.*)?$")
    fixed = F.col("target").rlike("(?i)^([a-z]+:|#|/)") | (bare == "")
    kind = F.when(F.lower(bare).rlike(rf"\.({FILES})$"), "blob").otherwise("tree")
    prefix = f"{package_path}/" if package_path not in ("", ".") else ""
    page = F.concat(F.lit(f"https://github.com/{repo}/"), kind, F.lit(f"/{ref}/{prefix}"), bare)
    url = F.when(F.col("is_image"), F.when(image, F.concat(F.lit(image_base.rstrip("/") + "/"), bare)).otherwise(F.col("target"))).otherwise(F.when(fixed, F.col("target")).otherwise(page))
    return links.withColumn("url", url)


def admonitions(docs: DataFrame) -> DataFrame:
    """(path, line, type, title, indent, level, content) of every ``!!!``, ``???`` and ``???+`` block that is not empty."""
    return docs.select("path", "content").mapInArrow(L.admonition_rows, "path string, line int, type string, title string, indent int, level int, content string")


def clean_example(code: Column) -> Column:
    """Example text without admonition openers; only the first fenced block; else without p, pre and code tags."""
    opener = r"[?!]{3}\+?\s*\w+(?:\s+\"[^\"]*\")?"
    text = F.regexp_replace(F.regexp_replace(code, rf"(?m)^{opener}\s*$", ""), rf"<p>{opener}</p>", "")
    html, fence = r"<pre><code>```(\w*)\n([\s\S]*?)```\s*</code></pre>", r"```\w*\n([\s\S]*?)```"
    inner = F.when(text.rlike(html), F.regexp_extract(text, html, 2)).when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(F.regexp_replace(text, r"</?(?:p|pre|code)>", ""))
    return N.trim_all(inner)


def fenced_examples(docs: DataFrame, text: str = "content") -> DataFrame:
    """(path, pos, title, language, code): every fence, dedented; python if it names no language; the title is the line before it."""
    each = docs.select("path", F.col(text).alias("content")).mapInArrow(L.example_rows, "path string, pos int, title string, language string, code string")
    title = F.regexp_replace(N.trim_all(F.col("title")), ":$", "")
    return each.select("path", "pos", F.nullif(title, F.lit("")).alias("title"), F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("python")).alias("language"), "code")
