"""Queries for the markdown corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.functions import lines as Li
from symloom.functions import names as N
from symloom.operators import corpus as C
from symloom.plans.bindings import bound, with_tables
from symloom.plans.registry import SQL, query

c = F.col
docs = lambda s, d: bound(s, d, "doc_files").select("path", "content")
DOCS = with_tables("doc_files") + ", doc AS (SELECT f.*, d.source, d.lang, CASE WHEN f.doc_id % 4 = 0 THEN 4 ELSE 0 END AS fm FROM doc_files f JOIN documents d USING (doc_id))"
I50, I40 = "'Item' || CAST(doc_id % 50 AS VARCHAR)", "'Thing' || CAST(doc_id % 40 AS VARCHAR)"
PY = f"'from acme_' || source || '.core import ' || {I50} || ', Tool as T'"
TS = f"'import {{ ' || {I40} || ', type Kind as K }} from \"@acme/' || source || '/sub\";' || chr(10) || 'import Def from \"@acme/' || source || '\";'"
BLOCKS = f"{DOCS}, block AS (SELECT path, source, doc_id, fm, 'python' AS language, CAST(4 + fm AS INT) AS start_line, {PY} AS code FROM doc UNION ALL SELECT path, source, doc_id, fm, 'ts', CAST(9 + fm AS INT), {TS} FROM doc)"
query("code_blocks", f"{BLOCKS} SELECT path, language, start_line, code FROM block")(lambda s, d: C.code_blocks(docs(s, d)))
HEADS = f"""{DOCS}, head AS (SELECT path, 1 AS level, 'Guide ' || CAST(doc_id AS VARCHAR) || ' to A/B testing!' AS title, 'guide-' || CAST(doc_id AS VARCHAR) || '-to-ab-testing' AS anchor, 1 AS start_line FROM doc
  UNION ALL SELECT path, 2, 'Using ' || source || '  now', 'using-' || source || '-now', 3 FROM doc UNION ALL SELECT path, 3, 'More', 'more', 8 FROM doc)"""
query("sections", f"{HEADS} SELECT * FROM head")(lambda s, d: C.sections(docs(s, d)))
query("page_metadata", f"""{DOCS} SELECT path, CASE WHEN fm > 0 THEN 'Page ' || CAST(doc_id AS VARCHAR) ELSE 'Guide ' || CAST(doc_id AS VARCHAR) || ' to A/B testing!' END AS title, CASE WHEN fm > 0 THEN 'About ' || lang END AS description,
  '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.mdx?$', ''), '/index$', ''), '^oss/acme', 'oss/python/acme') AS url FROM doc""")(lambda s, d: C.page_metadata(docs(s, d), "python", ("acme",)))
SECTION = "CASE WHEN language = 'python' AND fm = 0 THEN 'using-' || source || '-now' ELSE 'more' END"
for name in ("containing_section", "containing_section_all"):
    query(name, f"{BLOCKS} SELECT path, start_line, language, {SECTION} AS section FROM block")(lambda s, d: C.containing_section(C.code_blocks(docs(s, d)), C.sections(docs(s, d))).select("path", "start_line", "language", "section"))
python = lambda s, d: C.python_imports(C.code_blocks(docs(s, d)).filter("language = 'python'"))
script = lambda s, d: C.javascript_imports(C.code_blocks(docs(s, d)).filter("language = 'ts'"))
query("python_imports", f"{DOCS} SELECT path, 'acme_' || source || '.core' AS package, {I50} || ',Tool' AS symbols FROM doc")(lambda s, d: python(s, d).select("path", "package", F.array_join("symbols", ",").alias("symbols")))
query("javascript_imports", f"""{DOCS} SELECT path, '@acme/' || source || '/sub' AS package, {I40} || ',type' AS symbols, CAST(NULL AS VARCHAR) AS default_name, false AS is_type FROM doc
  UNION ALL SELECT path, '@acme/' || source, '', 'Def', false FROM doc""")(lambda s, d: script(s, d).select("path", "package", F.array_join("symbols", ",").alias("symbols"), "default_name", "is_type"))


def known(s, d):
    """Packages of the sources whose number is even."""
    sources = bound(s, d, "documents").select("source").distinct().filter("CAST(substr(source, 4) AS INT) % 2 = 0")
    return sources.select(F.concat(F.lit("acme_"), "source").alias("name"), F.lit("python").alias("language")).unionByName(sources.select(F.concat(F.lit("@acme/"), "source").alias("name"), F.lit("javascript").alias("language")))


EVEN = "CAST(substr(source, 4) AS INT) % 2 = 0"
query("known_package_imports", f"{DOCS} SELECT path, 'acme_' || source || '.core' AS package FROM doc WHERE {EVEN}")(lambda s, d: C.known_package_imports(python(s, d), known(s, d).filter("language = 'python'")).select("path", "package"))
MATCH = f"""{BLOCKS}, m AS (SELECT {I50} AS symbol, 'acme_' || source || '.core' AS package, path, {SECTION} AS section, 'python' AS language FROM block WHERE language = 'python' AND {EVEN}
  UNION ALL SELECT 'Tool', 'acme_' || source || '.core', path, {SECTION}, 'python' FROM block WHERE language = 'python' AND {EVEN}
  UNION ALL SELECT unnest([{I40}, 'type']), '@acme/' || source || '/sub', path, 'more', 'javascript' FROM block WHERE language = 'ts' AND {EVEN} UNION ALL SELECT 'Def', '@acme/' || source, path, 'more', 'javascript' FROM block WHERE language = 'ts' AND {EVEN})"""
for name in ("scan_imports", "scan_imports_all"):
    query(name, f"{MATCH} SELECT * FROM m")(lambda s, d: C.scan_imports(docs(s, d), known(s, d)).drop("start_line"))
RELATED = f"""{MATCH}, page AS (SELECT path, CASE WHEN fm > 0 THEN 'Page ' || CAST(doc_id AS VARCHAR) ELSE 'Guide ' || CAST(doc_id AS VARCHAR) || ' to A/B testing!' END AS title FROM doc),
  once AS (SELECT DISTINCT symbol, m.path, language, title, section FROM m JOIN page USING (path)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY title, path, language) AS rank, count(*) OVER (PARTITION BY symbol) AS total FROM once)"""
related = lambda s, d: C.related_docs(C.scan_imports(docs(s, d), known(s, d)), C.page_metadata(docs(s, d)))
wanted = lambda s, d: bound(s, d, "documents").select(F.concat(F.lit("Item"), c("doc_id") % 60).alias("symbol")).distinct()
for name in ("related_docs", "related_docs_all"):
    query(name, f"{RELATED} SELECT symbol, rank, title, path, language, section, total FROM ranked WHERE rank <= 20")(related)
for name in ("related_docs_for", "related_docs_for_all"):
    query(name, f"""{RELATED}, w AS (SELECT DISTINCT 'Item' || CAST(doc_id % 60 AS VARCHAR) AS symbol FROM documents) SELECT w.symbol, coalesce(string_agg(path, ',' ORDER BY rank), '') AS paths, coalesce(max(total), 0) AS total FROM w LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (symbol) GROUP BY w.symbol""")(
        lambda s, d: C.related_docs_for(wanted(s, d), related(s, d)).withColumn("paths", F.array_join("paths", ","))
    )
query("page_links", f"""{DOCS} SELECT path, unnest(['the item', 'site', 'pic', 'readme']) AS text, unnest(['#acme.core.' || {I50}, 'https://x.org/a', 'img/a.png', 'docs/readme.md']) AS target, unnest([false, false, true, false]) AS is_image,
  unnest(['#acme.core.' || {I50}, 'https://x.org/a', 'https://raw.org/img/a.png', 'https://github.com/acme/repo/blob/main/libs/docs/readme.md']) AS url FROM doc""")(lambda s, d: C.page_links(docs(s, d), "acme/repo", "main", "https://raw.org", "libs"))


# Pages that the SQL parses itself: fences by one expression over the page, then the clauses in them.
varied = lambda s, d: bound(s, d, "varied_files").select("path", "content")
FENCE = r"(?ms)^```(\w*)[^\n]*\n(.*?)^```[ \t\r]*$"
PARSED = f"""{with_tables("varied_files")}, fence AS (SELECT path, unnest(regexp_extract_all(content, '{FENCE}', 1)) AS tag, unnest(regexp_extract_all(content, '{FENCE}', 2)) AS inside FROM varied_files),
  block AS (SELECT path, lower(tag) AS language, left(inside, length(inside) - 1) AS code FROM fence WHERE inside <> '')"""
query("code_blocks_varied", f"{PARSED} SELECT path, language, code FROM block")(lambda s, d: C.code_blocks(varied(s, d)).select("path", "language", "code"))
JOINED = "array_to_string(list_transform(string_split(code, '('), lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, ')') THEN replace(split_part(x, ')', 1), chr(10), ' ') || ')' || substr(x, strpos(x, ')') + 1) ELSE replace(x, chr(10), ' ') END), '(')"
FROM = r"from\s+([\w_.]+)\s+import\s+(.+)"
NAMES = r"array_to_string(list_filter(list_transform(string_split({}, ','), lambda x: regexp_extract(x, '^\s*(\w+)', 1)), lambda x: x <> ''), ',')"
PYTHON = f"""{PARSED}, joined AS (SELECT path, {JOINED} AS code FROM block WHERE language IN ('python', 'py', 'python3')),
  clause AS (SELECT path, unnest(regexp_extract_all(code, '{FROM}', 1)) AS package, regexp_replace(unnest(regexp_extract_all(code, '{FROM}', 2)), '^\\(|\\)$', '', 'g') AS clause FROM joined),
  py AS (SELECT path, package, {NAMES.format('clause')} AS symbols FROM clause WHERE package NOT LIKE '.%')"""
query("python_imports_varied", f"{PYTHON} SELECT * FROM py WHERE symbols <> ''")(
    lambda s, d: C.python_imports(C.code_blocks(varied(s, d)).filter(c("language").isin(*C.PYTHON_FENCES))).select("path", "package", F.array_join("symbols", ",").alias("symbols"))
)
IMPORT = r"""import\s+(type\s+)?(?:(\*\s+as\s+\w+)|(\w+)(?:\s*,\s*\{([^}]*)\})?|(?:\{([^}]*)\}))\s+from\s+["'']([^"'']+)["'']"""
GROUPS = ", ".join(f"unnest(regexp_extract_all(code, '{IMPORT}', {i})) AS {n}" for i, n in enumerate(("typed", "space", "own", "beside", "alone", "package"), 1))
SCRIPT = f"""{PYTHON}, found AS (SELECT path, {GROUPS} FROM block WHERE language IN ('javascript', 'js', 'typescript', 'ts', 'jsx', 'tsx')),
  js AS (SELECT path, package, {NAMES.format("coalesce(beside, '') || coalesce(alone, '')")} AS symbols, nullif(own, '') AS default_name, coalesce(typed, '') <> '' AS is_type FROM found WHERE coalesce(space, '') = '' AND NOT regexp_matches(package, '^[./]'))"""
query("javascript_imports_varied", f"{SCRIPT} SELECT * FROM js WHERE symbols <> '' OR default_name IS NOT NULL")(
    lambda s, d: C.javascript_imports(C.code_blocks(varied(s, d)).filter(c("language").isin(*C.JAVASCRIPT_FENCES))).select("path", "package", F.array_join("symbols", ",").alias("symbols"), "default_name", "is_type")
)


def varied_packages(s, d):
    """Modules of even number, and one package that holds another known one."""
    ids = bound(s, d, "documents").select((c("doc_id") % 30).alias("m")).distinct()
    modules = ids.filter("m % 2 = 0").select(F.concat(F.lit("acme.m"), "m").alias("name"), F.lit("python").alias("language"))
    script = ids.filter("m < 2").select(F.when(c("m") == 0, "@acme").otherwise("@acme/t").alias("name"), F.lit("javascript").alias("language"))
    return modules.unionByName(script)


query("scan_imports_varied", rf"""{SCRIPT} SELECT unnest(string_split(symbols, ',')) AS symbol, package, path, 'python' AS language FROM py WHERE symbols <> '' AND CAST(nullif(regexp_extract(package, '^acme\.m(\d+)$', 1), '') AS INT) % 2 = 0
  UNION ALL SELECT unnest(list_filter(string_split(symbols, ','), lambda x: x <> '') || CASE WHEN default_name IS NULL THEN []::VARCHAR[] ELSE [default_name] END), package, path, 'javascript' FROM js WHERE package LIKE '@acme/%'""")(
    lambda s, d: C.scan_imports(varied(s, d), varied_packages(s, d)).select("symbol", "package", "path", "language")
)


def marked(s, d):
    """Whole texts of the documents, with their lines, and directives, admonitions, indents and examples around them."""
    indented = lambda n: F.replace("text", F.lit("\n"), F.lit("\n" + " " * n))
    sub = F.concat(F.lit("---\ntitle: x\n---\n\nIntro "), "text", F.lit("\n\n::: acme.mod"), c("doc_id"), F.when(c("doc_id") % 2 == 0, "\n    options:\n      members:\n        - Item\n        - run\n        - make_tool\n").otherwise("\n"), F.lit("::: acme.other text\n"))
    note = F.concat(F.lit("Intro\n!!! note \"Read\"\n    "), indented(4), F.lit("\n    ??? warning inline text\n        deeper\nafter\n!!! tip\n\nend"))
    return bound(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", sub.alias("sub"), note.alias("note"), F.concat(F.lit("    def f():\n        "), indented(8), F.lit("\n      x")).alias("code"), F.concat(F.lit("???+ example \"E\"\n```python\n"), "text", F.lit("\n```\nrest")).alias("example"))


# the names with _whole are kept from the time when the others read a part of each text
BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
LINES = "string_split(text, chr(10))"
LINED = {
    "parse_subpages": (
        """SELECT CAST(doc_id AS VARCHAR) AS path, regexp_replace('Intro ' || text, '\\s+$', '') AS markdown, CASE WHEN doc_id % 2 = 0 THEN 'acme.mod' || CAST(doc_id AS VARCHAR) || '.Item,acme.mod' || CAST(doc_id AS VARCHAR) || '.make_tool' ELSE 'acme.mod' || CAST(doc_id AS VARCHAR) END || ',acme.other' AS symbol_refs FROM documents""",
        lambda s, d: C.parse_subpages(marked(s, d).select("path", c("sub").alias("content"))).withColumn("symbol_refs", F.array_join("symbol_refs", ",")),
    ),
    "admonitions": (
        f"""SELECT CAST(doc_id AS VARCHAR) AS path, 2 AS line, 'note' AS type, 'Read' AS title, 0 AS indent, 0 AS level, regexp_replace(text || chr(10), '^\\s+', '') || '??? warning inline text' || chr(10) || '    deeper' AS content FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(3 + len({LINES}) AS INT), 'warning', 'Warning', 0, 1, 'inline text' || chr(10) || 'deeper' FROM documents WHERE text IS NOT NULL""",
        lambda s, d: C.admonitions(marked(s, d).select("path", c("note").alias("content"))),
    ),
    "dedent": (
        f"""SELECT CAST(doc_id AS VARCHAR) AS path, 'def f():' || chr(10) || array_to_string(list_transform({LINES}, lambda x: CASE WHEN regexp_matches(x, '\\S') THEN '    ' ELSE '        ' END || x), chr(10)) || chr(10) || '  x' AS text FROM documents""",
        lambda s, d: marked(s, d).select("path", Li.dedent(c("code")).alias("text")),
    ),
    "clean_example": (f"SELECT CAST(doc_id AS VARCHAR) AS path, {BARE} AS text FROM documents", lambda s, d: marked(s, d).select("path", C.clean_example(c("example")).alias("text"))),
    "fenced_examples": (
        f"SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS pos, '???+ example \"E\"' AS title, 'python' AS language, CASE WHEN contains(text, chr(10)) THEN text ELSE {BARE} END AS code FROM documents WHERE text IS NOT NULL",
        lambda s, d: C.fenced_examples(marked(s, d).select("path", c("example").alias("content"))),
    ),
}
for name, (sql, function) in LINED.items():
    query(name, sql)(function)
    query(f"{name}_whole", sql)(function)
