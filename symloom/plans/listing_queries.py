"""Queries for listings, markdown pages, URL jobs and latency figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import artifacts as A
from symloom.operators import listings as L
from symloom.plans.artifact_queries import LATEST, PREFIXLESS
from symloom.plans.bindings import bound, symbols, with_tables
from symloom.plans.registry import query

c = F.col
latest = lambda s, d: symbols(s, d, "latest")
packages = lambda s, d: bound(s, d, "packages")
BASE = "https://x.org"
PACKAGE_ORD = "CAST(regexp_extract(package, '[0-9]+') AS INT)"
query("package_listing", f"""{LATEST} SELECT CASE WHEN language = 'python' THEN 0 ELSE 1 END AS section, {PACKAGE_ORD} AS ord, '- [' || package || ']({BASE}/' || language || '/' || replace(package, '_', '-') || '): ' || CAST(count(*) AS VARCHAR) || ' symbols' AS line FROM latest GROUP BY package, language""")(
    lambda s, d: L.package_listing(packages(s, d), A.package_stats(latest(s, d)), BASE)
)
LINE = f"'- [' || name || ']({BASE}/' || language || '/' || replace(package, '_', '-') || '/' || {PREFIXLESS} || ') (' || kind || '): ' || regexp_replace(summary, '\\.\\s.*$', '')"
LINES = f"""{LATEST}, lines AS (SELECT CASE WHEN language = 'python' THEN 0 ELSE 1 END AS section, {PACKAGE_ORD} AS package_ord, kind, name, ord, {LINE} AS line FROM latest)"""
query("symbol_listing", f"""{LINES} SELECT * FROM (SELECT *, CAST(sum(strlen(line) + 1) OVER (ORDER BY section, package_ord, kind, name, ord) AS BIGINT) AS until FROM lines) WHERE until <= 60000""")(
    lambda s, d: L.symbol_listing(L.symbol_lines(latest(s, d), packages(s, d), BASE), 60_000)
)
CODE = "CASE WHEN language = 'python' THEN 'python' ELSE 'typescript' END"
LABEL = "CASE kind WHEN 'typeAlias' THEN 'Type' ELSE upper(substr(kind, 1, 1)) || substr(kind, 2) END"
PAGE = f"'{BASE}/' || language || '/' || replace(package, '_', '-') || '/' || {PREFIXLESS}"
N2 = "chr(10) || chr(10)"
MEMBERS = "CASE WHEN m1_name = m2_name THEN [{'n': m1_name, 'k': m1_kind}] ELSE [{'n': m1_name, 'k': m1_kind}, {'n': m2_name, 'k': m2_kind}] END"
PROPS, METHODS = (f"list_filter({MEMBERS}, lambda m: m.k = '{k}')" for k in ("property", "method"))
ROW = "'| `{0}` | `' || {1} || '` | ' || {2} || ' |  |'"
query("symbol_markdown", f"""{LATEST} SELECT package_id, version, qualified_name, md5(concat_ws({N2}, '# ' || name || {N2} || '> **' || {LABEL} || '** in `' || package || '`' || {N2} || '[View in docs](' || {PAGE} || ')', summary,
  '## Signature' || {N2} || '```' || {CODE} || chr(10) || signature || chr(10) || '```',
  '## Parameters' || {N2} || '| Name | Type | Required | Description |' || chr(10) || '|------|------|----------|-------------|' || chr(10) || {ROW.format('first', 'p1_type', "CASE WHEN p1_required THEN 'Yes' ELSE 'No' END")} || CASE WHEN n_params = 2 THEN chr(10) || {ROW.format('second', 'p2_type', "'No'")} ELSE '' END,
  '## Returns' || {N2} || '`' || returns_type || '`', '## Extends' || {N2} || '- `' || extends_name || '`',
  CASE WHEN len({PROPS}) > 0 THEN '## Properties' || {N2} || array_to_string(list_transform({PROPS}, lambda m: '- `' || m.n || '`'), chr(10)) END,
  CASE WHEN len({METHODS}) > 0 THEN '## Methods' || {N2} || array_to_string(list_transform({METHODS}, lambda m: '- [`' || m.n || '()`](' || {PAGE} || '/' || m.n || ')'), chr(10)) END,
  CASE WHEN deprecated THEN '## Deprecated' END)) AS markdown FROM latest""")(lambda s, d: L.symbol_markdown(latest(s, d), BASE).withColumn("markdown", F.md5("markdown")))
query("compact_markdown", f"""{LATEST} SELECT package_id, version, qualified_name, '### ' || name || {N2} || '**' || {LABEL} || '** in `' || package || '`' || {N2} || summary || {N2} || '```' || {CODE} || chr(10) || signature || chr(10) || '```' AS markdown FROM latest""")(
    lambda s, d: L.compact_markdown(latest(s, d))
)
query("package_markdown", f"""{LATEST}, k AS (SELECT package_id, package, language, kind, list_position(['class', 'function', 'interface', 'typeAlias', 'enum'], kind) AS o, CASE kind WHEN 'class' THEN 'Classes' WHEN 'function' THEN 'Functions' WHEN 'interface' THEN 'Interfaces' WHEN 'typeAlias' THEN 'Types' ELSE 'Enums' END AS t,
    string_agg('- `' || name || CASE WHEN kind = 'function' THEN '()' ELSE '' END || '` - ' || summary, chr(10) ORDER BY ord) AS l FROM latest WHERE kind IN ('class', 'function', 'interface', 'typeAlias', 'enum') GROUP BY ALL)
  SELECT package_id, md5('# ' || package || {N2} || '> ' || CASE WHEN language = 'python' THEN 'Python' ELSE 'JavaScript/TypeScript' END || ' package' || {N2} || '[View in docs]({BASE}/' || language || '/' || replace(package, '_', '-') || ')' || {N2} || string_agg('## ' || t || {N2} || l, {N2} ORDER BY o)) AS markdown FROM k GROUP BY package_id, package, language""")(
    lambda s, d: L.package_markdown(latest(s, d), BASE).withColumn("markdown", F.md5("markdown"))
)

# old paths of each form, and where they lead
FORMS = [
    ("'/python/acme_core/' || p || '.html'", "'/python/acme-core/' || p", "NULL"),
    ("'/python/integrations/acme_' || p || '/x/index.html'", "'/python/acme-' || p || '/x'", "NULL"),
    ("'/python/acme-core/' || p", "NULL", "NULL"),
    ("'/python/api_reference.html'", "'/python'", "NULL"),
    ("'/javascript/classes/_acme_core.load_' || p || '.Item.html'", "'/javascript/acme-core/load/' || p || '/Item'", "NULL"),
    ("'/javascript/modules/core.html'", "'/javascript/acme-core'", "NULL"),
    ("'/javascript/functions/'", "'/javascript'", "NULL"),
    ("'/javascript/acme-core/' || p", "NULL", "NULL"),
    ("'/v0.3/python/core/indexing/acme_core.indexing.' || p || '.html'", "'/python/acme-core/indexing/' || p", "'pkg_py_acme_core'"),
    ("'/v0.3/python/core/guide/' || p || '/'", "'/python/acme-core/guide/' || p", "'pkg_py_acme_core'"),
    ("'/v0.3/python/unknown/' || p", "'/python'", "NULL"),
    ("'/other/' || p", "NULL", "NULL"),
    ("'/javascript/enumerations.html'", "'/javascript'", "NULL"),
]
choose = lambda i: "CASE page_id % " + str(len(FORMS)) + " " + " ".join(f"WHEN {k} THEN {f[i]}" for k, f in enumerate(FORMS)) + " END"
P = "(SELECT page_id, 'p' || CAST(page_id AS STRING) AS p FROM {pages})"
query("legacy_redirects", f"SELECT {choose(0)} AS path, {choose(1)} AS target, {choose(2)} AS package_id FROM {P.format(pages='pages')}")(
    lambda s, d: L.legacy_redirects(s.sql(f"SELECT {choose(0)} AS path FROM {P}", pages=bound(s, d, "pages")), {"core": "acme-core"}, {"core": "acme-core"})
)
query("expand_dotted_paths", with_tables("requests") + r" SELECT path, replace(path, '.', '/') AS target FROM requests")(lambda s, d: L.expand_dotted_paths(bound(s, d, "requests").select("path")))
query("requested_format", with_tables("requests") + """ SELECT event_id, CASE WHEN format = 'md' THEN 'markdown' WHEN format = 'JSON' THEN 'json' WHEN accept = 'text/markdown' THEN 'markdown' WHEN accept = 'application/json' THEN 'json'
  WHEN user_agent IN ('GPTBot/1.1', 'my Cursor ide') THEN 'markdown' WHEN user_agent IN ('curl/8.0', 'python-requests/2') AND NOT contains(coalesce(accept, ''), 'text/html') THEN 'markdown' ELSE 'html' END AS content_format FROM requests""")(
    lambda s, d: L.requested_format(bound(s, d, "requests")).select("event_id", "content_format")
)
query("latency_percentiles", with_tables("requests") + """, w AS (SELECT event_type, floor(duration_ms) AS v FROM requests), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM w)
  SELECT event_type, max(CASE WHEN i = floor(n * 0.5) THEN v END) AS p50, max(CASE WHEN i = floor(n * 0.9) THEN v END) AS p90, max(CASE WHEN i = floor(n * 0.99) THEN v END) AS p99, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS error_rate FROM r GROUP BY event_type""")(
    lambda s, d: L.latency_percentiles(bound(s, d, "requests").withColumn("duration_ms", F.floor("duration_ms").cast("double")), "event_type")
)
