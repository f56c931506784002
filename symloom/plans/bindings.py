"""Symbol, release, page and log tables bound to the star-schema tables, in SQL that Spark and DuckDB both read.

A name in braces is a table: a given one, or another bound one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.plans.lineage import kept

TABLES: dict[str, str] = {
    # one row for each (part, year of shipment): a symbol of a release
    "flat": """
        SELECT 'pkg_' || eco || '_' || lower(replace(p_brand, '#', '_')) AS package_id,
          lower(replace(p_brand, '#', '_')) AS package, eco,
          CASE WHEN eco = 'py' THEN 'python' ELSE 'javascript' END AS language,
          '1.' || CAST(y - 1995 AS STRING) || '.0' AS version, CAST(y - 1995 AS INT) AS minor, p_partkey AS ord,
          kind, name, kind || '_' || name AS id,
          CASE WHEN eco = 'py' THEN 'acme_' || lower(replace(p_brand, '#', '_')) || '.' ELSE '' END || lower(p_type) || '.' || name AS qualified_name,
          name || '(x: ' || CAST(CAST(q AS INT) AS STRING) || '): ' || status AS signature,
          CASE p_partkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN NULL ELSE 'public' END AS visibility,
          'The ' || p_name || ' of ' || p_type || '. Kept since ' || CAST(y AS STRING) || '.' AS summary,
          returned = 1 AS deprecated, status AS returns_type, 'Base' || flag AS extends_name,
          'm' || CAST(s1 AS STRING) AS m1_name, CASE WHEN s1 % 4 = 0 THEN 'private' ELSE 'public' END AS m1_vis, CASE WHEN (s1 + y) % 3 = 0 THEN 'property' ELSE 'method' END AS m1_kind,
          'm' || CAST(s2 AS STRING) AS m2_name, CASE WHEN (s2 + y) % 4 = 0 THEN 'protected' ELSE 'public' END AS m2_vis, 'method' AS m2_kind,
          flag AS p1_type, status AS p2_type, 1 + CAST(n % 2 AS INT) AS n_params, y % 2 = 0 AS p1_required,
          CASE p_partkey % 6 WHEN 0 THEN '/tmp/b/extracted/libs/' || eco || '/src/' || name || '.py' WHEN 1 THEN '../../src/' || name || '.ts' WHEN 2 THEN '/home/x/src/' || name || '.ts'
            WHEN 3 THEN '/opt/node_modules/' || name || '.d.ts' WHEN 4 THEN 'lib/' || name || '.py' ELSE '/abs/' || name || '.py' END AS source_path
        FROM (
          SELECT p.*, x.*, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN 'py' ELSE 'js' END AS eco,
            CASE p_size % 8 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' WHEN 4 THEN 'enum' WHEN 5 THEN 'module' WHEN 6 THEN 'typeAlias' ELSE 'parameter' END AS kind,
            CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)
              ELSE split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || CAST(p_partkey AS STRING) END AS name
          FROM {part} p JOIN (
            SELECT l_partkey, CAST(year(l_shipdate) AS INT) AS y, max(l_quantity) AS q, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, min(l_returnflag) AS flag,
              max(l_linestatus) AS status, min(l_suppkey) AS s1, max(l_suppkey) AS s2, count(*) AS n
            FROM {lineitem} GROUP BY l_partkey, CAST(year(l_shipdate) AS INT)
          ) x ON p.p_partkey = x.l_partkey WHERE (p.p_partkey + x.y) % 7 <> 0
        ) s""",
    "latest": "SELECT * FROM {flat} WHERE minor = 6",
    "releases": """
        SELECT package_id, version, 1 AS major, minor, 0 AS patch, md5(package_id || version) AS sha, CAST(1995 + minor AS STRING) || '-12-31' AS release_date
        FROM (SELECT DISTINCT package_id, version, minor FROM {flat}) r""",
    "packages": """
        SELECT DISTINCT package_id, package AS published_name, 'Brand ' || package AS display_name, language,
          CASE WHEN language = 'python' THEN 'core' ELSE 'web' END AS project, CAST(substr(p_brand, 7) AS INT) AS ord
        FROM {flat} JOIN (SELECT DISTINCT p_brand FROM {part}) b ON package = lower(replace(p_brand, '#', '_'))""",
    "tags": """
        SELECT 'repo' || CAST(o_custkey % 10 AS STRING) AS repo, o_orderkey AS tag_ord, md5(CAST(o_orderkey AS STRING)) AS sha,
          CASE o_orderkey % 6 WHEN 0 THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '@' WHEN 1 THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '==' WHEN 2 THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '-v' WHEN 3 THEN 'v' WHEN 4 THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '-' ELSE '' END
            || CAST(year(o_orderdate) - 1995 AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN '-rc.1' WHEN o_orderkey % 11 = 0 THEN '.x' ELSE '' END AS tag
        FROM {orders}""",
    "tag_patterns": """
        SELECT DISTINCT 'repo' || CAST(o_custkey % 10 AS STRING) AS repo, 'lib' || CAST(o_custkey % 10 AS STRING) || '_' || k AS package_id,
          CASE k WHEN 'a' THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '@*' WHEN 'b' THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '==*' WHEN 'c' THEN 'lib' || CAST(o_custkey % 10 AS STRING) || '-v*' WHEN 'd' THEN 'v*' ELSE '*' END AS tag_pattern
        FROM {orders}, (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) AS v(k)""",
    "edges": "SELECT p_partkey AS child, CAST(floor(p_partkey / 2) AS BIGINT) AS base FROM {part} WHERE p_partkey > 0",
    "builds": """
        SELECT 'nation_' || CAST(s_nationkey AS STRING) AS package_id, CASE WHEN n_regionkey % 2 = 0 THEN 'core' ELSE 'web' END AS project,
          CASE WHEN s_nationkey % 3 = 0 THEN 'javascript' ELSE 'python' END AS language, substr(md5(s_name), 1, 16) AS build_id,
          CAST(s_suppkey AS STRING) || '.0.0' AS version, md5(CAST(s_suppkey AS STRING)) AS sha, s_suppkey AS created_at
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "requests": """
        SELECT event_id, '/' || CASE user_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'go' END || '/acme-' || event_type || '/mod.' || event_type || '.Item' || CAST(event_id % 100 AS STRING) AS path,
          CASE event_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'JSON' ELSE NULL END AS format,
          CASE event_id % 4 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/html,application/json' ELSE NULL END AS accept,
          CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'curl/8.0' WHEN 2 THEN 'GPTBot/1.1' WHEN 3 THEN 'python-requests/2' WHEN 4 THEN 'my Cursor ide' ELSE NULL END AS user_agent,
          value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_type
        FROM {events}""",
    "doc_files": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'src/oss/acme/' ELSE 'docs/' || source || '/' END || CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id AS STRING) || '/index' ELSE 'page' || CAST(doc_id AS STRING) END || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.mdx' END AS path,
          CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'title: "Page ' || CAST(doc_id AS STRING) || '"' || chr(10) || 'description: About ' || lang || chr(10) || '---' || chr(10) ELSE '' END
          || '# Guide ' || CAST(doc_id AS STRING) || ' to A/B testing!' || chr(10) || 'About ' || source || chr(10)
          || '## Using ' || source || '  now' || chr(10) || '```python' || chr(10) || 'from acme_' || source || '.core import Item' || CAST(doc_id % 50 AS STRING) || ', Tool as T' || chr(10) || '```' || chr(10)
          || 'See [the item](#acme.core.Item' || CAST(doc_id % 50 AS STRING) || ') and [site](https://x.org/a) ![pic](img/a.png) or [readme](docs/readme.md).' || chr(10)
          || '### More' || chr(10) || '```ts' || chr(10) || 'import {{ Thing' || CAST(doc_id % 40 AS STRING) || ', type Kind as K }} from "@acme/' || source || '/sub";' || chr(10) || 'import Def from "@acme/' || source || '";' || chr(10) || '```' || chr(10) || text || chr(10) AS content
        FROM {documents}""",
    # pages with empty, titled, indented and unclosed fences, and clauses over several lines, around the whole texts
    "varied_files": """
        SELECT doc_id, 'v/' || CAST(doc_id AS STRING) || '.md' AS path,
          'Intro' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '```' || chr(10) || '```' || chr(10) ELSE '' END
          || '```python title="x"' || chr(10) || 'from acme.m' || CAST(doc_id % 30 AS STRING) || ' import (' || chr(10) || '    Alpha' || CAST(doc_id % 70 AS STRING) || ',' || chr(10) || '    Beta as B,' || chr(10) || ')' || chr(10) || 'import os' || chr(10) || 'from .local import no' || chr(10) || '```' || chr(10)
          || CASE WHEN doc_id % 3 = 0 THEN '  ```python' || chr(10) || 'from acme.indented import No' || chr(10) || '  ```' || chr(10) ELSE '' END
          || '```TS' || chr(10) || 'import {{ Gamma' || CAST(doc_id % 20 AS STRING) || ' as G,' || chr(10) || '  Delta }} from "@acme/x";' || chr(10) || 'import * as ns from "n";' || chr(10) || 'import type Kind, {{ Own }} from "@acme/t";' || chr(10) || 'import Rel from "./rel";' || chr(10) || '```  ' || chr(10)
          || text || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '```py' || chr(10) || 'from acme.last import Omega' || chr(10) || '```' || chr(10) ELSE '' END
          || CASE WHEN doc_id % 5 = 0 THEN '```python' || chr(10) || 'from acme.open import Never' ELSE '' END AS content
        FROM {documents}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", TABLES[name])


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound table, or a given one."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TABLES[name], **{t: bound(spark, sf_dir, t) for t in _needs(name)})


def with_tables(*names: str) -> str:
    """The same tables as common table expressions, in front of a query; a trailing comma can be added by the caller."""
    done: list[str] = []

    def add(name: str) -> None:
        for t in _needs(name):
            if t in TABLES and t not in done:
                add(t)
        if name not in done:
            done.append(name)

    for name in names:
        if name in TABLES:
            add(name)
    return "WITH RECURSIVE none_needed AS (SELECT 1 AS one)" if not done else "WITH RECURSIVE " + ", ".join(f"{n} AS ({TABLES[n].format(**{t: t for t in _needs(n)})})" for n in done)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, releases) from one computation of the flat table."""
    flat = kept(bound(spark, sf_dir, "flat"))
    return nested(flat), spark.sql(TABLES["releases"], flat=flat)


def symbols(spark: SparkSession, sf_dir: str, name: str = "flat") -> DataFrame:
    return nested(bound(spark, sf_dir, name))


def nested(flat: DataFrame) -> DataFrame:
    """The symbol table with nested columns made from the flat ones, which stay."""
    member = lambda i: F.struct(F.col(f"m{i}_name").alias("name"), F.col(f"m{i}_kind").alias("kind"), F.col(f"m{i}_vis").alias("visibility"))
    param = lambda n, t, req: F.struct(F.lit(n).alias("name"), F.col(t).alias("type"), req.alias("required"), F.lit(None).cast("string").alias("default"))
    both = F.array(param("first", "p1_type", F.col("p1_required")), param("second", "p2_type", F.lit(False)))
    return flat.withColumns(
        {
            "members": F.when(F.col("m1_name") == F.col("m2_name"), F.array(member(1))).otherwise(F.array(member(1), member(2))),
            "params": F.slice(both, 1, F.col("n_params")),
            "extends": F.array("extends_name"),
            "implements": F.array().cast("array<string>"),
            "type_params": F.when(F.col("kind").isin("class", "interface"), F.array(F.struct(F.lit("T").alias("name"), F.col("p1_type").alias("constraint"), F.lit(None).cast("string").alias("default")))),
            "source_line": (F.col("ord") % 100 + 1).cast("int"),
            "deprecation": F.when(F.col("deprecated"), F.struct(F.concat(F.lit("Left in "), "version").alias("message"), F.concat(F.lit("new_"), "name").alias("replacement"))),
        }
    )
