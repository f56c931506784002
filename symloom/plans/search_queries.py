"""Queries for search."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.operators import search as S
from symloom.plans.artifact_queries import LATEST, RECORDS, records
from symloom.plans.bindings import bound
from symloom.plans.lineage import cut
from symloom.plans.registry import query

c = F.col
TOK = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9_]+'), lambda t: t <> '')"
INDEX = f"""{RECORDS}, field AS (SELECT id AS doc, 'title' AS field, {TOK('title')} AS ts FROM rec UNION ALL SELECT id, 'keywords', {TOK("array_to_string(keywords, ' ')")} FROM rec UNION ALL SELECT id, 'excerpt', {TOK('excerpt')} FROM rec),
  post AS (SELECT term, field, doc, CAST(length AS INT) AS length, count(*) AS tf FROM (SELECT doc, field, len(ts) AS length, unnest(ts) AS term FROM field) GROUP BY ALL)"""
query("build_search_index", f"{INDEX} SELECT * FROM post")(lambda s, d: S.build_search_index(records(s, d)))
index = lambda s, d: cut(S.build_search_index(records(s, d)))  # noqa: E731  built once, read by every step of a search


def queries(s, d):
    """Every word of part names, as it is, with its third letter missing, and with another first letter."""
    words = bound(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    slip = F.concat(F.substring("w", 1, 2), F.substr(c("w"), F.lit(4)))
    return words.select(c("w").alias("query_id"), c("w").alias("query")).unionByName(words.select(F.concat("w", F.lit("~")).alias("query_id"), slip.alias("query"))).unionByName(words.select(F.concat("w", F.lit("^")).alias("query_id"), F.concat(F.lit("q"), F.substr(c("w"), F.lit(2))).alias("query")))


ASK = "word AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), ask AS (SELECT w AS query_id, w AS asked FROM word UNION ALL SELECT w || '~', substr(w, 1, 2) || substr(w, 4) FROM word UNION ALL SELECT w || '^', 'q' || substr(w, 2) FROM word)"


def match(tag: str = "", fuzzy: float = 0.2, boosts: str = "CASE field WHEN 'title' THEN 3.0 WHEN 'keywords' THEN 2.0 ELSE 1.0 END", fields: str = "'title', 'keywords', 'excerpt'") -> str:
    """Common table expressions from ``ask`` to ``found`` (query_id, doc, score); names end in ``tag``."""
    return f""", most{tag} AS (SELECT *, CAST(round(length(asked) * {fuzzy}) AS INT) AS k FROM ask{tag}),
  hit{tag} AS (SELECT query_id, asked, term, 1.0 AS w FROM ask{tag} JOIN df ON term = asked
    UNION ALL SELECT query_id, asked, term, 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(asked))) FROM ask{tag} JOIN df ON starts_with(term, asked) AND term <> asked
    UNION ALL SELECT query_id, asked, term, 0.45 * length(term) / (length(term) + levenshtein(asked, term)) FROM most{tag} JOIN df ON k > 0 AND abs(length(term) - length(asked)) <= k AND levenshtein(asked, term) BETWEEN 1 AND k AND NOT starts_with(term, asked)),
  found{tag} AS (SELECT query_id, doc, sum(ln(1 + ((SELECT count(DISTINCT doc) FROM post) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * length / mean)) * w * {boosts}) AS score
    FROM hit{tag} JOIN df USING (term) JOIN post USING (term) JOIN mean USING (field) WHERE field IN ({fields}) GROUP BY ALL)"""


TERMS = ", df AS (SELECT term, count(DISTINCT doc) AS df FROM post GROUP BY term), mean AS (SELECT field, avg(length) AS mean FROM (SELECT DISTINCT doc, field, length FROM post) GROUP BY field)"
FOUND = f"{INDEX}, {ASK}{TERMS}{match()}"
query("search", f"{FOUND} SELECT query_id, doc, round(score, 4) AS score FROM found")(lambda s, d: S.search(queries(s, d), index(s, d)).withColumn("score", F.round("score", 4)))
query("search_filtered", f"""{FOUND}, f AS (SELECT found.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM found JOIN rec ON doc = id WHERE kind = 'class')
  SELECT query_id, rank, doc, round(score, 4) AS score, total FROM f WHERE rank <= 15""")(lambda s, d: S.search_filtered(S.search(queries(s, d), index(s, d)), records(s, d), "class", None, 15).select("query_id", "rank", "doc", F.round("score", 4).alias("score"), "total"))


def names(s, d):
    return bound(s, d, "part").select(c("p_name").alias("query_id"), F.replace(c("p_name"), F.lit(" "), F.lit("_")).alias("name")).distinct()


PARTS = "nm AS (SELECT DISTINCT p_name AS query_id FROM part), ask1 AS (SELECT query_id, replace(query_id, ' ', '_') AS asked FROM nm), ask2 AS (SELECT query_id, replace(query_id, ' ', '') AS asked FROM nm), ask3 AS (SELECT query_id, unnest(string_split(query_id, ' ')) AS asked FROM nm), ask4 AS (SELECT * FROM ask2)"
CONVERTED = f"""{INDEX}, {PARTS}{TERMS}{match('1')}{match('2')}{match('3')}{match('4', 0.1, '10.0', "'title'")},
  one AS (SELECT query_id, url, max(score) AS score, min(title) AS title FROM (SELECT * FROM found1 UNION ALL SELECT * FROM found2 UNION ALL SELECT * FROM found3 UNION ALL SELECT * FROM found4) JOIN rec ON doc = id GROUP BY query_id, url)
  SELECT query_id, url, round(score, 4) AS score, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, url) AS rank FROM one) WHERE rank <= 20"""
query("search_with_conversion", CONVERTED)(lambda s, d: S.search_with_conversion(names(s, d), index(s, d), records(s, d), False).withColumn("score", F.round("score", 4)))
query("substring_search", f"""{LATEST}, {ASK}, hit AS (SELECT query_id, package_id, name, qualified_name, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(name) = asked THEN 0 WHEN starts_with(lower(name), asked) THEN 1 ELSE 2 END, length(name), name, package_id, qualified_name) AS rank
  FROM ask JOIN latest ON contains(lower(name), asked) OR contains(lower(qualified_name), asked)) SELECT * FROM hit WHERE rank <= 10""")(lambda s, d: S.substring_search(queries(s, d), bound(s, d, "latest")))
