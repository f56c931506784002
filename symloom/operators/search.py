"""Search: a postings table, ranked queries with prefixes and spelling slips, and substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.functions import names as N
from symloom.operators.substrings import holding

# Weights of the fields, and the share of a term's letters that may differ.
BOOSTS = {"title": 3.0, "keywords": 2.0, "excerpt": 1.0}
FUZZY = 0.2
K1, B = 1.2, 0.7
#: Documents in one share of a frequent term's postings, and of the scores.
SHARE = 4096


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def build_search_index(records: DataFrame) -> DataFrame:
    """Postings (term, field, doc, tf, length) over title, excerpt and keywords of the records (id)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.array_join("keywords", " ") if f == "keywords" else F.col(f)).alias("terms")) for f in BOOSTS])
    each = records.select(F.col("id").alias("doc"), F.explode(fields).alias("f")).select("doc", "f.field", F.size("f.terms").alias("length"), F.explode("f.terms").alias("term"))
    return each.groupBy("term", "field", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))


def _slips(asked: DataFrame, terms: DataFrame, fuzzy: float) -> DataFrame:
    """(asked, term, d): terms within the edit distance d of round(length x fuzzy), but equal ones.

    Of a word with k slips, cut into k + 1 pieces, some piece stands unchanged in the other word: moved by no more
    places than there are pieces before it, and no more than pieces after it allow for the words' lengths. So words meet by equality on (length asked for, piece number, piece): the pieces of what is asked, and the
    substrings of the terms where these pieces could stand.
    """
    most = lambda size: f"cast(round(({size}) * {fuzzy}) AS int)"
    start = lambda size, i, k: f"cast(floor(({i}) * ({size}) / (({k}) + 1)) AS int)"
    pieces = asked.select("asked").distinct().withColumn("size", F.length("asked")).withColumn("most", F.expr(most("size"))).filter("most > 0")
    pieces = pieces.withColumn("p", F.explode(F.expr(f"transform(sequence(0, most), i -> struct(i, substr(asked, {start('size', 'i', 'most')} + 1, {start('size', 'i + 1', 'most')} - {start('size', 'i', 'most')}) AS piece))")))
    sizes = f"filter(sequence(greatest(1, cast(floor(length(term) / {1 + fuzzy}) AS int) - 1), cast(ceil(length(term) / {1 - fuzzy}) AS int) + 1), n -> {most('n')} > 0 AND abs(n - length(term)) <= {most('n')})"
    begin, length = start("n", "i", most("n")), f"{start('n', 'i + 1', most('n'))} - {start('n', 'i', most('n'))}"
    k, ahead = most("n"), "(length(term) - n)"
    least, last = f"greatest(-i, {ahead} - ({k} - i))", f"least(i, {ahead} + {k} - i)"
    shifts = f"filter(sequence(-{k}, {k}), s -> s >= {least} AND s <= {last} AND {begin} + s >= 0 AND {begin} + s + {length} <= length(term))"
    places = f"flatten(transform(sequence(0, {k}), i -> transform({shifts}, s -> struct(i, substr(term, {begin} + s + 1, {length}) AS piece))))"
    sized = terms.select("term", F.explode(F.expr(sizes)).alias("n")).join(F.broadcast(pieces.select(F.col("size").alias("n")).distinct()), "n")  # lengths that are asked for, a few
    stand = sized.select("term", F.col("n").alias("size"), F.explode(F.expr(places)).alias("p")).select("term", "size", "p.i", "p.piece")
    met = pieces.select("asked", "size", "most", "p.i", "p.piece").join(stand, ["size", "i", "piece"]).select("asked", "most", "term").distinct()
    return met.withColumn("d", F.levenshtein("asked", "term")).filter((F.col("d") <= F.col("most")) & (F.col("d") > 0)).select("asked", "term", "d")


def _matches(asked: DataFrame, terms: DataFrame, fuzzy: float) -> DataFrame:
    """(asked, term, df, weight) for distinct words: exact terms 1, longer terms with the same beginning, terms within the edit distance.

    Beginnings meet by equality on every prefix of the index terms that some query has, slips by the pieces that they
    leave whole, so no term is compared with the whole vocabulary.
    """
    exact = asked.join(terms.withColumn("asked", F.col("term")), "asked").select("asked", "term", "df", F.lit(1.0).alias("weight"))
    heads = terms.select("term", "df", F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substr(F.col("term"), F.lit(1), i))).alias("asked")).filter(F.length("term") > 1)
    prefix = asked.join(heads, "asked").select("asked", "term", "df", (0.375 * F.length("term") / (F.length("term") + 0.3 * (F.length("term") - F.length("asked")))).alias("weight"))
    slips = _slips(asked, terms, fuzzy).filter(~F.startswith(F.col("term"), F.col("asked"))).join(terms, "term")
    fuzzy_rows = slips.select("asked", "term", "df", (0.45 * F.length("term") / (F.length("term") + F.col("d"))).alias("weight"))
    return exact.unionByName(prefix).unionByName(fuzzy_rows)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("asked"))


def _sizes(index: DataFrame, fields: dict[str, float]) -> tuple[int, dict[str, float]]:
    """The number of documents, and the mean length of each field: one row."""
    lengths = index.groupBy("doc").agg(*[F.max(F.when(F.col("field") == f, F.col("length"))).alias(f) for f in fields])
    docs, *averages = lengths.agg(F.count(F.lit(1)), *[F.avg(f) for f in fields]).first()
    return docs, {f: mean for f, mean in zip(fields, averages, strict=True) if mean is not None}


def _parts(words: DataFrame, index: DataFrame, docs: int, means: dict[str, float], boosts: dict[str, float], fuzzy: float) -> DataFrame:
    """(asked, doc, score): what each term and field of a document adds to the score of a distinct word (asked).

    The postings of a term in more than ``SHARE`` documents are dealt by document into shares, so that no task gets them all.
    """
    terms = index.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    shares = F.ceil(F.col("df") / SHARE)
    frequent = terms.filter(F.col("df") > SHARE).select("term", shares.alias("shares"))  # a row for each SHARE postings at most
    share = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("shares")), F.lit(0).cast("long"))
    postings = index.filter(F.col("field").isin(*boosts)).join(F.broadcast(frequent), "term", "left").withColumn("share", share)
    matches = _matches(words, terms, fuzzy).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    table = lambda d: F.create_map(*[F.lit(x) for kv in (d or {"": 1.0}).items() for x in kv])
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean, weight = F.element_at(table(means), F.col("field")), F.element_at(table(boosts), F.col("field"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)) * F.col("weight") * weight
    return matches.join(postings, ["term", "share"]).select("asked", "doc", part.alias("score"))


def _summed(asked: DataFrame, parts: DataFrame, docs: int, on: list[str]) -> DataFrame:
    """(query_id, doc, score): parts are dealt by document, in as many shares as the documents need, and summed to queries there."""
    dealt = parts.repartition(docs // SHARE + 1, "doc")
    return asked.join(dealt, on).groupBy("query_id", "doc").agg(F.sum("score").alias("score"))


def search(queries: DataFrame, index: DataFrame, boosts: dict[str, float] = BOOSTS, fuzzy: float = FUZZY) -> DataFrame:
    """(query_id, doc, score): any term may match; BM25 with field weights, summed over terms and fields.

    Words meet the postings once for all queries that have them.
    """
    asked, (docs, means) = _asked(queries), _sizes(index, boosts)
    return _summed(asked, _parts(asked.select("asked").distinct(), index, docs, means, boosts, fuzzy), docs, ["asked"])


def top(found: DataFrame, n: int, *order) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(*(order or (F.desc(F.round("score", 9)), "doc")))
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def search_filtered(found: DataFrame, records: DataFrame, kind: str | None = None, package: str | None = None, limit: int = 20) -> DataFrame:
    """Ranked hits of one kind and package, at most 50, with the number of all such hits."""
    chosen = records.select(F.col("id").alias("doc"), "kind", "package_id")
    chosen = chosen.filter((F.col("kind") == kind) if kind else F.lit(True)).filter((F.col("package_id") == package) if package else F.lit(True))
    kept = found.join(chosen, "doc")
    totals = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return top(kept, min(limit, 50)).join(totals, "query_id")


def search_with_conversion(names: DataFrame, index: DataFrame, records: DataFrame, to_python: bool, limit: int = 20) -> DataFrame:
    """names (query_id, name): four searches (name, other convention, its words, titles only); the best score of each page."""
    other = N.camel_to_snake(F.col("name")) if to_python else N.snake_to_camel(F.col("name"))
    asks = F.array(F.col("name"), other, F.array_join(N.word_parts(F.col("name")), " "), other)
    four = names.select("query_id", F.posexplode(asks).alias("n", "query")).select(F.struct("query_id", "n").alias("query_id"), "query")
    asked, (docs, means) = _asked(four).withColumn("titles", F.col("query_id.n") == 3), _sizes(index, BOOSTS)
    parts = lambda titles, boosts, fuzzy: _parts(asked.filter(F.col("titles") == titles).select("asked").distinct(), index, docs, means, boosts, fuzzy).withColumn("titles", F.lit(titles))
    both = parts(False, BOOSTS, FUZZY).unionByName(parts(True, {"title": 10.0}, 0.1))
    found = _summed(asked, both, docs, ["asked", "titles"]).withColumn("query_id", F.col("query_id.query_id"))
    paged = found.join(records.select(F.col("id").alias("doc"), "url", "title"), "doc")
    best = paged.groupBy("query_id", "url").agg(F.max("score").alias("score"), F.min("title").alias("title"))
    return top(best, limit, F.desc(F.round("score", 9)), "url")


def substring_search(queries: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """queries (query_id, query) with symbols whose name or qualified name holds them: exact names, then beginnings, then short names.

    Distinct queries meet distinct names by their rarest part (``holding``); rows are joined to what they hold. An
    empty query is held by every name.
    """
    asked = queries.select("query_id", F.lower("query").alias("held")).distinct()
    low, full = F.lower("name"), F.lower("qualified_name")
    named = symbols.select("package_id", "name", "qualified_name", F.concat_ws("\n", low, full).alias("holder"))
    pairs = holding(asked, named, [])
    hits = asked.join(pairs, "held").join(named, "holder").filter(F.contains(low, F.col("held")) | F.contains(full, F.col("held")))
    order = F.when(F.lower("name") == F.col("held"), 0).when(F.startswith(F.lower("name"), F.col("held")), 1).otherwise(2)
    return top(hits, max(1, min(limit, 50)), order, F.length("name"), "name", "package_id", "qualified_name").drop("held", "holder")
