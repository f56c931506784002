"""Search, listings of parts, and look-ups, against brute force."""

import hashlib
import math
import random
import statistics

from pyspark.sql import functions as F

from symloom.functions import names as N
from symloom.operators import history as H
from symloom.operators import search as S
from symloom.operators import xref as X


def test_slips_lose_nothing(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 16))) for _ in range(150)}
    words |= {w[:i] + r.choice("abc") + w[i + r.randint(0, 1) :] for w in words for i in [r.randint(0, len(w))]} | {w[1:] for w in words if len(w) > 1}
    asked = spark.createDataFrame([(w,) for w in words], "asked string")
    terms = asked.withColumnRenamed("asked", "term")
    most = F.round(F.length("asked") * 0.2).cast("int")
    plain = asked.join(terms, F.lit(True)).withColumn("d", F.levenshtein("asked", "term")).filter((F.col("d") > 0) & (F.col("d") <= most)).select("asked", "term", "d")
    assert sorted(map(tuple, S._slips(asked, terms, 0.2).collect())) == sorted(map(tuple, plain.collect()))


def test_first_letter_may_be_wrong(spark):
    records = spark.createDataFrame([("1", "Loader", "", ["x"]), ("2", "Reader", "", ["y"])], "id string, title string, excerpt string, keywords array<string>")
    index = S.build_search_index(records)
    asked = spark.createDataFrame([("q", "xoader"), ("e", "")], "query_id string, query string")
    assert {(r["query_id"], r["doc"]) for r in S.search(asked, index).collect()} == {("q", "1")}


def _most_read(spark, job):
    """Most rows of a shuffle that one task of the job reads, where only small tables are broadcast and partitions stay as dealt."""
    context, store = spark.sparkContext, spark._jsc.sc().statusStore()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    context.setJobGroup("most read", "")
    try:
        job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k in settings:
            spark.conf.unset(k)
    most, tracker = 0, context.statusTracker()
    for stage in {s for j in tracker.getJobIdsForGroup("most read") for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        done = [m.get() for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())) if m.isDefined()]
        most = max([most, *(m.shuffleReadMetrics().recordsRead() for m in done)])
    return most


def test_no_task_reads_all_postings_of_a_term(spark, monkeypatch):
    """A term of all documents: its postings are dealt to several tasks, and the scores stay the same."""
    monkeypatch.setattr(S, "SHARE", 100, raising=False)
    n = 3000
    each = ["'title' AS field", "cast(id AS string) AS doc", "cast(1 + id % 3 AS int) AS length", "1L AS tf"]
    common, rare = spark.range(n).selectExpr("'loader' AS term", *each), spark.range(n // 3).selectExpr("concat('loader', id) AS term", *each)
    index = common.unionByName(rare).localCheckpoint()
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(["load", "loader", "loadex"])], "query_id string, query string")
    found = []
    most = _most_read(spark, lambda: found.extend(S.search(asked, index).collect()))
    assert (len(found), most < n) == (3 * n, True), most


def test_scores_against_all_pairs(spark, monkeypatch):
    """Shares of every size give the scores of the plain formula."""
    r = random.Random(7)
    words = ["load", "loader", "loaded", "reader", "read", "plate", "late", "plates", "a"]
    some = lambda k: [r.choice(words) for _ in range(r.randint(0, k))]
    rows = [(str(i), " ".join(some(3)), " ".join(some(6)), some(4)) for i in range(60)]
    index = S.build_search_index(spark.createDataFrame(rows, "id string, title string, excerpt string, keywords array<string>")).localCheckpoint()
    asks = [(str(i), " ".join(some(4))) for i in range(12)] + [("x", "loadr plat"), ("y", "nothing")]
    asked = spark.createDataFrame(asks, "query_id string, query string")
    texts = [(i, {"title": t.split(), "excerpt": e.split(), "keywords": k}) for i, t, e, k in rows]
    texts = [(i, fields) for i, fields in texts if any(fields.values())]
    df = {w: sum(any(w in ts for ts in fields.values()) for _, fields in texts) for w in words}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def weight(word, term, fuzzy):
        d, size = distance(word, term), len(term)
        if word == term:
            return 1.0
        if term.startswith(word):
            return 0.375 * size / (size + 0.3 * (size - len(word)))
        return 0.45 * size / (size + d) if d <= math.floor(len(word) * fuzzy + 0.5) else 0.0

    for share, boosts, fuzzy in ((1, S.BOOSTS, 0.2), (7, {"title": 10.0}, 0.1), (4096, S.BOOSTS, 0.2)):
        monkeypatch.setattr(S, "SHARE", share, raising=False)
        mean = {f: statistics.mean([len(fields[f]) for _, fields in texts if fields[f]]) for f in boosts}
        want = {}
        for q, query in asks:
            for i, fields in texts:
                for f, boost in boosts.items():
                    for term in set(fields[f]):
                        tf, idf = fields[f].count(term), math.log(1 + (len(texts) - df[term] + 0.5) / (df[term] + 0.5))
                        part = idf * tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len(fields[f]) / mean[f])) * boost * sum(weight(w, term, fuzzy) for w in set(query.split()))
                        if part:
                            want[q, i] = want.get((q, i), 0) + part
        got = {(x["query_id"], x["doc"]): x["score"] for x in S.search(asked, index, boosts, fuzzy).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_substring_search(spark):
    r = random.Random(2)
    names = [("p", "".join(r.choice("ab_") for _ in range(r.randint(1, 8)))) for _ in range(200)]
    table = spark.createDataFrame([(p, n, f"mod.{n}x") for p, n in set(names)], "package_id string, name string, qualified_name string")
    asked = [(str(i), q) for i, q in enumerate(["a", "ab", "ABB", "d.a", "", "b_ab", "zz"])]
    got = {}
    for x in S.substring_search(spark.createDataFrame(asked, "query_id string, query string"), table, 50).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["name"]
    for i, q in asked:
        low = q.lower()
        held = sorted({n for _, n in names if low in n or low in f"mod.{n}x"}, key=lambda n: (0 if n == low else 1 if n.startswith(low) else 2, len(n), n))
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == held[:50]


def test_replacements_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abA") for _ in range(r.randint(1, 6)))
    gone = {f"x.{word()}" for _ in range(60)}
    there = [("p", "2", f"y{i}.{word()}", i) for i in range(120)]
    removed = spark.createDataFrame([("p", "2", g) for g in gone], "package_id string, version string, qualified_name string")
    got = {x["qualified_name"]: x["replacement"] for x in H.replacement_candidates(removed, spark.createDataFrame(there, "package_id string, version string, qualified_name string, ord int")).collect()}
    base = lambda n: n.split(".")[-1].lower()
    want = {}
    for g in gone:
        fit = [n for _, _, n, _ in there if base(g) in base(n) or base(n) in base(g)]
        if fit:
            want[g] = fit[0]
    assert got == want


def test_parts_hold_the_key_of_what_a_name_holds(spark):
    df = spark.createDataFrame([("loader", "dataloader"), ("ab", "cab"), ("", "x"), ("abc", "abc")], "short string, long string")
    assert all(x[0] for x in df.select(F.forall(N.own_parts(F.col("short")), lambda p: F.array_contains(N.name_parts(F.col("long")), p))).collect())


def test_cross_language_against_all_pairs(spark):
    """The best target is that of all pairs scored, also where one name holds the other inside a word."""
    r = random.Random(2)
    made = lambda: "".join(r.choice(["chat", "Open", "AI", "load", "er", "_", "pdf", "Text", "X", "item", "Item"]) for _ in range(r.randint(1, 4)))
    names = sorted({made() for _ in range(120)} | {"ChatOpenAI", "loader", "ab", "a", ""})
    titles = sorted({(made(), r.choice("pq")) for _ in range(120)} | {("openai", "p"), ("pdfloader", "p"), ("TextLoaderX", "p"), ("a", "q"), ("", "q")})
    asks = [(i, n, n, r.choice(["home", "away", None]), "python", "javascript") for i, n in enumerate(names)]
    requests = spark.createDataFrame(asks, "request_id long, path string, name string, package string, source_language string, target_language string")
    targets = spark.createDataFrame([("javascript", p, t, f"/{p}/{k}") for k, (t, p) in enumerate(titles)], "language string, package string, title string, url string")
    mappings = spark.createDataFrame([("python", "javascript", "package", "home", "q")], "source_language string, target_language string, kind string, source string, target string")
    pairs = requests.join(targets, F.col("target_language") == F.col("language")).withColumn("score", N.match_score(F.col("name"), F.col("title")))
    every = pairs.select("request_id", requests["package"].alias("asker"), targets["package"].alias("owner"), "title", "url", "score").collect()
    for threshold in (0.6, 0.3):
        want = {}
        for x in every:
            if x["score"] >= threshold:
                key = (x["asker"] == "home" and x["owner"] == "q", x["score"], x["url"])
                want[x["request_id"]] = max(want.get(x["request_id"], key), key)
        got = X.resolve_cross_language(requests, targets, mappings, threshold).collect()
        found = {x["request_id"]: (x["url"], x["score"]) for x in got if x["match_type"] in ("exact", "normalized", "fuzzy")}
        assert len(got) == len(names) and found == {k: (v[2], v[1]) for k, v in want.items()}
    probe = spark.createDataFrame([(1, "x", "ChatOpenAI", None, "python", "javascript"), (2, "y", "loader", None, "python", "javascript")], requests.schema)
    few = targets.filter("title IN ('openai', 'pdfloader', 'TextLoaderX')")
    assert {x["request_id"]: round(x["score"], 3) for x in X.resolve_cross_language(probe, few, mappings).collect()} == {1: 0.62, 2: 0.633}


def test_common_parts_bring_nobody_together(spark):
    """Names that share a common part meet by their rare ones: postings of the key are as few as its holders."""
    from symloom.operators.substrings import holding

    held = spark.createDataFrame([("g", f"handler{i}") for i in range(300)] + [("g", None), (None, "x")], "k string, held string")
    holders = spark.createDataFrame([("g", f"myhandler{i}x") for i in range(300)] + [("h", "handler1")], "k string, holder string")
    pairs = {(r["held"], r["holder"]) for r in holding(held, holders, ["k"]).collect()}
    assert pairs == {(f"handler{i}", f"myhandler{j}x") for i in range(300) for j in range(300) if f"handler{i}" in f"myhandler{j}x"}


def test_names_meet_by_parts_as_long_as_they_are(spark, monkeypatch):
    """Numbered names of few words: what one name meets stays the same when the names become more."""
    from symloom.operators import substrings

    met = {}
    for n in (1000, 8000):
        names = [("g", f"{w}_{i}") for i in range(n) for w in (("large_ring", "hot_bolt")[i % 2],)]
        probe = spark.createDataFrame(names[-100:], "k string, held string")
        holders = spark.createDataFrame(names, "k string, holder string")
        with monkeypatch.context() as m:
            m.setattr(substrings.F, "contains", lambda a, b: F.lit(True))  # all that meet
            met[n] = substrings.holding(probe, holders, ["k"]).count()
        assert {(r["held"], r["holder"]) for r in substrings.holding(probe, holders, ["k"]).collect()} == {(x, y) for _, x in names[-100:] for _, y in names if x in y}
    assert met[8000] <= 2 * met[1000]


def test_holding_names_of_all_lengths(spark):
    from symloom.operators.substrings import holding

    r = random.Random(5)
    texts = sorted({"".join(r.choice("ab_") for _ in range(r.randint(0, 90))) for _ in range(150)} | {"", "a", "ab", "é" * 13})
    names = sorted({t[i : i + r.randint(0, 80)] for t in texts for i in range(0, len(t), 17)} | set(texts))
    held, holders = spark.createDataFrame([(x,) for x in names], "held string"), spark.createDataFrame([(x,) for x in texts], "holder string")
    assert {(p["held"], p["holder"]) for p in holding(held, holders, []).collect()} == {(x, y) for x in names for y in texts if x in y}


def _given_to_driver(spark, job):
    """Bytes of what the tasks of a job return to the driver; tables to broadcast are collected there."""
    context, store, tracker = spark.sparkContext, spark._jsc.sc().statusStore(), spark.sparkContext.statusTracker()

    def latest():
        context.setJobGroup("latest", "")
        context.parallelize([0], 1).count()
        context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty()
        return max(s for j in tracker.getJobIdsForGroup("latest") for s in tracker.getJobInfo(j).stageIds)

    first = latest()
    job()
    lists = [store.taskList(stage, 0, 1000) for stage in range(first + 1, latest())]
    done = [m.get() for tasks in lists for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())) if m.isDefined()]
    return sum(m.resultSize() for m in done)


def test_postings_are_not_broadcast(spark, monkeypatch):
    """Names small enough for a broadcast, but not their parts: those do not pass through the driver."""
    from symloom.operators import substrings

    names = [f"name_{hashlib.sha1(str(i).encode()).hexdigest()}" for i in range(6000)]
    asks = ["name_a", "name_0b", "zz", "abcde"]
    holders, held = spark.createDataFrame([(n,) for n in names], "holder string").localCheckpoint(), spark.createDataFrame([(a,) for a in asks], "held string")
    want = {(a, n) for a in asks for n in names if a in n}
    for few in (50_000, 0):
        monkeypatch.setattr(substrings, "FEW", few, raising=False)
        counts = []
        given = _given_to_driver(spark, lambda: counts.append(substrings.holding(held, holders, []).count()))
        assert (counts, given < 500_000) == ([len(want)], True), given
        assert {(r["held"], r["holder"]) for r in substrings.holding(held, holders, []).collect()} == want
