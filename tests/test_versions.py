"""The order of versions, and all that goes by it."""

import random

from pyspark.sql import functions as F

from symloom.functions.versions import version_key
from symloom.operators import history as H
from symloom.operators import releases as R
from symloom.operators.xref import ancestors, resolve_bases

#: Old to new; equal in all but the build part where a list holds several.
LINE = ["0.0.9", "0.9.0-alpha", "0.9.0", "1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alpha-b", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", ["1", "1.0", "1.0.0", "1.0.0+b1"], "1.0.0.1", "1.0.2", "1.0.10", "1.2", "1.10.0", "2.0.0-rc", "2.0.0", "10.0.0", "99999999999999999999.0.0", "1.x", "unknown", "v1.0.0"]
FLAT = [v for x in LINE for v in ([x] if isinstance(x, str) else x)]


def test_version_key(spark):
    shuffled = FLAT[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(v,) for v in [*shuffled, None]], "version string")
    assert [r[0] for r in df.filter("version IS NOT NULL").orderBy(version_key("version")).collect()] == FLAT
    keys = {r[0]: r[1] for r in df.select("version", version_key("version", ties=False)).collect()}
    assert keys[None] is None and len({keys[v] for v in LINE[13]}) == 1 and len(set(keys.values())) == len(LINE) + 1


def test_operators_go_by_it(spark):
    releases = spark.createDataFrame([("p", v) for v in FLAT], "package_id string, version string")
    pairs = {r["version"]: r["previous_version"] for r in R.release_pairs(releases).collect()}
    assert [pairs[v] for v in FLAT] == [None, *FLAT[:-1]]
    assert R.newest_in_series(releases, "1.0.0").first()["version"] == "1.0.0.1" and R.newest_in_series(releases, "1.0.0-").first()["version"] == "1.0.0-rc.1"
    rows = [("p", v, "a", change, f"m{k}", None, None, None) for k, v in enumerate(FLAT[::-1]) for change in ("modified", "deprecated")]
    history = spark.createDataFrame(rows, "package_id string, version string, qualified_name string, change string, message string, replacement string, release_date string, snapshot_after struct<x:int>")
    assert H.modified_in(history).first()["versions"] == FLAT
    assert H.deprecated_since(history).first()["since"] == FLAT[0]
    told = H.symbol_history(history).first()["entries"]
    assert [(e["version"], e["type"]) for e in told] == [(v, c) for v in FLAT[::-1] for c in ("modified", "deprecated")]
    stats = releases.selectExpr("*", "1 AS added", "1 AS removed", "1 AS modified")
    assert H.history_totals(stats).first()["latest"] == "v1.0.0"
    wanted = spark.createDataFrame([("p", "a", v) for v in ("0.0.1", "1.0.0-beta.3", "1.0.0+zz", "1.9", "zzz")], "package_id string, qualified_name string, version string")
    found = H.symbol_at_version(history.withColumn("snapshot_after", F.struct("version")), wanted)
    assert {r["version"]: r["told_in"] for r in found.collect()} == {"1.0.0-beta.3": "1.0.0-beta.2", "1.0.0+zz": "1.0.0+b1", "1.9": "1.2", "zzz": "v1.0.0"}


def test_ancestors_of_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 502), (502, 500), (0, 150), (7, 7), (None, 3), (4, None), (600, 600)]
    got = {(r["child"], r["base"]): r["depth"] for r in ancestors(spark.createDataFrame(edges, "child long, base long")).collect()}
    want = {}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
    for start in near:
        depth, frontier, seen = 0, {start}, {start}
        while frontier:
            depth += 1
            frontier = {b for a in frontier for b in near.get(a, ())} - seen
            seen |= frontier
            want.update({(start, b): depth for b in frontier})
    want |= {(7, 7): 1, (None, 3): 1, (4, None): 1, (600, 600): 1}
    assert got == want


def test_a_base_named_everywhere_gives_one_row(spark):
    symbols = spark.createDataFrame([(f"p{i}", f"m.Base{j}", f"Base{j}", "class", j) for i in range(20) for j in (1, 2)] + [("p3", "q.Base1", "x", "interface", 0)], "package_id string, qualified_name string, name string, kind string, ord long")
    candidates = spark.createDataFrame([(f"p{i}", 100 - i) for i in range(10)], "package_id string, rank long")
    bases = spark.createDataFrame([("p3", "C", "Base1"), ("zz", "C", "lib.Base2<T>"), ("zz", "D", "None1"), ("p15", "E", "Base1")], "package_id string, class_name string, base string")
    got = {(r["package_id"], r["class_name"]): (r["base_package"], r["base_name"]) for r in resolve_bases(bases, symbols, candidates).collect()}
    assert got == {("p3", "C"): ("p3", "q.Base1"), ("zz", "C"): ("p9", "m.Base2"), ("zz", "D"): (None, None), ("p15", "E"): ("p15", "m.Base1")}


def test_tags_meet_their_own_prefixes_only(spark):
    tags = ["a@1.0.0", "a==1.0.1", "a-1.0.2", "a-v1.0.3", "v1.2.0", "1.3.0", "@s/b@2.0.0-rc.1", "ab@3.0.0", "v=1.4.0", "", "a@1.0", "a@1.0.0-v1.2.3"]
    patterns = [("A", "a@*"), ("AEQ", "a==*"), ("AV", "a-v*"), ("V", "v*"), ("ANY", "*"), ("B", "@s/b@*"), ("NONE", "x")]
    got = R.parse_release_tags(spark.createDataFrame([("r", t, t) for t in tags] + [("other", "a@9.0.0", "z")], "repo string, tag string, sha string"), spark.createDataFrame([("r", *p) for p in patterns], "repo string, package_id string, tag_pattern string"))
    assert sorted((r["package_id"], r["version"], r["tag"]) for r in got.collect()) == sorted([("A", "1.0.0", "a@1.0.0"), ("A", "1.0.1", "a==1.0.1"), ("AEQ", "1.0.1", "a==1.0.1"), ("A", "1.0.2", "a-1.0.2"), ("AV", "1.0.3", "a-v1.0.3"), ("V", "1.2.0", "v1.2.0"), ("ANY", "1.2.0", "v1.2.0"), ("ANY", "1.3.0", "1.3.0"), ("B", "2.0.0-rc.1", "@s/b@2.0.0-rc.1"), ("ANY", "1.4.0", "v=1.4.0"), ("A", "1.0.0-v1.2.3", "a@1.0.0-v1.2.3")])


def test_listing_sums_ranges_and_not_one_task(spark):
    """A running sum of lines over range partitions, equal to the plain one, without a single-partition exchange."""
    from symloom.operators.listings import symbol_listing

    rows = [(i % 2, i % 3, "k%d" % (i % 2), "n%04d" % (i * 37 % 1000), i, "x" * (i % 50) + "é") for i in range(1000)]
    lines = spark.createDataFrame(rows, "section int, package_ord int, kind string, name string, ord long, line string").repartition(4)
    for bound in (0, 3, 1234, 10**6):
        want, until = [], 0
        for r in sorted(rows):
            until += len(r[5].encode()) + 1
            if until <= bound:
                want.append((*r, until))
        got = symbol_listing(lines, bound)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert symbol_listing(lines.limit(0)).count() == 0
