"""Snapshot diffs: hand-made cases, and properties that hold for any history."""

import random

import pytest

from symloom.operators import history as H
from symloom.operators import releases as R

SCHEMA = (
    "package_id string, version string, ord long, qualified_name string, kind string, signature string, returns_type string, deprecated boolean, extends array<string>, implements array<string>,"
    "members array<struct<name:string,kind:string,visibility:string>>, params array<struct<name:string,type:string,required:boolean,default:string>>"
)


def symbol(version, name, ord=0, signature="s", returns="r", deprecated=False, extends=("A",), implements=(), members=(), params=(), package="p"):
    return (package, version, ord, name, "class", signature, returns, deprecated, list(extends), list(implements), list(members), list(params))


def releases(spark, *versions, package="p"):
    return spark.createDataFrame([(package, v, *map(int, v.split("."))) for v in versions], "package_id string, version string, major int, minor int, patch int")


def events(df):
    return sorted((r["version"], r["previous_version"], r["change"], r["qualified_name"], ",".join(sorted(f"{c['type']}:{c['member_name'] or ''}:{c['breaking']}" for c in r["changes"]))) for r in df.collect())


def test_added_removed_modified(spark):
    rows = [symbol("1.0.0", "a"), symbol("1.0.0", "b"), symbol("1.2.0", "a", signature="t"), symbol("1.10.0", "a", signature="t"), symbol("1.10.0", "b")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = events(H.release_deltas(table, releases(spark, "1.0.0", "1.2.0", "1.10.0", "1.11.0")))
    assert got == [
        ("1.0.0", None, "added", "a", ""),
        ("1.0.0", None, "added", "b", ""),
        ("1.10.0", "1.2.0", "added", "b", ""),
        ("1.2.0", "1.0.0", "modified", "a", "signature-changed::False"),
        ("1.2.0", "1.0.0", "removed", "b", ""),
    ]


def test_last_of_equal_names_counts(spark):
    rows = [symbol("1.0.0", "a", 0, "old"), symbol("1.0.0", "a", 1, "new"), symbol("1.1.0", "a", 0, "new")]
    assert [e[2] for e in events(H.release_deltas(spark.createDataFrame(rows, SCHEMA), releases(spark, "1.0.0", "1.1.0")))] == ["added"]


def test_rule_sets_differ(spark):
    m = lambda *xs: [dict(zip(("name", "kind", "visibility"), x, strict=True)) for x in xs]
    p = lambda *xs: [dict(zip(("name", "type", "required", "default"), x, strict=True)) for x in xs]
    old = symbol("1.0.0", "a", extends=("A", "B"), returns=None, members=m(("x", "method", "public"), ("y", "method", "private")), params=p(("q", "int", False, None)))
    new = symbol("1.1.0", "a", extends=("B", "A"), returns="int", deprecated=True, members=m(("x", "property", "protected"), ("z", "method", "private")), params=p(("q", "int | str", True, "1")))
    table, rel = spark.createDataFrame([old, new], SCHEMA), releases(spark, "1.0.0", "1.1.0")
    build = events(H.release_deltas(table, rel))
    assert build[1][4] == "param-type-changed:q:True,return-type-changed::True"
    detailed = events(H.release_deltas(table, rel, "detailed"))
    assert detailed[1][2] == "deprecated"
    assert detailed[2][4].split(",") == [
        "extends-changed::True", "member-added:z:False", "member-removed:y:True", "member-visibility-changed:x:True",
        "param-default-changed:q:False", "param-optionality-changed:q:True", "param-type-changed:q:False", "return-type-changed::False",
    ]


def test_null_lists_count_as_empty(spark):
    rows = [list(symbol("1.0.0", "a")), list(symbol("1.1.0", "a"))]
    rows[0][10] = rows[0][11] = None
    assert [e[2] for e in events(H.release_deltas(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), releases(spark, "1.0.0", "1.1.0")))] == ["added"]


@pytest.fixture(scope="module")
def random_table(spark):
    r = random.Random(2)
    versions = ["0.9.0", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]
    rows = [symbol(v, f"n{i}", i, signature=r.choice("st"), deprecated=r.random() < 0.2, package=p) for p in ("p", "q") for v in versions for i in range(40) if r.random() < 0.7]
    rel = releases(spark, *versions).unionByName(releases(spark, *versions, package="q"))
    return spark.createDataFrame(rows, SCHEMA).cache(), rel


def test_counts_reconcile(spark, random_table):
    table, rel = random_table
    stats = {(r["package_id"], r["version"]): r for r in H.version_stats(H.release_deltas(table, rel), table).collect()}
    for p in ("p", "q"):
        total = 0
        for v in ("0.9.0", "1.0.0", "1.2.0", "1.10.0", "2.0.0"):
            s = stats[p, v]
            total += s["added"] - s["removed"]
            assert total == s["total_symbols"]


@pytest.mark.parametrize("mode", ["build", "detailed"])
def test_incremental_equals_full(random_table, mode):
    table, rel = random_table
    full = H.release_deltas(table, rel, mode)
    old = full.filter("version IN ('0.9.0', '1.0.0')")
    new = H.incremental_history(old, table, rel, mode)
    assert events(H.merge_history(new, old)) == events(full)


def test_window_equals_pairwise(random_table):
    table, rel = random_table
    full = H.release_deltas(table.filter("package_id = 'p'"), rel).filter("version = '1.10.0'")
    pair = H.diff(table.filter("package_id = 'p' AND version = '1.2.0'"), table.filter("package_id = 'p' AND version = '1.10.0'"))
    assert sorted((r["qualified_name"], r["change"]) for r in full.collect()) == sorted((r["qualified_name"], r["change"]) for r in pair.collect())


def test_replacement_is_the_first_similar_name(spark):
    removed = spark.createDataFrame([("p", "2", "x.Load")], "package_id string, version string, qualified_name string")
    newer = spark.createDataFrame([("p", "2", "y.Other", 0), ("p", "2", "y.DataLoader", 1), ("p", "2", "y.load", 2), ("q", "2", "y.Load", 0)], "package_id string, version string, qualified_name string, ord long")
    assert H.replacement_candidates(removed, newer).first()["replacement"] == "y.DataLoader"


def test_tags(spark):
    tags = spark.createDataFrame([("r", t, t) for t in ("@a/b@1.2.3", "@a/b==1.2.4", "@a/b-1.2.5", "@a/b@1.2", "v1.0.0", "2.0.0", "x-v3.0.0", "x==3.0.1", "v1.0.0-rc.1", "01.2.3")], "repo string, tag string, sha string")
    packages = spark.createDataFrame([("r", p, p) for p in ("@a/b@*", "v*", "*", "x-v*", "x==*")], "repo string, package_id string, tag_pattern string")
    got = {}
    for row in R.parse_release_tags(tags, packages).collect():
        got.setdefault(row["package_id"], set()).add(row["version"])
    assert got == {"@a/b@*": {"1.2.3", "1.2.4", "1.2.5"}, "v*": {"1.0.0", "1.0.0-rc.1"}, "*": {"2.0.0", "1.0.0", "1.0.0-rc.1"}, "x-v*": {"3.0.0"}, "x==*": {"3.0.1"}}


def test_selection(spark):
    rows = [("p", v, *map(int, v.split(".")), None, v, v) for v in ("0.0.1", "0.0.3", "0.2.0", "0.2.9", "0.2.10", "1.0.0", "1.0.2", "1.1.5")]
    table = spark.createDataFrame(rows, "package_id string, version string, major int, minor int, patch int, prerelease string, tag string, sha string")
    versions = lambda df: {r["version"] for r in df.collect()}
    assert versions(R.latest_per_minor(table)) == {"0.0.3", "0.2.10", "1.0.2", "1.1.5"}
    assert versions(R.first_last_per_minor(table)) == {"0.0.3", "0.2.0", "0.2.10", "1.0.0", "1.0.2", "1.1.5"}
    assert versions(R.collapse_v0(table)) == {"0.2.10", "1.0.0", "1.0.2", "1.1.5"}
    assert versions(R.limit_minors(table, 2)) == {"1.0.0", "1.0.2", "1.1.5"}
    assert versions(R.limit_versions(table, 3)) == {"1.0.0", "1.0.2", "1.1.5"}
    assert versions(R.min_version(table, "0.2.10")) == {"0.2.10", "1.0.0", "1.0.2", "1.1.5"}
