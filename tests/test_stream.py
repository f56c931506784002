"""The history as a stream: whatever the order and number of files, it is that of the whole table."""

import pytest

from symloom.operators import history as H
from symloom.streaming.history import compact, of_versions, read_history, stream_history
from tests.test_history import SCHEMA, events, releases, symbol

ROWS = {
    "1.0.0": [symbol("1.0.0", "a")],
    "1.1.0": [symbol("1.1.0", "a"), symbol("1.1.0", "b"), symbol("1.1.0", "c")],
    "1.2.0": [symbol("1.2.0", "a"), symbol("1.2.0", "b"), symbol("1.2.0", "c")],  # changes nothing
    "1.3.0": [symbol("1.3.0", "a", signature="t"), symbol("1.3.0", "c"), symbol("1.3.0", "d")],
}


@pytest.mark.parametrize(
    "arrivals",
    [
        [["1.0.0", "1.1.0"], ["1.2.0"], ["1.3.0"]],
        [["1.0.0"], ["1.3.0"], ["1.1.0"], ["1.2.0"]],  # late releases
        [["1.0.0", "1.1.0/2"], ["1.1.0/1", "1.3.0"], ["1.2.0"], ["1.3.0", "1.0.0"]],  # one version in two files, replays
    ],
)
def test_arrivals_end_in_the_full_history(spark, tmp_path, arrivals):
    table = spark.createDataFrame([r for rows in ROWS.values() for r in rows], SCHEMA)
    for k, names in enumerate(arrivals):
        rows = []
        for name in names:
            version, _, part = name.partition("/")
            rows += {"": ROWS[version], "1": ROWS[version][2:], "2": ROWS[version][:2]}[part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_history(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", table.schema)
    full = H.release_deltas(table, releases(spark, *ROWS))
    assert events(read_history(spark, f"{tmp_path}/out")) == events(full)
    stream_history(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", table.schema)  # nothing new
    assert events(read_history(spark, f"{tmp_path}/out")) == events(full)


def test_compaction_and_unreadable_versions(spark, tmp_path):
    """Late, repeated and odd versions, compacted after every arrival, end in the history of the whole table."""
    names = ["1.0.0-rc.1", "1.0.0", "1.0.0+b1", "1.1", "1.0.0-rc.10", "unknown", "1", "1.10.0"]
    made = {v: [symbol(v, "a", signature=str(k // 2)), symbol(v, "x%d" % k)] for k, v in enumerate(names)}
    table = spark.createDataFrame([r for rows in made.values() for r in rows], SCHEMA)
    full = H.release_deltas(table, table.select("package_id", "version").distinct())
    for k, some in enumerate([names[3:5], names[:1], names[5:7], names[1:3], names[7:] + names[:1]]):
        spark.createDataFrame([r for v in some for r in made[v]], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        stream_history(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", table.schema)
        if k < 4:
            assert compact(spark, f"{tmp_path}/out") == compact(spark, f"{tmp_path}/out") == k
    assert events(read_history(spark, f"{tmp_path}/out")) == events(full)
    assert [r["version"] for r in spark.read.parquet(f"{tmp_path}/out/told/batch=4").orderBy("version").collect()] == ["1.0.0-rc.1", "1.0.0-rc.10", "1.10.0", "unknown"]


def test_a_batch_opens_its_own_versions_only(spark, tmp_path):
    """The folders of a few versions are chosen before anything is read."""
    versions = [f"1.{k}.0" for k in range(12)]
    table = spark.createDataFrame([symbol(v, "a") for v in versions], SCHEMA)
    table.write.partitionBy("package_id", "version").parquet(f"{tmp_path}/snapshots")
    kept = spark.read.schema(table.schema).parquet(f"{tmp_path}/snapshots")
    few = of_versions(kept, table.filter("version IN ('1.3.0', '1.4.0')").select("package_id", "version"))
    assert few.count() == 2
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "1.3.0" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_incremental_with_quiet_and_late_releases(spark):
    table = spark.createDataFrame([r for rows in ROWS.values() for r in rows], SCHEMA)
    rel = releases(spark, *ROWS)
    full = H.release_deltas(table, rel)
    old = full.filter("version <= '1.2.0'")
    new = H.incremental_history(old, table, rel)  # 1.2.0 has no rows and is compared again
    assert {r["version"] for r in new.collect()} == {"1.3.0"} and events(H.merge_history(new, old)) == events(full)
    known = rel.filter("version IN ('1.0.0', '1.2.0')")
    before = H.release_deltas(table.filter("version IN ('1.0.0', '1.2.0')"), known)
    new = H.incremental_history(before, table, rel, told=known)
    assert events(H.merge_history(new, before, H.stale_versions(known, table, rel))) == events(full)


def test_deltas_carry_snapshots_and_details(spark):
    columns = SCHEMA + ", deprecation struct<message:string,replacement:string>"
    rows = [(*symbol("1.0.0", "a", members=[("m", "method", "public"), ("p", "method", "private")]), None), (*symbol("1.1.0", "a", signature="t", deprecated=True), ("gone soon", "b"))]
    rel = spark.createDataFrame([("p", "1.0.0", 1, 0, 0, "s0", "d0"), ("p", "1.1.0", 1, 1, 0, "s1", "d1")], "package_id string, version string, major int, minor int, patch int, sha string, release_date string")
    history = H.release_deltas(spark.createDataFrame(rows, columns), rel, "detailed")
    found = {(r["version"], r["change"]): r for r in history.collect()}
    added, modified, deprecated = found["1.0.0", "added"], found["1.1.0", "modified"], found["1.1.0", "deprecated"]
    assert [m["name"] for m in added["snapshot_after"]["members"]] == ["m"] and added["snapshot_before"] is None and added["sha"] == "s0"
    assert (modified["snapshot_before"]["signature"], modified["snapshot_after"]["signature"], modified["release_date"]) == ("s", "t", "d1")
    assert (deprecated["message"], deprecated["replacement"]) == ("gone soon", "b")
    since = H.deprecated_since(history).first()
    assert (since["since"], since["message"], since["replacement"]) == ("1.1.0", "gone soon", "b")
    wanted = spark.createDataFrame([("p", "a", "1.0.0"), ("p", "a", "1.5.0"), ("p", "x", "1.0.0")], "package_id string, qualified_name string, version string")
    assert {r["version"]: r["snapshot"]["signature"] for r in H.symbol_at_version(history, wanted).collect()} == {"1.0.0": "s", "1.5.0": "t"}


def test_shards_are_written_from_one_telling_of_the_history(spark, tmp_path):
    """The index comes from the shards as written: the rows of the history are made once."""
    from symloom.sources import io

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("p1", f"1.{i % 3}.0", f"a.name{i}") for i in range(40)] + [("p2", "2.0.0", "b.x")]
    history = spark.createDataFrame(rows, "package_id string, version string, qualified_name string")
    io.write_history_shards(history.mapInArrow(counted, history.schema), str(tmp_path / "h"), digits=1)
    assert made.value == len(rows)
    index = {r["package_id"]: (r["versions"], r["shards"]) for r in spark.read.parquet(str(tmp_path / "h" / "index")).collect()}
    assert index["p1"][0] == ["1.0.0", "1.1.0", "1.2.0"] and index["p2"][0] == ["2.0.0"] and len(index["p2"][1]) == 1
    assert spark.read.parquet(str(tmp_path / "h" / "shards")).count() == len(rows)


def test_the_streamed_table_is_bound_once(spark, monkeypatch):
    """Both arrivals are parts of one table, which is computed once."""
    from symloom.plans import source_queries as Q

    calls = []
    kept = Q.kept
    monkeypatch.setattr(Q, "kept", lambda df: calls.append(1) or kept(df))
    rows = Q._stream(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and rows.count() > 0
