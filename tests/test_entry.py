"""The driver's contract, and queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("symbol_id", "match_score", "parse_release_tags", "routing_map", "search_records", "legacy_redirects", "requested_format", "inherited_members", "page_links", "code_blocks", "latency_percentiles", "package_order", "catalog", "release_deltas")


def text(value):
    return "" if value is None or value != value else repr(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
class TestGivenTables:
    def test_flagship(self, spark):
        assert entry.entry(spark).count() > 0

    @pytest.mark.parametrize("name", SAMPLE)
    def test_against_sql(self, spark, name):
        import duckdb

        db = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
        assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
