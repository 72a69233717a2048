"""Every query that has SQL against DuckDB, and the plans' shape."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from filemeta.plans import catalogue, parse  # noqa: E402

from .oracle import differences  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(spark, SMALL, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) == ""


def test_entry_points():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_has_no_python_and_no_exchange(spark):
    names = spark.read.parquet(f"{SMALL}/part.parquet").selectExpr("p_partkey", "p_name AS name")
    plan = _plan(parse.parse_names(names))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_exact_studios_are_a_broadcast_hash_join(spark):
    plan = _plan(catalogue.QUERIES["q16_studio_exact"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_substring_studios_meet_no_nested_loop(spark):
    assert "NestedLoop" not in _plan(catalogue.QUERIES["q18_studio_substring"](spark, SMALL))


def test_scans_read_only_what_is_used(spark):
    plan = _plan(catalogue.QUERIES["q02_basename"](spark, SMALL))
    assert "html" not in plan


def test_stream_counts_every_event(spark):
    found = catalogue.QUERIES["s01_stream_parse"](spark, SMALL)
    assert found.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_stream_reads_users_whose_number_is_a_marker_or_a_year(spark, tmp_path):
    import duckdb

    users = [5, 99, 100, 240, 720, 1080, 1950, 2024, 2160, 10800, 12024, 19191, 99999, 100000, 192024, 2024010112, -240, None]
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-03-05 10:00:00' + INTERVAL ({i % 4}) HOUR, {'NULL' if u is None else u}::BIGINT, 'click', 1.0::DOUBLE, '{{}}')" for i, u in enumerate(users))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert differences(spark, str(tmp_path), catalogue.QUERIES["s01_stream_parse"], catalogue.ORACLE_SQL["s01_stream_parse"]) == ""
