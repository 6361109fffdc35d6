"""The driver contract: every query with SQL is compared with DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnwright import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
CHOSEN = ["c1_user_turns", "c3_prompt_prefix", "d7_letter", "d12_tool_blocks", "e12_candidates", "f5_first_wins", "g4_balance", "g5_ratio", "g7_split", "g12_group_margin", "h5_compute_score", "h7_token_f1", "h12_route", "j5_runtime_fields", "d10_unified_parse", "d11_normalize", "d13_render", "d14_surface", "d16_canonical", "d17_reward_input", "d19_forced_surface", "d20_prompt_suffix", "d24_json_from_text", "b4_json_safe", "b5_empty_objects", "b10_tools_text", "f8_membership", "h8_trajectory_reward", "i3_judge", "i6_strict_scores", "g10_running_counts", "e8_required_fields", "i7_registered_scorer", "i4_turn_parse_judged", "a9_json_array_sink", "a7_config_and_paths"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    sql = tables.execute(catalog.ORACLES[name])
    at = [[d[0] for d in sql.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())


def test_registry(spark):
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(catalog.QUERIES) >= 100
    assert entry.entry(spark).count() == 4
