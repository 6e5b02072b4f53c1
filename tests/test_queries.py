"""Registered queries against their SQL on DuckDB."""

import duckdb
import pytest

from lodestar.plans.catalog import ORACLES, QUERIES
from lodestar.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
CHOSEN = "all_edges edges_valid file_replace ego_neighbors ego_edges graph_stats best_edge bfs_reachable dijkstra_cost dead_code_details whitelist_reason tree_rollup tree_filter macro_edges macro_samples resolve_all edges_calls search_multi_kw search_topn diff_status cache_merge flow_upsert debounce_last enclosing_symbol pipeline_steps call_sites_regex ego_2hop graph_cleared symbol_ranges cursor_symbols symbol_excerpts symbol_docs symbol_signatures import_rows call_rows module_steps script_symbols script_bases script_calls script_modules flow_store store_cleared summary_store job_progress scope_picker folder_members folded_report".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, (list, tuple)) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


def test_every_query_has_sql_but_paths():
    assert set(QUERIES) - set(ORACLES) == {"path_nodes"}
