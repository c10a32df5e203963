"""The driver contract, and queries against DuckDB on the smallest tables where these are there."""

import glob
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COMPARED = [
    "module_dependency_rollup", "edge_merge_accumulate", "edge_merge_keep", "node_merge", "call_ladder_resolve", "degree_in_out", "include_reach", "scc_members", "module_layers", "overview_nodes", "capability_rollup",
    "module_inference", "include_resolution", "script_import_targets", "scan_filter", "file_facts", "sliding_complexity", "symbol_registry", "component_names", "session_islands", "p3_found", "p3_end_totals", "p5_found", "p5_paths",
]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_core_stands_alone():
    for name in entry.CORE:
        module = importlib.import_module(name)
        assert module.QUERIES and not any(v.__module__.startswith(entry.LLM.rpartition(".")[0]) for v in module.QUERIES.values())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["from_module", "to_module", "edge_count", "weight", "support_count"]


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(map(_plain, r)) for r in result.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
