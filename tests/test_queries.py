"""Registered queries against their SQL on the smallest tables (tools/check_queries.py runs all of them)."""

import glob
import os

import duckdb
import pytest

from tessera.plans import QUERIES, SQL
from tools.check_queries import rows_of

SF = "/root/testdata/sf0.001"
CHECKED = [
    "scan_parquet_table", "corpus_tables_to_cells", "dedupe_table_names", "unmelt_cells", "largest_tables", "limit_gt_per_lake",
    "assign_partitions", "provenance_rows", "resolve_tables", "resolve_columns", "answer_table", "tile_budget", "slice_rowwise",
    "covered_cells", "tileset_overlap", "merge_closure", "cell_tile_annotation", "embed_table_rows", "tile_embedding", "retrieve_topk",
    "retrieve_inner_product", "retrieve_perfect", "pack_greedy", "build_requests", "request_cache_hits", "request_limit_flags",
    "response_cost", "rolling_rate", "rolling_rate_windows", "prediction_rollup", "answer_accuracy", "profile_histogram_log",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(columns, cursor.fetchall())


def test_registry_is_importable_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
