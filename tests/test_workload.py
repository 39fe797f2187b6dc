"""Queries of every group against their oracle, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from braidgraph.workload import ORACLES, QUERIES
from braidgraph.workload.fixtures import TABLES
from tools.check import rows_of

SF_DIR = "/root/testdata/sf0.001"
CHECKED = (
    "triples_history", "triples_as_of", "entity_versions", "relations_history",
    "entities_by_relation", "entities_hydrated", "relations_with_attributes",
    "traverse_two_hops", "triple_nearest_up", "inherited_triple", "schema_report",
    "vector_topk", "vector_traverse", "text_search", "typed_wide", "graph_uri_edges",
    "proposals", "votes", "op_routing", "entity_profile", "stream_ops_replay",
)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    relation = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in relation.description]
    expected = relation.fetchall()
    result = queries()[name](spark, SF_DIR)
    assert sorted(result.columns) == sorted(columns)
    assert rows_of(result.columns, result.collect()) == rows_of(columns, expected)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_holds_the_library():
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
