"""Work that must not grow beyond what a query reads."""

import contextlib
import io
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from braidgraph import schema
from braidgraph.functions.predicates import is_
from braidgraph.operators import governance, history, paths, relations, reports, vectors
from braidgraph.plans import lineage
from braidgraph.vocabulary import DEFAULT
from braidgraph.workload import fixtures
from braidgraph.workload import governance as workload
from helpers import graph as small_graph
from helpers import log, relation_log, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_a_filter_on_the_trade_graph_leaves_only_the_tables_it_needs(spark):
    graph = fixtures.graph(spark, SF_DIR)
    parents = graph.relations.filter("relation_type = 'parent_space'")
    brands = graph.triples.filter("attribute = 'brand'")
    assert {Path(f).name for f in parents.inputFiles()} == {"region.parquet", "nation.parquet"}
    assert {Path(f).name for f in brands.inputFiles()} == {"part.parquet"}
    assert parents.count() == 30


def entity(block, name):
    return (block, 0, block, "s", "SET_TRIPLE", name, "name", name)


def edge(block, pos, id_, from_, to):
    return (block, 0, pos, "s", "CREATE_RELATION", id_, from_, to, "t", "0")


def test_relations_are_not_dealt_out_by_their_ends(spark):
    ops = log(spark, [entity(1, "a"), entity(1, "b"), entity(5, "late")]).unionByName(
        relation_log(
            spark,
            [
                edge(2, 1, "ab", "a", "b"), edge(3, 2, "early", "a", "late"),
                edge(5, 3, "same", "late", "a"), edge(6, 4, "after", "late", "b"),
                edge(6, 5, "absent", "a", "nowhere"), edge(6, 6, "none", None, "a"),
                edge(6, 7, "neither", "nowhere", "late"),
            ],
        )
    )
    marked = history.relation_creations(ops)
    assert "SortMergeJoin" not in plan(marked)
    assert rows(marked.select("relation.id", "accepted")) == [
        ("ab", True), ("absent", False), ("after", True), ("early", False), ("neither", False),
        ("none", False), ("same", True),
    ]
    assert rows(history.derive_relations(ops).select("id")) == [("ab",), ("after",), ("same",)]


def test_queries_of_a_search_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame(
        [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id long, vector array<double>"
    ).write.parquet(f"{tmp_path}/vectors")
    held = spark.read.parquet(f"{tmp_path}/vectors")
    found = vectors.top_k(held.withColumnRenamed("id", "query_id"), held, 3)
    assert "Broadcast" not in plan(found)
    assert found.count() == 150


def test_counts_of_paths_follow_no_steps_per_pair(spark, monkeypatch):
    written = []
    write = paths.materialize
    monkeypatch.setattr(
        paths, "materialize", lambda df, name: written.append(name) or write(df, name)
    )
    edges = ["ab", "ac", "bd", "cd", "ce", "de", "ef"]
    found = paths.shortest_counts(
        small_graph(spark, relations=[(e, e[0], e[1], "t", "0", "s") for e in edges]),
        spark.createDataFrame(
            [("a", "d"), ("a", "f"), ("b", "f"), ("a", "b"), ("a", "x")], "source string, target string"
        ),
    )
    assert rows(found.select("source", "target", "hops", "paths")) == [
        ("a", "b", 1, 1), ("a", "d", 2, 2), ("a", "f", 3, 1), ("b", "f", 3, 1),
    ]
    assert "path-graph" not in written


def test_a_part_of_the_governance_log_has_the_rows_of_the_whole(spark):
    payload = "struct<" + ", ".join(
        f"{f.name}: {f.dataType.simpleString()}" for f in schema.PAYLOAD.fields
    ) + ">"
    events = [
        (1, "spaces_created", {"dao_address": "0xD", "space_address": "0xS"}),
        (2, "members_added", {"dao_address": "0xD", "member_address": "0xA"}),
        (3, "members_removed", {"dao_address": "0xD", "member_address": "0xA"}),
        (4, "proposed_edits", {"dao_address": "0xD", "plugin_address": "0xP", "proposal_id": "1",
                               "creator": "0xA", "content_uri": "u"}),
    ]
    events = spark.createDataFrame(
        [(block, kind, 0, given) for block, kind, given in events],
        f"block_number long, kind string, pos int, payload {payload}",
    ).withColumn("block_ts", F.timestamp_seconds("block_number"))
    part = governance.Writes([DEFAULT.address], [DEFAULT.member, DEFAULT.types], [DEFAULT.account_type])
    whole, found = governance.event_ops(events), governance.event_ops(events, writes=part)
    type_id, kind = F.col("relation.to_entity"), F.col("relation.type")
    asked = whole.filter(
        (F.col("triple.attribute") == DEFAULT.address) | (kind == DEFAULT.member)
        | ((kind == DEFAULT.types) & (type_id == DEFAULT.account_type))
    )
    assert found.count() == 4
    assert found.exceptAll(asked).isEmpty() and asked.exceptAll(found).isEmpty()


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_views_of_spaces_read_no_proposals(spark, monkeypatch):
    stored = []
    write = history.materialize
    monkeypatch.setattr(
        history, "materialize", lambda df, name: stored.append(name) or write(df, name)
    )
    graph = workload.governance_graph(spark, SF_DIR, workload.SPACE_VIEW)
    assert stored == ["late-ends"]
    for rows_ in (graph.triples, graph.relations):
        assert "orders.parquet" not in {Path(f).name for f in rows_.inputFiles()}
    assert governance.spaces(graph).count() == 30


def test_rows_are_not_brought_together_by_their_kind(spark, monkeypatch):
    written = {}
    for module in (reports, relations):
        write = module.materialize
        monkeypatch.setattr(
            module, "materialize",
            lambda df, name, write=write: written.setdefault(name, write(df, name)),
        )
    found = small_graph(
        spark,
        triples=[("age", "name", "s", "Age"), ("a", "name", "s", "A"), ("a", "age", "s", "7")],
        relations=[("ah", "a", "h", "t", "0", "s"), ("bh", "b", "h", "t", "1", "s")],
    )
    named = reports.triples_with_names(found, attribute=is_("age"))
    assert rows(named.select("entity", "value", "attribute_name")) == [("a", "7", "Age")]
    assert rows(written["kind-names"]) == [("age", "Age")]
    hub = spark.createDataFrame([("h",), ("h",)], "id string")
    assert rows(relations.inbound(found, hub).select("id")) == [("ah",), ("bh",)]
    assert rows(written["touched"]) == [("h",)]
    profile = reports.entity_profile(found, hub)
    assert rows(profile.select("id", "section", "label", "value", "other")) == [
        ("h", "inbound", "t", "A", "a"), ("h", "inbound", "t", "No name", "b"),
    ]
    assert rows(written["profiled"]) == [("h",)]


def test_no_method_of_event_operations_is_too_long_to_be_compiled(spark):
    kind, payload = "proposed_added_members", schema.PAYLOAD.simpleString()
    events = spark.createDataFrame([(7, kind, "0xA", "0xB", "p1", "0xC", "0xD")],
                                   "block long, kind string, a string, b string, i string, c string, m string")
    given = {"dao_address": "a", "plugin_address": "b", "proposal_id": "i", "creator": "c", "member": "m"}
    fields = [F.expr(given.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in schema.PAYLOAD.fields]
    events = events.select(
        F.col("block").alias("block_number"), F.timestamp_seconds("block").alias("block_ts"), "kind",
        F.lit(0).alias("pos"), F.struct(*fields).cast(payload).alias("payload"),
    )
    ops = governance.event_ops(events)
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        ops.explain("codegen")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue())]
    # HotSpot leaves methods of more than 8,000 bytes to its interpreter.
    assert sizes and max(sizes) <= 8000
    assert ops.filter("op_type = 'CREATE_RELATION'").count() == 5
    assert ops.filter("relation.type is not null").select("relation.id").distinct().count() == 5


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_vectors_are_read_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "write_graph", None)
    graph = fixtures.vector_graph(spark, SF_DIR)
    assert {Path(f).name for f in graph.triples.inputFiles()} == {"embeddings.parquet"}
    types = graph.relations.filter("relation_type = 'types'")
    assert {Path(f).name for f in types.inputFiles()} == {"embeddings.parquet"}
    asked = graph.triples.select(F.col("entity").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.search_triples(graph, asked.limit(3), limit=1)
    assert all(row["query_id"] == row["entity"] for row in found.collect())


def test_shuffle_files_of_a_written_table_go_with_its_end(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString("\n")))

    before = shuffled()
    table = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    written = lineage.materialize(table, "grouped")
    assert spark.conf.get(setting) == kept
    # The files are removed in the background.
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert written.count() == 7
