import tempfile
from dataclasses import replace
from helpers import rows

import pytest
from pyspark.sql import functions as F

from braidgraph import schema
from braidgraph.functions import ids
from braidgraph.functions.predicates import snapshot
from braidgraph.graph import Graph
from braidgraph.operators import governance, hierarchy, history
from braidgraph.plans.lineage import materialize
from braidgraph.sources import edits, seed, tables
from braidgraph.sources.blocks import read_blocks, stream_blocks
from braidgraph.streaming import ingest
from braidgraph.vocabulary import DEFAULT

HOME = DEFAULT.home_network


def blocks(spark, events):
    """Blocks from {number: {kind: [payload, ...]}}."""
    table = [{"block_number": n, **lists} for n, lists in sorted(events.items())]
    frame = spark.createDataFrame(table, schema.BLOCKS)
    return frame.withColumn("block_ts", F.timestamp_seconds("block_number"))


def indexer(spark, events, content=None):
    fanned = governance.fan_out(blocks(spark, events))
    imports = None
    if content is not None:
        imports = governance.import_targets(fanned, content, HOME)
    ops = governance.event_ops(fanned, imports).unionByName(seed.bootstrap(spark))
    ops = materialize(ops, "indexer-ops")
    return Graph(
        history.derive_triples(ops, False), history.derive_relations(ops, False),
        history.derive_entities(ops),
    )


def content(spark, items):
    return spark.createDataFrame(items, schema.CONTENT)


def space(spark, dao):
    return spark.range(1).select(ids.space_id(F.lit(HOME), F.lit(dao))).first()[0]


CREATED = {"dao_address": "0xDAO1", "space_address": "0xSPACE"}


def test_space_becomes_personal(spark):
    personal = {"dao_address": "0xdao1", "personal_admin_address": "0xADMIN",
                "initial_editor": "0xED"}
    found = governance.spaces(indexer(spark, {
        1: {"spaces_created": [CREATED]}, 2: {"personal_plugins_created": [personal]},
    })).collect()
    assert len(found) == 1
    assert found[0]["entity"] == space(spark, "0xDAO1")
    assert (found[0]["governance_type"], found[0]["personal_plugin"]) == ("Personal", "0xadmin")
    public = governance.spaces(indexer(spark, {1: {"spaces_created": [CREATED]}})).first()
    assert (public["governance_type"], public["dao_address"]) == ("Public", "0xdao1")


def test_imported_space_keeps_its_id(spark):
    events = {1: {
        "spaces_created": [CREATED],
        "edits_published": [{"content_uri": "ipfs://i", "plugin_address": "0xSpace",
                             "dao_address": "0xDAO1"}],
    }}
    landed = content(spark, [{"uri": "ipfs://i", "type": "IMPORT_SPACE", "edits": [],
                              "previous_network": "other", "previous_contract_address": "0xOLD"}])
    expected = spark.range(1).select(ids.space_id(F.lit("other"), F.lit("0xold"))).first()[0]
    assert governance.spaces(indexer(spark, events, landed)).first()["entity"] == expected


def test_subspace_added_and_removed(spark):
    two = {1: {"spaces_created": [CREATED, {"dao_address": "0xDAO2", "space_address": "0xS2"}]}}
    link = {"subspace": "0xDAO2", "plugin_address": "0xP", "dao_address": "0xDAO1"}
    added = {**two, 2: {"subspaces_added": [link]}}
    child, parent = space(spark, "0xDAO2"), space(spark, "0xDAO1")
    above = hierarchy.parent_spaces(indexer(spark, added)).filter("depth > 0")
    assert rows(above) == [(child, parent, 1)]
    removed = {**added, 3: {"subspaces_removed": [link]}}
    assert hierarchy.parent_spaces(indexer(spark, removed)).filter("depth > 0").count() == 0


def test_members_editors_and_votes(spark):
    member = {"member_address": "0xA", "dao_address": "0xDAO1"}
    proposal = {"proposal_id": "7", "creator": "0xA", "start_time": "1", "end_time": "2",
                "member": "0xB", "plugin_address": "0xVote", "dao_address": "0xDAO1"}

    def vote(voter, option):
        return {"onchain_proposal_id": "7", "voter": voter, "vote_option": option,
                "plugin_address": "0xVOTE"}

    events = {
        1: {"spaces_created": [CREATED],
            "initial_editors_added": [{"addresses": ["0xA", "0xB"], "dao_address": "0xDAO1"}]},
        2: {"members_added": [member, {**member, "member_address": "0xB"}]},
        3: {"members_removed": [member], "proposed_added_members": [proposal]},
        4: {"votes_cast": [vote("0xa", 2), vote("0xB", 3), vote("0xB", 9)]},
        5: {"executed_proposals": [{"proposal_id": "7", "plugin_address": "0xvote"}]},
    }
    found = indexer(spark, events)
    assert rows(governance.members(found).select("address")) == [("0xb",)]
    # One account can hold two roles in a space.
    assert rows(governance.editors(found).select("address")) == [("0xa",), ("0xb",)]
    made = governance.proposals(found).first()
    assert (made["kind"], made["status"]) == ("add_member_proposal", "Executed")
    assert made["space_id"] == space(spark, "0xDAO1")
    assert rows(governance.votes(found).select("vote")) == [("ACCEPT",), ("REJECT",)]
    bad = governance.invalid_votes(governance.fan_out(blocks(spark, events)))
    assert bad.count() == 1


def edit(uri, *operations):
    ops = [
        {"type": kind, "triple": {"entity": e, "attribute": a, "value": v, "value_type": "TEXT"}}
        for kind, e, a, v in operations
    ]
    return {"uri": uri, "type": "ADD_EDIT", "id": uri, "name": uri, "ops": ops}


EDITS = [
    edit("ipfs://1", ("SET_TRIPLE", "abc", "name", "One"), ("DELETE_ENTITY", "abc", "", "")),
    edit("ipfs://2", ("SET_TRIPLE", "abc", "name", "Two")),
    edit("ipfs://3", ("DELETE_TRIPLE", "abc", "name", None)),
    {"uri": "ipfs://all", "type": "IMPORT_SPACE", "edits": ["ipfs://1", "ipfs://2", "ipfs://none"]},
    {"uri": "ipfs://odd", "type": "ARCHIVE_SPACE"},
]


def published(*uris):
    return {"edits_published": [
        {"content_uri": u, "plugin_address": "0xP", "dao_address": "0xDAO1"} for u in uris
    ]}


def test_edits_are_resolved_and_numbered(spark):
    landed = content(spark, EDITS)
    events = governance.fan_out(blocks(spark, {5: published("ipfs://odd", "ipfs://all", "ipfs://3",
                                                            "ipfs://gone")}))
    found = edits.published_edits(events)
    resolved = edits.resolve(found, landed)
    assert rows(resolved.select("edit_idx", "edit_uri", "version")) == [
        (0, "ipfs://1", "0000000000000005:00000000"), (1, "ipfs://2", "0000000000000005:00000001"),
        (2, "ipfs://3", "0000000000000005:00000002"),
    ]
    assert rows(edits.unresolved(found, landed).select("content_uri", "reason")) == [
        ("ipfs://gone", "missing content"), ("ipfs://none", "missing imported edit"),
        ("ipfs://odd", "unhandled type"),
    ]
    ops = edits.handled(edits.edit_ops(resolved, landed))
    assert rows(ops.select("op_type", "triple.value")) == [
        ("DELETE_TRIPLE", None), ("SET_TRIPLE", "One"), ("SET_TRIPLE", "Two")
    ]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="ingest-", dir="/tmp")


def run(spark, folder, log, landed, switches=ingest.Switches()):
    stream = ingest.observed(stream_blocks(spark, f"{folder}/blocks", files_per_batch=1))
    query = ingest.start(stream, log, landed, f"{folder}/checkpoint", switches=switches)
    query.awaitTermination()
    return query


def current(spark, log):
    derived = history.derive_triples(ingest.read_ops(spark, log, log.edit_ops))
    return rows(derived.filter(snapshot()).select("entity", "value"))


def test_stream_resumes_skips_repeats_and_undoes(spark, folder):
    landed, log = content(spark, EDITS), ingest.Log(f"{folder}/log")

    def land(events):
        blocks(spark, events).coalesce(1).write.mode("append").parquet(f"{folder}/blocks")

    land({1: {"spaces_created": [CREATED]}, 2: published("ipfs://1")})
    run(spark, folder, log, landed)
    assert current(spark, log) == [("abc", "One")]
    land({3: published("ipfs://2")})
    query = run(spark, folder, log, landed)
    assert current(spark, log) == [("abc", "Two")]
    assert query.lastProgress.observedMetrics["head"]["head_block"] == 3
    # The same block again, in a later batch.
    land({3: published("ipfs://2")})
    run(spark, folder, log, landed)
    assert ingest.read_ops(spark, log, log.edit_ops).count() == 2
    assert tuple(ingest.progress(spark, log).first())[0::2] == (3, 3)
    # A reorg takes block 3 back and brings another one.
    ingest.signal_undo(spark, log, last_valid_block=2, batch=2)
    assert current(spark, log) == [("abc", "One")]
    land({3: published("ipfs://3")})
    run(spark, folder, log, landed)
    assert current(spark, log) == []
    assert ingest.progress(spark, log).first()["block_number"] == 3


def test_a_batch_that_runs_twice_replaces_itself(spark, folder):
    landed, log = content(spark, EDITS), ingest.Log(f"{folder}/log")
    for _ in range(2):
        ingest.append_batch(blocks(spark, {2: published("ipfs://1")}), 0, log, landed)
    assert ingest.read_ops(spark, log, log.edit_ops).count() == 1


def test_switches_and_blacklist(spark):
    landed = content(spark, EDITS)
    events = blocks(spark, {1: {**published("ipfs://1"), "spaces_created": [CREATED],
                                "members_added": [{"member_address": "0xA", "dao_address": "0xDAO1"}]}})
    basic = ingest.Switches(governance=False)
    indexer_ops, edit_ops = ingest.block_ops(events, landed, switches=basic)
    assert indexer_ops.filter("triple.attribute = 'content_uri'").count() == 0
    assert indexer_ops.filter(F.col("relation.type") == DEFAULT.member).count() == 0
    assert edit_ops.count() == 1
    blacklist = spark.createDataFrame([(space(spark, "0xDAO1"),)], "space_id string")
    assert ingest.block_ops(events, landed, blacklist)[1].count() == 0


def test_blocks_of_a_range(spark, folder):
    blocks(spark, {n: {} for n in range(10)}).write.json(f"{folder}/blocks")
    found = read_blocks(spark, f"{folder}/blocks", start=3, end=6, fmt="json")
    assert rows(found.select("block_number")) == [(3,), (4,), (5,)]


def test_graph_tables_round_trip(spark, folder):
    graph = indexer(spark, {1: {"spaces_created": [CREATED]}})
    tables.write_graph(graph, f"{folder}/graph")
    again = tables.read_graph(spark, f"{folder}/graph")
    assert rows(governance.spaces(again).select("dao_address")) == [("0xdao1",)]
    # Writing again with overwrite resets the tables.
    fewer = replace(graph, triples=graph.triples.limit(1))
    tables.write_graph(fewer, f"{folder}/graph", mode="overwrite")
    assert tables.read_graph(spark, f"{folder}/graph").triples.count() == 1


def test_repeats_inside_a_batch_and_late_content(spark, folder):
    log = ingest.Log(f"{folder}/repeats")
    landed = content(spark, EDITS)
    twice = blocks(spark, {2: published("ipfs://1")})
    ingest.append_batch(twice.union(twice), 0, log, lambda: landed.union(landed))
    once = ingest.Log(f"{folder}/once")
    ingest.append_batch(blocks(spark, {2: published("ipfs://1")}), 0, once, landed)

    def written(which):
        return sorted(map(repr, ingest.read_ops(spark, which, which.edit_ops).collect()))

    assert written(log) == written(once) and written(log)


def test_ids_of_null_parts_are_null(spark):
    from braidgraph.functions import ids

    rows = spark.createDataFrame([("n", "A"), ("n", None), (None, "A"), (None, None)], "n string, a string")
    found = rows.select(ids.space_id("n", "a").alias("s"), ids.account_id("a").alias("k")).collect()
    assert [r["s"] is None for r in found] == [False, True, True, True]
    assert [r["k"] is None for r in found] == [False, True, False, True]


def test_late_content_is_taken_up(spark, folder):
    events = {
        2: {**published("ipfs://1", "ipfs://all"), "spaces_created": [CREATED]},
        3: published("ipfs://3"), 4: published("ipfs://gone"), 5: {},
    }
    log, whole = ingest.Log(f"{folder}/late"), ingest.Log(f"{folder}/whole")
    ingest.append_batch(blocks(spark, events), 0, whole, content(spark, EDITS))

    def written(which):
        both = (which.indexer_ops, which.edit_ops)
        return [sorted(map(repr, ingest.read_ops(spark, which, path).collect())) for path in both]

    def waiting(which):
        return rows(ingest.pending_edits(spark, which))

    def part(*numbers):
        return blocks(spark, {n: events[n] for n in numbers})

    two = content(spark, [item for item in EDITS if item["uri"] in ("ipfs://2", "ipfs://odd")])
    ingest.append_batch(part(2, 3), 0, log, two)
    assert written(log)[1] == [] and waiting(log) == [
        (2, "ipfs://1"), (2, "ipfs://all"), (3, "ipfs://3")
    ]
    some = content(spark, [item for item in EDITS if item["uri"] != "ipfs://3"])
    for _ in range(2):
        # The same batch again replaces itself, and so do the blocks it takes up.
        ingest.append_batch(part(4, 2), 1, log, some)
        assert waiting(log) == [(2, "ipfs://none"), (3, "ipfs://3"), (4, "ipfs://gone")]
    ingest.append_batch(part(5), 2, log, content(spark, EDITS))
    assert written(log) == written(whole) and written(log)[1]
    assert waiting(log) == waiting(whole) == [(2, "ipfs://none"), (4, "ipfs://gone")]
    assert tuple(ingest.progress(spark, log).first())[0::2] == (5, 4)
    # The last content lands when no more blocks come.
    last = content(spark, [*EDITS, edit("ipfs://none", ("SET_TRIPLE", "x", "name", "X")),
                           edit("ipfs://gone", ("SET_TRIPLE", "y", "name", "Y"))])
    full = ingest.Log(f"{folder}/full")
    ingest.append_batch(blocks(spark, events), 0, full, last)
    for _ in range(2):
        ingest.retry(spark, log, 0, last)
        assert written(log) == written(full) and waiting(log) == []
    # A reorg takes back what was written anew with the batch in which the block arrived.
    ingest.signal_undo(spark, log, last_valid_block=1, batch=0)
    left = {r["block_number"] for r in ingest.read_ops(spark, log, log.edit_ops).collect()}
    assert left == {4}
    ingest.append_batch(part(2, 3), 3, log, last)
    assert written(log) == written(full)
