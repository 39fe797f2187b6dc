"""Log, history, snapshots and versions."""

from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, is_, snapshot
from braidgraph.graph import Graph
from braidgraph.operators import entities, history, snapshots, triples, versions, writes
from braidgraph.plans.lineage import scratch_path
from braidgraph.workload import fixtures
from braidgraph.workload.registry import query

TRIPLE = ["entity", "attribute", "space_id", "value", "min_version"]
# The third edit of the block that three quarters of the blocks precede.
AS_OF = "(SELECT printf('%016d:%08d', CAST(max(block_number) * 3 // 4 AS BIGINT), 2) FROM fx_ops)"
UNDO_BLOCK = "(SELECT max(block_number) * 3 // 4 FROM fx_ops)"


def late_block(log) -> int:
    return log.agg(F.max("block_number")).first()[0] * 3 // 4


def as_of(spark, sf_dir) -> str:
    return f"{late_block(fixtures.ops(spark, sf_dir)):016d}:{2:08d}"


def history_of(spark, sf_dir):
    return history.derive_triples(fixtures.ops(spark, sf_dir))


@query("SELECT entity, attribute, space_id, value, version AS min_version, max_version FROM fx_history")
def triples_history(spark, sf_dir):
    return history_of(spark, sf_dir).select(*TRIPLE, "max_version")


@query(
    "SELECT entity, attribute, space_id, value, version AS min_version FROM fx_history "
    "WHERE max_version IS NULL"
)
def triples_current(spark, sf_dir):
    return history_of(spark, sf_dir).filter(snapshot()).select(*TRIPLE)


@query(
    "SELECT entity, attribute, space_id, value, version AS min_version FROM fx_history "
    f"WHERE version <= {AS_OF} AND (max_version IS NULL OR max_version > {AS_OF})"
)
def triples_as_of(spark, sf_dir):
    return history_of(spark, sf_dir).filter(snapshot(as_of(spark, sf_dir))).select(*TRIPLE)


_stores: dict[tuple[str, str], snapshots.Snapshots] = {}
MARKS = 16


def snapshot_store(spark, sf_dir) -> snapshots.Snapshots:
    """Snapshots at sixteen marks of the log, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = snapshots.Snapshots(scratch_path(spark, "snapshots"))
        log = fixtures.ops(spark, sf_dir)
        newest = log.agg(F.max("block_number")).first()[0]
        snapshots.build(store, log, every=newest // MARKS + 1)
        _stores[key] = store
    return _stores[key]


# The same rows from one snapshot and the changes after it.
@query(
    "SELECT entity, attribute, space_id, value, version AS min_version FROM fx_history "
    f"WHERE version <= {AS_OF} AND (max_version IS NULL OR max_version > {AS_OF})"
)
def triples_as_of_snapshots(spark, sf_dir):
    store = snapshot_store(spark, sf_dir)
    return snapshots.triples_at(spark, store, as_of(spark, sf_dir)).select(*TRIPLE)


def _derived(spark, sf_dir) -> Graph:
    log = fixtures.ops(spark, sf_dir)
    return Graph(
        history.derive_triples(log), fixtures.graph(spark, sf_dir).relations,
        history.derive_entities(log), fixtures.VOCABULARY,
    )


@query(
    "SELECT DISTINCT entity AS id FROM fx_history WHERE max_version IS NULL "
    "AND attribute = 'purchase' AND CAST(value AS DECIMAL(38,6)) >= 10"
)
def entities_by_attribute(spark, sf_dir):
    bought = entities.HasAttribute("purchase", Where(gte="10", numeric=True))
    return entities.find(
        _derived(spark, sf_dir), entities.EntityFilter(attributes=[bought]), limit=None
    ).select("id")


# With versioning off the log order alone decides, and only the last state is kept.
@query("""
SELECT entity, attribute, space_id, value, '0' AS min_version FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, attribute, space_id
         ORDER BY block_number DESC, edit_idx DESC, phase DESC, op_pos DESC) AS rn
  FROM fx_ops_ordered) x
WHERE rn = 1 AND op_type = 'SET_TRIPLE'
""")
def triples_unversioned(spark, sf_dir):
    log = fixtures.ops(spark, sf_dir)
    return history.derive_triples(log, versioning=False).select(*TRIPLE)


@query("""
SELECT entity AS id,
       min(CASE WHEN op_type = 'SET_TRIPLE' THEN block_number END) AS created,
       max(block_number) AS updated
FROM fx_ops GROUP BY entity HAVING created IS NOT NULL
""")
def entity_system_properties(spark, sf_dir):
    rows = history.derive_entities(fixtures.ops(spark, sf_dir))
    return rows.select(
        "id", F.col("created_at_block").cast("bigint").alias("created"),
        F.col("updated_at_block").cast("bigint").alias("updated"),
    )


@query(
    "SELECT entity, attribute, space_id, value, version AS min_version, max_version FROM kept_history",
    kept_ops=f"SELECT * FROM fx_ops_ordered WHERE block_number <= {UNDO_BLOCK}",
    kept_history=fixtures._intervals("kept_ops", "entity, attribute, space_id", "SET_TRIPLE"),
)
def undo_after_block(spark, sf_dir):
    log = fixtures.ops(spark, sf_dir)
    kept = history.undo_after(log, late_block(log))
    return history.derive_triples(kept).select(*TRIPLE, "max_version")


def edited_graph(spark, sf_dir) -> Graph:
    """The derived triples plus one edit entity per (block, edit) with its index."""
    log = fixtures.ops(spark, sf_dir)
    edits = log.select("block_number", "edit_idx").distinct().select(
        F.concat(F.lit("edit:"), history.version_stamp()).alias("entity"),
        F.lit("edit_index").alias("attribute"),
        F.lit("indexer").alias("space_id"),
        history.version_stamp().alias("value"),
    )
    tables = _derived(spark, sf_dir)
    derived = writes.initial_triples(history_of(spark, sf_dir))
    return Graph(
        derived.unionByName(writes.initial_triples(edits)),
        tables.relations, tables.entities, fixtures.VOCABULARY,
    )


@query(
    "SELECT DISTINCT entity, 'edit:' || version AS edit_id, version FROM fx_history"
)
def entity_versions(spark, sf_dir):
    return versions.entity_versions(edited_graph(spark, sf_dir), space_id=Where(ne="indexer"))


@query("""
SELECT DISTINCT 'edit:' || version AS edit_id, version FROM fx_ops_ordered
WHERE op_type = 'DELETE_TRIPLE'
""")
def version_index_lookup(spark, sf_dir):
    deleting = fixtures.ops(spark, sf_dir).filter("op_type = 'DELETE_TRIPLE'")
    wanted = deleting.select(F.concat(F.lit("edit:"), history.version_stamp()).alias("edit_id"))
    return versions.version_of(edited_graph(spark, sf_dir), wanted)


# The state of every user at the first edit that deleted something of theirs.
@query("""
SELECT p.entity, p.version AS at_version, h.attribute, h.space_id, h.value
FROM (SELECT entity, min(version) AS version FROM fx_ops_ordered
      WHERE op_type = 'DELETE_TRIPLE' GROUP BY entity) p
JOIN fx_history h ON h.entity = p.entity AND h.version <= p.version
 AND (h.max_version IS NULL OR h.max_version > p.version)
""")
def attributes_at_version(spark, sf_dir):
    points = (
        fixtures.ops(spark, sf_dir)
        .filter("op_type = 'DELETE_TRIPLE'")
        .groupBy(F.col("triple.entity").alias("entity"))
        .agg(F.min(history.version_stamp()).alias("version"))
    )
    return versions.attributes_at(_derived(spark, sf_dir), points).select(
        "entity", F.col("version").alias("at_version"), "attribute", "space_id", "value"
    )


# Users whose last event was an error are deleted from their space.
@query("""
SELECT h.entity, h.attribute, h.space_id, h.value, h.version AS min_version
FROM fx_history h
WHERE max_version IS NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) l
  WHERE l.last = 'error' AND h.entity = 'user:' || l.user_id)
""")
def entity_delete(spark, sf_dir):
    log = fixtures.ops(spark, sf_dir)
    last = fixtures.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last")
    )
    gone = last.filter("last = 'error'").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
        F.concat(F.lit("space:"), (F.col("user_id") % 4).cast("string")).alias("space_id"),
    )
    now = writes.Block(number=10**9)
    deletes = writes.delete_entities(gone, history.derive_triples(log), now)
    return (
        history.derive_triples(log.unionByName(deletes)).filter(snapshot()).select(*TRIPLE)
    )


# Batch lookup by key: the purchases of every user in their space.
@query("""
SELECT entity, attribute, space_id, value, version AS min_version FROM fx_history
WHERE max_version IS NULL AND attribute = 'purchase'
""")
def triple_lookup(spark, sf_dir):
    users = fixtures.table(spark, sf_dir, "events").select("user_id").distinct()
    keys = users.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
        F.lit("purchase").alias("attribute"),
        F.concat(F.lit("space:"), (F.col("user_id") % 4).cast("string")).alias("space_id"),
    )
    return triples.lookup(history_of(spark, sf_dir), keys).select(*TRIPLE)


@query(f"""
SELECT entity, attribute, space_id, value, version AS min_version FROM fx_history
WHERE version <= {AS_OF} AND (max_version IS NULL OR max_version > {AS_OF})
  AND attribute IN ('click', 'view') AND space_id <> 'space:0' AND value >= '20' AND value < '5'
""")
def triple_scan(spark, sf_dir):
    return triples.scan(
        history_of(spark, sf_dir), attribute=Where(any_of=["click", "view"]),
        space_id=Where(ne="space:0"), value=Where(gte="20", lt="5"), version=as_of(spark, sf_dir),
    ).select(*TRIPLE)


# The attributes of users that clicked, as one map per user and space.
@query("""
SELECT entity, space_id,
       string_agg(attribute || '=' || value, '|' ORDER BY attribute) AS attributes
FROM fx_history h WHERE max_version IS NULL AND EXISTS (
  SELECT 1 FROM fx_history c WHERE c.max_version IS NULL AND c.attribute = 'click'
  AND c.entity = h.entity)
GROUP BY entity, space_id
""")
def attribute_groups(spark, sf_dir):
    current = history_of(spark, sf_dir)
    clicked = triples.scan(current, attribute=is_("click")).select(F.col("entity").alias("id"))
    maps = triples.attribute_maps(triples.attributes_of(current, clicked))
    shown = F.transform(
        F.array_sort(F.map_keys("attributes")),
        lambda key: F.concat(key, F.lit("="), F.col("attributes")[key]["value"]),
    )
    return maps.select("entity", "space_id", F.concat_ws("|", shown).alias("attributes"))


# The last value of each attribute across the spaces of an entity, ties by space.
@query("""
SELECT entity, attribute, first(value ORDER BY version DESC, space_id DESC) AS value FROM fx_history
WHERE max_version IS NULL GROUP BY entity, attribute
""")
def attributes_merged(spark, sf_dir):
    current = history_of(spark, sf_dir).filter(snapshot())
    return triples.merge_attributes(current, "min_version").select("entity", "attribute", "value")
