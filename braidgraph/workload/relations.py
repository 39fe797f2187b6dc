"""Relation history, filters, projections and traversals."""

from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, is_
from braidgraph.graph import Graph
from braidgraph.operators import entities, history, relations
from braidgraph.operators.entities import EntityFilter, HasAttribute, Hop
from braidgraph.operators.relations import RelationFilter
from braidgraph.operators.writes import initial_triples
from braidgraph.workload import fixtures
from braidgraph.workload.registry import query

EDGE = ["id", "from_id", "to_id", "relation_type", "index", "space_id"]

SEEN = """
SELECT entity, min(block_number * 1000000 + edit_idx) AS seen FROM fx_ops
WHERE op_type = 'SET_TRIPLE' GROUP BY entity"""
ACCEPTED = """
SELECT r.*, printf('%016d:%08d', r.block_number, r.edit_idx) AS version,
       CASE r.op_type WHEN 'CREATE_RELATION' THEN 3 ELSE 4 END AS phase
FROM fx_relation_ops r
LEFT JOIN seen_at f ON f.entity = r.from_id LEFT JOIN seen_at t ON t.entity = r.to_id
WHERE r.op_type = 'DELETE_RELATION'
   OR (f.seen <= r.block_number * 1000000 + r.edit_idx
       AND t.seen <= r.block_number * 1000000 + r.edit_idx)"""
HISTORY = fixtures._intervals("accepted_ops", "id, space_id", "CREATE_RELATION")


def _log(spark, sf_dir):
    return fixtures.ops(spark, sf_dir).unionByName(fixtures.relation_ops(spark, sf_dir))


@query(
    "SELECT id, from_id, to_id, relation_type, index, space_id, version AS min_version, "
    "max_version, CAST(block_number AS STRING) AS created_at_block FROM relation_history",
    seen_at=SEEN, accepted_ops=ACCEPTED, relation_history=HISTORY,
)
def relations_history(spark, sf_dir):
    return history.derive_relations(_log(spark, sf_dir)).select(
        *EDGE, "min_version", "max_version", "created_at_block"
    )


# Creations whose ends did not exist yet.
@query(
    "SELECT r.op_pos, r.id FROM fx_relation_ops r LEFT JOIN accepted_ops a "
    "ON a.op_pos = r.op_pos WHERE r.op_type = 'CREATE_RELATION' AND a.op_pos IS NULL",
    seen_at=SEEN, accepted_ops=ACCEPTED,
)
def relations_dropped(spark, sf_dir):
    marked = history.relation_creations(_log(spark, sf_dir))
    return marked.filter(~F.col("accepted")).select("op_pos", F.col("relation.id").alias("id"))


# Lines of finished orders of customers with a high balance that bought large parts.
@query("""
SELECT id, from_id, to_id, relation_type, index, space_id FROM fx_relations
WHERE relation_type = 'contains'
AND from_id IN (SELECT entity FROM fx_triples WHERE attribute='status' AND value='F')
AND to_id IN (SELECT entity FROM fx_triples WHERE attribute='size'
              AND CAST(value AS DECIMAL(18,2)) > 40)
""")
def relations_by_filter(spark, sf_dir):
    where = RelationFilter(
        relation_type=is_("contains"),
        from_=EntityFilter(attributes=[HasAttribute("status", is_("F"))]),
        to=EntityFilter(attributes=[HasAttribute("size", Where(gt="40", numeric=True))]),
    )
    return relations.find(fixtures.graph(spark, sf_dir), where, limit=None).select(*EDGE)


@query("""
SELECT id, from_id, to_id, relation_type, index, space_id FROM fx_relations
WHERE relation_type IN ('located_in', 'parent_space') AND space_id <> 'nation:2'
ORDER BY index, id LIMIT 100 OFFSET 30
""")
def relations_page(spark, sf_dir):
    where = RelationFilter(
        relation_type=Where(any_of=["located_in", "parent_space"]),
        space_id=Where(ne="nation:2"),
    )
    return relations.find(fixtures.graph(spark, sf_dir), where, limit=100, skip=30).select(*EDGE)


@query("""
SELECT r.id, from_id, to_id, '0' AS from_created_at_block, '0' AS to_created_at_block
FROM fx_relations r JOIN fx_entities f ON f.id = from_id JOIN fx_entities t ON t.id = to_id
WHERE relation_type = 'placed_by'
""")
def relations_with_nodes(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    edges = relations.find(tables, RelationFilter(relation_type=is_("placed_by")), limit=None)
    return relations.with_nodes(tables, edges).select(
        "id", "from_id", "to_id", "from_created_at_block", "to_created_at_block"
    )


def line_graph(spark, sf_dir) -> Graph:
    """Order lines whose relations carry quantities as attributes."""
    tables = fixtures.graph(spark, sf_dir)
    line = fixtures.select(spark, sf_dir, LINE_TRIPLES.replace("string_cast", "STRING"))
    return Graph(initial_triples(line), tables.relations, tables.entities, fixtures.VOCABULARY)


LINE_TRIPLES = """
SELECT 'contains>order:' || CAST(l_orderkey AS STRING) || '>part:' || CAST(l_partkey AS STRING)
       AS entity, 'root' AS space_id, 'quantity' AS attribute,
       CAST(CAST(sum(l_quantity) AS DECIMAL(18,2)) AS STRING) AS value, 'NUMBER' AS value_type
FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL
SELECT 'contains>order:' || CAST(l_orderkey AS STRING) || '>part:' || CAST(l_partkey AS STRING),
       'root', 'shipped', min(l_linestatus), 'TEXT'
FROM lineitem GROUP BY l_orderkey, l_partkey"""


@query(
    "SELECT r.id, from_id, to_id, attribute, value FROM fx_relations r "
    "LEFT JOIN line_triples l ON l.entity = r.id AND l.space_id = r.space_id "
    "WHERE relation_type IN ('contains', 'supplied_by')",
    line_triples=LINE_TRIPLES,
)
def relations_with_attributes(spark, sf_dir):
    tables = line_graph(spark, sf_dir)
    where = RelationFilter(relation_type=Where(any_of=["contains", "supplied_by"]))
    edges = relations.find(tables, where, limit=None)
    return relations.with_attributes(tables, edges).select(
        "id", "from_id", "to_id", "attribute", "value"
    )


# A page of relations with attributes as lists and both end nodes.
@query(
    "SELECT r.id, from_id, to_id, string_agg(attribute || '=' || value, '|' ORDER BY attribute) "
    "AS attributes FROM (SELECT * FROM fx_relations WHERE relation_type = 'contains' "
    "ORDER BY index, id LIMIT 100 OFFSET 10) r "
    "JOIN line_triples l ON l.entity = r.id GROUP BY 1, 2, 3",
    line_triples=LINE_TRIPLES,
)
def relations_page_with_attributes(spark, sf_dir):
    tables = line_graph(spark, sf_dir)
    edges = relations.find(tables, RelationFilter(relation_type=is_("contains")), limit=100, skip=10)
    page = relations.with_nodes(tables, relations.with_attribute_lists(tables, edges))
    shown = F.transform("attributes", lambda a: F.concat(a["attribute"], F.lit("="), a["value"]))
    return page.select("id", "from_id", "to_id", F.concat_ws("|", shown).alias("attributes"))


# Batch lookup by (relation id, space): the order relation of every order.
@query("""
SELECT id, from_id, to_id, relation_type, index, space_id FROM fx_relations
WHERE relation_type = 'placed_by'
""")
def relation_lookup(spark, sf_dir):
    keys = fixtures.table(spark, sf_dir, "orders").select(
        F.format_string("placed_by>order:%d>customer:%d", "o_orderkey", "o_custkey").alias("id"),
        F.lit("root").alias("space_id"),
    )
    return relations.lookup(fixtures.graph(spark, sf_dir), keys).select(*EDGE)


@query("""
SELECT r.id AS relation_id, r.index, to_id AS id FROM fx_relations r
JOIN fx_entities e ON e.id = r.to_id WHERE relation_type = 'supplied_by'
""")
def relation_targets(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    edges = relations.find(tables, RelationFilter(relation_type=is_("supplied_by")), limit=None)
    return relations.targets(tables, edges).select("relation_id", "index", "id")


@query("""
SELECT r.id, from_id, to_id, relation_type, index, space_id FROM fx_relations r
WHERE from_id IN (SELECT entity FROM fx_triples WHERE attribute = 'brand' AND value = 'Brand#12')
""")
def outbound_relations(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    parts = entities.matching(
        tables, EntityFilter(attributes=[HasAttribute("brand", is_("Brand#12"))])
    )
    return relations.outbound(tables, parts).select(*EDGE)


@query("""
SELECT r.id, from_id, to_id, relation_type, index, space_id FROM fx_relations r
WHERE space_id = 'root' AND to_id IN (
  SELECT entity FROM fx_triples WHERE attribute = 'brand' AND value = 'Brand#12')
""")
def inbound_relations(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    parts = entities.matching(
        tables, EntityFilter(attributes=[HasAttribute("brand", is_("Brand#12"))])
    )
    return relations.inbound(tables, parts, space_id=is_("root")).select(*EDGE)


# Each relation of a kind with its source, target, type and own entity.
@query("""
SELECT id, from_id, to_id, relation_type, '0' AS from_created_at_block,
       CAST(NULL AS STRING) AS type_created_at_block FROM fx_relations
WHERE relation_type = 'located_in'
""")
def relation_ends(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    edges = relations.find(tables, RelationFilter(relation_type=is_("located_in")), limit=None)
    return relations.ends(tables, edges).select(
        "id", "from_id", "to_id", "relation_type", "from_created_at_block", "type_created_at_block"
    )


# From the customers of a segment to their orders, then to the parts in them.
@query("""
SELECT DISTINCT c.to_id AS id FROM fx_relations p JOIN fx_relations c ON c.from_id = p.from_id
WHERE p.relation_type = 'placed_by' AND c.relation_type = 'contains' AND p.to_id IN (
  SELECT entity FROM fx_triples WHERE attribute = 'segment' AND value = 'BUILDING')
AND c.to_id <> 'part:0'
""")
def traverse_two_hops(spark, sf_dir):
    where = EntityFilter(
        attributes=[HasAttribute("segment", is_("BUILDING"))],
        hops=[
            Hop(is_("placed_by"), inbound=True),
            Hop(is_("contains"), destination=Where(ne="part:0")),
        ],
    )
    return entities.matching(fixtures.graph(spark, sf_dir), where)
