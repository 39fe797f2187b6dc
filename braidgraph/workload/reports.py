"""Composite reports over whole tables of ids."""

from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, is_
from braidgraph.operators import governance, hierarchy, reports
from braidgraph.operators.entities import EntityFilter, OrderBy
from braidgraph.operators.relations import RelationFilter
from braidgraph.workload import fixtures
from braidgraph.workload.governance import (
    ACCOUNT_VIEW,
    ACCOUNTS,
    SPACE_REPORT,
    SPACES,
    _held,
    _space,
    governance_graph,
)
from braidgraph.workload.registry import query

NAMED = "SELECT entity AS id, value AS name FROM fx_triples WHERE attribute = 'name'"


def _edges(near: str, far: str, section: str) -> str:
    return f"""
    SELECT p.id, '{section}' AS section, r.id AS relation_id, r.relation_type AS label,
           coalesce(n.name, 'No name') AS value, r.{far} AS other
    FROM fx_relations r
    JOIN profiled_ids p ON p.id = r.{near} LEFT JOIN name_rows n ON n.id = r.{far}"""


# Attributes and relations of every supplier, customer, nation and region.
@query(
    "SELECT entity AS id, 'attribute' AS section, CAST(NULL AS STRING) AS relation_id, "
    "'No attribute name' AS label, value, CAST(NULL AS STRING) AS other "
    "FROM fx_triples JOIN profiled_ids ON id = entity "
    f"UNION ALL {_edges('from_id', 'to_id', 'outbound')} "
    f"UNION ALL {_edges('to_id', 'from_id', 'inbound')}",
    name_rows=NAMED,
    profiled_ids="SELECT from_id AS id FROM fx_relations WHERE relation_type = 'types' AND to_id "
    "IN ('type:supplier', 'type:customer', 'type:nation', 'type:region')",
)
def entity_profile(spark, sf_dir):
    graph = fixtures.graph(spark, sf_dir)
    kinds = ["type:supplier", "type:customer", "type:nation", "type:region"]
    ids = graph.relations.filter(
        (F.col("relation_type") == "types") & F.col("to_id").isin(kinds)
    ).select(F.col("from_id").alias("id"))
    return reports.entity_profile(graph, ids)


@query(
    "SELECT e.id, coalesce(name, 'No name') AS name, CAST(NULL AS STRING) AS description "
    "FROM fx_entities e LEFT JOIN name_rows n ON n.id = e.id",
    name_rows=NAMED,
)
def entity_labels(spark, sf_dir):
    graph = fixtures.graph(spark, sf_dir)
    return reports.labels(graph, graph.entities)


@query(
    "SELECT entity, attribute, value, space_id, 'No attribute name' AS attribute_name "
    "FROM fx_triples WHERE attribute <> 'status' AND space_id <> 'root'"
)
def triples_with_names(spark, sf_dir):
    found = reports.triples_with_names(
        fixtures.graph(spark, sf_dir), attribute=Where(ne="status"), space_id=Where(ne="root")
    )
    return found.select("entity", "attribute", "value", "space_id", "attribute_name")


# Name, description and cover of each part as the nations that are supplied see it.
@query("""
SELECT k.space_id, 'part:' || substr(k.entity, 7) AS entity, t.value AS name,
       CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS cover
FROM fx_title_keys k JOIN fx_triples t
  ON t.entity = 'part:' || substr(k.entity, 7) AND t.attribute = 'name'
""")
def entity_fields_inherited(spark, sf_dir):
    graph = fixtures.graph(spark, sf_dir)
    return reports.entity_fields(graph, _part_keys(spark, sf_dir), hierarchy.parent_spaces(graph))


@query("""
SELECT k.space_id, 'part:' || substr(k.entity, 7) AS entity, CAST(NULL AS STRING) AS name,
       CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS cover FROM fx_title_keys k
""")
def entity_fields_strict(spark, sf_dir):
    return reports.entity_fields(fixtures.graph(spark, sf_dir), _part_keys(spark, sf_dir))


def _part_keys(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "fx_title_keys").select(
        "space_id", F.replace("entity", F.lit("topic:"), F.lit("part:")).alias("entity")
    )


@query("""
SELECT from_id AS entity, space_id, to_id AS id, index FROM fx_relations
WHERE relation_type = 'types' AND from_id LIKE 'order:%'
""")
def entity_types_links(spark, sf_dir):
    graph = fixtures.graph(spark, sf_dir)
    keys = graph.entities.filter(F.col("id").startswith("order:")).select(
        F.col("id").alias("entity"), F.lit("root").alias("space_id")
    )
    return reports.entity_links(graph, keys, "types")


@query("""
SELECT id, from_id, to_id, space_id FROM fx_relations
WHERE relation_type = 'located_in' AND to_id > 'nation:2'
""")
def entity_relations(spark, sf_dir):
    graph = fixtures.graph(spark, sf_dir)
    keys = graph.triples.select("entity", "space_id")
    where = RelationFilter(
        relation_type=is_("located_in"), to=EntityFilter(id=Where(gt="nation:2"))
    )
    return reports.entity_relations(graph, keys, where).select("id", "from_id", "to_id", "space_id")


@query("""
SELECT entity AS id FROM fx_triples WHERE attribute = 'acctbal' AND space_id = 'nation:3'
ORDER BY value DESC, entity LIMIT 40 OFFSET 3
""")
def entities_of_space_page(spark, sf_dir):
    return reports.entity_page(
        fixtures.graph(spark, sf_dir), space_id=is_("nation:3"),
        order_by=OrderBy("acctbal", descending=True), first=40, skip=3,
    ).select("id")


@query("""
SELECT id, from_id, to_id, relation_type FROM fx_relations
WHERE id > 'located_in' AND relation_type <> 'types' ORDER BY index, id LIMIT 1000 OFFSET 7
""")
def relations_full_page(spark, sf_dir):
    where = RelationFilter(id=Where(gt="located_in"), relation_type=Where(ne="types"))
    rows = reports.relation_page(fixtures.graph(spark, sf_dir), where, first=1000, skip=7)
    return rows.select("id", "from_id", "to_id", "relation_type")


@query("SELECT entity, address FROM account_rows WHERE address > '0x5e' ORDER BY entity LIMIT 100 "
       "OFFSET 20", account_rows=ACCOUNTS)
def accounts_page(spark, sf_dir):
    rows = governance.accounts(
        governance_graph(spark, sf_dir, ACCOUNT_VIEW), {"address": Where(gt="0x5e")}
    )
    return reports.page(rows, "entity", first=100, skip=20)


LINKS = f"""
SELECT {_space('subspace')} AS child, {_space('dao_address')} AS parent FROM fx_events a
WHERE kind = 'subspaces_added' AND subspace NOT IN (
  SELECT subspace FROM fx_events WHERE kind = 'subspaces_removed')"""


@query(
    "SELECT entity, governance_type, dao_address, "
    "(SELECT count(*) FROM member_rows m WHERE m.space_id = entity) AS members, "
    "(SELECT count(*) FROM editor_rows e WHERE e.space_id = entity) AS editors, "
    "(SELECT count(*) FROM space_links WHERE child = entity) AS parents, "
    "(SELECT count(*) FROM space_links WHERE child = entity) AS all_parents, "
    "(SELECT count(*) FROM space_links WHERE parent = entity) AS subspaces, "
    "(SELECT count(*) FROM space_links WHERE parent = entity) AS all_subspaces "
    "FROM space_rows",
    space_rows=SPACES, space_links=LINKS,
    member_rows=_held("members_added", "members_removed", "member_address"),
    editor_rows=_held("editors_added", "editors_removed", "editor_address"),
)
def space_report(spark, sf_dir):
    graph = governance_graph(spark, sf_dir, SPACE_REPORT)
    rows = reports.space_report(
        graph, hierarchy.parent_spaces(graph), hierarchy.subspaces(graph)
    )
    return rows.select(
        "entity", "governance_type", "dao_address", "members", "editors", "parents",
        "all_parents", "subspaces", "all_subspaces",
    )
