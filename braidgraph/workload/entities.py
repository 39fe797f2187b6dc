"""Filters, order, pages and hydration of entities."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, is_, one_of
from braidgraph.operators import entities, triples
from braidgraph.operators.entities import EntityFilter, HasAttribute, HasRelation, OrderBy
from braidgraph.workload import fixtures
from braidgraph.workload.registry import query


@query("""
SELECT 'eq' AS op, entity, value FROM fx_triples WHERE attribute='segment' AND value='BUILDING'
UNION ALL SELECT 'ne', entity, value FROM fx_triples WHERE attribute='segment' AND value<>'BUILDING'
UNION ALL SELECT 'gt', entity, value FROM fx_triples WHERE attribute='acctbal' AND value>'500'
UNION ALL SELECT 'gte', entity, value FROM fx_triples WHERE attribute='brand' AND value>='Brand#2'
UNION ALL SELECT 'lt', entity, value FROM fx_triples WHERE attribute='orderdate' AND value<'1997-01-01'
UNION ALL SELECT 'lte', entity, value FROM fx_triples WHERE attribute='status' AND value<='O'
UNION ALL SELECT 'any_of', entity, value FROM fx_triples
  WHERE attribute='priority' AND value IN ('1-URGENT','5-LOW')
UNION ALL SELECT 'none_of', entity, value FROM fx_triples
  WHERE attribute='priority' AND value NOT IN ('1-URGENT','5-LOW')
UNION ALL SELECT 'numeric', entity, value FROM fx_triples
  WHERE attribute='totalprice' AND CAST(value AS DECIMAL(18,2)) BETWEEN 9000 AND 200000
""")
def prop_filter_all_ops(spark, sf_dir):
    table = fixtures.graph(spark, sf_dir).triples
    cases = {
        "eq": ("segment", Where(eq="BUILDING")),
        "ne": ("segment", Where(ne="BUILDING")),
        "gt": ("acctbal", Where(gt="500")),
        "gte": ("brand", Where(gte="Brand#2")),
        "lt": ("orderdate", Where(lt="1997-01-01")),
        "lte": ("status", Where(lte="O")),
        "any_of": ("priority", Where(any_of=["1-URGENT", "5-LOW"])),
        "none_of": ("priority", Where(none_of=["1-URGENT", "5-LOW"])),
        "numeric": ("totalprice", Where(gte="9000", lte="200000", numeric=True)),
    }
    parts = [
        triples.scan(table, attribute=is_(attribute), value=where).select(
            F.lit(op).alias("op"), "entity", "value"
        )
        for op, (attribute, where) in cases.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _ids(spark, sf_dir, where: EntityFilter) -> DataFrame:
    return entities.find(fixtures.graph(spark, sf_dir), where, limit=None).select("id")


@query("SELECT DISTINCT entity AS id FROM fx_triples WHERE space_id IN ('nation:3', 'region:1')")
def entities_in_space(spark, sf_dir):
    return _ids(spark, sf_dir, EntityFilter(space_id=one_of("nation:3", "region:1")))


@query("""
SELECT from_id AS id FROM fx_relations
WHERE relation_type = 'types' AND to_id IN ('type:supplier', 'type:part')
""")
def entities_by_type(spark, sf_dir):
    return _ids(spark, sf_dir, EntityFilter(types=["type:supplier", "type:part"]))


@query("""
SELECT id FROM fx_entities WHERE id IN (
  SELECT from_id FROM fx_relations WHERE relation_type = 'contains' AND to_id >= 'part:5')
AND id IN (SELECT entity FROM fx_triples WHERE attribute = 'status' AND value = 'F')
AND id <> 'order:1'
""")
def entities_by_relation(spark, sf_dir):
    return _ids(
        spark, sf_dir,
        EntityFilter(
            id=Where(ne="order:1"),
            relations=[HasRelation(is_("contains"), to_id=Where(gte="part:5"))],
            attributes=[HasAttribute("status", value=is_("F"))],
        ),
    )


@query("""
SELECT id FROM fx_entities WHERE id NOT IN (
  SELECT from_id FROM fx_relations WHERE relation_type = 'types'
  AND to_id IN ('type:order', 'type:part'))
""")
def entities_not_type(spark, sf_dir):
    return _ids(spark, sf_dir, EntityFilter(not_types=["type:order", "type:part"]))


# Attribute filters on value and value type, chained.
@query("""
SELECT id FROM fx_entities WHERE id IN (
  SELECT entity FROM fx_triples WHERE attribute = 'acctbal' AND value_type IN ('NUMBER', 'TEXT')
  AND TRY_CAST(value AS DECIMAL(18,2)) > 5000 AND space_id <> 'nation:7')
AND id IN (SELECT entity FROM fx_triples WHERE attribute = 'segment'
           AND value NOT IN ('BUILDING', 'MACHINERY') AND value_type <> 'NUMBER')
""")
def entities_by_attribute_filters(spark, sf_dir):
    rich = HasAttribute(
        "acctbal", value=Where(gt="5000", numeric=True),
        value_type=one_of("NUMBER", "TEXT"), space_id=Where(ne="nation:7"),
    )
    segment = HasAttribute(
        "segment", value=Where(none_of=["BUILDING", "MACHINERY"]), value_type=Where(ne="NUMBER")
    )
    return _ids(spark, sf_dir, EntityFilter(attributes=[rich, segment]))


# Batch lookup of nodes by id: every customer that ordered.
@query("SELECT DISTINCT 'customer:' || CAST(o_custkey AS STRING) AS id FROM orders")
def entities_by_id(spark, sf_dir):
    keys = fixtures.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id")
    )
    return entities.by_ids(fixtures.graph(spark, sf_dir), keys).select("id")


@query("""
SELECT entity AS id, CAST(value AS DECIMAL(18,2)) AS balance FROM fx_triples
WHERE attribute = 'acctbal' AND entity LIKE 'customer:%'
ORDER BY CAST(value AS DECIMAL(18,2)) DESC, entity LIMIT 200 OFFSET 50
""")
def entities_ordered_page(spark, sf_dir):
    page = entities.find(
        fixtures.graph(spark, sf_dir), EntityFilter(types=["type:customer"]),
        OrderBy("acctbal", descending=True, numeric=True), limit=200, skip=50,
    )
    return page.select("id", F.col("sort_value").cast("decimal(18,2)").alias("balance"))


@query("""
SELECT entity AS id, value FROM fx_triples WHERE attribute = 'acctbal'
ORDER BY value, entity LIMIT 100 OFFSET 20
""")
def entities_ordered_as_text(spark, sf_dir):
    page = entities.find(
        fixtures.graph(spark, sf_dir), order_by=OrderBy("acctbal"), limit=100, skip=20
    )
    return page.select("id", F.col("sort_value").alias("value"))


# One page of suppliers with their attributes and types as lists.
@query("""
WITH page AS (SELECT entity AS id FROM fx_triples WHERE attribute = 'name'
              AND entity LIKE 'supplier:%' ORDER BY value, entity LIMIT 60 OFFSET 5)
SELECT id,
  (SELECT string_agg(attribute || '=' || value, '|' ORDER BY attribute)
   FROM fx_triples WHERE entity = id) AS attributes,
  (SELECT string_agg(to_id, '|' ORDER BY to_id) FROM fx_relations
   WHERE relation_type = 'types' AND from_id = page.id) AS types
FROM page
""".replace("WITH page AS", "SELECT * FROM (WITH page AS") + ") x")
def entities_hydrated(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    page = entities.find(
        tables, EntityFilter(types=["type:supplier"]), OrderBy("name"), limit=60, skip=5
    )
    shown = F.transform("attributes", lambda a: F.concat(a["key"], F.lit("="), a["value"]))
    return entities.hydrate_page(tables, page).select(
        "id", F.concat_ws("|", shown).alias("attributes"), F.concat_ws("|", "types").alias("types")
    )


@query("""
SELECT e.id, h.kind, h.key, h.value FROM fx_entities e LEFT JOIN (
  SELECT entity AS id, 'attribute' AS kind, attribute AS key, value FROM fx_triples
  UNION ALL SELECT from_id, 'type', to_id, NULL FROM fx_relations WHERE relation_type = 'types') h
ON e.id = h.id
""")
def entities_hydrated_long(spark, sf_dir):
    tables = fixtures.graph(spark, sf_dir)
    nodes = entities.find(tables, limit=None)
    return entities.hydrate(tables, nodes).select("id", "kind", "key", "value")
