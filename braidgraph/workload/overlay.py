"""Typed views, value conversion and conformance."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where
from braidgraph.operators import conformance, overlay, triples
from braidgraph.operators.overlay import Field
from braidgraph.workload import fixtures
from braidgraph.workload.registry import query
from braidgraph.workload.relations import LINE_TRIPLES, line_graph

ORDER = {
    "status": Field("status"),
    "total": Field("totalprice", "NUMBER"),
    "ordered_at": Field("orderdate", "TIME"),
    "segment": Field("segment", required=False),
}


@query("""
SELECT entity, max(CASE WHEN attribute = 'status' THEN value END) AS status,
       max(CASE WHEN attribute = 'totalprice' THEN CAST(value AS DOUBLE) END) AS total,
       max(CASE WHEN attribute = 'orderdate' THEN CAST(replace(value, 'Z', '') AS TIMESTAMP) END)
         AS ordered_at,
       CAST(NULL AS STRING) AS segment
FROM fx_triples WHERE entity LIKE 'order:%' GROUP BY entity
""")
def typed_wide(spark, sf_dir):
    wide = overlay.to_wide(fixtures.graph(spark, sf_dir).triples, ORDER)
    valid, _ = overlay.split_errors(wide, ORDER)
    return valid


# Entities that have some but not all required fields.
@query("""
SELECT entity, CAST(NULL AS DOUBLE) AS balance FROM fx_triples
WHERE attribute = 'name' AND entity NOT IN (
  SELECT entity FROM fx_triples WHERE attribute = 'acctbal')
""")
def typed_errors(spark, sf_dir):
    fields = {"name": Field("name"), "balance": Field("acctbal", "NUMBER")}
    wide = overlay.to_wide(fixtures.graph(spark, sf_dir).triples, fields)
    _, errors = overlay.split_errors(wide, fields)
    return errors.select("entity", "balance")


@query("""
SELECT entity, attribute, value, value_type FROM fx_triples
WHERE entity LIKE 'customer:%' OR (entity LIKE 'order:%' AND attribute <> 'orderdate')
UNION ALL
SELECT entity, attribute, replace(value, 'Z', '.000000Z'), value_type FROM fx_triples
WHERE attribute = 'orderdate'
""")
def wide_to_triples(spark, sf_dir):
    customers = fixtures.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity"),
        "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"),
    )
    orders = fixtures.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("entity"),
        "o_orderstatus", "o_orderpriority", "o_orderdate",
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
    )
    parts = [
        overlay.to_triples(
            customers, ["entity"],
            {"c_name": ("name", "TEXT"), "c_mktsegment": ("segment", "TEXT"),
             "c_acctbal": ("acctbal", "NUMBER")},
        ),
        overlay.to_triples(
            orders, ["entity"],
            {"o_orderstatus": ("status", "TEXT"), "o_orderpriority": ("priority", "TEXT"),
             "o_totalprice": ("totalprice", "NUMBER"), "o_orderdate": ("orderdate", "TIME")},
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""
SELECT n.entity, n.value AS name, TRY_CAST(b.value AS DOUBLE) AS balance
FROM fx_triples n JOIN fx_triples b ON b.entity = n.entity AND b.attribute = 'acctbal'
WHERE n.attribute = 'name' AND n.entity LIKE 'customer:%'
  AND TRY_CAST(b.value AS DECIMAL(18,2)) < 0 AND n.value > 'Customer#000000010'
""")
def typed_find(spark, sf_dir):
    fields = {"name": Field("name"), "balance": Field("acctbal", "NUMBER")}
    return overlay.find(
        fixtures.graph(spark, sf_dir), "type:customer", fields,
        {"balance": Where(lt="0", numeric=True), "name": Where(gt="Customer#000000010")},
        limit=None,
    )


# Order lines as typed relations.
@query(
    "SELECT r.id, from_id, to_id, quantity, shipped FROM contained_lines r JOIN line_values ON entity = r.id "
    "WHERE quantity IS NOT NULL AND shipped IS NOT NULL",
    line_values="SELECT entity, max(CASE attribute WHEN 'quantity' THEN CAST(value AS DOUBLE) END) "
    "AS quantity, max(CASE attribute WHEN 'shipped' THEN value END) AS shipped "
    "FROM line_triples WHERE attribute IN ('quantity', 'shipped') GROUP BY entity",
    contained_lines="SELECT id, from_id, to_id FROM fx_relations WHERE relation_type = 'contains'",
    line_triples=LINE_TRIPLES,
)
def typed_relations(spark, sf_dir):
    fields = {"quantity": Field("quantity", "NUMBER"), "shipped": Field("shipped")}
    view = overlay.relation_view(line_graph(spark, sf_dir), "contains", fields)
    return view.select("id", "from_id", "to_id", "quantity", "shipped")


# Typed reads out of the attribute map of an entity.
@query("""
SELECT entity, CAST(max(CASE WHEN attribute = 'size' THEN value END) AS BIGINT) AS size,
       max(CASE WHEN attribute = 'brand' THEN value END) AS brand
FROM fx_triples WHERE entity LIKE 'part:%' GROUP BY entity
""")
def typed_map_access(spark, sf_dir):
    parts = fixtures.graph(spark, sf_dir).triples.filter(F.col("entity").startswith("part:"))
    maps = triples.attribute_maps(parts)
    return maps.select(
        "entity", overlay.get("attributes", "size", "BIGINT").alias("size"),
        overlay.get("attributes", "brand").alias("brand"),
    )


@query("""
SELECT 'account' AS kind, lower('0xC' || lpad(CAST(c_custkey AS STRING), 12, '0')) AS source,
       md5(lower('0xC' || lpad(CAST(c_custkey AS STRING), 12, '0'))) AS id FROM customer
UNION ALL SELECT 'space', 'home:' || n_nationkey, md5('home:' || n_nationkey) FROM nation
UNION ALL SELECT 'edit', x, md5(x) FROM (
  SELECT DISTINCT 'ipfs://' || (event_id // 50) || '/' || (event_id % 5) AS x FROM events) e
UNION ALL SELECT 'version', x, md5(x) FROM (
  SELECT DISTINCT 'space:' || (user_id % 4) || ':' || (event_id // 50) AS x FROM events) v
""")
def assign_ids(spark, sf_dir):
    customers = fixtures.table(spark, sf_dir, "customer")
    events = fixtures.table(spark, sf_dir, "events")
    block = F.floor(F.col("event_id") / 50).cast("string")
    address = F.concat(F.lit("0xC"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    parts = [
        conformance.assign_ids(customers, F.lower(address), "account"),
        conformance.assign_ids(
            fixtures.table(spark, sf_dir, "nation"),
            F.concat_ws(":", F.lit("home"), F.col("n_nationkey").cast("string")), "space",
        ),
        conformance.assign_ids(
            events,
            F.concat(F.lit("ipfs://"), block, F.lit("/"), (F.col("event_id") % 5).cast("string")),
            "edit",
        ),
        conformance.assign_ids(
            events,
            F.concat_ws(
                ":", F.concat(F.lit("space:"), (F.col("user_id") % 4).cast("string")), block
            ),
            "version",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


# An id shared by two sources is reported: names of parts are not unique keys.
@query("""
SELECT md5(p_name) AS id, count(DISTINCT p_partkey) AS sources FROM part
GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1
""")
def id_collisions(spark, sf_dir):
    parts = fixtures.table(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("source"),
        F.md5(F.col("p_name").cast("binary")).alias("id"),
    )
    return conformance.id_collisions(parts)


# Every value declared as a number, a truth value, a time or text.
REPORT = """
SELECT attribute, CASE attribute WHEN 'status' THEN 'CHECKBOX' WHEN 'priority' THEN 'NUMBER'
       WHEN 'name' THEN 'TIME' ELSE value_type END AS value_type, value FROM fx_triples"""


@query(
    r"""
    SELECT attribute, value_type, count(*) AS total,
      count(CASE WHEN value_type = 'NUMBER' AND TRY_CAST(value AS DOUBLE) IS NULL
                   OR value_type = 'CHECKBOX' AND value NOT IN ('true', 'false')
                   OR value_type = 'TIME' AND TRY_CAST(replace(value, 'Z', '') AS TIMESTAMP) IS NULL
                 THEN 1 END) AS failed,
      count(CASE WHEN value_type = 'NUMBER' AND regexp_full_match(value, '[+-]?[0-9]+')
                 THEN 1 END) AS as_signed,
      count(CASE WHEN value_type = 'NUMBER' AND regexp_full_match(value, '[+]?[0-9]+')
                 THEN 1 END) AS as_unsigned
    FROM declared_values GROUP BY 1, 2
    """,
    declared_values=REPORT,
)
def typed_value_report(spark, sf_dir):
    declared = fixtures.graph(spark, sf_dir).triples.withColumn(
        "value_type",
        F.when(F.col("attribute") == "status", "CHECKBOX")
        .when(F.col("attribute") == "priority", "NUMBER")
        .when(F.col("attribute") == "name", "TIME")
        .otherwise(F.col("value_type")),
    )
    return conformance.typed_value_report(declared)


# Order lines refer to parts by uri; every fifth supplier id has no entity behind it.
REFERENCES = """
SELECT 'order:' || CAST(l_orderkey AS STRING) AS entity, 'item' AS attribute,
       'root' AS space_id, 'graph://part:' || CAST(l_partkey + l_suppkey AS STRING) AS value
FROM lineitem
UNION ALL
SELECT 'order:' || CAST(o_orderkey AS STRING), 'note', 'root',
       CASE o_orderstatus WHEN 'F' THEN 'graph://' ELSE o_orderpriority END FROM orders"""


@query(
    "SELECT entity, attribute, nullif(substr(value, 9), '') AS target FROM reference_values "
    "WHERE value LIKE 'graph://%'",
    reference_values=REFERENCES,
)
def graph_uri_edges(spark, sf_dir):
    rows = fixtures.select(spark, sf_dir, REFERENCES)
    return conformance.references(rows).select("entity", "attribute", "target")


@query(
    "SELECT entity, attribute, nullif(substr(value, 9), '') AS target FROM reference_values "
    "WHERE value LIKE 'graph://%' AND substr(value, 9) NOT IN (SELECT id FROM fx_entities)",
    reference_values=REFERENCES,
)
def dangling_references(spark, sf_dir):
    edges = conformance.references(fixtures.select(spark, sf_dir, REFERENCES))
    return conformance.dangling(edges, fixtures.graph(spark, sf_dir).entities).select(
        "entity", "attribute", "target"
    )


# Event types stand for vote codes; unknown codes go to the error side.
@query("""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT'
       ELSE 'unknown' END AS vote FROM events
""")
def code_conformance(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events")
    codes = {"purchase": "ACCEPT", "error": "REJECT"}
    known, unknown = conformance.conform(events, "event_type", codes, "vote")
    return known.select("event_id", "vote").unionByName(
        unknown.select("event_id", F.lit("unknown").alias("vote"))
    )


@query(
    "SELECT source, address, lower(address) AS key FROM (SELECT DISTINCT role AS source, address "
    "FROM fx_roles UNION SELECT DISTINCT 'DAO', dao_address FROM fx_roles) x"
)
def address_conformance(spark, sf_dir):
    roles = fixtures.view(spark, sf_dir, "fx_roles")
    return conformance.conform_addresses(
        {
            "MEMBER": roles.filter("role = 'MEMBER'").select("address"),
            "EDITOR": roles.filter("role = 'EDITOR'").select("address"),
            "DAO": roles.select(F.col("dao_address").alias("address")),
        }
    )
