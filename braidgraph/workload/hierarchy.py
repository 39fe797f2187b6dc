"""The space hierarchy, nearest values and inherited schema."""

from pyspark.sql import functions as F

from braidgraph.graph import Graph
from braidgraph.operators import hierarchy, hierarchy_versions
from braidgraph.operators.history import version_stamp
from braidgraph.operators.writes import initial_relations
from braidgraph.workload import fixtures
from braidgraph.workload.registry import query

KEY = ["space_id", "entity", "attribute"]

# The first value in order of depth for each key, over a candidates view.
NEAREST = """
SELECT space_id, entity, attribute, value, found_space, depth FROM (
  SELECT *, row_number() OVER (PARTITION BY space_id, entity, attribute
                               ORDER BY depth, found_space) AS rn FROM candidate_hits) x
WHERE rn = 1"""
DOWN_HITS = """
SELECT k.space_id, k.entity, k.attribute, t.value, t.space_id AS found_space, p.depth
FROM fx_title_keys k JOIN fx_parents p ON p.root = k.space_id
JOIN fx_titles t ON t.entity = k.entity AND t.attribute = k.attribute AND t.space_id = p.space_id"""
UP_HITS = """
SELECT k.space_id, k.entity, k.attribute, t.value, t.space_id AS found_space, p.depth
FROM fx_title_keys k JOIN fx_parents p ON p.space_id = k.space_id
JOIN fx_titles t ON t.entity = k.entity AND t.attribute = k.attribute AND t.space_id = p.root"""
DIRECTIONS = """
SELECT space_id, attribute, direction FROM (
  SELECT k.space_id, k.attribute, t.value AS direction,
         row_number() OVER (PARTITION BY k.space_id, k.attribute ORDER BY p.depth) AS rn
  FROM (SELECT DISTINCT space_id, attribute FROM fx_title_keys) k
  LEFT JOIN fx_parents p ON p.root = k.space_id
  LEFT JOIN fx_titles t ON t.entity = k.attribute AND t.attribute = 'direction'
   AND t.space_id = p.space_id WHERE t.value IS NOT NULL) x WHERE rn = 1"""


def _keys(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "fx_title_keys")


def _parents(spark, sf_dir):
    return hierarchy.parent_spaces(fixtures.graph(spark, sf_dir))


@query("SELECT root, space_id, depth FROM fx_parents")
def space_parents(spark, sf_dir):
    return _parents(spark, sf_dir)


@query("SELECT space_id AS root, root AS space_id, depth FROM fx_parents")
def space_children(spark, sf_dir):
    return hierarchy.subspaces(fixtures.graph(spark, sf_dir))


# One level down from the spaces that hold customers' regions.
@query("""
SELECT space_id AS root, root AS space_id, depth FROM fx_parents
WHERE depth <= 1 AND space_id IN (SELECT 'region:' || CAST(r_regionkey AS STRING) FROM region)
""")
def space_children_one_level(spark, sf_dir):
    roots = fixtures.table(spark, sf_dir, "region").select(
        F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("space_id")
    )
    return hierarchy.subspaces(fixtures.graph(spark, sf_dir), roots, max_depth=1)


@query(NEAREST, candidate_hits=DOWN_HITS)
def triple_nearest_down(spark, sf_dir):
    return hierarchy.nearest_down(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), _parents(spark, sf_dir)
    ).drop("value_type")


@query(NEAREST, candidate_hits=UP_HITS)
def triple_nearest_up(spark, sf_dir):
    return hierarchy.nearest_up(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), _parents(spark, sf_dir)
    ).drop("value_type")


# A ranking given by the caller: every space looks at the root first, then at itself.
RANKING = """
SELECT root, space_id, CASE space_id WHEN 'root' THEN 0 ELSE 1 + depth END AS depth
FROM fx_parents"""


@query(
    NEAREST,
    candidate_hits=DOWN_HITS.replace("fx_parents", "given_ranking"), given_ranking=RANKING,
)
def triple_ranked_spaces(spark, sf_dir):
    ranking = _parents(spark, sf_dir).withColumn(
        "depth", F.when(F.col("space_id") == "root", 0).otherwise(F.col("depth") + 1)
    )
    return hierarchy.nearest(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), ranking
    ).drop("value_type")


@query("SELECT space_id, attribute, direction FROM title_directions", title_directions=DIRECTIONS)
def property_direction(spark, sf_dir):
    return hierarchy.aggregation_directions(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), _parents(spark, sf_dir)
    )


INHERITED_HITS = """
SELECT h.* FROM down_hits h JOIN title_directions d USING (space_id, attribute)
WHERE direction IN ('Down', 'Bidirectional')
UNION ALL
SELECT h.* FROM up_hits h JOIN title_directions d USING (space_id, attribute)
WHERE direction IN ('Up', 'Bidirectional')"""


@query(
    NEAREST, candidate_hits=INHERITED_HITS, down_hits=DOWN_HITS, up_hits=UP_HITS,
    title_directions=DIRECTIONS,
)
def inherited_triple(spark, sf_dir):
    return hierarchy.inherited_triples(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), _parents(spark, sf_dir)
    ).drop("value_type")


@query(
    NEAREST,
    candidate_hits=DOWN_HITS + " WHERE t.space_id = k.space_id",
)
def strict_triple(spark, sf_dir):
    return hierarchy.inherited_triples(
        fixtures.title_graph(spark, sf_dir), _keys(spark, sf_dir), _parents(spark, sf_dir),
        strict=True,
    ).drop("value_type")


def _nations(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("space_id")
    )


TYPES = """
SELECT DISTINCT p.root AS space_id, t.entity AS type_id
FROM fx_schema_triples t JOIN fx_parents p ON p.space_id = t.space_id AND p.root LIKE 'nation:%'
WHERE t.entity IN (SELECT from_id FROM fx_schema_relations WHERE relation_type = 'types')"""
PROPERTIES = """
SELECT DISTINCT t.space_id, t.type_id, r.to_id AS property, r.id AS relation_id, r.index
FROM types_in t JOIN fx_parents p ON p.root = t.space_id
JOIN fx_schema_relations r ON r.relation_type = 'properties' AND r.from_id = t.type_id
 AND r.space_id = p.space_id"""
VALUE_TYPES = """
SELECT space_id, property, value_type FROM (
  SELECT t.space_id, t.property, r.to_id AS value_type,
         row_number() OVER (PARTITION BY t.space_id, t.property ORDER BY r.index, r.id) AS rn
  FROM (SELECT DISTINCT space_id, property FROM properties_of) t
  JOIN fx_parents p ON p.root = t.space_id
  JOIN fx_schema_relations r ON r.relation_type = 'value_type' AND r.from_id = t.property
   AND r.space_id = p.space_id) x WHERE rn = 1"""
NAMES = """
SELECT space_id, id, name FROM (
  SELECT p.root AS space_id, t.entity AS id, t.value AS name,
         row_number() OVER (PARTITION BY p.root, t.entity ORDER BY p.depth) AS rn
  FROM fx_schema_triples t JOIN fx_parents p ON p.space_id = t.space_id
  WHERE t.attribute = 'name') x WHERE rn = 1"""
SCHEMA = dict(types_in=TYPES, properties_of=PROPERTIES, value_types_of=VALUE_TYPES, names_of=NAMES)


@query("SELECT * FROM types_in", **SCHEMA)
def space_types(spark, sf_dir):
    return hierarchy.space_types(
        fixtures.schema_graph(spark, sf_dir), _nations(spark, sf_dir), _parents(spark, sf_dir)
    )


@query("""
SELECT DISTINCT space_id, entity AS type_id FROM fx_schema_triples
WHERE space_id LIKE 'nation:%' AND entity LIKE 'class:%'
""")
def space_types_strict(spark, sf_dir):
    return hierarchy.space_types(fixtures.schema_graph(spark, sf_dir), _nations(spark, sf_dir))


@query("SELECT space_id, type_id, property, relation_id, index FROM properties_of", **SCHEMA)
def type_properties(spark, sf_dir):
    graph, parents = fixtures.schema_graph(spark, sf_dir), _parents(spark, sf_dir)
    types = hierarchy.space_types(graph, _nations(spark, sf_dir), parents)
    return hierarchy.type_properties(graph, types, parents)


@query("SELECT space_id, property, value_type FROM value_types_of", **SCHEMA)
def property_value_types(spark, sf_dir):
    graph, parents = fixtures.schema_graph(spark, sf_dir), _parents(spark, sf_dir)
    types = hierarchy.space_types(graph, _nations(spark, sf_dir), parents)
    properties = hierarchy.type_properties(graph, types, parents)
    return hierarchy.value_types(graph, properties, parents)


@query(
    "SELECT t.space_id, t.type_id, p.property, v.value_type, a.name AS type_name, "
    "b.name AS property_name, c.name AS value_type_name FROM types_in t "
    "LEFT JOIN properties_of p ON p.space_id = t.space_id AND p.type_id = t.type_id "
    "LEFT JOIN value_types_of v ON v.space_id = t.space_id AND v.property = p.property "
    "LEFT JOIN names_of a ON a.space_id = t.space_id AND a.id = t.type_id "
    "LEFT JOIN names_of b ON b.space_id = t.space_id AND b.id = p.property "
    "LEFT JOIN names_of c ON c.space_id = t.space_id AND c.id = v.value_type",
    **SCHEMA,
)
def schema_report(spark, sf_dir):
    return hierarchy.schema_report(
        fixtures.schema_graph(spark, sf_dir), _nations(spark, sf_dir), _parents(spark, sf_dir)
    )


# Lines of parts seen from the home nation of their supplier, in any space above or below.
SUPPLY = """
SELECT 'supplied_by>' || CAST(l_partkey AS STRING) || '>' || CAST(l_suppkey AS STRING) AS id,
       'topic:' || CAST(l_partkey AS STRING) AS from_id,
       'supplier:' || CAST(l_suppkey AS STRING) AS to_id, 'title' AS relation_type,
       lpad(CAST(l_suppkey AS STRING), 12, '0') AS index,
       'nation:' || CAST(s_nationkey AS STRING) AS space_id
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey"""


@query(
    "SELECT DISTINCT k.space_id, k.entity, r.id AS relation_id, r.to_id, r.space_id AS found_space "
    "FROM fx_title_keys k JOIN title_directions d ON d.space_id = k.space_id "
    "JOIN supply_edges r ON r.from_id = k.entity "
    "LEFT JOIN fx_parents up ON up.root = k.space_id AND up.space_id = r.space_id "
    "LEFT JOIN fx_parents down ON down.space_id = k.space_id AND down.root = r.space_id "
    "WHERE r.space_id = k.space_id "
    "OR (direction IN ('Down', 'Bidirectional') AND up.root IS NOT NULL) "
    "OR (direction IN ('Up', 'Bidirectional') AND down.root IS NOT NULL)",
    supply_edges=SUPPLY, title_directions=DIRECTIONS,
)
def inherited_relations(spark, sf_dir):
    titles = fixtures.title_graph(spark, sf_dir)
    edges = initial_relations(fixtures.select(spark, sf_dir, SUPPLY))
    graph = Graph(titles.triples, edges, titles.entities, fixtures.VOCABULARY)
    return hierarchy.inherited_relations(
        graph, _keys(spark, sf_dir), _parents(spark, sf_dir)
    ).select("space_id", "entity", "relation_id", "to_id", "found_space")


# Names of parts as each nation that supplies them sees them.
@query("""
SELECT k.space_id, k.id, t.value AS name FROM (
  SELECT DISTINCT 'nation:' || CAST(s_nationkey AS STRING) AS space_id,
         'part:' || CAST(l_partkey AS STRING) AS id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) k
JOIN fx_triples t ON t.entity = k.id AND t.attribute = 'name'
""")
def entity_names_inherited(spark, sf_dir):
    pairs = _keys(spark, sf_dir).filter(F.col("space_id").startswith("nation:")).select(
        "space_id", F.replace("entity", F.lit("topic:"), F.lit("part:")).alias("id")
    )
    return hierarchy.names_in(
        fixtures.graph(spark, sf_dir), pairs, _parents(spark, sf_dir)
    )


# The hierarchy as of four versions, each walked anew from the edges that hold there.
AS_OF_MARKS = """
SELECT printf('%016d:%08d', CAST(m * k // 4 AS BIGINT), 0) AS at_version
FROM (SELECT max(o_orderkey) AS m FROM orders) x, (SELECT unnest([1, 2, 3, 4]) AS k) y"""
AS_OF_EDGES = """
SELECT at_version, child, parent FROM (
  SELECT at_version, child, parent, added,
         row_number() OVER (PARTITION BY at_version, child, parent ORDER BY version DESC, added DESC) AS rn
  FROM as_of_marks JOIN fx_space_changes ON version <= at_version) x
WHERE rn = 1 AND added"""


@query(
    """
SELECT version, root, space_id, min(depth) AS depth FROM (
  WITH RECURSIVE up AS (
    SELECT at_version AS version, child AS root, child AS space_id, 0 AS depth FROM as_of_edges
    UNION SELECT at_version, parent, parent, 0 FROM as_of_edges
    UNION SELECT up.version, up.root, e.parent, up.depth + 1
    FROM up JOIN as_of_edges e ON e.at_version = up.version AND e.child = up.space_id AND e.child <> e.parent)
  SELECT * FROM up) reached
GROUP BY version, root, space_id""",
    as_of_marks=AS_OF_MARKS, as_of_edges=AS_OF_EDGES,
)
def space_parents_as_of(spark, sf_dir):
    """Built from the first half of the changes, extended by the second, read at quarters."""
    changes = fixtures.view(spark, sf_dir, "fx_space_changes")
    last = fixtures.table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m"))
    quarters = last.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "m").select(
        F.floor(F.col("m") * F.col("k") / 4).alias("block_number"), F.lit(0).alias("edit_idx")
    )
    marks = [row["at"] for row in quarters.select(version_stamp().alias("at")).orderBy("at").collect()]
    before = hierarchy_versions.edge_versions(changes.filter(F.col("version") < marks[1]))
    closure = hierarchy_versions.closure_versions(before)
    closure = hierarchy_versions.extend(closure, hierarchy_versions.edge_versions(changes), marks[1])
    found = None
    for mark in marks:
        rows = hierarchy_versions.spaces_at(closure, mark).select(F.lit(mark).alias("version"), "*")
        found = rows if found is None else found.unionByName(rows)
    return found
