"""The space hierarchy: walks, nearest values and inherited schema.

``closure`` tables have (root, space_id, depth), one row per reachable space with its
smallest depth; the root itself is at depth 0.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, snapshot
from braidgraph.graph import Graph
from braidgraph.operators import entities
from braidgraph.plans.lineage import materialize
from braidgraph.vocabulary import DIRECTIONS

KEY = ["space_id", "entity", "attribute"]


def parent_edges(graph: Graph) -> DataFrame:
    """Current (child, parent) pairs of spaces."""
    voc = graph.vocabulary
    return (
        graph.relations.filter(
            snapshot()
            & (F.col("relation_type") == voc.parent_space)
            & (F.col("space_id") == voc.indexer_space)
        )
        .select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))
        .distinct()
    )


def _walk(
    graph: Graph, src: str, dst: str, roots: DataFrame | None, max_depth: int | None
) -> DataFrame:
    """Breadth-first, one level per round, each (root, space) kept once."""
    edges = materialize(parent_edges(graph), "space-edges")
    step = edges.select(F.col(src).alias("space_id"), F.col(dst).alias("next_id"))
    if roots is None:
        roots = edges.select(F.explode(F.array("child", "parent")).alias("space_id"))
    level = roots.select(
        F.col("space_id").alias("root"), "space_id", F.lit(0).alias("depth")
    ).distinct()
    reached = level = materialize(level, "space-level")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = (
            level.join(step, "space_id")
            .select("root", F.col("next_id").alias("space_id"), F.lit(depth).alias("depth"))
            .distinct()
            .join(reached.select("root", "space_id"), ["root", "space_id"], "left_anti")
        )
        level = materialize(found, "space-level")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return materialize(reached, "space-closure")


def parent_spaces(
    graph: Graph, roots: DataFrame | None = None, max_depth: int | None = None
) -> DataFrame:
    """Spaces above each root (all spaces by default)."""
    return _walk(graph, "child", "parent", roots, max_depth)


def subspaces(
    graph: Graph, roots: DataFrame | None = None, max_depth: int | None = None
) -> DataFrame:
    """Spaces below each root (all spaces by default)."""
    return _walk(graph, "parent", "child", roots, max_depth)


def with_self(spaces: DataFrame) -> DataFrame:
    """Closure rows of spaces that only see themselves."""
    return spaces.select(
        F.col("space_id").alias("root"), "space_id", F.lit(0).alias("depth")
    ).distinct()


def covering(closure: DataFrame, keys: DataFrame) -> DataFrame:
    """The closure, plus a depth 0 row for key spaces that take part in no hierarchy."""
    alone = with_self(keys).join(
        closure.filter("depth = 0").select("root"), "root", "left_anti"
    )
    return closure.unionByName(alone)


def _nearest(hits: DataFrame, keys: list[str]) -> DataFrame:
    found = F.struct("value", "value_type", "found_space", "depth")
    order = F.struct("depth", "found_space")
    return (
        hits.groupBy(*keys).agg(F.min_by(found, order).alias("found")).select(*keys, "found.*")
    )


def nearest(
    graph: Graph, keys: DataFrame, ranking: DataFrame, version: str | None = None
) -> DataFrame:
    """Nearest value of each (space_id, entity, attribute) key along a ranking.

    ``ranking`` has (root, space_id, depth) with ``root`` matching the space of the key.
    Each key is expanded to the spaces it may look in, then met with the triples on the
    full key, so popular spaces are spread over their entities. Space ids break ties.
    """
    candidates = (
        keys.select(*KEY)
        .distinct()
        .withColumnRenamed("space_id", "root")
        .join(ranking, "root")
        .withColumnRenamed("space_id", "found_space")
    )
    values = graph.triples.filter(snapshot(version)).select(
        "entity", "attribute", F.col("space_id").alias("found_space"), "value", "value_type"
    )
    hits = candidates.join(values, ["entity", "attribute", "found_space"])
    return _nearest(hits, ["root", "entity", "attribute"]).withColumnRenamed("root", "space_id")


def nearest_down(
    graph: Graph, keys: DataFrame, parents: DataFrame, version: str | None = None
) -> DataFrame:
    """Nearest value among the space and its parents."""
    return nearest(graph, keys, covering(parents, keys), version)


def nearest_up(
    graph: Graph, keys: DataFrame, parents: DataFrame, version: str | None = None
) -> DataFrame:
    """Nearest value among the space and its subspaces.

    A space may have any number of subspaces but few spaces above it. So the values
    are lifted to every space above their own, and met with the keys there.
    """
    keys = keys.select(*KEY).distinct()
    values = (
        graph.triples.filter(snapshot(version))
        .select("entity", "attribute", "space_id", "value", "value_type")
        .join(keys.select("entity", "attribute").distinct(), ["entity", "attribute"], "left_semi")
    )
    above = covering(parents, values).select(
        F.col("root").alias("found_space"), F.col("space_id").alias("seen_from"), "depth"
    )
    lifted = (
        values.withColumnRenamed("space_id", "found_space")
        .join(above, "found_space")
        .withColumnRenamed("seen_from", "space_id")
    )
    return _nearest(lifted.join(keys, KEY, "left_semi"), KEY)


def aggregation_directions(
    graph: Graph, keys: DataFrame, parents: DataFrame
) -> DataFrame:
    """Direction in which each (space_id, attribute) inherits; null where none is set.

    A few attributes always inherit down. For others the nearest direction triple of
    the attribute over the space and its parents decides.
    """
    voc = graph.vocabulary
    pairs = keys.select("space_id", "attribute").distinct()
    declared = nearest_down(
        graph,
        pairs.select(
            "space_id",
            F.col("attribute").alias("entity"),
            F.lit(voc.aggregation_direction).alias("attribute"),
        ),
        parents,
    ).select("space_id", F.col("entity").alias("attribute"), F.col("value").alias("declared"))
    direction = F.when(F.col("attribute").isin(*voc.inherited_down), F.lit("Down")).otherwise(
        F.when(F.col("declared").isin(*DIRECTIONS), F.col("declared"))
    )
    return pairs.join(declared, ["space_id", "attribute"], "left").select(
        "space_id", "attribute", direction.alias("direction")
    )


def inherited_triples(
    graph: Graph,
    keys: DataFrame,
    parents: DataFrame,
    version: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Nearest value of each (space_id, entity, attribute) in its inheritance direction."""
    keys = keys.select(*KEY).distinct()
    if strict:
        return nearest(graph, keys, with_self(keys), version)
    directed = keys.join(
        aggregation_directions(graph, keys, parents), ["space_id", "attribute"]
    )
    values = graph.triples.filter(snapshot(version)).select(
        "entity", "attribute", F.col("space_id").alias("found_space"), "value", "value_type"
    )
    return _nearest(_met(materialize(directed, "directed-keys"), values, parents), KEY)


def _met(directed: DataFrame, rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Every row that a key sees, with the number of steps between the two.

    ``directed`` has keys with their direction, ``rows`` (entity, attribute, found_space,
    ...). A key that inherits down is listed at all spaces above it, as those are few; for
    one that inherits up the rows are listed at the spaces above their own. Both lists
    name the space where key and row meet, so one join answers all directions. The space
    itself is seen in every direction.
    """
    direction = F.col("direction")
    above = covering(parents, directed).select(
        F.col("root").alias("space_id"), F.col("space_id").alias("meet"), "depth"
    )
    down = (
        directed.join(above, "space_id")
        .filter((F.col("depth") == 0) | direction.isin("Down", "Bidirectional"))
        .select(*KEY, "meet", F.lit(False).alias("lifted"), "depth")
    )
    upward = directed.filter(direction.isin("Up", "Bidirectional"))
    up = upward.select(
        *KEY, F.col("space_id").alias("meet"), F.lit(True).alias("lifted"), F.lit(0).alias("depth")
    )
    own = rows.select(
        "*", F.col("found_space").alias("meet"), F.lit(False).alias("lifted"), F.lit(0).alias("steps")
    )
    over = parents.filter("depth > 0").select(
        F.col("root").alias("found_space"), F.col("space_id").alias("meet"),
        F.lit(True).alias("lifted"), F.col("depth").alias("steps"),
    )
    asked = upward.select("entity", "attribute").distinct()
    lifted = rows.join(asked, ["entity", "attribute"], "left_semi").join(over, "found_space")
    met = down.unionByName(up).join(
        own.unionByName(lifted), ["entity", "attribute", "meet", "lifted"]
    )
    return met.withColumn("depth", F.col("depth") + F.col("steps")).drop("meet", "lifted", "steps")


def inherited_relations(
    graph: Graph,
    keys: DataFrame,
    parents: DataFrame,
    version: str | None = None,
    strict: bool = False,
    direction: str | None = None,
) -> DataFrame:
    """Relations of each (space_id, entity, attribute) over the spaces it inherits from.

    ``attribute`` is the relation type. Returns the key, the relation and the space
    that holds it. Pass ``direction`` where it is known to be the same for all keys.
    """
    keys = keys.select(*KEY).distinct()
    edges = graph.relations.filter(snapshot(version)).select(
        F.col("from_id").alias("entity"),
        F.col("relation_type").alias("attribute"),
        F.col("space_id").alias("found_space"),
        F.col("id").alias("relation_id"),
        "to_id",
        "index",
    )
    if strict:
        own = keys.withColumn("found_space", F.col("space_id"))
        return own.join(edges, ["entity", "attribute", "found_space"])
    if direction is None:
        directed = keys.join(
            aggregation_directions(graph, keys, parents), ["space_id", "attribute"]
        )
        directed = materialize(directed, "directed-keys")
    else:
        directed = keys.withColumn("direction", F.lit(direction))
    return _met(directed, edges, parents).drop("depth")


def _known_direction(graph: Graph, attribute: str) -> str | None:
    return "Down" if attribute in graph.vocabulary.inherited_down else None


def value_types(
    graph: Graph,
    keys: DataFrame,
    parents: DataFrame,
    relation_type: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Value type of each (space_id, property): the first inherited one by index.

    Pass the relation value type id to get the type of the targets of a relation.
    """
    relation_type = relation_type or graph.vocabulary.value_type
    wanted = keys.select(
        "space_id", F.col("property").alias("entity"), F.lit(relation_type).alias("attribute")
    )
    found = inherited_relations(
        graph, wanted, parents, strict=strict, direction=_known_direction(graph, relation_type)
    )
    first = F.min_by("to_id", F.struct("index", "relation_id"))
    return found.groupBy("space_id", F.col("entity").alias("property")).agg(
        first.alias("value_type")
    )


def space_types(
    graph: Graph,
    roots: DataFrame,
    parents: DataFrame | None = None,
    id_filter: Where | None = None,
) -> DataFrame:
    """(space_id, type_id) of the types defined in each space.

    With ``parents`` the types of the parent spaces are included.
    """
    type_ids = entities.of_types(graph, [graph.vocabulary.schema_type])
    if id_filter is not None:
        type_ids = type_ids.filter(id_filter.on("id"))
    defined = (
        graph.triples.filter(snapshot())
        .select(F.col("entity").alias("id"), F.col("space_id").alias("found_space"))
        .join(type_ids, "id", "left_semi")
        .distinct()
    )
    spaces = with_self(roots) if parents is None else covering(parents, roots)
    seen = (
        spaces.withColumnRenamed("space_id", "found_space")
        .join(roots.select(F.col("space_id").alias("root")).distinct(), "root", "left_semi")
        .select("root", "found_space")
    )
    return (
        defined.join(seen, "found_space")
        .select(F.col("root").alias("space_id"), F.col("id").alias("type_id"))
        .distinct()
    )


def type_properties(graph: Graph, types: DataFrame, parents: DataFrame) -> DataFrame:
    """Properties of each (space_id, type_id), with their index."""
    wanted = types.select(
        "space_id",
        F.col("type_id").alias("entity"),
        F.lit(graph.vocabulary.properties).alias("attribute"),
    )
    direction = _known_direction(graph, graph.vocabulary.properties)
    return inherited_relations(graph, wanted, parents, direction=direction).select(
        "space_id",
        F.col("entity").alias("type_id"),
        F.col("to_id").alias("property"),
        "index",
        "relation_id",
    )


def names_in(graph: Graph, pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Inherited name of each (space_id, id)."""
    wanted = pairs.select(
        "space_id",
        F.col("id").alias("entity"),
        F.lit(graph.vocabulary.name).alias("attribute"),
    )
    return nearest_down(graph, wanted, parents).select(
        "space_id", F.col("entity").alias("id"), F.col("value").alias("name")
    )


def schema_report(graph: Graph, roots: DataFrame, parents: DataFrame) -> DataFrame:
    """Types of each space with their properties, value types and all their names.

    Each step feeds several later ones, so it is written once instead of being
    computed again in every branch.
    """
    types = materialize(space_types(graph, roots, parents), "schema-types")
    properties = materialize(
        type_properties(graph, types, parents).select("space_id", "type_id", "property"),
        "schema-properties",
    )
    kinds = value_types(graph, properties, parents)
    report = materialize(
        types.join(properties, ["space_id", "type_id"], "left").join(
            kinds, ["space_id", "property"], "left"
        ),
        "schema-report",
    )
    ids = report.select("space_id", F.explode(F.array("type_id", "property", "value_type")))
    pairs = ids.select("space_id", F.col("col").alias("id")).dropna().distinct()
    names = materialize(names_in(graph, pairs, parents), "schema-names")
    for column, name in (
        ("type_id", "type_name"),
        ("property", "property_name"),
        ("value_type", "value_type_name"),
    ):
        named = names.select(
            "space_id", F.col("id").alias(column), F.col("name").alias(name)
        )
        report = report.join(named, ["space_id", column], "left")
    return report
