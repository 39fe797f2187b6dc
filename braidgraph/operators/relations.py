"""Finding relations and projecting their ends, attributes and targets."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, all_of, snapshot
from braidgraph.graph import Graph
from braidgraph.operators import entities
from braidgraph.operators.entities import EntityFilter
from braidgraph.plans.lineage import materialize

SYSTEM_PROPERTIES = ["created_at", "created_at_block", "updated_at", "updated_at_block"]


@dataclass(frozen=True)
class RelationFilter:
    id: Where | None = None
    relation_type: Where | None = None
    from_: EntityFilter | None = None
    to: EntityFilter | None = None
    space_id: Where | None = None


def _end(found: DataFrame, graph: Graph, column: str, where: EntityFilter) -> DataFrame:
    """Filter one end as an entity; the ends of a relation always exist."""
    if where.hops:
        ids = entities.matching(graph, where).withColumnRenamed("id", column)
        return found.join(ids, column, "left_semi")
    return entities.narrow(graph, found, where, column)


def find(
    graph: Graph,
    where: RelationFilter = RelationFilter(),
    version: str | None = None,
    limit: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Relation edges that match: a page by index and id, or without a limit all, unordered."""
    if limit is None and skip:
        raise ValueError("skip needs a limit")
    filters = {
        "id": where.id,
        "relation_type": where.relation_type,
        "space_id": where.space_id,
    }
    conditions = [w.on(name) for name, w in filters.items() if w is not None]
    found = graph.relations.filter(all_of([snapshot(version), *conditions]))
    if where.from_ is not None:
        found = _end(found, graph, "from_id", where.from_)
    if where.to is not None:
        found = _end(found, graph, "to_id", where.to)
    if limit is None:
        return found
    found = found.orderBy("index", "id")
    return (found.offset(skip) if skip else found).limit(limit)


def lookup(graph: Graph, keys: DataFrame, version: str | None = None) -> DataFrame:
    """The relation of each (id, space_id) key that has one."""
    return graph.relations.filter(snapshot(version)).join(
        keys.select("id", "space_id").distinct(), ["id", "space_id"], "left_semi"
    )


def outbound(
    graph: Graph, ids: DataFrame, space_id: Where | None = None, version: str | None = None
) -> DataFrame:
    """Relations that leave the given entities."""
    return _touching(graph, ids, "from_id", space_id, version)


def inbound(
    graph: Graph, ids: DataFrame, space_id: Where | None = None, version: str | None = None
) -> DataFrame:
    """Relations that reach the given entities."""
    return _touching(graph, ids, "to_id", space_id, version)


def _touching(graph, ids, column, space_id, version) -> DataFrame:
    in_space = [space_id.on("space_id")] if space_id is not None else []
    # Written first: then the join of the relations of a hub can be split.
    keys = materialize(ids.select(F.col("id").alias(column)).distinct(), "touched")
    return graph.relations.filter(all_of([snapshot(version), *in_space])).join(
        keys, column, "left_semi"
    )


def with_nodes(graph: Graph, edges: DataFrame) -> DataFrame:
    """Add the system properties of both end nodes as ``from_*`` and ``to_*``."""

    def nodes(end: str) -> DataFrame:
        return graph.entities.select(
            F.col("id").alias(f"{end}_id"),
            *[F.col(c).alias(f"{end}_{c}") for c in SYSTEM_PROPERTIES],
        )

    return edges.join(nodes("from"), "from_id").join(nodes("to"), "to_id")


def with_attributes(graph: Graph, edges: DataFrame, version: str | None = None) -> DataFrame:
    """Add the attributes of each relation, one row per attribute.

    The relation id is the entity that holds them. Relations without attributes keep
    one row with nulls.
    """
    attributes = graph.triples.filter(snapshot(version)).select(
        F.col("entity").alias("id"), "space_id", "attribute", "value", "value_type"
    )
    return edges.join(attributes, ["id", "space_id"], "left")


def with_attribute_lists(
    graph: Graph, edges: DataFrame, version: str | None = None
) -> DataFrame:
    """One page of relations, each with its sorted list of attributes."""
    entry = F.when(
        F.col("attribute").isNotNull(), F.struct("attribute", "value", "value_type")
    )
    lists = (
        with_attributes(graph, edges.select("id", "space_id"), version)
        .groupBy("id", "space_id")
        .agg(F.sort_array(F.collect_set(entry)).alias("attributes"))
    )
    return edges.join(lists, ["id", "space_id"])


def targets(graph: Graph, edges: DataFrame) -> DataFrame:
    """The target node of each relation, with the relation it came from."""
    nodes = graph.entities.withColumnRenamed("id", "to_id")
    return (
        edges.select(F.col("id").alias("relation_id"), "index", "to_id")
        .join(nodes, "to_id")
        .withColumnRenamed("to_id", "id")
    )


def ends(graph: Graph, edges: DataFrame) -> DataFrame:
    """Each relation joined to its four entities: source, target, type and own.

    A relation type or relation without a node of its own gives null.
    """
    result = edges.select("id", "from_id", "to_id", "relation_type", "space_id")
    for column, name, how in (
        ("from_id", "from_created_at_block", "inner"),
        ("to_id", "to_created_at_block", "inner"),
        ("relation_type", "type_created_at_block", "left"),
        ("id", "own_created_at_block", "left"),
    ):
        node = graph.entities.select(
            F.col("id").alias(column), F.col("created_at_block").alias(name)
        )
        result = result.join(node, column, how)
    return result
