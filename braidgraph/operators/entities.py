"""Finding entities: filters, order, pages and hydration.

Every filter is a semi join on entity id against a side reduced to distinct ids, so
a hot entity is folded before the shuffle and the row count never grows.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, all_of, is_, one_of, snapshot
from braidgraph.graph import Graph
from braidgraph.vocabulary import MAX_PAGE


@dataclass(frozen=True)
class HasAttribute:
    """The entity has this attribute, optionally with a matching value."""

    attribute: str
    value: Where | None = None
    value_type: Where | None = None
    space_id: Where | None = None
    version: str | None = None


@dataclass(frozen=True)
class HasRelation:
    """The entity has an outgoing relation that matches."""

    relation_type: Where | None = None
    to_id: Where | None = None
    space_id: Where | None = None
    version: str | None = None


@dataclass(frozen=True)
class Hop:
    """Follow relations to their targets, or with ``inbound`` to their sources."""

    relation_type: Where | None = None
    destination: Where | None = None
    inbound: bool = False
    space_id: Where | None = None
    version: str | None = None


@dataclass(frozen=True)
class EntityFilter:
    id: Where | None = None
    attributes: Sequence[HasAttribute] = ()
    relations: Sequence[HasRelation] = ()
    types: Sequence[str] = ()
    not_types: Sequence[str] = ()
    space_id: Where | None = None
    hops: Sequence[Hop] = field(default=())


@dataclass(frozen=True)
class OrderBy:
    attribute: str
    descending: bool = False
    numeric: bool = False


def with_attribute(graph: Graph, has: HasAttribute) -> DataFrame:
    """Distinct ids of entities that have the attribute."""
    filters = {"value": has.value, "value_type": has.value_type, "space_id": has.space_id}
    conditions = [where.on(name) for name, where in filters.items() if where is not None]
    return (
        graph.triples.filter(F.col("attribute") == has.attribute)
        .filter(all_of([snapshot(has.version), *conditions]))
        .select(F.col("entity").alias("id"))
        .distinct()
    )


def with_relation(graph: Graph, has: HasRelation) -> DataFrame:
    """Distinct ids of entities that have the outgoing relation."""
    filters = {
        "relation_type": has.relation_type,
        "to_id": has.to_id,
        "space_id": has.space_id,
    }
    conditions = [where.on(name) for name, where in filters.items() if where is not None]
    return (
        graph.relations.filter(all_of([snapshot(has.version), *conditions]))
        .select(F.col("from_id").alias("id"))
        .distinct()
    )


def of_types(graph: Graph, types: Sequence[str], version: str | None = None) -> DataFrame:
    """Distinct ids of entities with any of the types."""
    return with_relation(
        graph, HasRelation(is_(graph.vocabulary.types), one_of(*types), version=version)
    )


def in_spaces(graph: Graph, space_id: Where, version: str | None = None) -> DataFrame:
    """Distinct ids of entities with at least one attribute in the spaces."""
    return (
        graph.triples.filter(snapshot(version) & space_id.on("space_id"))
        .select(F.col("entity").alias("id"))
        .distinct()
    )


def follow(graph: Graph, ids: DataFrame, hop: Hop) -> DataFrame:
    """Move a working set of entity ids along one relation; other columns are kept."""
    start, end = ("to_id", "from_id") if hop.inbound else ("from_id", "to_id")
    filters = {
        "relation_type": hop.relation_type,
        end: hop.destination,
        "space_id": hop.space_id,
    }
    conditions = [where.on(name) for name, where in filters.items() if where is not None]
    edges = (
        graph.relations.filter(all_of([snapshot(hop.version), *conditions]))
        .select(F.col(start).alias("id"), F.col(end).alias("next_id"))
        .distinct()
    )
    carried = [c for c in ids.columns if c != "id"]
    return (
        ids.join(edges, "id")
        .select(*carried, F.col("next_id").alias("id"))
        .distinct()
    )


def narrow(
    graph: Graph,
    rows: DataFrame,
    where: EntityFilter,
    column: str = "id",
    version: str | None = None,
) -> DataFrame:
    """Keep the rows whose entity in ``column`` passes the filter; hops are not followed."""
    if where.id is not None:
        rows = rows.filter(where.id.on(column))
    sides = [with_attribute(graph, has) for has in where.attributes]
    sides += [with_relation(graph, has) for has in where.relations]
    if where.types:
        sides.append(of_types(graph, where.types, version))
    if where.space_id is not None:
        sides.append(in_spaces(graph, where.space_id, version))
    for side in sides:
        rows = rows.join(side.withColumnRenamed("id", column), column, "left_semi")
    if where.not_types:
        others = of_types(graph, where.not_types, version).withColumnRenamed("id", column)
        rows = rows.join(others, column, "left_anti")
    return rows


def matching(graph: Graph, where: EntityFilter, version: str | None = None) -> DataFrame:
    """Ids of the entities that pass the filter, then moved along its hops."""
    found = narrow(graph, graph.entities.select("id"), where, version=version)
    for hop in where.hops:
        found = follow(graph, found, hop)
    return found


def check_page(limit: int) -> int:
    if limit > MAX_PAGE:
        raise ValueError(f"a page holds at most {MAX_PAGE} rows, not {limit}")
    return limit


def find(
    graph: Graph,
    where: EntityFilter = EntityFilter(),
    order_by: OrderBy | None = None,
    limit: int | None = None,
    skip: int = 0,
    version: str | None = None,
) -> DataFrame:
    """Entity nodes that pass the filter, ordered and paged; without a limit, all of them.

    A page needs its limit: rows cannot be skipped without one.
    Ordering by an attribute drops entities without it. Ids break ties.
    """
    if limit is None and skip:
        raise ValueError("skip needs a limit")
    if where.hops:
        nodes = graph.entities.join(matching(graph, where, version), "id", "left_semi")
    else:
        nodes = narrow(graph, graph.entities, where, version=version)
    order = [F.col("id")]
    if order_by is not None:
        sort_value = (
            F.col("value").try_cast("decimal(38,6)") if order_by.numeric else F.col("value")
        )
        pick = F.max if order_by.descending else F.min
        values = (
            graph.triples.filter(snapshot() & (F.col("attribute") == order_by.attribute))
            .select(F.col("entity").alias("id"), sort_value.alias("sort_value"))
            .filter(F.col("sort_value").isNotNull())
            .groupBy("id")
            .agg(pick("sort_value").alias("sort_value"))
        )
        nodes = nodes.join(values, "id")
        key = F.col("sort_value")
        order.insert(0, key.desc() if order_by.descending else key.asc())
    if limit is None and order_by is None:
        return nodes
    nodes = nodes.orderBy(*order)
    if skip:
        nodes = nodes.offset(skip)
    return nodes if limit is None else nodes.limit(limit)


def by_ids(graph: Graph, keys: DataFrame) -> DataFrame:
    """Entity nodes of a set of ids."""
    return graph.entities.join(keys.select("id").distinct(), "id", "left_semi")


def hydrate(
    graph: Graph,
    nodes: DataFrame,
    space_id: Where | None = None,
    version: str | None = None,
) -> DataFrame:
    """Attributes and types of the given nodes in long form.

    One row per attribute (``kind`` attribute, ``key`` and ``value``) and per type
    (``kind`` type, ``key`` the type id). Nodes with neither keep one row of nulls.
    """
    in_space = [space_id.on("space_id")] if space_id is not None else []
    ids = nodes.select("id")
    attributes = (
        graph.triples.filter(all_of([snapshot(version), *in_space]))
        .select(F.col("entity").alias("id"), F.lit("attribute").alias("kind"),
                F.col("attribute").alias("key"), "value", "value_type", "space_id")
        .join(ids, "id", "left_semi")
    )
    is_type = F.col("relation_type") == graph.vocabulary.types
    types = (
        graph.relations.filter(all_of([snapshot(version), is_type, *in_space]))
        .select(F.col("from_id").alias("id"), F.lit("type").alias("kind"),
                F.col("to_id").alias("key"), F.lit(None).cast("string").alias("value"),
                F.lit(None).cast("string").alias("value_type"), "space_id")
        .join(ids, "id", "left_semi")
    )
    return nodes.join(attributes.unionByName(types), "id", "left")


def hydrate_page(
    graph: Graph,
    nodes: DataFrame,
    space_id: Where | None = None,
    version: str | None = None,
) -> DataFrame:
    """The nodes of one page with their sorted lists of attributes and types.

    Attributes and types are aggregated apart and joined, so their counts add up
    instead of multiplying. Meant for pages; use :func:`hydrate` for whole tables.
    """
    long = hydrate(graph, nodes.select("id"), space_id, version)
    attribute = F.when(
        F.col("kind") == "attribute", F.struct("key", "value", "value_type", "space_id")
    )
    type_id = F.when(F.col("kind") == "type", F.col("key"))
    lists = long.groupBy("id").agg(
        F.sort_array(F.collect_set(attribute)).alias("attributes"),
        F.sort_array(F.collect_set(type_id)).alias("types"),
    )
    return nodes.join(lists, "id", "left")
