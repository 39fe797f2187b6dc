"""Composite reports: what an API call returns for one id, for a table of ids."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, all_of, snapshot
from braidgraph.graph import Graph
from braidgraph.operators import governance, hierarchy, relations, triples
from braidgraph.operators.entities import OrderBy, EntityFilter, check_page, find
from braidgraph.operators.relations import RelationFilter
from braidgraph.plans.lineage import materialize


def _names(graph: Graph) -> DataFrame:
    """One current name per entity, whatever the space."""
    return (
        graph.triples.filter(snapshot() & (F.col("attribute") == graph.vocabulary.name))
        .groupBy(F.col("entity").alias("id"))
        .agg(F.min("value").alias("name"))
    )


def named(
    graph: Graph, rows: DataFrame, column: str, output: str, missing: str | Column = "No name"
) -> DataFrame:
    """Add the name of the id in ``column``.

    The names are written first: then a join of rows that share an id can be split.
    """
    names = materialize(_names(graph), "names")
    return _with_names(rows, names, column, output, missing)


def kind_named(
    graph: Graph, rows: DataFrame, column: str, output: str, missing: str | Column
) -> DataFrame:
    """Like :func:`named`, for a column of few ids: attributes or relation types.

    Only the names of those that occur are kept, so that the rows need not be brought
    together by their kind.
    """
    used = rows.select(F.col(column).alias("id")).distinct()
    names = materialize(_names(graph).join(used, "id", "left_semi"), "kind-names")
    return _with_names(rows, names, column, output, missing)


def _with_names(
    rows: DataFrame, names: DataFrame, column: str, output: str, missing: str | Column
) -> DataFrame:
    fallback = missing if isinstance(missing, Column) else F.lit(missing)
    names = names.select(F.col("id").alias(column), F.col("name").alias("_name"))
    return (
        rows.join(names, column, "left")
        .withColumn(output, F.coalesce("_name", fallback))
        .drop("_name")
    )


def labels(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, name, description) of every id, in one pass over the triples."""
    voc = graph.vocabulary
    wanted = ids.select("id").distinct()

    def pick(attribute: str) -> Column:
        return F.min(F.when(F.col("attribute") == attribute, F.col("value")))

    found = (
        graph.triples.filter(snapshot() & F.col("attribute").isin(voc.name, voc.description))
        .select(F.col("entity").alias("id"), "attribute", "value")
        .groupBy("id")
        .agg(pick(voc.name).alias("name"), pick(voc.description).alias("description"))
    )
    return wanted.join(found, "id", "left").withColumn(
        "name", F.coalesce("name", F.lit("No name"))
    )


def entity_fields(
    graph: Graph,
    keys: DataFrame,
    parents: DataFrame | None = None,
    version: str | None = None,
) -> DataFrame:
    """Name, description and cover of each (space_id, entity).

    With ``parents`` the nearest value in the hierarchy is taken, otherwise only the
    space's own. All three attributes are looked up together.
    """
    voc = graph.vocabulary
    attributes = {"name": voc.name, "description": voc.description, "cover": voc.cover}
    pairs = keys.select("space_id", "entity").distinct()
    wanted = pairs.withColumn(
        "attribute", F.explode(F.array(*[F.lit(a) for a in attributes.values()]))
    )
    if parents is None:
        found = hierarchy.nearest(graph, wanted, hierarchy.with_self(pairs), version)
    else:
        found = hierarchy.nearest_down(graph, wanted, parents, version)
    wide = found.groupBy("space_id", "entity").agg(
        *[
            F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(name)
            for name, a in attributes.items()
        ]
    )
    return pairs.join(wide, ["space_id", "entity"], "left")


def entity_links(
    graph: Graph, keys: DataFrame, relation_type: str, version: str | None = None
) -> DataFrame:
    """Targets of one kind of relation (blocks, types) of each (space_id, entity)."""
    edges = graph.relations.filter(
        snapshot(version) & (F.col("relation_type") == relation_type)
    ).select(F.col("from_id").alias("entity"), "space_id", F.col("to_id").alias("id"), "index")
    linked = edges.join(
        keys.select("entity", "space_id").distinct(), ["entity", "space_id"], "left_semi"
    )
    return linked.join(graph.entities.select("id"), "id", "left_semi")


def entity_relations(
    graph: Graph,
    keys: DataFrame,
    where: RelationFilter = RelationFilter(),
    version: str | None = None,
) -> DataFrame:
    """Outgoing relations of each (space_id, entity) that match the filter."""
    edges = relations.find(graph, where, version, limit=None)
    return edges.join(
        keys.select(F.col("entity").alias("from_id"), "space_id").distinct(),
        ["from_id", "space_id"],
        "left_semi",
    )


def triples_with_names(
    graph: Graph,
    attribute: Where | None = None,
    space_id: Where | None = None,
    version: str | None = None,
) -> DataFrame:
    """Triples with the name of their attribute."""
    found = triples.scan(
        graph.triples, attribute=attribute, space_id=space_id, version=version
    )
    return kind_named(graph, found, "attribute", "attribute_name", "No attribute name")


def _first_edges(
    graph: Graph, ids: DataFrame, inbound: bool, per_entity: int | None
) -> DataFrame:
    """The first relations of each entity by index and id, at most ``per_entity``.

    With None, all. The rank filter is pushed below the shuffle as a group limit, so a hub sends no
    more than ``per_entity`` rows from each task.
    """
    near, far = ("to_id", "from_id") if inbound else ("from_id", "to_id")
    edges = graph.relations.filter(snapshot()).select(
        F.col(near).alias("id"), F.col("id").alias("relation_id"), "relation_type",
        F.col(far).alias("other"), "index",
    )
    edges = edges.join(ids, "id", "left_semi")
    if per_entity is None:
        return edges.drop("index")
    order = Window.partitionBy("id").orderBy("index", "relation_id")
    return (
        edges.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= per_entity)
        .drop("index", "rank")
    )


def entity_profile(
    graph: Graph, ids: DataFrame, edges_per_entity: int | None = None
) -> DataFrame:
    """All attributes and the in- and outbound relations of each id, with names.

    ``edges_per_entity`` keeps the first so many relations of either direction.

    Long form: ``section`` is attribute, inbound or outbound; ``label`` the name of the
    attribute or relation type; ``value`` the attribute value or the name at the other
    end, whose id is ``other``.
    """
    # Written first: then the joins of the relations of a hub can be split.
    ids = materialize(ids.select("id").distinct(), "profiled")
    attributes = triples.attributes_of(graph.triples, ids).select(
        F.col("entity").alias("id"), "attribute", "value"
    )
    attributes = kind_named(graph, attributes, "attribute", "label", "No attribute name").select(
        "id", F.lit("attribute").alias("section"), F.lit(None).cast("string").alias("relation_id"),
        "label", "value", F.lit(None).cast("string").alias("other"),
    )
    outbound = _first_edges(graph, ids, False, edges_per_entity).withColumn(
        "section", F.lit("outbound")
    )
    inbound = _first_edges(graph, ids, True, edges_per_entity).withColumn(
        "section", F.lit("inbound")
    )
    edges = outbound.unionByName(inbound)
    edges = kind_named(graph, edges, "relation_type", "label", F.col("relation_type"))
    edges = named(graph, edges, "other", "value").select(
        "id", "section", "relation_id", "label", "value", "other"
    )
    return attributes.unionByName(edges)


def entity_page(
    graph: Graph,
    where: EntityFilter = EntityFilter(),
    space_id: Where | None = None,
    order_by: OrderBy | None = None,
    *,
    first: int,
    skip: int = 0,
) -> DataFrame:
    """One page of the entities of a space that pass a filter."""
    if space_id is not None:
        where = EntityFilter(**{**where.__dict__, "space_id": space_id})
    return find(graph, where, order_by, check_page(first), skip)


def relation_page(
    graph: Graph,
    where: RelationFilter = RelationFilter(),
    *,
    first: int,
    skip: int = 0,
    version: str | None = None,
) -> DataFrame:
    """One page of relations with their end nodes."""
    edges = relations.find(graph, where, version, check_page(first), skip)
    return relations.with_nodes(graph, edges)


def space_report(
    graph: Graph, parents: DataFrame, subspaces: DataFrame, where: dict[str, Where] | None = None
) -> DataFrame:
    """Each space with the numbers of its members, editors, parents and subspaces.

    Direct and transitive counts come from the closures; every side is grouped before
    it is joined.
    """
    spaces = governance.spaces(graph, where)

    def counted(rows: DataFrame, key: str, name: str, *conditions: Column) -> DataFrame:
        return (
            rows.filter(all_of(conditions))
            .groupBy(F.col(key).alias("entity"))
            .agg(F.count(F.lit(1)).alias(name))
        )

    sides = [
        counted(governance.members(graph), "space_id", "members"),
        counted(governance.editors(graph), "space_id", "editors"),
        counted(parents, "root", "parents", F.col("depth") == 1),
        counted(parents, "root", "all_parents", F.col("depth") > 0),
        counted(subspaces, "root", "subspaces", F.col("depth") == 1),
        counted(subspaces, "root", "all_subspaces", F.col("depth") > 0),
    ]
    for side in sides:
        spaces = spaces.join(side, "entity", "left")
    counts = ["members", "editors", "parents", "all_parents", "subspaces", "all_subspaces"]
    return spaces.fillna(0, counts)


def page(rows: DataFrame, *order: str, first: int, skip: int = 0) -> DataFrame:
    """One page of a view."""
    rows = rows.orderBy(*order)
    return (rows.offset(skip) if skip else rows).limit(check_page(first))
