"""Versions of entities and the edits that made them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, snapshot
from braidgraph.graph import Graph


def edit_versions(graph: Graph) -> DataFrame:
    """(edit_id, version) of every edit that recorded its index."""
    return graph.triples.filter(
        snapshot() & (F.col("attribute") == graph.vocabulary.edit_index)
    ).select(F.col("entity").alias("edit_id"), F.col("value").alias("version"))


def entity_versions(
    graph: Graph, ids: DataFrame | None = None, space_id: Where | None = None
) -> DataFrame:
    """Every version at which an entity got a new attribute value, with its edit.

    Sort by version for chronological order.
    """
    triples = graph.triples
    if space_id is not None:
        triples = triples.filter(space_id.on("space_id"))
    touched = triples.select("entity", F.col("min_version").alias("version")).distinct()
    if ids is not None:
        keys = ids.select(F.col("id").alias("entity"))
        touched = touched.join(keys, "entity", "left_semi")
    return touched.join(edit_versions(graph), "version").select(
        "entity", "edit_id", "version"
    )


def version_of(graph: Graph, edits: DataFrame) -> DataFrame:
    """The version of each edit id."""
    return edit_versions(graph).join(
        edits.select("edit_id").distinct(), "edit_id", "left_semi"
    )


def attributes_at(graph: Graph, points: DataFrame) -> DataFrame:
    """Attributes of each (entity, version) point, in all spaces, valid at that version."""
    valid = (F.col("min_version") <= F.col("version")) & (
        F.col("max_version").isNull() | (F.col("max_version") > F.col("version"))
    )
    return points.select("entity", "version").join(graph.triples, "entity").filter(valid)
