"""Triple lookups and scans, attribute groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, all_of, snapshot

VALUE_FIELDS = ["value", "value_type", "format", "unit", "language"]


def scan(
    triples: DataFrame,
    *,
    entity: Where | None = None,
    attribute: Where | None = None,
    value: Where | None = None,
    value_type: Where | None = None,
    space_id: Where | None = None,
    version: str | None = None,
) -> DataFrame:
    """Triples valid at ``version`` that match every given filter."""
    filters = {
        "entity": entity,
        "attribute": attribute,
        "value": value,
        "value_type": value_type,
        "space_id": space_id,
    }
    conditions = [where.on(name) for name, where in filters.items() if where is not None]
    return triples.filter(all_of([snapshot(version), *conditions]))


def lookup(triples: DataFrame, keys: DataFrame, version: str | None = None) -> DataFrame:
    """The triple of each (entity, attribute, space_id) key that has one."""
    return triples.filter(snapshot(version)).join(
        keys.select("entity", "attribute", "space_id").distinct(),
        ["entity", "attribute", "space_id"],
        "left_semi",
    )


def attributes_of(
    triples: DataFrame,
    entities: DataFrame,
    *,
    space_id: Where | None = None,
    attribute: Where | None = None,
    version: str | None = None,
) -> DataFrame:
    """Attributes of the given entities, one row per attribute and space."""
    return scan(triples, attribute=attribute, space_id=space_id, version=version).join(
        entities.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi"
    )


def attribute_maps(triples: DataFrame) -> DataFrame:
    """One map from attribute to value per entity and space.

    At most one value is open per attribute, so a map is as large as the schema of
    its entity. Use :func:`scan` for a row per attribute.
    """
    entry = F.struct("attribute", F.struct(*VALUE_FIELDS).alias("value"))
    return triples.groupBy("entity", "space_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("attributes")
    )


def merge_attributes(rows: DataFrame, order: str) -> DataFrame:
    """Keep the last value per (entity, attribute) by ``order``, then by space."""
    fields = [f for f in VALUE_FIELDS if f in rows.columns]
    last = F.struct(order, "space_id") if "space_id" in rows.columns else F.col(order)
    return (
        rows.groupBy("entity", "attribute")
        .agg(F.max_by(F.struct(*fields), last).alias("last"))
        .select("entity", "attribute", "last.*")
    )
