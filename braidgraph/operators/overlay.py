"""Typed wide views of entities and back."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.predicates import Where, snapshot
from braidgraph.functions.values import from_text, to_text
from braidgraph.graph import Graph
from braidgraph.operators import entities


@dataclass(frozen=True)
class Field:
    """A column of a typed view: the attribute it shows and the type it reads."""

    attribute: str
    value_type: str = "TEXT"
    required: bool = True


def to_wide(
    triples: DataFrame, fields: dict[str, Field], keys: tuple[str, ...] = ("entity",)
) -> DataFrame:
    """One typed row per key; a value that is absent or does not parse gives null.

    Conditional aggregation combines map side, so one pass and one shuffle build all
    columns.
    """
    attributes = [f.attribute for f in fields.values()]

    def pick(field: Field) -> Column:
        value = F.when(F.col("attribute") == field.attribute, F.col("value"))
        return from_text(F.max(value), field.value_type)

    return (
        triples.filter(F.col("attribute").isin(attributes))
        .groupBy(*keys)
        .agg(*[pick(field).alias(name) for name, field in fields.items()])
    )


def complete(fields: dict[str, Field]) -> Column:
    """Rows of a wide view that have every required value."""
    present = F.lit(True)
    for name, field in fields.items():
        if field.required:
            present &= F.col(name).isNotNull()
    return present


def split_errors(
    wide: DataFrame, fields: dict[str, Field]
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows that lack a required value)."""
    return wide.filter(complete(fields)), wide.filter(~complete(fields))


def to_triples(
    rows: DataFrame, keys: list[str], attributes: dict[str, tuple[str, str]]
) -> DataFrame:
    """Wide rows as (keys, attribute, value, value_type); nulls are skipped.

    ``attributes`` maps a column to its (attribute id, value type).
    """
    texts = {column: to_text(F.col(column), kind) for column, (_, kind) in attributes.items()}
    wide = rows.select(*keys, *[text.alias(column) for column, text in texts.items()])
    names = F.create_map(*[F.lit(x) for c, (a, _) in attributes.items() for x in (c, a)])
    types = F.create_map(*[F.lit(x) for c, (_, t) in attributes.items() for x in (c, t)])
    return (
        wide.unpivot(keys, list(attributes), "column", "value")
        .filter(F.col("value").isNotNull())
        .select(
            *keys,
            names[F.col("column")].alias("attribute"),
            "value",
            types[F.col("column")].alias("value_type"),
        )
    )


def find(
    graph: Graph,
    type_id: str,
    fields: dict[str, Field],
    where: dict[str, Where] | None = None,
    space_id: str | None = None,
    version: str | None = None,
    limit: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """Typed rows of the entities of one type, filtered by field.

    Filters apply to the stored text and semi join before the view is built, so only
    matching entities are aggregated. Without a limit all rows are returned, unordered.
    """
    if limit is None and skip:
        raise ValueError("skip needs a limit")
    filters = [
        entities.HasAttribute(
            fields[name].attribute,
            value=condition,
            space_id=None if space_id is None else Where(eq=space_id),
            version=version,
        )
        for name, condition in (where or {}).items()
    ]
    current = graph.triples.filter(snapshot(version))
    if space_id is not None:
        current = current.filter(F.col("space_id") == space_id)
    wanted = entities.EntityFilter(attributes=filters, types=[type_id])
    current = entities.narrow(graph, current, wanted, "entity", version)
    rows = to_wide(current, fields).filter(complete(fields))
    if limit is None:
        return rows
    rows = rows.orderBy("entity")
    return (rows.offset(skip) if skip else rows).limit(limit)


def relation_view(
    graph: Graph, relation_type: str, fields: dict[str, Field], version: str | None = None
) -> DataFrame:
    """Relations of one type with the typed attributes of the relation itself."""
    edges = graph.relations.filter(
        snapshot(version) & (F.col("relation_type") == relation_type)
    ).select("id", "from_id", "to_id", "index", "space_id")
    attributes = to_wide(
        graph.triples.filter(snapshot(version))
        .withColumnRenamed("entity", "id")
        .join(edges.select("id"), "id", "left_semi"),
        fields,
        ("id", "space_id"),
    )
    return edges.join(attributes, ["id", "space_id"], "left").filter(complete(fields))


def get(attributes: Column | str, attribute: str, value_type: str = "TEXT") -> Column:
    """A typed value out of an attribute map; null when it is absent."""
    attributes = F.col(attributes) if isinstance(attributes, str) else attributes
    entry = F.try_element_at(attributes, F.lit(attribute))
    return from_text(entry["value"], value_type)
