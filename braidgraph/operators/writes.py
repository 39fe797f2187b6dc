"""Write operators: each turns rows into operations to append to the log.

``at`` is a :class:`Block` telling where in the log the operations belong.
Single-row writes are the same calls with one-row input.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph import schema
from braidgraph.functions.ids import derived_id
from braidgraph.functions.predicates import snapshot
from braidgraph.vocabulary import (
    CREATE_RELATION,
    DEFAULT,
    DELETE_RELATION,
    DELETE_TRIPLE,
    SET_TRIPLE,
    UNVERSIONED,
    Vocabulary,
)


@dataclass(frozen=True)
class Block:
    number: int = 0
    timestamp: datetime = datetime(1970, 1, 1)
    edit_idx: int = 0


def _operations(
    rows: DataFrame, op_type: str, at: Block, space_id: Column, triple=None, relation=None
) -> DataFrame:
    absent_triple = F.lit(None).cast(schema.TRIPLE)
    absent_relation = F.lit(None).cast(schema.RELATION)
    position = F.col("op_pos") if "op_pos" in rows.columns else F.monotonically_increasing_id()
    return rows.select(
        F.lit(at.number).cast("bigint").alias("block_number"),
        F.lit(at.timestamp).cast("timestamp").alias("block_ts"),
        F.lit(at.edit_idx).cast("int").alias("edit_idx"),
        position.cast("bigint").alias("op_pos"),
        space_id.alias("space_id"),
        F.lit(op_type).alias("op_type"),
        (absent_triple if triple is None else triple).alias("triple"),
        (absent_relation if relation is None else relation).alias("relation"),
    )


def _fields(rows: DataFrame, struct, required: tuple[str, ...]) -> Column:
    return F.struct(
        *[
            (
                F.col(field.name)
                if field.name in rows.columns or field.name in required
                else F.lit(None)
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in struct.fields
        ]
    )


def _space(rows: DataFrame, space_id: str | None) -> Column:
    return F.col("space_id") if space_id is None else F.lit(space_id)


def set_triples(rows: DataFrame, at: Block, space_id: str | None = None) -> DataFrame:
    """Set triples given as (entity, attribute, value, value_type, options...)."""
    triple = _fields(rows, schema.TRIPLE, ("entity", "attribute", "value"))
    return _operations(rows, SET_TRIPLE, at, _space(rows, space_id), triple=triple)


def delete_triples(rows: DataFrame, at: Block, space_id: str | None = None) -> DataFrame:
    """Delete the open triples with the given (entity, attribute) keys."""
    keys = rows.select(
        "entity", "attribute", *[c for c in ("space_id", "op_pos") if c in rows.columns]
    )
    triple = _fields(keys, schema.TRIPLE, ("entity", "attribute"))
    return _operations(keys, DELETE_TRIPLE, at, _space(keys, space_id), triple=triple)


def set_attributes(
    rows: DataFrame,
    attributes: dict[str, tuple[str, str]],
    at: Block,
    entity: str = "entity",
    space_id: str | None = None,
) -> DataFrame:
    """Set attribute groups given as wide rows.

    ``attributes`` maps a column to its (attribute id, value type); nulls are skipped.
    """
    from braidgraph.operators.overlay import to_triples

    keys = [entity] if space_id is not None else [entity, "space_id"]
    triples = to_triples(rows, keys, attributes).withColumnRenamed(entity, "entity")
    return set_triples(triples, at, space_id)


def set_types(
    rows: DataFrame,
    at: Block,
    space_id: str | None = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Create one types relation per element of ``types`` for each ``entity``."""
    space = _space(rows, space_id)
    edges = rows.select(space.alias("space_id"), "entity", F.explode("types").alias("type_id"))
    edges = edges.select(
        "space_id",
        derived_id("space_id", "entity", F.lit(vocabulary.types), "type_id").alias("id"),
        F.lit(vocabulary.types).alias("type"),
        F.col("entity").alias("from_entity"),
        F.col("type_id").alias("to_entity"),
        F.lit("0").alias("index"),
    )
    return create_relations(edges, at)


def insert_entities(
    rows: DataFrame,
    attributes: dict[str, tuple[str, str]],
    at: Block,
    space_id: str | None = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Insert entities given as wide rows with an ``entity`` id and a ``types`` array."""
    return set_attributes(rows, attributes, at, space_id=space_id).unionByName(
        set_types(rows, at, space_id, vocabulary)
    )


def create_relations(rows: DataFrame, at: Block, space_id: str | None = None) -> DataFrame:
    """Create relations given as (id, type, from_entity, to_entity, index)."""
    relation = _fields(rows, schema.RELATION, ("id", "type", "from_entity", "to_entity"))
    return _operations(rows, CREATE_RELATION, at, _space(rows, space_id), relation=relation)


def insert_relations(
    rows: DataFrame,
    attributes: dict[str, tuple[str, str]],
    at: Block,
    space_id: str | None = None,
) -> DataFrame:
    """Create relations that carry attributes; the relation id is their entity."""
    edges = create_relations(rows, at, space_id)
    if not attributes:
        return edges
    return edges.unionByName(
        set_attributes(rows, attributes, at, entity="id", space_id=space_id)
    )


def delete_relations(rows: DataFrame, at: Block, space_id: str | None = None) -> DataFrame:
    """Close the open relations with the given ids."""
    keys = rows.select("id", *[c for c in ("space_id", "op_pos") if c in rows.columns])
    relation = _fields(keys, schema.RELATION, ("id",))
    return _operations(keys, DELETE_RELATION, at, _space(keys, space_id), relation=relation)


def delete_entities(rows: DataFrame, triples: DataFrame, at: Block) -> DataFrame:
    """Delete all open triples of the given (entity, space_id) pairs."""
    keys = rows.select("entity", "space_id").distinct()
    current = triples.filter(snapshot()).select("entity", "attribute", "space_id")
    return delete_triples(current.join(keys, ["entity", "space_id"], "left_semi"), at)


def initial_triples(rows: DataFrame) -> DataFrame:
    """Seed rows as open triples at the unversioned version."""
    defaults = {"min_version": F.lit(UNVERSIONED), "max_version": F.lit(None)}
    return rows.select(
        *[
            (
                F.col(field.name)
                if field.name in rows.columns
                else defaults.get(field.name, F.lit(None))
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.TRIPLES.fields
        ]
    )


def initial_relations(rows: DataFrame) -> DataFrame:
    """Seed rows as open relations at the unversioned version."""
    epoch = F.timestamp_seconds(F.lit(0))
    defaults = {
        "min_version": F.lit(UNVERSIONED),
        "created_at": epoch,
        "updated_at": epoch,
        "created_at_block": F.lit("0"),
        "updated_at_block": F.lit("0"),
    }
    return rows.select(
        *[
            (
                F.col(field.name)
                if field.name in rows.columns
                else defaults.get(field.name, F.lit(None))
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.RELATIONS.fields
        ]
    )
