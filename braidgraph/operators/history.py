"""Deriving versioned tables from the append-only operation log.

Writes append rows to ``ops``; triples, relations and entities follow from it. The
order of an operation is (block, edit, phase, position): within one edit all sets
come first, then deletes, relation creations and relation deletions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize
from braidgraph.vocabulary import (
    CREATE_RELATION,
    DELETE_RELATION,
    DELETE_TRIPLE,
    OP_PHASES,
    SET_TRIPLE,
    UNVERSIONED,
)

TRIPLE_KEY = ["entity", "attribute", "space_id"]
RELATION_KEY = ["id", "space_id"]
ORDER = ["block_number", "edit_idx", "phase", "op_pos"]
# Blocks whose versions of one key are put in order by one task.
SLICE_BLOCKS = 10_000


def version_stamp(block: str = "block_number", idx: str = "edit_idx") -> Column:
    """Version of an edit; string order equals log order for up to 10^8 edits of a block."""
    return F.format_string("%016d:%08d", F.col(block).cast("bigint"), F.col(idx).cast("int"))


def phase(op_type: str = "op_type") -> Column:
    """Rank of an operation within its edit; null for operations that are not handled."""
    pairs = [F.lit(x) for pair in OP_PHASES.items() for x in pair]
    return F.create_map(*pairs)[F.col(op_type)]


def edit_position(block: str = "block_number", idx: str = "edit_idx") -> Column:
    """The place of an edit in the log; compares by block, then by edit."""
    return F.struct(
        F.col(block).cast("bigint").alias("block"), F.col(idx).cast("bigint").alias("edit")
    )


def _ordered(ops: DataFrame, op_types: list[str], versioning: bool) -> DataFrame:
    version = version_stamp() if versioning else F.lit(UNVERSIONED)
    return (
        ops.filter(F.col("op_type").isin(op_types))
        .withColumn("version", version)
        .withColumn("phase", phase())
    )


def _intervals(
    ops: DataFrame, key: list[str], opening: str, versioning: bool, slice_blocks: int
) -> DataFrame:
    """Valid-time intervals of the ``opening`` operations of each key.

    Only the last operation of a key and version counts, which aggregates before the
    shuffle however often a key is written. It ends at the next version of its key;
    closing operations only end the row before them.
    """
    payload = [name for name in ops.columns if name not in (*key, "version", *ORDER)]
    # The order leads the struct, so it is shuffled once, with the row.
    last = (
        ops.groupBy(*key, "version")
        .agg(F.max(F.struct(*ORDER, *payload)).alias("last"))
        .select(*key, "version", "last.*")
    )
    if versioning:
        rows = _with_next_version(last, ops, key, slice_blocks)
    else:
        rows = last.withColumn("max_version", F.lit(None).cast("string"))
    return rows.filter(F.col("op_type") == opening).withColumnRenamed("version", "min_version")


def _with_next_version(
    last: DataFrame, ops: DataFrame, key: list[str], slice_blocks: int
) -> DataFrame:
    """The next version of each row, with a key's blocks dealt out in ranges.

    Rows look ahead within their range, so a task orders a bounded part of a hot key. The
    last row of a range takes the first version of the key's next range, from a table
    that holds only keys of several ranges, a row per key and range.
    """
    block_range = F.floor(F.col("block_number") / slice_blocks)
    in_range = Window.partitionBy(*key, "range").orderBy("block_number", "edit_idx")
    across = Window.partitionBy(*key).orderBy("range")
    following = (
        ops.groupBy(*key, block_range.alias("range"))
        .agg(F.min(edit_position()).alias("first"))
        .withColumn("next", F.lead("first").over(across))
        .filter(F.col("next").isNotNull())
        .select(*key, "range", version_stamp("next.block", "next.edit").alias("next_range_version"))
    )
    return (
        last.withColumn("range", block_range)
        .withColumn("next_version", F.lead("version").over(in_range))
        .join(following, [*key, "range"], "left")
        .withColumn("max_version", F.coalesce("next_version", "next_range_version"))
        .drop("range", "next_version", "next_range_version")
    )


def derive_triples(
    ops: DataFrame, versioning: bool = True, slice_blocks: int = SLICE_BLOCKS
) -> DataFrame:
    """All versions of all triples, with their validity intervals."""
    flat = _ordered(ops, [SET_TRIPLE, DELETE_TRIPLE], versioning).select(
        "triple.*", "space_id", "version", "op_type", *ORDER
    )
    return _intervals(flat, TRIPLE_KEY, SET_TRIPLE, versioning, slice_blocks).select(
        *TRIPLE_KEY, "value", "value_type", "format", "unit", "language",
        "min_version", "max_version",
    )


def _place() -> Column:
    """:func:`edit_position` as one number, in the same order, that groups without sorting."""
    block = F.coalesce(F.col("block_number").cast("decimal(19,0)"), F.lit(-(2**63)).cast("decimal(19,0)"))
    edit = F.coalesce(F.col("edit_idx").cast("decimal(10,0)"), F.lit(-(10**10) + 1).cast("decimal(10,0)"))
    return (block * F.lit(10**11).cast("decimal(12,0)") + edit).cast("decimal(38,0)")


def relation_creations(
    ops: DataFrame, existing: DataFrame | None = None, sets: DataFrame | None = None
) -> DataFrame:
    """Mark relation creations: ``accepted`` holds when both ends existed at that point.

    ``existing`` lists entities that were there before the log started. With ``sets``, the
    log of triples that tells when ends come to exist is that one.
    """
    made = (ops if sets is None else sets).filter(F.col("op_type") == SET_TRIPLE)
    known = made.select(F.col("triple.entity").alias("id"), _place().alias("created_at"))
    if existing is not None:
        start = F.lit(-(10**11)).cast("decimal(38,0)").alias("created_at")
        known = known.unionByName(existing.select("id", start))
    creations = ops.filter(F.col("op_type") == CREATE_RELATION)
    late = materialize(_late_ends(creations, known), "late-ends")

    def end(name: str) -> DataFrame:
        return late.select(
            F.col("id").alias(f"{name}_end"), F.col("created_at").alias(f"{name}_created")
        )

    def exists(name: str, entity: str) -> Column:
        in_time = F.col(f"{name}_end").isNull() | (F.col(f"{name}_created") <= _place())
        return F.col(entity).isNotNull() & F.coalesce(in_time, F.lit(False))

    return (
        creations.join(
            end("from"), F.col("relation.from_entity") == F.col("from_end"), "left"
        )
        .join(end("to"), F.col("relation.to_entity") == F.col("to_end"), "left")
        .withColumn(
            "accepted", exists("from", "relation.from_entity") & exists("to", "relation.to_entity")
        )
        .drop("from_end", "to_end", "from_created", "to_created")
    )


def _late_ends(creations: DataFrame, known: DataFrame) -> DataFrame:
    """(id, created_at) of ends that some creation names before they exist.

    The place is null for an end that never exists. First uses and first sets of an entity
    meet in one aggregate, which combines before its shuffle; the relations themselves only
    meet the few ends that are not there from their first use on.
    """
    used = creations.select(
        F.explode(F.array("relation.from_entity", "relation.to_entity")).alias("id"),
        _place().alias("used_at"),
    )
    in_time = F.col("created_at") <= F.col("used_at")
    return (
        used.unionByName(known, allowMissingColumns=True)
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("used_at").alias("used_at"), F.min("created_at").alias("created_at"))
        .filter(F.col("used_at").isNotNull() & ~F.coalesce(in_time, F.lit(False)))
        .select("id", "created_at")
    )


def derive_relations(
    ops: DataFrame,
    versioning: bool = True,
    existing: DataFrame | None = None,
    slice_blocks: int = SLICE_BLOCKS,
    sets: DataFrame | None = None,
) -> DataFrame:
    """All versions of all relations; creations with a missing end are dropped.

    ``sets`` is the log of triples, if it is not part of ``ops``.
    """
    accepted = relation_creations(ops, existing, sets).filter("accepted").drop("accepted")
    deletions = ops.filter(F.col("op_type") == DELETE_RELATION)
    flat = _ordered(
        accepted.unionByName(deletions), [CREATE_RELATION, DELETE_RELATION], versioning
    ).select(
        F.col("relation.id").alias("id"),
        F.col("relation.from_entity").alias("from_id"),
        F.col("relation.to_entity").alias("to_id"),
        F.col("relation.type").alias("relation_type"),
        F.col("relation.index").alias("index"),
        "space_id", "version", "op_type", "block_ts", *ORDER,
    )
    block = F.col("block_number").cast("string")
    return _intervals(flat, RELATION_KEY, CREATE_RELATION, versioning, slice_blocks).select(
        "id", "from_id", "to_id", "relation_type", "index", "space_id",
        "min_version", "max_version",
        F.col("block_ts").alias("created_at"), block.alias("created_at_block"),
        F.col("block_ts").alias("updated_at"), block.alias("updated_at_block"),
    )


def derive_entities(ops: DataFrame) -> DataFrame:
    """System properties: created by the first set, updated by every set or delete."""
    is_set = F.col("op_type") == SET_TRIPLE
    set_block = F.when(is_set, F.col("block_number"))
    return (
        ops.filter(F.col("op_type").isin(SET_TRIPLE, DELETE_TRIPLE))
        .select(F.col("triple.entity").alias("id"), "op_type", "block_number", "block_ts")
        .groupBy("id")
        .agg(
            F.min_by("block_ts", set_block).alias("created_at"),
            F.min(set_block).alias("created_block"),
            F.max_by("block_ts", "block_number").alias("updated_at"),
            F.max("block_number").alias("updated_block"),
        )
        .filter(F.col("created_block").isNotNull())
        .select(
            "id", "created_at", F.col("created_block").cast("string").alias("created_at_block"),
            "updated_at", F.col("updated_block").cast("string").alias("updated_at_block"),
        )
    )


def undo_after(ops: DataFrame, block_number: int) -> DataFrame:
    """The log as it was after ``block_number``; derive again to undo later blocks."""
    return ops.filter(F.col("block_number") <= block_number)
