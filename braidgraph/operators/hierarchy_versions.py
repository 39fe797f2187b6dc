"""The space hierarchy as of any version, maintained as edges come and go.

Edges are (child, parent, min_version, max_version). A closure has (root, space_id,
depth, min_version, max_version): from ``min_version`` up to but not including
``max_version``, ``depth`` is the smallest number of steps up from the root to the space;
a null end is open. A walk as of a version is a filter. ``extend`` takes a closure of all
changes before a version to one of later changes: it walks again only from the roots
below a changed edge, and only from that version on.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.functions.predicates import snapshot
from braidgraph.operators.history import version_stamp
from braidgraph.plans.lineage import materialize
from braidgraph.vocabulary import CREATE_RELATION, DELETE_RELATION, Vocabulary

PAIR = ["root", "space_id"]
CLOSURE = [*PAIR, "depth", "min_version", "max_version"]
# Later than every version stamp.
OPEN = "~"


def _end(name: str = "max_version") -> Column:
    return F.coalesce(F.col(name), F.lit(OPEN))


def _stored(end: str = "hi") -> Column:
    return F.when(F.col(end) != OPEN, F.col(end))


def edge_changes(ops: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(child, parent, version, added) of the subspace operations of a log."""
    handled = F.col("op_type").isin(CREATE_RELATION, DELETE_RELATION)
    return ops.filter(handled & (F.col("relation.type") == vocabulary.parent_space)).select(
        F.col("relation.from_entity").alias("child"),
        F.col("relation.to_entity").alias("parent"),
        version_stamp().alias("version"),
        (F.col("op_type") == CREATE_RELATION).alias("added"),
    )


def edge_versions(changes: DataFrame) -> DataFrame:
    """Validity intervals of edges from (child, parent, version, added).

    An edge added again while it holds, or removed while it does not, changes nothing.
    Added and removed at one version, it holds. Rows with a null are ignored.
    """
    edge = ["child", "parent"]
    order = Window.partitionBy(*edge).orderBy("version")
    turns = (
        changes.dropna(subset=[*edge, "version", "added"])
        .groupBy(*edge, "version")
        .agg(F.max("added").alias("added"))
        .withColumn("was", F.lag("added", 1, False).over(order))
        .filter(F.col("added") != F.col("was"))
        .withColumn("max_version", F.lead("version").over(order))
    )
    return turns.filter("added").select(*edge, F.col("version").alias("min_version"), "max_version")


def _uncovered(candidates: DataFrame, reached: DataFrame | None) -> DataFrame:
    """The times of candidate pairs outside those already reached, as maximal intervals.

    Both come as (root, space_id, lo, hi). Their ends are counted up in order of version
    within a pair: one shuffle, and a task orders the changes of one pair at most.
    """

    def ends(rows: DataFrame, own: int) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")),
                               F.struct(F.col("hi").alias("at"), F.lit(-1).alias("step"))))
        steps = rows.select(*PAIR, at.alias("end")).select(*PAIR, "end.at", "end.step")
        return steps.select(
            *PAIR, "at", (F.col("step") * own).alias("found"), (F.col("step") * (1 - own)).alias("known")
        )

    both = ends(candidates, 1) if reached is None else ends(candidates, 1).unionByName(ends(reached, 0))
    order = Window.partitionBy(*PAIR).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = both.groupBy(*PAIR, "at").agg(F.sum("found").alias("found"), F.sum("known").alias("known"))
    is_new = (F.sum("found").over(so_far) > 0) & (F.sum("known").over(so_far) == 0)
    turns = (
        marks.withColumn("on", is_new)
        .withColumn("was", F.lag("on", 1, False).over(order))
        .filter(F.col("on") != F.col("was"))
        .withColumn("hi", F.lead("at").over(order))
    )
    return turns.filter("on").select(*PAIR, F.col("at").alias("lo"), "hi")


def _walk(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Breadth-first over (child, parent, lo, hi): pairs with depth and time.

    Every level holds the times at which a pair is not reached by fewer steps, so a cycle
    ends the walk. A space takes part while an edge at either end of it holds.
    """
    step = edges.select(
        F.col("child").alias("space_id"), F.col("parent").alias("next_id"),
        F.col("lo").alias("from_version"), F.col("hi").alias("to_version"),
    )
    ends = edges.select(F.explode(F.array("child", "parent")).alias("root"), "lo", "hi")
    if roots is not None:
        ends = ends.join(roots, "root", "left_semi")
    start = ends.select("root", F.col("root").alias("space_id"), "lo", "hi")
    level = materialize(_uncovered(start, None).withColumn("depth", F.lit(0)), "version-level")
    reached, depth = level, 0
    while True:
        depth += 1
        meets = (F.col("from_version") < F.col("hi")) & (F.col("to_version") > F.col("lo"))
        found = level.join(step, "space_id").filter(meets).select(
            "root", F.col("next_id").alias("space_id"),
            F.greatest("lo", "from_version").alias("lo"), F.least("hi", "to_version").alias("hi"),
        )
        # Only pairs that are met again need their known times.
        found = materialize(found.distinct(), "version-step")
        known = reached.join(found.select(*PAIR).distinct(), PAIR, "left_semi")
        new = _uncovered(found, known.select(*PAIR, "lo", "hi"))
        level = materialize(new.withColumn("depth", F.lit(depth)), "version-level")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)


def _clipped(edges: DataFrame, since: str) -> DataFrame:
    return edges.select(
        "child", "parent", F.greatest(F.col("min_version"), F.lit(since)).alias("lo"), _end().alias("hi")
    ).filter("lo < hi")


def closure_versions(edges: DataFrame) -> DataFrame:
    """The closure of all edges at all versions."""
    edges = materialize(_clipped(edges, ""), "version-edges")
    found = _walk(edges, None)
    found = found.select(*PAIR, "depth", F.col("lo").alias("min_version"), _stored().alias("max_version"))
    return materialize(found, "closure-versions")


def extend(closure: DataFrame, edges: DataFrame, since: str) -> DataFrame:
    """The closure of ``edges``, from one of the same edges without changes at or after ``since``.

    A root whose walks use a changed edge reached the edge's child before ``since``, by an
    unchanged edge that still holds, or is one of its ends. Rows of all other roots stay
    as they are; those of the affected are cut at ``since``, walked anew from there, and
    joined where nothing changed.
    """
    later = (F.col("min_version") >= since) | (F.col("max_version") >= since)
    changed = edges.filter(later).select(F.explode(F.array("child", "parent")).alias("space_id")).distinct()
    changed = materialize(changed, "changed-spaces")
    held = closure.filter(snapshot())
    affected = held.join(changed, "space_id", "left_semi").select("root")
    affected = materialize(affected.unionByName(changed.select(F.col("space_id").alias("root"))).distinct(), "affected")
    is_closed = F.col("max_version").isNotNull()
    untouched = closure.filter(is_closed).unionByName(held.join(affected, "root", "left_anti"))
    old = held.join(affected, "root", "left_semi").select(
        *PAIR, "depth", F.col("min_version").alias("old_version")
    )
    clipped = materialize(_clipped(edges, since), "version-edges")
    walked = _walk(clipped, affected).withColumn("is_first", F.col("lo") == since)
    first = walked.filter("is_first").join(old, [*PAIR, "depth"], "full_outer")
    first = first.select(
        *PAIR, "depth", F.coalesce("old_version", "lo").alias("min_version"),
        # What isn't reached in the same number of steps any more ends here.
        F.when(F.col("lo").isNull(), F.lit(since)).otherwise(_stored()).alias("max_version"),
    )
    rest = walked.filter("not is_first").select(
        *PAIR, "depth", F.col("lo").alias("min_version"), _stored().alias("max_version")
    )
    found = untouched.select(*CLOSURE).unionByName(first).unionByName(rest)
    return materialize(found, "closure-versions")


def spaces_at(closure: DataFrame, version: str) -> DataFrame:
    """(root, space_id, depth) as of a version: spaces above each root; swapped, those below."""
    return closure.filter(snapshot(version)).select(*PAIR, "depth")
