"""Connected components of a link table, as joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

ROUNDS = 100


def _roots(names: DataFrame) -> DataFrame:
    """Each node's name followed to the end, halving the way in every round."""
    for _ in range(ROUNDS):
        ahead = names.select(F.col("node").alias("name"), F.col("name").alias("next"))
        followed = materialize(names.join(ahead, "name").select("node", "name", "next"), "names")
        names = followed.select("node", F.col("next").alias("name"))
        if followed.filter("next < name").isEmpty():
            return names
    raise RuntimeError(f"names did not settle in {ROUNDS} rounds")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); the smallest node names it.

    Each round names a node after its smallest neighbour, follows the names to the nodes
    that have no smaller neighbour, and puts these in place of the nodes. Links within a
    name are then gone, and at most half of the nodes go on, so links are read once a
    round and soon few. The way back leads each node through the rounds' names. Rounds
    are written to shared storage; hot nodes meet in partial aggregates, and as the
    links' side of a join, which adaptive execution can split.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = materialize(links.select(*ends).distinct(), "links")
    rounds = []
    for _ in range(ROUNDS):
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            left.select(F.col("b"), F.col("a"))
        )
        least = both.groupBy("node").agg(F.min("near").alias("near"))
        names = _roots(
            materialize(least.select("node", F.least("node", "near").alias("name")), "names")
        )
        rounds.append(names)
        renamed = left.join(
            names.select(F.col("node").alias("a"), F.col("name").alias("name_a")), "a"
        ).join(names.select(F.col("node").alias("b"), F.col("name").alias("name_b")), "b")
        renamed = renamed.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
        left = materialize(renamed.filter("a != b").select(*ends).distinct(), "links")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("name"), F.col("name").alias("last"))
        found = rounds.pop().join(later, "name", "left").select(
            "node", F.coalesce("last", "name").alias("name")
        )
        found = materialize(found, "names")
    return found.select("node", F.col("name").alias("component"))
