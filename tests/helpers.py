"""Small graphs and logs for tests."""

import random

from braidgraph import schema
from braidgraph.graph import Graph
from braidgraph.operators import history
from braidgraph.operators.writes import initial_relations, initial_triples
from braidgraph.workload.fixtures import VOCABULARY

OP = "block long, edit int, pos long, space string, op string, entity string, attribute string, value string"


def log(spark, rows):
    """Triple operations given as (block, edit, pos, space, op, entity, attribute, value)."""
    table = spark.createDataFrame(rows, OP)
    return table.selectExpr(
        "block AS block_number", "timestamp_seconds(block) AS block_ts", "edit AS edit_idx",
        "pos AS op_pos", "space AS space_id", "op AS op_type",
        f"CAST(struct(entity, attribute, value, 'TEXT', null, null, null) AS "
        f"{schema.TRIPLE.simpleString()}) AS triple",
        f"CAST(null AS {schema.RELATION.simpleString()}) AS relation",
    )


def relation_log(spark, rows):
    """Relation operations given as (block, edit, pos, space, op, id, from, to, type, index)."""
    table = spark.createDataFrame(
        rows, "block long, edit int, pos long, space string, op string, id string, "
        "f string, t string, type string, index string",
    )
    return table.selectExpr(
        "block AS block_number", "timestamp_seconds(block) AS block_ts", "edit AS edit_idx",
        "pos AS op_pos", "space AS space_id", "op AS op_type",
        f"CAST(null AS {schema.TRIPLE.simpleString()}) AS triple",
        f"CAST(struct(id, type, f, t, index) AS {schema.RELATION.simpleString()}) AS relation",
    )


def graph(spark, triples=(), relations=(), ids=()):
    """Open triples (entity, attribute, space, value) and relations (id, from, to, type, index, space)."""
    triple_rows = spark.createDataFrame(
        list(triples) or [("-", "-", "-", "-")],
        "entity string, attribute string, space_id string, value string",
    ).selectExpr("*", "'TEXT' AS value_type")
    relation_rows = spark.createDataFrame(
        list(relations) or [("-", "-", "-", "-", "-", "-")],
        "id string, from_id string, to_id string, relation_type string, index string, space_id string",
    )
    known = {t[0] for t in triples} | {r[1] for r in relations} | {r[2] for r in relations} | set(ids)
    nodes = spark.createDataFrame([(i,) for i in sorted(known)] or [("-",)], "id string").selectExpr(
        "id", "timestamp_seconds(0) AS created_at", "'0' AS created_at_block",
        "timestamp_seconds(0) AS updated_at", "'0' AS updated_at_block",
    )
    return Graph(initial_triples(triple_rows), initial_relations(relation_rows), nodes, VOCABULARY)


def random_log(seed, size, keys=3, blocks=40):
    """A random log over few keys, so that versions collide and one key is hot."""
    rng = random.Random(seed)
    rows = []
    for pos in range(size):
        hot = rng.random() < 0.4
        entity = "hot" if hot else f"e{rng.randrange(keys)}"
        op = "DELETE_TRIPLE" if rng.random() < 0.25 else "SET_TRIPLE"
        rows.append((rng.randrange(blocks), rng.randrange(3), pos, "s", op, entity, "a", f"v{pos}"))
    return rows


def replay(rows, versioning=True):
    """The intervals of a log by applying its operations one by one."""
    phases = {"SET_TRIPLE": 1, "DELETE_TRIPLE": 2}
    intervals, current = [], {}
    for block, edit, pos, space, op, entity, attribute, value in sorted(
        rows, key=lambda r: (r[0], r[1], phases[r[4]], r[2])
    ):
        version = f"{block:016d}:{edit:08d}" if versioning else "0"
        key = (entity, attribute, space)
        if key in current:
            began, old = current.pop(key)
            if began != version:
                intervals.append((*key, old, began, version))
        if op == "SET_TRIPLE":
            current[key] = (version, value)
    intervals += [(*key, value, began, None) for key, (began, value) in current.items()]
    return sorted(intervals, key=repr)


def intervals(df):
    table = df.select("entity", "attribute", "space_id", "value", "min_version", "max_version")
    return sorted((tuple(r) for r in table.collect()), key=repr)


def rows(df):
    return sorted(tuple(row) for row in df.collect())


__all__ = ["graph", "history", "intervals", "log", "random_log", "relation_log", "replay", "rows"]
