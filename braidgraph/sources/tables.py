"""The graph tables on disk.

Triples are range partitioned by (attribute, entity) and relations by (type, target),
so a filter on the attribute or relation type reads few files and row groups, and a
popular attribute or hub still spreads over many files.
"""

from pyspark.sql import DataFrame, SparkSession

from braidgraph import schema
from braidgraph.graph import Graph
from braidgraph.vocabulary import DEFAULT, Vocabulary

LAYOUT = {
    "triples": ["attribute", "entity"],
    "relations": ["relation_type", "to_id", "from_id"],
    "entities": ["id"],
}
SCHEMAS = {
    "triples": schema.TRIPLES,
    "relations": schema.RELATIONS,
    "entities": schema.ENTITIES,
}


def write_table(rows: DataFrame, name: str, folder: str, mode: str = "errorifexists") -> None:
    keys = LAYOUT[name]
    fields = SCHEMAS[name].fieldNames()
    (
        rows.select(*[f for f in fields if f in rows.columns])
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .parquet(f"{folder}/{name}")
    )


def write_graph(graph: Graph, folder: str, mode: str = "errorifexists") -> None:
    """Write all tables; with ``mode="overwrite"`` this resets a graph to its seed."""
    for name in LAYOUT:
        write_table(getattr(graph, name), name, folder, mode)


def read_graph(spark: SparkSession, folder: str, vocabulary: Vocabulary = DEFAULT) -> Graph:
    tables = {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name in LAYOUT
    }
    return Graph(**tables, vocabulary=vocabulary)
