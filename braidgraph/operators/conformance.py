"""Whole-table checks and conformance of ids, values, codes and addresses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.functions.ids import address_key
from braidgraph.functions.values import from_text

GRAPH_SCHEME = "graph://"


def assign_ids(rows: DataFrame, source: Column, kind: str) -> DataFrame:
    """(kind, source, id) of every distinct source name."""
    return rows.select(source.alias("source")).distinct().select(
        F.lit(kind).alias("kind"), "source", F.md5(F.col("source").cast("binary")).alias("id")
    )


def id_collisions(assigned: DataFrame) -> DataFrame:
    """Ids given to more than one source."""
    return (
        assigned.groupBy("id")
        .agg(F.count_distinct("kind", "source").alias("sources"))
        .filter(F.col("sources") > 1)
    )


def typed_value_report(triples: DataFrame) -> DataFrame:
    """How many values of each (attribute, value_type) parse as their declared type."""
    value = F.col("value")
    parsed = F.lit(False)
    for kind in ("NUMBER", "CHECKBOX", "TIME"):
        parsed = F.when(
            F.col("value_type") == kind, from_text(value, kind).isNotNull()
        ).otherwise(parsed)
    opaque = F.col("value_type").isin("TEXT", "URL", "POINT") & value.isNotNull()
    ok = F.coalesce(opaque | parsed, F.lit(False))
    is_number = F.col("value_type") == "NUMBER"

    def counted(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return triples.groupBy("attribute", "value_type").agg(
        F.count(F.lit(1)).alias("total"),
        counted(~ok).alias("failed"),
        counted(is_number & from_text(value, "BIGINT").isNotNull()).alias("as_signed"),
        counted(is_number & from_text(value, "UNSIGNED").isNotNull()).alias("as_unsigned"),
    )


def references(triples: DataFrame) -> DataFrame:
    """Values that name an entity, as (entity, attribute, space_id, target) edges.

    A reference with an empty id is malformed and gets a null target.
    """
    target = F.replace("value", F.lit(GRAPH_SCHEME), F.lit(""))
    return triples.filter(F.startswith("value", F.lit(GRAPH_SCHEME))).select(
        "entity", "attribute", "space_id",
        F.when(target != "", target).alias("target"),
    )


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """References to entities that do not exist, and malformed ones."""
    ids = entities.select(F.col("id").alias("target"))
    return edges.join(ids, "target", "left_anti")


def conform(
    rows: DataFrame, column: str, codes: dict, output: str
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``output`` decoded, rows with an unknown code)."""
    decoded = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    tagged = rows.withColumn(output, F.try_element_at(decoded, F.col(column)))
    return tagged.filter(F.col(output).isNotNull()), tagged.filter(
        F.col(output).isNull()
    ).drop(output)


def conform_addresses(tables: dict[str, DataFrame]) -> DataFrame:
    """Every spelling of every address: (source, address, key), and one key per address.

    ``tables`` maps the name of a source to a DataFrame with one ``address`` column.
    """
    spellings = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias("source"), "address").distinct()
        spellings = part if spellings is None else spellings.unionByName(part)
    return spellings.withColumn("key", address_key("address"))
