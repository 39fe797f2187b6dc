"""Triples as of a version, read from full snapshots at block marks and the changes between.

The store holds, for each mark, the triples open after the block of the mark, and for the
blocks from there to the next mark the rows they opened and the rows of the snapshot they
closed. A read of a version opens one snapshot and the changes after it, whatever the age
of the log. New blocks extend the store from its last snapshot: what is written stays.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.operators.history import (
    SLICE_BLOCKS,
    TRIPLE_KEY,
    derive_triples,
    edit_position,
    version_stamp,
)
from braidgraph.vocabulary import DELETE_TRIPLE, SET_TRIPLE

COLUMNS = [*TRIPLE_KEY, "value", "value_type", "format", "unit", "language", "min_version"]
ROWS = ", ".join(f"{name} string" for name in COLUMNS)
CLOSED = [*TRIPLE_KEY, "min_version", "max_version"]
# Before the first block.
START = -1


@dataclass(frozen=True)
class Snapshots:
    """The folders of a store; a mark is a block number."""

    folder: str

    def snapshot(self, mark: int) -> str:
        return f"{self.folder}/snapshots/mark={mark}"

    def opened(self, mark: int) -> str:
        return f"{self.folder}/opened/after={mark}"

    def closed(self, mark: int) -> str:
        return f"{self.folder}/closed/after={mark}"

    def marks(self, spark: SparkSession) -> list[int]:
        """The marks in order, one row each; a mark counts once all before it is written."""
        try:
            rows = spark.read.schema("mark long").parquet(f"{self.folder}/marks").collect()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted({row["mark"] for row in rows})


def _rows(spark: SparkSession, path: str, columns: str = ROWS) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def extend(store: Snapshots, ops: DataFrame, mark: int, slice_blocks: int = SLICE_BLOCKS) -> None:
    """Take the operations after the last mark up to block ``mark`` into the store.

    ``ops`` is the log or any part of it that holds these blocks. The mark is written
    last, so an extension that was lost on the way is done again in full.
    """
    spark = ops.sparkSession
    marks = store.marks(spark)
    if not marks:
        _write(spark.createDataFrame([], ROWS), store.snapshot(START))
    last = marks[-1] if marks else START
    if mark <= last:
        raise ValueError(f"block {mark} is not after the last mark {last}")
    block = F.col("block_number")
    fresh = ops.filter(
        (block > last) & (block <= mark) & F.col("op_type").isin(SET_TRIPLE, DELETE_TRIPLE)
    )
    before = _rows(spark, store.snapshot(last))
    opened = derive_triples(fresh, slice_blocks=slice_blocks).select(*COLUMNS, "max_version")
    _write(opened, store.opened(last))
    opened = _rows(spark, store.opened(last), f"{ROWS}, max_version string")

    # The first operation of a key ends what the snapshot holds of it.
    keys = [F.col("triple.entity"), F.col("triple.attribute"), F.col("space_id")]
    first = fresh.groupBy(*keys).agg(F.min(edit_position()).alias("first"))
    first = first.select(*TRIPLE_KEY, version_stamp("first.block", "first.edit").alias("max_version"))
    _write(before.join(first, TRIPLE_KEY).select(*CLOSED), store.closed(last))

    gone = _rows(spark, store.closed(last), ", ".join(f"{name} string" for name in CLOSED))
    kept = before.join(gone.select(*TRIPLE_KEY), TRIPLE_KEY, "left_anti")
    now = opened.filter("max_version IS NULL").select(*COLUMNS)
    _write(kept.select(*COLUMNS).unionByName(now), store.snapshot(mark))
    spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("append").parquet(
        f"{store.folder}/marks"
    )


def build(store: Snapshots, ops: DataFrame, every: int) -> None:
    """A store of the whole log with a mark every ``every`` blocks, and one at its end."""
    newest = ops.agg(F.max("block_number")).first()[0]
    if newest is None:
        return
    marks = store.marks(ops.sparkSession)
    done = marks[-1] if marks else START
    for mark in [*range(done + every, newest, every), newest]:
        if mark > done:
            extend(store, ops, mark)


def triples_at(spark: SparkSession, store: Snapshots, version: str) -> DataFrame:
    """The triples as of ``version`` (see ``version_stamp``), in COLUMNS.

    A version after the last mark is one of blocks the store has not seen: an error.
    """
    block = int(version.partition(":")[0])
    marks = store.marks(spark)
    if not marks or block > marks[-1]:
        raise ValueError(f"block {block} is not in the store")
    # The block itself lies after the snapshot, since the version may end inside of it.
    mark = max([START, *(m for m in marks if m < block)])
    closed = _rows(spark, store.closed(mark), ", ".join(f"{name} string" for name in CLOSED))
    gone = closed.filter(F.col("max_version") <= version).select(*TRIPLE_KEY)
    kept = _rows(spark, store.snapshot(mark)).join(gone, TRIPLE_KEY, "left_anti")
    opened = _rows(spark, store.opened(mark), f"{ROWS}, max_version string").filter(
        (F.col("min_version") <= version)
        & (F.col("max_version").isNull() | (F.col("max_version") > version))
    )
    return kept.select(*COLUMNS).unionByName(opened.select(*COLUMNS))


def files_of(store: Snapshots, spark: SparkSession) -> list[str]:
    """All data files of the store."""
    every = [START, *store.marks(spark)]
    paths = [store.snapshot(mark) for mark in every]
    paths += [path(mark) for mark in every[:-1] for path in (store.opened, store.closed)]
    return [file for path in paths for file in spark.read.schema(ROWS).parquet(path).inputFiles()]
