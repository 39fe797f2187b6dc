"""Packing of documents into sequences by their length histogram.

Documents are cut into pieces of at most one sequence. The pieces are counted by
length, and the histogram alone decides the plan: lengths are placed longest first,
always into the shortest pack that is open, and whole counts of equal packs move
together. The plan has a few thousand lines whatever the number of documents; pieces
find their place in it by their rank among the pieces of their length.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.elias_fano import arrow_schema
from braidgraph.llm.tokens import Encoder, encoded_rows, id_width, ids_crc32, vocabulary
from braidgraph.plans.lineage import materialize

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
PIECES_WITH_IDS = PIECES + ", ids binary"
PLAN = "length int, first_rank long, pieces long, first_sequence long, offset int"


def pack_histogram(
    counts: dict[int, int], size: int
) -> Iterator[tuple[int, int, int, int, int]]:
    """Shortest-pack-first over a length histogram.

    Yields lines (length, first_rank, pieces, first_sequence, offset): the pieces of
    that length with ranks from ``first_rank`` lie at ``offset`` of the sequences from
    ``first_sequence``, one each. Equal packs are kept as one group (free space, first
    sequence, number), so the work grows with the number of lengths, not of pieces.
    """
    groups: list[tuple[int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit into {size}")
        rank, left = 0, counts[length]
        while left:
            if groups and -groups[0][0] >= length:
                free, first, number = -groups[0][0], groups[0][1], groups[0][2]
                heapq.heappop(groups)
                placed = min(left, number)
                if placed < number:
                    heapq.heappush(groups, (-free, first + placed, number - placed))
            else:
                free, first, placed = size, sequences, left
                sequences += left
            yield length, rank, placed, first, size - free
            if free > length:
                heapq.heappush(groups, (-(free - length), first, placed))
            rank, left = rank + placed, left - placed


def pieces(
    docs: DataFrame, size: int, vocabulary_path: str | None, end_id: int, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``size`` ids: full ones from the start, then what is left."""
    text = vocabulary(vocabulary_path)
    width = id_width(text)
    shipped = docs.sparkSession.sparkContext.broadcast(text)
    columns = PIECES_WITH_IDS if with_ids else PIECES

    def cut(batches):
        encoder = Encoder(shipped.value, width)
        schema = arrow_schema(columns)
        end = np.array([end_id], f"<u{width}").tobytes()
        rows: list[tuple] = []
        for doc_id, blob in encoded_rows(batches, encoder):
            ids = np.frombuffer(blob + end, f"<u{width}")
            for start in range(0, len(ids), size):
                part = ids[start : start + size]
                row = (doc_id, start, len(part), ids_crc32(part), len(ids))
                rows.append(row + (part.astype("<u4").tobytes(),) if with_ids else row)
            if len(rows) >= (512 if with_ids else 8192):
                yield _columns(rows, schema)
                rows = []
        if rows:
            yield _columns(rows, schema)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(cut, columns)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ranked(pieces: DataFrame, slots: int) -> DataFrame:
    """Add ``rank``: 0, 1, ... among the pieces of a length.

    A length may be that of a third of all pieces, so each length is dealt out to
    ``slots`` by hash, numbered there, and moved by the pieces of the slots before.
    """
    dealt = pieces.withColumn(
        "slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots)).cast("int")
    )
    counts = dealt.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")
    first = counts.select("length", "slot", before.alias("first"))
    order = Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("row", F.row_number().over(order) - 1)
    return (
        numbered.join(first, ["length", "slot"])
        .withColumn("rank", F.col("first") + F.col("row"))
        .drop("slot", "first", "row")
    )


def pack(
    docs: DataFrame,
    size: int = 2048,
    vocabulary_path: str | None = None,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text); a row per piece with its sequence and offset.

    A null or empty text is the end id alone. Repeated rows are packed each on their
    own, and rows without an id too. An empty table gives no piece. Other columns are
    ignored. ``with_ids`` adds the ids of each piece as 32-bit integers.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, size, vocabulary_path, end_id, with_ids), "pieces")
    # At most ``size`` rows.
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {row["length"]: row["n"] for row in histogram}
    plan = spark.createDataFrame(list(pack_histogram(counts, size)), PLAN)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece, line = ranked(cut, slots).alias("p"), F.broadcast(plan).alias("l")
    rank = F.col("p.rank") - F.col("l.first_rank")
    placed = piece.join(
        line,
        (F.col("p.length") == F.col("l.length")) & (rank >= 0) & (rank < F.col("l.pieces")),
    )
    return placed.select(
        "p.doc_id",
        "p.start",
        F.col("p.length").cast("long").alias("length"),
        "p.ids_crc32",
        "p.doc_tokens",
        (F.col("l.first_sequence") + rank).alias("sequence_id"),
        F.col("l.offset").cast("long").alias("offset"),
        *(["p.ids"] if with_ids else []),
    )
