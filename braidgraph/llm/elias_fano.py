"""Token ids of documents on disk, with Elias-Fano coded document boundaries.

Documents are dealt out by range of their id and encoded in ascending order, so the
concatenation of the parts is the corpus. A part is written as segments: the ids of
whole documents as one array, and the monotone sequences of document ends and of
document ids in Elias-Fano form, with sampled select positions of 32 bits. The files are
Parquet with binary columns, committed by Spark, so lost tasks are repeated safely.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.llm.tokens import encoded_rows, id_width, ids_crc32, shared_encoder, vocabulary

SEGMENT_TOKENS = 1 << 19
SEGMENT_DOCUMENTS = 1 << 16
SELECT_SAMPLE = 256

_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

SEGMENTS = (
    "shard int, segment int, base long, n_tokens long, n_docs int, n_null int, width int, "
    "first_id long, id_bits int, id_low binary, id_high binary, id_select binary, "
    "end_bits int, end_low binary, end_high binary, end_select binary, ids binary"
)
DOCUMENTS = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


@dataclass
class EliasFano:
    """A non-decreasing sequence of non-negative integers.

    Each value is split into ``bits`` low bits, stored as they are, and a high part,
    stored in unary; both take about two bits a value above the entropy.
    """

    count: int
    bits: int
    low: bytes
    high: bytes
    select: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        count = len(values)
        if not count:
            return cls(0, 0, b"", b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must be non-negative and must not decrease")
        bits = max(0, int(values[-1] // count).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits)) & 1
        ones = (values >> bits) + np.arange(count)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(
            count,
            bits,
            np.packbits(low.astype(np.uint8), bitorder="little").tobytes(),
            np.packbits(unary, bitorder="little").tobytes(),
            ones[::SELECT_SAMPLE].astype("<u4").tobytes(),
        )

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.int64)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")
        picked = bits[: self.count * self.bits].reshape(self.count, self.bits)[index]
        return picked.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))

    def decode(self) -> np.ndarray:
        unary = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        ones = np.flatnonzero(unary)[: self.count]
        every = np.arange(self.count)
        return ((ones - every) << self.bits) | self._low(every)

    def get(self, index: int) -> int:
        """One value: a select from the nearest sample, then its low bits."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        samples = np.frombuffer(self.select, "<u4")
        position = int(samples[index // SELECT_SAMPLE])
        missing = index % SELECT_SAMPLE
        high = np.frombuffer(self.high, np.uint8)
        if missing:
            byte = (position + 1) // 8
            here = int(high[byte]) & (0xFF << ((position + 1) % 8)) & 0xFF
            while _BIT_COUNT[here] < missing:
                missing -= int(_BIT_COUNT[here])
                byte += 1
                here = int(high[byte])
            for _ in range(missing - 1):
                here &= here - 1
            position = byte * 8 + (here & -here).bit_length() - 1
        first, low = index * self.bits, 0
        for k in range(self.bits):
            at = first + k
            low |= (self.low[at >> 3] >> (at & 7) & 1) << k
        return ((position - index) << self.bits) | low


def _segments(
    rows: Iterable[tuple[int | None, bytes]], shard: int, width: int, end_id: int
) -> Iterator[tuple]:
    end = np.array([end_id], f"<u{width}").tobytes()
    base = segment = total = 0
    keys: list[int | None] = []
    blobs: list[bytes] = []
    sizes: list[int] = []

    def closed() -> tuple:
        known = [key for key in keys if key is not None]
        first = known[0] if known else 0
        ids = EliasFano.encode(np.array(known, np.int64) - first if known else np.zeros(0))
        ends = EliasFano.encode(np.cumsum(sizes))
        return (
            shard, segment, base, sum(sizes), len(keys), len(keys) - len(known), width,
            first, ids.bits, ids.low, ids.high, ids.select,
            ends.bits, ends.low, ends.high, ends.select, b"".join(blobs),
        )

    for key, blob in rows:
        size = len(blob) // width + 1
        if keys and (total + size > SEGMENT_TOKENS or len(keys) >= SEGMENT_DOCUMENTS):
            yield closed()
            base, segment, total = base + total, segment + 1, 0
            keys, blobs, sizes = [], [], []
        keys.append(key)
        blobs += (blob, end)
        sizes.append(size)
        total += size
    if keys:
        yield closed()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_INT, _LONG, _BINARY = pa.int32(), pa.int64(), pa.binary()
_TYPES = {"int": _INT, "long": _LONG, "binary": _BINARY}


def arrow_schema(text: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (part.split() for part in text.split(", "))])


def write_corpus(
    docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = 2
) -> None:
    """Encode ``docs`` (doc_id, text) and write them below ``path`` in order of doc_id.

    A null text is empty and becomes the end id alone. Rows without an id come first.
    Rows of one id are written in order of their text. An empty table gives no segment.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    text = vocabulary(vocabulary_path)
    width = id_width(text)
    shipped = spark.sparkContext.broadcast(text)

    def encode(batches):
        encoder = shared_encoder(shipped.value, width)
        shard = TaskContext.get().partitionId()
        schema = arrow_schema(SEGMENTS)
        for row in _segments(encoded_rows(batches, encoder), shard, width, end_id):
            yield _batch([row], schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(encode, SEGMENTS).write.mode("overwrite").parquet(path)


def shard_starts(segments: DataFrame) -> DataFrame:
    """Ids before each part. The window runs over one row per part."""
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard")) - F.col("size")
    return totals.select("shard", before.alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens and ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(batches):
        schema = arrow_schema(DOCUMENTS)
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(list(_documents(row)), schema)

    found = segments.mapInArrow(decode, DOCUMENTS)
    return found.join(shard_starts(segments), "shard").select(
        "doc_id",
        (F.col("shard_start") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def _documents(row: dict) -> Iterator[tuple]:
    known = row["n_docs"] - row["n_null"]
    keys = EliasFano(known, row["id_bits"], row["id_low"], row["id_high"], row["id_select"])
    coded = EliasFano(
        row["n_docs"], row["end_bits"], row["end_low"], row["end_high"], row["end_select"]
    )
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    doc_ids = [None] * row["n_null"] + (keys.decode() + row["first_id"]).tolist()
    start = 0
    for doc_id, end in zip(doc_ids, coded.decode().tolist()):
        crc = ids_crc32(ids[start:end])
        yield row["shard"], doc_id, row["base"] + start, end - start, crc
        start = end
