"""Repeated passages by Rabin-Karp hashes of every window of words.

A task hashes all windows of its documents and decides among them at once: of the
documents that hold a window, only the smallest can keep it. What is left, one entry
per window and task, is dealt out by a second hash to buckets, packed as arrays. A
bucket finds the smallest document of each window over all tasks and sends the places
of the others back. Places of a document merge into maximal intervals.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.words import BLOCK_BYTES, mix, sequence_hashes, text_slices, words

# Windows a task decides among at once.
GROUP_WINDOWS = 2_000_000

_PACK = zstandard.ZstdCompressor(level=1)
_OTHER = np.uint64(0xA0761D6478BD642F)


def _windows(column: pa.Array, width: int) -> Iterator[tuple]:
    """Per slice of rows: window hashes, their row and their place in the row."""
    for start, end in text_slices(column):
        found = words(column.slice(start, end - start))
        runs = sequence_hashes(found.hashes, width)
        sizes = np.diff(found.first)
        counts = np.maximum(sizes - width + 1, 0)
        rows = np.repeat(np.arange(end - start), counts)
        heads = np.cumsum(counts) - counts
        places = np.arange(int(counts.sum())) - heads[rows]
        yield runs[found.first[rows] + places], rows + start, places


def _first_of(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash and document, and per entry of that order: is its document the least."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, docs == least


def _packed(data: bytes) -> bytes:
    return _PACK.compress(data)


def _deltas(values: np.ndarray, kind: str) -> bytes:
    return _packed(np.diff(values, prepend=0).astype(kind).tobytes())


def _undo(blob: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), kind), dtype=np.int64)


def _parts(to: np.ndarray, docs: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    """(destination, indices in order of document and place) for each destination."""
    by = np.lexsort((places, docs, to))
    to = to[by]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else to
    for start, end in zip(cuts, np.append(cuts[1:], len(to))):
        yield int(to[start]), by[start:end]


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _place_rows(docs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple]:
    for to, at in _parts(_doc_bucket(docs, buckets), docs, places):
        yield to, 1, None, _deltas(docs[at], "<i8"), _deltas(places[at], "<i4")


def _decide(held: list[tuple], buckets: int) -> Iterator[tuple]:
    """Rows for windows to compare with other tasks (kind 0) and for decided places."""
    hashes, docs, places = (np.concatenate(parts) for parts in zip(*held))
    order, least = _first_of(hashes, docs)
    hashes, docs, places = hashes[order], docs[order], places[order]
    yield from _place_rows(docs[~least], places[~least], buckets)
    hashes, docs, places = hashes[least], docs[least], places[least]
    other = mix(hashes ^ _OTHER) >> np.uint64(32)
    to = (other * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for bucket, at in _parts(to, docs, places):
        packed = _deltas(docs[at], "<i8"), _deltas(places[at], "<i4")
        yield bucket, 0, hashes[at].tobytes(), *packed


def _compare(held: list[tuple], buckets: int) -> Iterator[tuple]:
    """Rows for places whose window starts in a smaller document of another task."""
    hashes, docs, places = (np.concatenate(parts) for parts in zip(*held))
    order, least = _first_of(hashes, docs)
    late = order[~least]
    yield from _place_rows(docs[late], places[late], buckets)


BLOBS = "bucket int, kind int, hashes binary, docs binary, places binary"
_BLOB_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32())]
    + [(name, pa.binary()) for name in ("hashes", "docs", "places")]
)
_RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("bounds", pa.binary())])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    size = 0
    for row in rows:
        pending.append(row)
        size += sum(len(value) for value in row if isinstance(value, bytes))
        if size > BLOCK_BYTES or len(pending) >= 4096:
            yield _batch(pending, schema)
            pending, size = [], 0
    if pending:
        yield _batch(pending, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _table(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(_batches(rows, schema)), schema=schema)


def _intervals(docs: np.ndarray, places: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """Per document the maximal word intervals of its windows, as pairs of bounds."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + width))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(docs)) - 1
    bounds = np.stack([places[starts], places[ends] + width], axis=1).astype("<i4")
    owner = docs[starts]
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for first, last in zip(cuts, np.append(cuts[1:], len(owner))):
        yield int(owner[first]), bounds[first:last].tobytes()


def repeated_intervals(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, bounds): the word intervals each document loses; int32 pairs, end exclusive."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.col("doc_id").isNotNull()
    )

    def windows(batches):
        def rows():
            held: list[tuple] = []
            count = 0
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for hashes, at, places in _windows(batch.column(1), width):
                    if len(hashes):
                        held.append((hashes, ids[at], places.astype(np.int32)))
                        count += len(hashes)
                    if count >= GROUP_WINDOWS:
                        yield from _decide(held, buckets)
                        held, count = [], 0
            if held:
                yield from _decide(held, buckets)

        return _batches(rows(), _BLOB_SCHEMA)

    def compare(table: pa.Table) -> pa.Table:
        held, decided = [], []
        for row in table.to_pylist():
            if row["kind"] == 1:
                decided.append((row["bucket"], 1, None, row["docs"], row["places"]))
            else:
                hashes = np.frombuffer(row["hashes"], np.uint64)
                held.append((hashes, _undo(row["docs"], "<i8"), _undo(row["places"], "<i4")))
        if held:
            decided += _compare(held, buckets)
        return _table(iter(decided), _BLOB_SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        ids = [_undo(blob, "<i8") for blob in table["docs"].to_pylist()]
        places = [_undo(blob, "<i4") for blob in table["places"].to_pylist()]
        found = _intervals(np.concatenate(ids), np.concatenate(places), width)
        return _table(found, _RUN_SCHEMA)

    found = chosen.mapInArrow(windows, BLOBS).groupBy("bucket").applyInArrow(compare, BLOBS)
    return found.groupBy("bucket").applyInArrow(merge, "doc_id long, bounds binary")


def remove_repeats(docs: DataFrame, width: int = 50, with_text: bool = False) -> DataFrame:
    """Remove each word that lies in a window found in a document with a smaller id.

    A word is a run without ASCII white space, and a window is ``width`` consecutive
    words of one document; windows are judged on the input. Returns doc_id, n_words,
    n_removed and kept_sha256, the hash of the kept words joined by one space, which
    ``with_text`` adds as kept_text. A null or empty text has no words. Rows without an
    id lose nothing and take nothing from others. Rows that repeat an id are one
    document: they take nothing from each other and lose the same places. An empty table
    gives no rows; other columns are ignored. Windows are told apart by a 64-bit hash
    alone; their words are not compared.
    """
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    shape += ", kept_text string" if with_text else ""

    def squeeze(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            packed = [_packed(text.as_py() or b"") for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"]
            )

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, packed, bounds in zip(*(column.to_pylist() for column in batch.columns)):
                all_words = zstandard.decompress(packed).split()
                kept = all_words
                if bounds is not None:
                    kept, at = [], 0
                    for start, end in np.frombuffer(bounds, "<i4").reshape(-1, 2).tolist():
                        kept += all_words[at:start]
                        at = end
                    kept += all_words[at:]
                text = b" ".join(kept)
                row = (doc_id, len(all_words), len(all_words) - len(kept))
                row += (hashlib.sha256(text).hexdigest(),)
                rows.append(row + (text.decode(),) if with_text else row)
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] * (len(rows[0]) - 3)
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                names = [part.split()[0] for part in shape.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    lost = repeated_intervals(docs, width).withColumnRenamed("doc_id", "lost_id")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = chosen.mapInArrow(squeeze, "doc_id long, packed binary")
    joined = packed.join(lost, packed["doc_id"] == lost["lost_id"], "left")
    return joined.select("doc_id", "packed", "bounds").mapInArrow(cut, shape)
