"""Repeated passages of bytes, by prefix-free parsing.

A rolling hash of every ``TRIGGER`` bytes is taken, and the least of the hashes inside a
window (the last of equal ones) is the window's trigger: it depends on the window's bytes
alone, so equal windows have equal triggers at equal places. Consecutive windows share a
trigger; the bytes they cover are a phrase. Phrases are the dictionary, and a document is
the sequence of its phrases.

1. The parse. Phrases of all documents meet under their name, a 128-bit hash. Of equal
   phrases the first in the corpus stands for all, and every window of the others is
   repeated. In a highly repetitive text that settles almost all of it.
2. The dictionary. Different phrases can share windows only if they share the trigger
   string. Those that do send their bytes to one place, where two orders are made: the
   left sides sorted from the trigger backwards and the right sides sorted forwards, with
   the lengths that neighbours have in common. Both together order the windows of a
   trigger as the corpus does: windows that start as far before it are equal if both
   sides agree far enough. The first in the corpus stands for all again. A trigger of
   more than ``HOT`` phrases sends a name for each window instead, which can be dealt out.
3. Repeated windows of a document merge to maximal runs.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.words import BLOCK_BYTES, mix, text_bytes, text_slices
from braidgraph.plans.lineage import materialize

TRIGGER = 32
# Phrases of one trigger that are compared in one place.
HOT = 20_000
# Phrases a task decides among at once, and window starts hashed at once.
GROUP_PHRASES = 150_000
CHUNK_STARTS = 1 << 17
# Text of a bucket, so that its phrases stay small whatever the input.
BUCKET_BYTES = 16 << 20

_PACK = zstandard.ZstdCompressor(level=1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 22) - 1)

# What is to be done with the windows of a phrase.
REPEATED, COMPARED, NAMED = 0, 1, 2


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each ``TRIGGER`` bytes, by doubling: what is hashed grows from 1 to 32.

    It only finds triggers and deals out work; equality is never taken from it.
    """
    with np.errstate(over="ignore"):
        found = mix(data.astype(np.uint64) + np.uint64(1))
        size = 1
        while size < TRIGGER:
            found = found[:-size] * _BASE + (found[size:] ^ (found[size:] >> np.uint64(29)))
            size *= 2
        return mix(found)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def parse(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per stretch of text the phrases: row, first and last window, trigger, its hash.

    Places are bytes from the start of ``data``, which holds rows cut at ``offsets``. A
    phrase at the end of a stretch may be cut; that costs work and changes no result.
    """
    starts = len(data) - width + 1
    for first in range(0, starts, CHUNK_STARTS):
        count = min(CHUNK_STARTS, starts - first)
        hashes = _rolling(data[first : first + count + width - 1])
        places = _PLACE - np.arange(len(hashes), dtype=np.uint64)
        least = _least(hashes & ~_PLACE | places, width - TRIGGER + 1)
        triggers = (_PLACE - (least & _PLACE)).astype(np.int64)
        at = np.arange(first, first + count)
        rows = np.searchsorted(offsets, at, "right") - 1
        inside = np.flatnonzero(at + width <= offsets[rows + 1])
        if not len(inside):
            continue
        t, r = triggers[inside], rows[inside]
        new = np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(inside)) - 1
        own = t[heads]
        yield r[heads], inside[heads] + first, inside[tails] + first, own + first, hashes[own]


def _names(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit names of byte strings, as pairs of 64-bit numbers."""
    name = xxhash.xxh3_128_digest
    view = memoryview(data)
    joined = b"".join(name(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _compressed(data: bytes) -> bytes:
    return _PACK.compress(data)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return _compressed(np.ascontiguousarray(values, dtype=kind).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _deltas(values: np.ndarray, kind: str) -> bytes:
    return _packed(np.diff(values, prepend=values.dtype.type(0)), kind)


def _sums(blob: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unpacked(blob, kind), dtype=np.int64)


def _first_of(names: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple:
    """Order by name, document and start; where a name is new; and which entries come
    later in the corpus than the first of their name."""
    order = np.lexsort((starts, docs, *names.T))
    names, docs, starts = names[order], docs[order], starts[order]
    new = np.append(True, (names[1:] != names[:-1]).any(axis=1))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, new, (docs != docs[first]) | (starts != starts[first])


def _deal(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(destination, its entries) for each destination, entries in order."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(to) else to
    for start, end in zip(cuts, np.append(cuts[1:], len(to))):
        yield int(to[order[start]]), order[start:end]


PARCELS = "bucket int, kind int, names binary, docs binary, copies binary, starts binary, counts binary, leads binary, triggers binary, data binary"
_PARCEL_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32())]
    + [(part.split()[0], pa.binary()) for part in PARCELS.split(", ")[2:]]
)
_FIELDS = ("docs", "copies", "starts", "counts", "leads", "triggers")
MARKS = "doc_id long, copy int, start int, count int, lead int, trigger long, action int"
_MARK_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int32()) for name in ("copy", "start", "count", "lead")]
    + [("trigger", pa.int64()), ("action", pa.int32())]
)


class _Held:
    """Phrases with their documents, as columns."""

    def __init__(self) -> None:
        self.parts: dict[str, list[np.ndarray]] = {name: [] for name in (*_FIELDS, "names")}
        self.size = 0

    def add(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            self.parts[name].append(values)
        self.size += len(columns["docs"])

    def columns(self) -> dict[str, np.ndarray]:
        """The phrases as one array a column; nothing is held any longer."""
        found = {}
        for name, parts in self.parts.items():
            if parts:
                found[name] = np.concatenate(parts)
                parts.clear()
        return found

    def parcel(self, row: dict) -> None:
        """Add the phrases of a packed row."""
        names = {"names": _unpacked(row["names"], "<u8").reshape(-1, 2)} if row["names"] else {}
        self.add(
            docs=_sums(row["docs"], "<i8"), copies=_unpacked(row["copies"], "<i4"),
            starts=_sums(row["starts"], "<i8"), counts=_unpacked(row["counts"], "<u2"),
            leads=_unpacked(row["leads"], "<u2"), triggers=_unpacked(row["triggers"], "<u4"),
            **names,
        )


def _parcel(bucket: int, kind: int, held: dict, at: np.ndarray, data: bytes | None) -> pa.RecordBatch:
    at = at[np.lexsort((held["starts"][at], held["docs"][at]))] if data is None else at
    names = None if held.get("names") is None else held["names"][at].tobytes()
    row = (
        bucket, kind, names and _compressed(names), _deltas(held["docs"][at], "<i8"),
        _packed(held["copies"][at], "<i4"), _deltas(held["starts"][at], "<i8"),
        _packed(held["counts"][at], "<u2"), _packed(held["leads"][at], "<u2"),
        _packed(held["triggers"][at], "<u4"), data,
    )
    arrays = [pa.array([value], field.type) for value, field in zip(row, _PARCEL_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_PARCEL_SCHEMA)


def _marks(held: dict, at: np.ndarray, actions: np.ndarray, bucket: int) -> pa.RecordBatch:
    trigger = held["triggers"][at].astype(np.int64) | bucket << 32
    columns = (
        held["docs"][at], held["copies"][at], held["starts"][at].astype(np.int32),
        held["counts"][at].astype(np.int32), held["leads"][at].astype(np.int32), trigger, actions,
    )
    arrays = [pa.array(values, field.type) for values, field in zip(columns, _MARK_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_MARK_SCHEMA)


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by a hash of the values; triggers are least hashes, so small ones."""
    high = mix(values ^ _BASE) >> np.uint64(32)
    return (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _decide(held: _Held, hashes: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases to compare with other tasks (kind 0), and those known to be repeated (1)."""
    own = held.columns()
    order, _, later = _first_of(own["names"], own["docs"], own["starts"])
    known = {name: values for name, values in own.items() if name != "names"}
    for bucket, at in _deal(_bucket_of(own["docs"][order[later]].view(np.uint64), buckets)):
        yield _parcel(bucket, 1, known, order[later][at], None)
    kept = order[~later]
    for bucket, at in _deal(_bucket_of(np.concatenate(hashes)[kept], buckets)):
        yield _parcel(bucket, 0, own, kept[at], None)


def _settle(table: pa.Table, hot: int) -> pa.Table:
    """Marks of a bucket's phrases: repeated, or to be compared by their windows, which are
    named instead for triggers of more than ``hot`` phrases."""
    held, out = _Held(), []
    bucket = table.column("bucket")[0].as_py()
    for row in table.to_pylist():
        if row["kind"] == 1:
            known = _Held()
            known.parcel(row)
            known = known.columns()
            every = np.arange(len(known["docs"]))
            out.append(_marks(known, every, np.full(len(every), REPEATED), bucket))
        else:
            held.parcel(row)
    if held.size:
        own = held.columns()
        order, new, later = _first_of(own["names"], own["docs"], own["starts"])
        out.append(_marks(own, order[later], np.full(int(later.sum()), REPEATED), bucket))
        # Different phrases of each trigger; the first of a phrase stands for all.
        first = order[new]
        _, of, sizes = np.unique(own["triggers"][first], return_inverse=True, return_counts=True)
        shared = sizes[of] > 1
        actions = np.where(sizes[of] > hot, NAMED, COMPARED)
        out.append(_marks(own, first[shared], actions[shared], bucket))
    return pa.Table.from_batches(out, schema=_MARK_SCHEMA)


def _sorted_sides(sides: np.ndarray, lengths: np.ndarray, triggers: np.ndarray) -> tuple:
    """Order of byte strings (rows of ``sides``, zeros behind) by trigger and content, and
    how many bytes each has in common with the one before it; -1 if not the trigger."""
    words = np.ascontiguousarray(sides).view(">u8")
    order = np.lexsort((lengths, *words.T[::-1], triggers))
    ordered = sides[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), sides.shape[1])
    common = np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))
    common[triggers[order][1:] != triggers[order][:-1]] = -1
    return order, np.append(-1, common)


def _sides(data: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, step: int, most: int) -> np.ndarray:
    """Bytes from ``firsts`` on, or back, as rows that are filled with zeros to eights."""
    width = -(-most // 8) * 8
    out = np.zeros((len(firsts), width), np.uint8)
    row = np.repeat(np.arange(len(firsts)), lengths)
    column = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = data[firsts[row] + step * column]
    return out


def repeated_windows(own: dict, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, window start in its document) of windows that start earlier as well.

    ``data`` holds the bytes of the phrases one after the other. Phrases of a trigger are
    ordered by their left sides read backwards and by their right sides. Windows that
    start ``lead`` bytes before the trigger are equal if the left sides agree in so many
    bytes, and the right sides in the rest of the width.
    """
    counts, leads = own["counts"].astype(np.int64), own["leads"].astype(np.int64)
    sizes = counts + width - 1
    ends = np.cumsum(sizes)
    at = ends - sizes + leads
    most = width - TRIGGER
    right = _sorted_sides(_sides(data, at, sizes - leads, 1, width), sizes - leads, own["triggers"])
    left = _sorted_sides(_sides(data, at - 1, leads, -1, max(most, 1)), leads, own["triggers"])
    phrases, starts = [], []
    for lead in range(most + 1):
        members = np.flatnonzero((leads >= lead) & (leads - counts < lead))
        if len(members) < 2:
            continue
        classes = []
        for (order, common), need in ((left, lead), (right, width - lead)):
            found = np.empty(len(order), np.int64)
            found[order] = np.cumsum(common < need)
            classes.append(found[members])
        window = own["starts"][members] + leads[members] - lead
        names = np.stack(classes, axis=1)
        order, _, later = _first_of(names, own["docs"][members], window)
        phrases.append(members[order[later]])
        starts.append(window[order[later]])
    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(phrases), np.concatenate(starts)


def _runs(docs: np.ndarray, copies: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Marks of repeated windows, neighbours in one."""
    order = np.lexsort((starts, copies, docs))
    docs, copies, starts = docs[order], copies[order], starts[order]
    new = np.append(True, (np.diff(docs) != 0) | (np.diff(copies) != 0) | (np.diff(starts) > 1))
    heads = np.flatnonzero(new) if len(docs) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(docs)) - 1 if len(heads) else heads
    none = np.zeros(len(heads), np.int64)
    held = {
        "docs": docs[heads], "copies": copies[heads], "starts": starts[heads],
        "counts": starts[tails] - starts[heads] + 1, "leads": none, "triggers": none,
    }
    return _marks(held, np.arange(len(heads)), np.full(len(heads), REPEATED), 0)


def _compare(table: pa.Table, width: int) -> pa.Table:
    """Marks of repeated windows among the phrases, or the named windows, of a bucket."""
    held, named, blobs = _Held(), _Held(), []
    for row in table.to_pylist():
        if row["kind"] == NAMED:
            named.parcel(row)
        else:
            held.parcel(row)
            blobs.append(zstandard.decompress(row["data"]))
    out = []
    if held.size:
        own, data = held.columns(), np.frombuffer(b"".join(blobs), np.uint8)
        phrases, starts = repeated_windows(own, data, width)
        out.append(_runs(own["docs"][phrases], own["copies"][phrases], starts))
    if named.size:
        own = named.columns()
        order, _, later = _first_of(own["names"], own["docs"], own["starts"])
        at = order[later]
        out.append(_runs(own["docs"][at], own["copies"][at], own["starts"][at]))
    return pa.Table.from_batches(out, schema=_MARK_SCHEMA)


def _compared_parcels(rows: list[tuple], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Parcels of (doc_id, copy, text, marks): bytes of phrases, or names of windows."""
    hot, pieces, to = _Held(), [], []
    for doc_id, copy, data, marks in rows:
        for mark in marks:
            start, count = mark["start"], mark["count"]
            bucket, trigger = mark["trigger"] >> 32, mark["trigger"] & 0xFFFFFFFF
            if mark["action"] == COMPARED:
                pieces.append(data[start : start + count + width - 1])
                to.append((doc_id, copy, start, count, mark["lead"], trigger, bucket))
            else:
                begins = np.arange(start, start + count)
                found = _names(data, begins, begins + width)
                size, none = len(found), np.zeros(len(found), np.uint64)
                hot.add(
                    docs=np.full(size, doc_id), copies=np.full(size, copy), starts=begins,
                    counts=none, leads=none, triggers=none, names=found,
                )
    if to:
        columns = dict(zip((*_FIELDS, "bucket"), (np.array(c) for c in zip(*to))))
        for bucket, at in _deal(columns.pop("bucket")):
            yield _parcel(bucket, COMPARED, columns, at, _compressed(b"".join(pieces[i] for i in at)))
    if hot.size:
        columns = hot.columns()
        for bucket, at in _deal(_bucket_of(columns["names"][:, 0], buckets)):
            yield _parcel(bucket, NAMED, columns, at, None)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for start in range(0, batch.num_rows, 256):
        yield from batch.slice(start, 256).to_pylist()


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, packed): whole texts, compressed for the way to their marks."""

    def squeeze(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            packed = [_compressed(text.as_py() or b"") for text in texts]
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "packed"])

    return docs.mapInArrow(squeeze, "doc_id long, copy int, packed binary")


def repeated_marks(docs: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """(doc_id, copy, start, count): windows of (doc_id, copy, text) that start earlier in
    the corpus as well, as runs of window starts that may touch or overlap."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    known = docs.filter(F.col("doc_id").isNotNull())

    def phrases(batches):
        held, hashes = _Held(), []
        for batch in batches:
            ids, copies = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for start, end in text_slices(batch.column(2), BLOCK_BYTES // 2):
                data, offsets = text_bytes(batch.column(2).slice(start, end - start))
                raw = data.tobytes()
                for rows, first, last, triggers, found in parse(data, offsets, width):
                    rows_at = rows + start
                    held.add(
                        docs=ids[rows_at], copies=copies[rows_at], starts=first - offsets[rows],
                        counts=last - first + 1, leads=triggers - first,
                        triggers=found & np.uint64(0xFFFFFFFF),
                        names=_names(raw, first, last + width),
                    )
                    hashes.append(found)
                    if held.size >= GROUP_PHRASES:
                        yield from _decide(held, hashes, buckets)
                        held, hashes = _Held(), []
        if held.size:
            yield from _decide(held, hashes, buckets)

    def parcels(batches):
        rows, size = [], 0
        for batch in batches:
            for row in _rows(batch):
                rows.append((row["doc_id"], row["copy"], zstandard.decompress(row["packed"]), row["marks"]))
                size += sum(mark["count"] + width for mark in row["marks"])
                if size >= BLOCK_BYTES:
                    yield from _compared_parcels(rows, buckets, width)
                    rows, size = [], 0
        yield from _compared_parcels(rows, buckets, width)

    dealt = known.mapInArrow(phrases, PARCELS).groupBy("bucket")
    settled = materialize(dealt.applyInArrow(lambda t: _settle(t, hot), MARKS), "phrase-marks")
    fields = F.struct("start", "count", "lead", "trigger", "action")
    open_marks = settled.filter(F.col("action") != REPEATED).groupBy("doc_id", "copy")
    open_marks = open_marks.agg(F.collect_list(fields).alias("marks"))
    joined = _squeezed(known).join(open_marks, ["doc_id", "copy"])
    compared = joined.mapInArrow(parcels, PARCELS).groupBy("bucket").applyInArrow(
        lambda table: _compare(table, width), MARKS
    )
    names = ("doc_id", "copy", "start", "count")
    return settled.filter(F.col("action") == REPEATED).select(*names).unionByName(compared.select(*names))


def remove_repeated_bytes(
    docs: DataFrame, width: int = 100, with_text: bool = False, hot: int = HOT
) -> DataFrame:
    """Remove each byte covered by ``width`` bytes that also start earlier in the corpus.

    Texts are UTF-8 bytes; earlier is a smaller doc_id, or a smaller place in the same
    document. Matches never cross documents, may overlap, and are judged on the input.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, the
    hash of what is left, which ``with_text`` adds as kept, binary. A null text is empty; a
    text below the width loses nothing. Rows without an id lose nothing and take nothing
    from others. Rows of one id are one document: what starts at the same place of two of
    them is no repetition, and each loses what its own text repeats. An empty table
    gives no rows; other columns are ignored. ``width`` is 33 to 65,535.
    """
    if not TRIGGER < width < 1 << 16:
        raise ValueError(f"width must be between {TRIGGER + 1} and 65535")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shape += ", kept binary" if with_text else ""

    def cut(batches):
        for batch in batches:
            rows = []
            for row in _rows(batch):
                data = zstandard.decompress(row["packed"])
                kept, at, spans = [], 0, 0
                runs = sorted((run["start"], run["start"] + run["count"] - 1 + width) for run in row["runs"] or ())
                for start, end in runs:
                    if start > at or not spans:
                        kept.append(data[at:start])
                        spans += 1
                    at = max(at, end)
                kept.append(data[at:])
                left = b"".join(kept)
                found = (row["doc_id"], len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
                rows.append((*found, left) if with_text else found)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values) for values in zip(*rows)],
                    names=[part.split()[0] for part in shape.split(", ")],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("copy"), "text")
    runs = repeated_marks(chosen, width, hot).groupBy("doc_id", "copy")
    runs = runs.agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    joined = _squeezed(chosen).join(runs, ["doc_id", "copy"], "left")
    return joined.select("doc_id", "packed", "runs").mapInArrow(cut, shape)
