"""Two tokenizers side by side: which ids cover the same bytes, counted over the corpus.

A token of each side is linked to every token of the other that shares a byte with it.
Documents are encoded in chunks. A chunk's links become records of pair and document,
sorted by pair, and are spilled as one zstd run to shared storage. The pairs with their
sums, without the documents, are radix-partitioned by the id of side B and shuffled as
short runs, so a frequent id is one record a chunk there. A partition merges its runs with
a heap: equal pairs meet, and as the order is by B first, all pairs of a B id are counted
before the next begins. Its largest count is then known, and the counts stream back to
the runs they came from. Each chunk reads its spilled records again and adds them up by
document.

Neither tokenizer joins what stands before white space to what follows, so a text is cut
there and each different piece is aligned once.
"""

import hashlib
import heapq
import io
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.tokens import _BYTES, _PIECE, _UNEVEN, _VISIBLE, _Pieces, vocabulary
from braidgraph.llm.words import mix, text_slices
from braidgraph.plans.lineage import materialize

CHUNK_LINKS = 4_000_000
CHUNK_DOCUMENTS = 100_000
CACHED_PIECES = 250_000
# Bytes of text that are looked through for new pieces at once.
SLICE_BYTES = 2 << 20
# Pairs of a run that a merge unpacks at once.
BLOCK_PAIRS = 8_192
# Ids of both sides and a document's place in its chunk share 64 bits.
MOST_IDS = 1 << 16

_BROKEN: tuple = ()
_WHOLE: tuple = (None,)

_PACK = zstandard.ZstdCompressor(level=1)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return _PACK.compress(values.astype(kind).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


class Aligner:
    """Aligns texts by a vocabulary of each kind; made once per task.

    A piece starts with white space, and its alignment is (tokens of A, tokens of B, groups,
    links, text of the groups). Pieces not met before are encoded and aligned many at once.
    No entry of B's vocabulary holds white space after anything else, but for carriage
    returns; texts with these are aligned in one.
    """

    def __init__(self, vocabulary_a: str, vocabulary_b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary_a)
        tokenizer.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=vocabulary_b)
        if max(tokenizer.get_vocab_size(), self._b.get_piece_size()) > MOST_IDS:
            raise ValueError(f"vocabularies of more than {MOST_IDS} ids")
        # A's entries are written with a character for each byte.
        bytes_of = {chr(byte if byte in _VISIBLE else _BYTES[byte]): byte for byte in range(256)}
        self._bytes_a = [b""] * MOST_IDS
        for entry, token in tokenizer.get_vocab().items():
            known = all(c in bytes_of for c in entry)
            self._bytes_a[token] = bytes(bytes_of[c] for c in entry) if known else entry.encode()
        self._bytes_b = [
            bytes([int(self._b.id_to_piece(token)[3:5], 16)])
            if self._b.is_byte(token)
            else self._b.id_to_piece(token).replace("\u2581", " ").encode()
            for token in range(self._b.get_piece_size())
        ]
        self._sizes_a = np.array([len(data) for data in self._bytes_a])
        self._sizes_b = np.array([len(data) for data in self._bytes_b])
        self._names = [str(token) for token in range(MOST_IDS)]
        self._space = self._b.piece_to_id("\u2581")
        # Alignments by what stands after the lead, and ids of A by the same.
        self._known: dict[str, dict[str, tuple]] = {" ": {}, "\n": {}, "": {}}
        kind = np.dtype("<u2")
        self._ids_a = {lead: _Pieces(tokenizer, kind, lead if lead == " " else "") for lead in self._known}
        self._ids_a[" "].tails = self._ids_a[""]
        self._odd = False

    def _encoded_a(self, piece: str, lead: str) -> list[int]:
        if lead == "\n":
            ids = self._ids_a[""]["\n"] + self._ids_a[""][piece] if piece else self._ids_a[""]["\n"]
        elif lead == " " and not piece:
            ids = self._ids_a[""][" "]
        else:
            ids = self._ids_a[lead][piece]
        return array("H", ids).tolist()

    def _learn(self, pieces: list[str], lead: str) -> None:
        known = self._known[lead]
        if len(known) + len(pieces) > CACHED_PIECES:
            known.clear()
            for held in self._ids_a.values():
                held.clear()
        a = [self._encoded_a(piece, lead) for piece in pieces]
        whole = [lead + piece for piece in pieces]
        # B puts a space before a text: it is the piece's own, or a token that goes again.
        spaced = [piece[0] == " " for piece in whole]
        found = self._b.encode([p[1:] if own else p for p, own in zip(whole, spaced)], num_threads=1)
        b = []
        for own, piece, ids in zip(spaced, whole, found):
            if own:
                b.append(ids or [self._space])
            else:
                b.append(ids[1:] if ids[0] == self._space and "\r" not in piece else None)
        known.update(zip(pieces, self._aligned(whole, a, b)))

    def _aligned(self, texts: list[str], a: list, b: list) -> list[tuple]:
        """The alignment of each text; _BROKEN if a side differs, _WHOLE if B is None."""
        bytes_a, bytes_b = self._bytes_a.__getitem__, self._bytes_b.__getitem__
        result: list[tuple] = []
        good = []
        for at, (text, ids_a, ids_b) in enumerate(zip(texts, a, b)):
            data = text.encode()
            if ids_b is None:
                result.append(_WHOLE)
            elif b"".join(map(bytes_a, ids_a)) != data or b"".join(map(bytes_b, ids_b)) != data:
                result.append(_BROKEN)
            else:
                result.append((len(ids_a), len(ids_b)))
                good.append(at)
        self._odd |= len(good) < len(texts)
        if not good:
            return result
        all_a = [token for at in good for token in a[at]]
        all_b = [token for at in good for token in b[at]]
        ids_a, ids_b = np.array(all_a, np.uint32), np.array(all_b, np.uint32)
        ends_a, ends_b = np.cumsum(self._sizes_a[ids_a]), np.cumsum(self._sizes_b[ids_b])
        # Between two ends of either side lie one token of A and one of B: a link.
        ends = np.union1d(ends_a, ends_b)
        links = ids_b[np.searchsorted(ends_b, ends)] << np.uint32(16) | ids_a[np.searchsorted(ends_a, ends)]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        names_a = list(map(self._names.__getitem__, all_a))
        names_b = list(map(self._names.__getitem__, all_b))
        cuts_a = (np.searchsorted(ends_a, both) + 1).tolist()
        cuts_b = (np.searchsorted(ends_b, both) + 1).tolist()
        groups, first_a, first_b = [], 0, 0
        for cut_a, cut_b in zip(cuts_a, cuts_b):
            groups.append(f"{','.join(names_a[first_a:cut_a])}|{','.join(names_b[first_b:cut_b])}")
            first_a, first_b = cut_a, cut_b
        last = ends_a[np.cumsum([result[at][0] for at in good]) - 1]
        blob = links.astype("<u4").tobytes()
        first_link = first_group = 0
        after_link = ((np.searchsorted(ends, last) + 1) * 4).tolist()
        after_group = (np.searchsorted(both, last) + 1).tolist()
        for at, end_link, end_group in zip(good, after_link, after_group):
            text = ";".join(groups[first_group:end_group])
            result[at] += (end_group - first_group, blob[first_link:end_link], text)
            first_link, first_group = end_link, end_group
        return result

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """The alignment of each text with a space before it; None if it has no tokens."""
        plans: list[dict[str, list[str]] | None] = []
        for text in texts:
            if not text or "\r" in text:
                plans.append(None)
                continue
            ends = text[0] + text[-1]
            if " " in ends or "\n" in ends or any(mark in text for mark in _UNEVEN):
                plans.append({"": _PIECE.findall(" " + text)})
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                plans.append({" ": lines, "\n": [line[0] for line in lines[1:]]})
        for lead, known in self._known.items():
            wanted: set[str] = set()
            for plan in plans:
                wanted.update(*_lead_pieces(plan, lead))
            missing = wanted.difference(known)
            if len(known) + len(missing) > CACHED_PIECES:
                known.clear()
                for held in self._ids_a.values():
                    held.clear()
                missing = wanted
            if missing:
                self._learn(list(missing), lead)
        return [self._text(text, plan) if text else None for text, plan in zip(texts, plans)]

    def _text(self, text: str, plan: dict | None) -> tuple | None:
        if plan is None:
            return self._in_one(text)
        if "" in plan:
            found = list(map(self._known[""].__getitem__, plan[""]))
        else:
            spaced, lined = self._known[" "].__getitem__, self._known["\n"].__getitem__
            first, *rest = plan[" "]
            found = list(map(spaced, first))
            for line in rest:
                found.append(lined(line[0]))
                found += map(spaced, line[1:])
        if self._odd:
            if _BROKEN in found:
                return None
            if _WHOLE in found:
                return self._in_one(text)
        n_a, n_b, n_groups, links, groups = zip(*found)
        return sum(n_a), sum(n_b), sum(n_groups), b"".join(links), ";".join(groups)

    def _in_one(self, text: str) -> tuple | None:
        spaced = " " + text
        ids = b"".join(map(self._ids_a[""].__getitem__, _PIECE.findall(spaced)))
        found = self._aligned([spaced], [array("H", ids).tolist()], [self._b.encode(text)])[0]
        return found or None


def _lead_pieces(plan: dict | None, lead: str) -> list[list[str]]:
    """The pieces of a text that stand behind a lead, without it."""
    if plan is None or lead not in plan:
        return []
    if lead == " ":
        first, *rest = plan[lead]
        return [first, *(line[1:] for line in rest)]
    return [plan[lead]]


SPILLED = "chunk long, part int, pairs binary, sums binary, docs binary, records binary"
_SPILL_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int32())]
    + [(name, pa.binary()) for name in ("pairs", "sums", "docs", "records")]
)
_DOC_SCHEMA = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string())]
)


def _radix(pairs: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each pair, by its id of side B."""
    return (mix((pairs >> np.uint64(16)).astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _spill(chunk: int, docs: list[tuple], links: list[bytes], parts: int) -> Iterator[tuple]:
    """Rows of a chunk: its documents with their records, and a run for each partition."""
    sizes = [len(blob) // 4 for blob in links]
    pairs = np.frombuffer(b"".join(links), "<u4").astype(np.uint64)
    codes = pairs << np.uint64(32) | np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    times = np.diff(np.append(first, len(codes)))
    records = codes[first]
    of = records >> np.uint64(32)
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else first
    own = of[heads]
    blob = b"".join(
        len(data).to_bytes(8, "little") + data
        for data in (
            _packed(np.diff(own, prepend=np.uint64(0)), "<u4"),
            _packed(np.diff(np.append(heads, len(of))), "<u4"),
            _packed(records & np.uint64(0xFFFFFFFF), "<u4"),
            _packed(times, "<u4"),
        )
    )
    columns = [pa.array(values, field.type) for values, field in zip(zip(*docs), _DOC_SCHEMA)]
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _DOC_SCHEMA) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=_DOC_SCHEMA))
    yield chunk, -1, None, None, _PACK.compress(sink.getvalue()), blob
    if len(own):
        sums = np.add.reduceat(times, heads)
        part = _radix(own, parts)
        for to in np.unique(part).tolist():
            at = np.flatnonzero(part == to)
            yield chunk, to, _packed(own[at], "<u4"), _packed(sums[at], "<u8"), None, None


def _run(index: int, pairs: bytes, sums: bytes) -> Iterator[tuple[int, int, int]]:
    """(pair, run, sum) of a run, in order; numbers become objects a block at a time."""
    keys, times = _unpacked(pairs, "<u4"), _unpacked(sums, "<u8")
    for start in range(0, len(keys), BLOCK_PAIRS):
        some = keys[start : start + BLOCK_PAIRS].tolist()
        yield from zip(some, [index] * len(some), times[start : start + BLOCK_PAIRS].tolist())


def _merge(table: pa.Table) -> pa.Table:
    """Counts of each run's pairs over all runs of a partition, twice the count plus one
    if it is the largest of the pair's B id, in the order of the run."""
    runs = table.to_pylist()
    back = [array("Q") for _ in runs]
    merged = heapq.merge(*(_run(i, row["pairs"], row["sums"]) for i, row in enumerate(runs)))
    for _, of_b in groupby(merged, lambda record: record[0] >> 16):
        held = []
        for _, same in groupby(of_b, itemgetter(0)):
            places = list(same)
            held.append((sum(record[2] for record in places), places))
        most = max(held, key=itemgetter(0))[0]
        for count, places in held:
            value = 2 * count + (count == most)
            for _, run, _ in places:
                back[run].append(value)
    counts = [_packed(np.frombuffer(values, "<u8"), "<u8") for values in back]
    columns = [table.column("chunk").combine_chunks(), table.column("part").combine_chunks()]
    return pa.table([*columns, pa.array(counts, pa.binary())], names=["chunk", "part", "counts"])


def _summed(docs: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of large whole numbers by document: 26 bits at a time, as floats hold 53."""
    low = np.bincount(docs, values & (1 << 26) - 1, size).astype(np.int64)
    return low + (np.bincount(docs, values >> 26, size).astype(np.int64) << 26)


def _add_up(row: dict, counts: dict[int, bytes], parts: int) -> pa.Table:
    """The documents of a chunk, from its records and the counts of its pairs."""
    docs = pa.ipc.open_stream(zstandard.decompress(row["docs"])).read_all()
    blob, fields, at = row["records"], [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        fields.append(_unpacked(blob[at + 8 : at + 8 + size], "<u4"))
        at += 8 + size
    own, lengths, places, times = fields
    own = np.cumsum(own, dtype=np.uint64)
    values = np.zeros(len(own), np.int64)
    part = _radix(own, parts)
    for to, found in counts.items():
        values[part == to] = _unpacked(found, "<u8").astype(np.int64)
    values = np.repeat(values, lengths)
    times = times.astype(np.int64)
    best = _summed(places, times * (values & 1), len(docs))
    sums = _summed(places, times * (values >> 1), len(docs))
    docs = docs.append_column("n_best", pa.array(best, pa.int64()))
    return docs.append_column("count_sum", pa.array(sums, pa.int64()))


def align_tokenizers(
    docs: DataFrame, vocabulary_a: str | None = None, model_b: str | None = None
) -> DataFrame:
    """How two tokenizers cut each document, with what their links count in the corpus.

    A is a byte-level vocabulary of the tokenizers library, given a space and the text;
    B is a sentencepiece model, which puts the space itself. Strings of special tokens are
    plain text. Byte places where tokens of both end cut them into groups. Tokens that
    share a byte are linked, and the count of two ids is the number of links between
    them in all documents. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their B id, ties included), count_sum and groups_sha256. A
    text that is null or empty, or that either side doesn't give back byte by byte, has
    no tokens: zeros and an empty string. Rows are kept apart, also those without an id
    or with the same one. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if model_b is None:
        import public_tokenizers

        model_b = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_b, "rb") as file:
        shipped = spark.sparkContext.broadcast((vocabulary(vocabulary_a), file.read()))

    def spill(batches):
        aligner = Aligner(*shipped.value)
        base = TaskContext.get().partitionId() << 32
        chunks = 0
        rows: list[tuple] = []
        links: list[bytes] = []
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            for row in _spill(base + chunks, rows, links, parts):
                columns = [pa.array([v], f.type) for v, f in zip(row, _SPILL_SCHEMA)]
                yield pa.RecordBatch.from_arrays(columns, schema=_SPILL_SCHEMA)

        for batch in batches:
            for start, end in text_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, end - start)
                aligned = aligner.texts(part.column(1).to_pylist())
                for doc_id, found in zip(part.column(0).to_pylist(), aligned):
                    if found is None:
                        rows.append((doc_id, 0, 0, 0, 0, ""))
                        links.append(b"")
                    else:
                        n_a, n_b, n_groups, own, groups = found
                        digest = hashlib.sha256(groups.encode()).hexdigest()
                        rows.append((doc_id, n_a, n_b, n_groups, len(own) // 4, digest))
                        links.append(own)
                        held += len(own) // 4
                    if held >= CHUNK_LINKS or len(rows) >= CHUNK_DOCUMENTS:
                        yield from closed()
                        rows, links, held, chunks = [], [], 0, chunks + 1
        if rows:
            yield from closed()

    def contribute(chunk: pa.Table, back: pa.Table) -> pa.Table:
        counts = {row["part"]: row["counts"] for row in back.to_pylist()}
        return pa.concat_tables([_add_up(row, counts, parts) for row in chunk.to_pylist()])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spilled = materialize(chosen.mapInArrow(spill, SPILLED), "pair-runs")
    runs = spilled.filter("part >= 0").select("chunk", "part", "pairs", "sums")
    back = runs.groupBy("part").applyInArrow(_merge, "chunk long, part int, counts binary")
    chunks = spilled.filter("part < 0").select("chunk", "docs", "records")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(contribute, shape)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
