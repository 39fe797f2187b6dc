"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

The library spends most of its time on words it has met before. Its splitting pattern
never joins what stands before a run of white space to what follows, so a text is cut
there, each different piece is encoded once by the library, and the ids are looked up
for the others. The result is that of encoding the whole text.
"""

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from braidgraph.llm.words import text_slices

# The code points that Unicode calls white space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_UNEVEN = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000")
_UNEVEN += tuple(map(chr, range(0x2000, 0x200B)))
# Letters are a unit of the splitting pattern if no letter follows.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_MARKS = "".join(mark for mark in map(chr, range(33, 127)) if not mark.isalnum())
# The vocabulary writes bytes as characters: visible ones as themselves, the others in
# turn from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [byte for byte in range(256) if byte not in _VISIBLE]
_BYTES = {byte: 256 + turn for turn, byte in enumerate(_HIDDEN)}

CACHED_PIECES = 1_000_000
# Longer pieces are seldom met again and are not kept.
CACHED_CHARACTERS = 64


def vocabulary(path: str | None = None) -> str:
    """The text of a vocabulary file, small enough to travel with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def id_width(vocabulary_text: str) -> int:
    """Bytes that hold every id of a vocabulary."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(vocabulary_text).get_vocab_size() <= 1 << 16 else 4


class _Pieces(dict):
    """Ids of pieces, each encoded when first met; ``lead`` stands before every piece."""

    def __init__(self, tokenizer, kind: np.dtype, lead: str) -> None:
        super().__init__()
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._code, self._lead = {2: "H", 4: "I"}[kind.itemsize], lead
        # None: its own. A reference to itself would keep the pieces beyond their last use.
        self.tails: dict[str, bytes] | None = None

    def __missing__(self, piece: str) -> bytes:
        head = piece.rstrip(_MARKS)
        if not _LETTERS.fullmatch(head):
            found = self._encode(self._lead + piece, add_special_tokens=False).ids
            ids = array(self._code, found).tobytes()
        elif head != piece:
            tails = self if self.tails is None else self.tails
            ids = self[head] + tails[piece[len(head) :]]
        else:
            written = (self._lead + piece).encode().decode("latin-1").translate(_BYTES)
            ids = array(self._code, [token.id for token in self._merge(written)]).tobytes()
        if len(piece) <= CACHED_CHARACTERS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian ids of ``width`` bytes; made once per task.

    Strings of special tokens inside a text are their ids, as the library has it. They hold
    no white space, so none is cut, and no piece with one is letters followed by marks.
    """

    def __init__(self, vocabulary_text: str, width: int = 2) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary_text)
        kind = np.dtype(f"<u{width}")
        self._plain = _Pieces(tokenizer, kind, "")
        self._spaced = _Pieces(tokenizer, kind, " ")
        self._spaced.tails = self._plain

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; null is an empty text."""
        return [self._ids(text) if text else b"" for text in texts]

    def _ids(self, text: str) -> bytes:
        plain, spaced = self._plain, self._spaced
        ends = text[0] + text[-1]
        if " " in ends or "\n" in ends or any(mark in text for mark in _UNEVEN):
            return b"".join(map(plain.__getitem__, _PIECE.findall(text)))
        result: list[bytes] = []
        for line in text.split("\n"):
            if result:
                result.append(plain["\n"])
            first, *rest = line.split(" ")
            result.append(plain[first])
            result += map(spaced.__getitem__, rest)
        return b"".join(result)


_ENCODERS: dict[tuple[int, int], tuple[str, Encoder]] = {}


def shared_encoder(vocabulary_text: str, width: int = 2) -> Encoder:
    """The encoder of this Python worker, which keeps its pieces for the worker's next tasks.

    Only that of the last vocabulary is kept, so the pieces stay within ``CACHED_PIECES``.
    """
    key = (hash(vocabulary_text), width)
    if key not in _ENCODERS or _ENCODERS[key][0] != vocabulary_text:
        _ENCODERS.clear()
        _ENCODERS[key] = vocabulary_text, Encoder(vocabulary_text, width)
    return _ENCODERS[key][1]


def encoded_rows(
    batches: Iterable[pa.RecordBatch], encoder: Encoder, text: str = "text", key: str = "doc_id"
) -> Iterator[tuple[int | None, bytes]]:
    """Key and ids of each row of Arrow batches, in order."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        keys = batch.column(batch.schema.get_field_index(key))
        for start, end in text_slices(texts):
            part = texts.slice(start, end - start).to_pylist()
            yield from zip(keys.slice(start, end - start).to_pylist(), encoder.encode(part))


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
