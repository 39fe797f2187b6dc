"""Words of whole texts as arrays.

Texts stay in the byte buffer of their Arrow column; words are found and hashed there,
many documents at a time. A word is a maximal run of bytes outside a set of separators,
and UTF-8 keeps bytes over 0x7F apart from ASCII, so byte runs are character runs.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of texts taken at once.
BLOCK_BYTES = 4 << 20
# Bytes hashed at once: temporary arrays take some sixty times as much.
HASH_BYTES = 1 << 18

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        z = values ^ (values >> np.uint64(30))
        z = z * np.uint64(0xBF58476D1CE4E5B9)
        z = z ^ (z >> np.uint64(27))
        z = z * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: byte bounds, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def text_slices(column: pa.Array, most_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``most_bytes`` each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    bounds = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        done = bounds[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(bounds, done + most_bytes, "right")))
        yield row, end
        row = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = before.copy()
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.append(inside[1:], False) if len(data) else inside
    cuts = offsets[1:] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, _word_hashes(data, starts, ends), first)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), np.uint64)
    if not len(starts):
        return hashes
    lengths = ends - starts
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE))
        word = 0
        while word < len(starts):
            stop = max(word + 1, int(np.searchsorted(ends, starts[word] + HASH_BYTES, "right")))
            size = lengths[word:stop]
            heads = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(heads, size)
            at = within + np.repeat(starts[word:stop], size)
            # Each byte is mixed with its place, so that no sum of signs cancels.
            mixed = mix(_BYTE[data[at]] ^ powers[within])
            hashes[word:stop] = np.add.reduceat(mixed, heads)
            word = stop
        return mix(hashes + lengths.astype(np.uint64))


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` words, from prefix sums of powers.

    The hash of a run does not depend on its place, so equal runs of different texts
    agree. Runs may cross texts; the caller keeps those that do not.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if width <= 8:
            total = np.zeros(count, np.uint64)
            for k in range(width):
                total = total * _STEP + hashes[k : k + count]
            return mix(total)
        powers = np.cumprod(np.full(len(hashes), _STEP))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers, out=sums[1:])
        backs = np.cumprod(np.full(count, _STEP_BACK))
        return mix((sums[width:] - sums[:count]) * backs)
