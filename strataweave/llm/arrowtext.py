"""Vectorised text primitives for Arrow batches inside Spark tasks.

Everything here works on the UTF-8 buffer of one Arrow string column, a bounded
slice of rows at a time, so memory follows the slice and not the table.
A "word" is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are folded to a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text still forms a slice of its own.
SLICE_BYTES = 1 << 20
_POSITIONS = 1 << 12
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection that spreads every bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers for ``seed``."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(n, dtype=np.uint64) + _U(seed) * _U(0x632BE59BD9B4E019))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One odd 64-bit value per folded byte, zero for white space.
_BYTE = (constants(11, 256) | _U(1))[_LOWER]
_BYTE[_SPACE] = 0
_PLACE = constants(12, _POSITIONS) | _U(1)
_PLACE_HIGH = constants(13, _POSITIONS) | _U(1)
_PLACE_HIGH[0] = 1  # a run hashes alike whether or not its slice holds a run beyond _POSITIONS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts take about ``limit`` bytes together, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end); runs are sorted and disjoint."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    value = table[raw[place + np.repeat(starts, lengths)]]
    if int(lengths.max()) <= _POSITIONS:
        value *= _PLACE[place]
    else:
        value *= _PLACE[place % _POSITIONS]
        value *= _PLACE_HIGH[(place // _POSITIONS) % _POSITIONS] + _U(2) * (place // _POSITIONS).astype(np.uint64)
    out = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(value, first[full])
    return mix64(out + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's first word (n+1 marks)."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return run_hashes(raw, starts, ends, _BYTE), np.searchsorted(starts, offsets)


_STEP = constants(21, 64) | _U(1)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text, or of the whole sequence if it is shorter."""
    k = min(n, len(hashes))
    if k == 0:
        return hashes
    out = hashes[: len(hashes) - k + 1] * _STEP[0]
    for i in range(1, k):
        out = out + hashes[i : len(hashes) - k + 1 + i] * _STEP[i]
    return mix64(out + _U(k))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)
