"""Vectorised text helpers shared by the operators of this subpackage.

Every helper works on one Arrow batch of strings: the UTF-8 bytes of all rows
lie in one numpy buffer, so words, word hashes and n-gram hashes of thousands
of texts cost a handful of array operations and no per-word Python object.
Nulls count as empty texts. A word is a run of bytes outside space and
0x09-0x0D; a word never crosses a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: bytes of text that one set of numpy temporaries covers (a longer single text is taken whole)
SLICE_BYTES = 1 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def pieces(batches, name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of at most ``limit`` bytes of text (one row at least), so
    that what a task makes of them at once stays small however many rows a batch has."""
    for batch in batches:
        for a, b in slices(buffers(batch.column(batch.schema.get_field_index(name)))[1], limit):
            yield batch.slice(a, b - a)


def text_slices(batch: pa.RecordBatch, name: str = "text", fold: bool = False):
    """(first row, end row, bytes, offsets) of every slice of a batch's text column; with
    ``fold`` in lower case, letters of all scripts."""
    column = batch.column(batch.schema.get_field_index(name))
    data, offsets = buffers(pc.utf8_lower(column) if fold else column)
    for a, b in slices(offsets):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``separator`` tells of each byte whether words end at it."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    sep = separator[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = sep[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~sep & edge[:-1])
    edge[:-1] = sep
    edge[offsets] = True
    edge[-1] = True
    ends = np.flatnonzero(~sep & edge[1:]) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span (eight bytes a round)."""
    h = np.full(len(starts), _GOLD, np.uint64)
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    at8 = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
    length = ends - starts
    todo, pos = np.arange(len(starts)), starts
    left = length
    for _ in range(_LONG_WORD // 8):
        chunk = np.ascontiguousarray(at8[pos]).view("<u8")[:, 0]
        short = left < 8
        if short.any():
            keep = np.uint64(64) - (left[short] * 8).astype(np.uint64)
            chunk[short] = np.where(left[short] > 0, (chunk[short] << keep) >> keep, np.uint64(0))
        h[todo] = mix(h[todo] ^ (chunk * _GOLD))
        more = left > 8
        if not more.any():
            break
        todo, pos, left = todo[more], pos[more] + 8, left[more] - 8
    else:
        raw = data.tobytes()
        for t, p, n in zip(todo, pos, left):
            h[t] = np.uint64(xxhash.xxh64_intdigest(raw[p:p + n], int(h[t])))
    return mix(h + length.astype(np.uint64))


def ngram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside a row: (hash, index of the first word)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1:k - 1 + n])
    g = h[at]
    for j in range(1, k):
        g = mix(g * _GOLD + h[at + j])
    return g, at


def code_points_before(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
