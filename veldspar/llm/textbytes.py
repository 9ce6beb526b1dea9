"""Vectorised words and shingles on Arrow string buffers: no Python object is made per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered. Spans of bytes are named by sums of mixed
eight-byte chunks, each mixed with its place, so that no two structured texts share a name by the algebra of the sum; one
lane gives 64 bits, and a second one, mixed otherwise, 128 bits where equality must be trusted over a whole corpus. All
cutting points are ASCII, so UTF-8 sequences are never split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone, in blocks of its words.
STEP_BYTES = 1 << 19
#: Words named at once.
BLOCK = 1 << 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_other(x: np.ndarray) -> np.ndarray:
    """Another such bijection (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: (mixer, offset of chunks, step of places, step of lengths) of the two lanes.
_LANES = ((mix, 0x243F6A8885A308D3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (mix_other, 0x13198A2E03707344, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _named(loads: np.ndarray, start: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
    mixer, offset, place, length = _LANES[lane]
    offset, place, length = np.uint64(offset), np.uint64(place), np.uint64(length)
    total = mixer((loads[start] & _LOW_BYTES[np.minimum(size, 8)]) + offset)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # chunks beside the first one
        first = np.cumsum(more) - more
        j = np.arange(1, int(more.sum()) + 1) - np.repeat(first, more)
        left = np.repeat(size[long], more) - 8 * j
        chunk = loads[np.repeat(start[long], more) + 8 * j] & _LOW_BYTES[np.minimum(left, 8)]
        total[long] += np.add.reduceat(mixer(chunk + mixer(j.astype(np.uint64) * place + offset)), first)
    return mixer(total + size.astype(np.uint64) * length)


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """64-bit names of spans of bytes, one array for each lane."""
    padded = np.empty(len(data) + 8, dtype=np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    loads = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size, out = end - start, [np.empty(len(start), dtype=np.uint64) for _ in range(lanes)]
    blocks = np.unique(np.concatenate((np.arange(0, len(start), BLOCK), np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), 16 * BLOCK)), [len(start)])))
    for a, b in zip(blocks[:-1].tolist(), blocks[1:].tolist()):
        for lane in range(lanes):
            out[lane][a:b] = _named(loads, start[a:b], size[a:b], lane)
    return out


def distinct(name: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a place, number) of the distinct names, or of the distinct pairs of two lanes, in order of names."""
    order = np.argsort(name)
    sorted_ = name[order]
    lead = np.ones(len(name), dtype=bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=lead[1:])
    number = np.empty(len(name), dtype=np.int64)
    number[order] = np.cumsum(lead) - 1
    first = order[lead]
    if other is not None and (other[first][number] != other).any():
        _, first, number = np.unique(np.rec.fromarrays([name, other]), return_index=True, return_inverse=True)
    return first, number


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its rows; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most ``most`` bytes of text (one row at least), with their bytes and offsets."""
    data, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Words of some rows in order: byte spans, 64-bit names and the second lane (if asked for), and for row r the words
    first[r] to first[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    first: np.ndarray
    other: np.ndarray | None = None


def words(data: np.ndarray, offsets: np.ndarray, lanes: int = 1) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(IS_SPACE[data], out=inside[1:-1])
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    found = names(LOWER[data], start, end, lanes)
    return Words(start, end, found[0], np.searchsorted(start, offsets), found[1] if lanes > 1 else None)


def chain(names: np.ndarray, k: int) -> np.ndarray:
    """A name for each run of k successive words; k >= 1."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + names[i : i + n] + np.uint64(i + 1))
    return out


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct names of its k-word shingles; with fewer words, the whole sequence as one."""
    runs = chain(w.name, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield chain(w.name[a:b], b - a) ^ np.uint64(0x5851F42D4C957F2D + b - a)
        else:
            yield np.zeros(0, np.uint64)
