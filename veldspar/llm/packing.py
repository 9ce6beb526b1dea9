"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is its token ids and an end id. It is cut into full sequences, then halves of the capacity down to
``least_cut``, and a rest shorter than that, so that every length but the rest's is a reciprocal of the capacity. Class j
holds lengths in (capacity / (j + 1), capacity / j], and each of its bins takes exactly j pieces: full to the last id
for the cut lengths, nearly full for the short rests. Workers fill their own bins without asking each other, with
bounded memory: a class keeps fewer than j pieces open. What is open when a worker's rows end is cut to fill whole
sequences, and the last of these into sequences of powers of two, which need no padding.

Sequence ids carry the partition's number, so they are unique without a shuffle.

Tokens: pieces of the byte-level pattern are found on arrays of code points and named by 128-bit hashes; only names that
a worker has not met lately are encoded by the vocabulary, so frequent words cost a table lookup. A long text is cut
for this before blanks between letters, where a piece always begins.

Defined results: null and empty texts are documents of the end id alone; repeated rows are packed as often as they
occur; a null doc_id is packed under null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import importlib.util
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow, table

CAPACITY, LEAST_CUT, END_ID = 2048, 64, 1
#: Pattern pieces that a worker keeps with their ids; all are dropped when as many have come in. One takes about 150 bytes.
CACHE = 150_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_LETTER, _NUMBER, _SPACE, _OTHER, _TOP = 1, 2, 3, 0, 0x33480
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def vocabulary_path(name: str) -> str:
    """A file of the installed public vocabularies."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


def installed(path: str) -> str:
    """The path, or the file of its name among the vocabularies that are installed here, on a worker."""
    return path if Path(path).exists() else vocabulary_path(Path(path).name)


class Tokenizer:
    """Ids of byte-level BPE for many texts at once, equal to those of the library ``tokenizers``."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kinds = {"L": _LETTER, "N": _NUMBER}
        self._kind = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(_TOP + 1)), dtype=np.uint8, count=_TOP + 1)
        self._kind[_SPACES] = _SPACE
        self._kind[_TOP] = _OTHER
        self.clear()

    def clear(self) -> None:
        #: of the pieces met: number by first name; second names, and where their ids lie
        self._seen: dict[int, int] = {}
        self._other, self._begin, self._size, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def pieces(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the pattern's pieces in the code points of some texts, whose own starts are ``first``."""
        n = len(points)
        kind = self._kind[np.minimum(points, _TOP)]
        row = np.zeros(n + 1, dtype=bool)
        row[first] = True
        row[n] = True
        before = np.empty(n, dtype=np.uint8)
        before[0] = 255
        before[1:] = kind[:-1]
        start = (kind != before) | row[:-1]
        space = kind == _SPACE
        # the last of a run of spaces before more text parts from the run, and leads the next piece if it is a blank
        lead = np.zeros(n, dtype=bool)
        lead[:-1] = space[:-1] & ~space[1:]
        lead &= ~row[1:]
        start |= lead
        blank = np.flatnonzero(lead & (points == 32))
        start[blank + 1] = False
        # 's 't 'm 'd 're 've 'll where a piece starts with the apostrophe
        at = np.flatnonzero(start & (points == 39))
        if len(at):
            ends = np.append(first, n)
            room = ends[np.searchsorted(ends, at, side="right")] - at
            c1 = np.where(room > 1, points[np.minimum(at + 1, n - 1)], 0)
            c2 = np.where(room > 2, points[np.minimum(at + 2, n - 1)], 0)
            two = np.isin(c1, [115, 116, 109, 100])
            three = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
            start[at[two | three] + 1] = False
            for which, width in ((two, 2), (three, 3)):
                after = at[which] + width
                after = after[after < n]
                start[after] |= kind[after] == _LETTER
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray, most: int = 2 * tb.STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the offsets of each text's ids."""
        ids, cut, n = [], [], 0
        blocks = blocks_of(data, offsets, most)
        for a, b in zip(blocks[:-1], blocks[1:]):
            inside = offsets[(offsets >= a) & (offsets < b)]
            some, at = self._block(data[a:b], inside - a)
            ids.append(some)
            cut.append(n + at)
            n += len(some)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        last = np.full((offsets == len(data)).sum(), n)
        return np.concatenate(ids), np.concatenate([*cut, last])

    def _block(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some bytes, and how many come before each of the texts that begin at ``first``."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        if len(points) == len(data):
            starts = self.pieces(points, np.unique(np.append(0, first)))
        else:
            leads = (data & 0xC0) != 0x80
            chars = np.concatenate(([0], np.cumsum(leads)))
            starts = np.flatnonzero(leads)[self.pieces(points, np.unique(np.append(0, chars[first])))]
        ends = np.append(starts[1:], len(data))
        name, other = tb.names(data, starts, ends, 2)
        where, back = tb.distinct(name, other)
        if len(self._seen) > CACHE:
            self.clear()
        piece = np.array([self._seen.get(x, -1) for x in name[where].tolist()], dtype=np.int64)
        met = np.flatnonzero(piece >= 0)
        piece[met[self._other[piece[met]] != other[where[met]]]] = -1
        if len(new := np.flatnonzero(piece < 0)):
            raw = data.tobytes()
            found = [self._encode(raw[a:b].decode()) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            piece[new] = len(self._other) + np.arange(len(new))
            for x, i in zip(name[where[new]].tolist(), piece[new].tolist()):
                self._seen.setdefault(x, i)
            self._other = np.append(self._other, other[where[new]])
            self._begin = np.append(self._begin, len(self._ids) + np.cumsum(size) - size)
            self._size = np.append(self._size, size)
            self._ids = np.append(self._ids, np.fromiter((x for ids in found for x in ids), dtype=np.uint32, count=int(size.sum())))
        sizes = self._size[piece][back]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self._ids[np.repeat(self._begin[piece][back] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, first)]


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def blocks_of(data: np.ndarray, offsets: np.ndarray, most: int) -> list[int]:
    """Where to cut bytes of texts into blocks of about ``most``, at a text's begin or before a blank between letters."""
    out = [0] if len(data) else []
    while out and out[-1] < len(data):
        at = out[-1] + most
        while at < len(data):
            some = data[at - 1 : at + most + 1]
            safe = np.flatnonzero((some[1:-1] == 32) & _ASCII_LETTER[some[:-2]] & _ASCII_LETTER[some[2:]])
            begun = int(offsets[min(np.searchsorted(offsets, at), len(offsets) - 1)])
            found = min(at + int(safe[0]) if len(safe) else len(data), begun if begun >= at else len(data))
            if found < at + most:
                break
            at += most
        out.append(found if at < len(data) else len(data))
    return out


def cuts(n: int, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least_cut:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """A worker's open bins. A piece is (doc_id, start, ids, doc_tokens); closed sequences come back as rows."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, defaultdict(list)

    def _row(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids), n, self.next, offset, ids.tobytes()
            offset += len(ids)
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        each = self.capacity // len(piece[2])
        held = self.open[each]
        held.append(piece)
        if len(held) == each:
            yield from self._row(held)
            held.clear()

    def close(self) -> Iterator[tuple]:
        """Cut all that is open into whole sequences, and the last of them into powers of two."""
        rest = [p for each in sorted(self.open) for p in self.open[each]]
        self.open.clear()
        left = sum(len(p[2]) for p in rest)
        while rest:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc_id, start, ids, n = rest[0]
                if len(ids) <= room:
                    taken.append(rest.pop(0))
                    room -= len(ids)
                else:
                    taken.append((doc_id, start, ids[:room], n))
                    rest[0] = (doc_id, start + room, ids[room:], n)
                    room = 0
            yield from self._row(taken)


_tokenizers: dict[str, Tokenizer] = {}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, least_cut: int = LEAST_CUT, end_id: int = END_ID) -> DataFrame:
    """One row per piece of the rows of ``docs`` (doc_id, text): its place in a sequence and its ids (little-endian
    unsigned 32-bit). ``path`` names a vocabulary of ranks, read on the workers."""

    def made(batches):
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(installed(path))
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text"):
                ids, at = _tokenizers[path].encode(data, offsets)
                out = []
                for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    start = 0
                    for size in cuts(len(own), capacity, least_cut):
                        out.extend(bins.add((doc_id, start, own[start : start + size], len(own))))
                        start += size
                if out:
                    yield table_of(out)
        _tokenizers[path].clear()
        if rest := list(bins.close()):
            yield table_of(rest)

    return arrow(docs.select("doc_id", "text"), made, PIECES)


def packed_digests(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary_path("byte_bpe_50k.tiktoken")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
