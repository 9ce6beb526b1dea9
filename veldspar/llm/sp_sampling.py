"""SentencePiece encoding with sampled segmentations, and decoding.

A text's lattice has a node before each character and an edge for each vocabulary piece; characters without a piece are
spelled in byte pieces. Pieces have Zipf probabilities of their rank in the vocabulary, raised to ``ALPHA``.

Segmentations are drawn without replacement by Gumbel top-k: give every path a Gumbel variable located at its log
probability and take the k highest. The search is A-star on perturbed bounds, top down: a set of paths has one
exactly known bound, the maximum of its variables, a Gumbel variable located at the set's total log probability, which the
backward pass over the lattice gives for all continuations of a node at once. The best path of the best set is sampled
forward from its edges' probabilities; the rest of the set splits by the first edge that differs into disjoint sets,
whose maxima are Gumbel variables truncated at the set's own. So each sample costs one pass over its text, and the
search never expands a path that isn't returned.

Every draw is a hash of the row's key, the sample and the place, so results depend on no worker, batch or order. The
inclusion score of a sample is its probability to be among the first k given the (k + 1)-th value; probability divided by
inclusion score weighs samples without bias.

Words are cut before a space mark that follows another character, as no piece spans this (checked when the vocabulary
is read). Defined results: null and empty texts have one segmentation, without pieces; fewer paths than k give fewer samples;
a literal space mark is spelled in bytes, so every text decodes to itself; repeated rows have equal samples; a null
doc_id counts as key 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb
from .common import arrow, table
from .packing import installed, vocabulary_path

SAMPLES, ALPHA, RANK_OFFSET = 3, 1.0, 10.0
MARK = 0x2581
#: Stands for a space mark of the text itself; no character, so never a piece.
LITERAL = 0x110000
TABLE_BITS = 21
#: Nodes of words that a worker keeps from text to text; one takes about 120 bytes.
CACHE_NODES = 1 << 19

OUT = "doc_id long, sample int, ids binary, log_prob double, inclusion double"


def keyed(*keys) -> np.ndarray:
    """A 64-bit value that depends on all keys; arrays must be of one length."""
    x = np.full(1, 0x6A09E667F3BCC909, dtype=np.uint64)
    for k in sorted(keys, key=np.ndim):  # single values are mixed first, and once
        x = tb.mix((x ^ np.atleast_1d(k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x3C6EF372FE94F82B))
    return x


def placed(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of some rows' places, whose rows' keys are mixed already."""
    return tb.mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit values as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(*keys) -> np.ndarray:
    """Numbers in (0, 1) that depend on all keys."""
    return unit(keyed(*keys))


def below(bound: float, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location`` (-inf for none), truncated at ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - location))


class Edges:
    """Edges by node, those of node i from first[i] to first[i + 1]; an id of -1 is a character in bytes."""

    def __init__(self, first: np.ndarray, node: np.ndarray, size: np.ndarray, ids: np.ndarray, log_p: np.ndarray):
        self.first, self.node, self.size, self.id, self.log_p = first, node, size, ids, log_p


class Vocabulary:
    """Pieces of a SentencePiece model file, with probabilities; found by hashes of code points, then compared."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, text, self.byte_id, ids = [b""] * sp.get_piece_size(), [], np.zeros(256, dtype=np.int32), []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text.append(piece)
                ids.append(i)
                raw[i] = piece.replace(chr(MARK), " ").encode()
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in text):
            raise ValueError("a piece spans a word's start")
        #: each piece's bytes, eight in a number
        self.length = np.array([len(x) for x in raw])
        widest = -(-int(self.length.max()) // 8) * 8
        self.eights = np.frombuffer(b"".join(x.ljust(widest, b"\0") for x in raw), dtype="<u8").reshape(len(raw), -1)
        self.longest = max(map(len, text))
        rank = np.arange(sp.get_piece_size(), dtype=float)
        log_p = -np.log(rank + RANK_OFFSET)
        log_p = ALPHA * (log_p - np.logaddexp.reduce(log_p))
        self.byte_log_p = float(log_p[self.byte_id.max()] + log_p.min()) / 2
        size = np.array([len(p) for p in text])
        points = np.zeros((len(text), self.longest), dtype=np.int32)
        points[np.arange(self.longest) < size[:, None]] = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.int32)
        #: by the first bits of names: whether they may be of a piece, and of what a longer piece begins with
        name, self.whole, self.begins = np.zeros(len(text), dtype=np.uint64), np.zeros(1 << TABLE_BITS, dtype=bool), np.zeros(1 << TABLE_BITS, dtype=bool)
        for i in range(self.longest):
            some = np.flatnonzero(size > i)
            name[some] = self._further(name[some], points[some, i])
            slot = (name[some] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.whole[slot[size[some] == i + 1]] = True
            self.begins[slot[size[some] > i + 1]] = True
        if len(np.unique(name)) < len(name):
            raise ValueError("two pieces share a name")
        order = np.argsort(name)
        self.name, self.id = name[order], np.array(ids, dtype=np.int32)[order]
        #: the pieces' code points, three in a number
        self.threes = np.stack([packed(np.pad(points, ((0, 0), (0, 2))), i)[order] for i in range(0, self.longest, 3)], axis=1)
        self.log_p = log_p[self.id]
        # single code points: their names, their pieces (-1 for none), and whether longer pieces begin with them
        self.one_name = self._further(np.zeros(LITERAL + 1, dtype=np.uint64), np.arange(LITERAL + 1))
        self.one_piece, self.one_begins = np.full(LITERAL + 1, -1, dtype=np.int32), np.zeros(LITERAL + 1, dtype=bool)
        single = np.flatnonzero(size[order] == 1)
        self.one_piece[points[order][single, 0]] = single
        self.one_begins[points[size > 1, 0]] = True
        # the first piece of each run of names that begin alike, and the longest run
        slot, first, count = np.unique(self.name >> np.uint64(64 - TABLE_BITS), return_index=True, return_counts=True)
        self.slot, self.run = np.zeros(1 << TABLE_BITS, dtype=np.int32), int(count.max())
        self.slot[slot.astype(np.int64)] = first

    @staticmethod
    def _further(name: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The name of what has one more code point."""
        return tb.mix((name ^ point.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x3C6EF372FE94F82B))

    def lattice(self, points: np.ndarray, end: np.ndarray) -> "Edges":
        """All edges of words laid end to end; ``end`` is each node's word's end."""
        n = len(points)
        threes = packed(np.append(points, [0, 0]))
        where = self.one_piece[points]
        node, bare = np.flatnonzero(where >= 0), np.flatnonzero(where < 0)
        found = [(bare, 1, np.full(len(bare), -1, dtype=np.int32), self.byte_log_p * utf8_size(points[bare])), (node, 1, self.id[where[node]], self.log_p[where[node]])]
        count = np.ones(n, dtype=np.int64)
        at = np.flatnonzero(self.one_begins[points])
        name = self.one_name[points[at]]
        for size in range(2, self.longest + 1):
            inside = np.flatnonzero(at + size <= end[at])
            at = at[inside]
            if not len(at):
                break
            name = self._further(name[inside], points[at + size - 1])
            slot = (name >> np.uint64(64 - TABLE_BITS)).view(np.int64)
            may = np.flatnonzero(self.whole[slot])
            where, names = self.slot[slot[may]], name[may]
            for _ in range(1, self.run):
                where = np.minimum(where + (self.name[where] < names), len(self.name) - 1)
            hit = np.flatnonzero(self.name[where] == names)
            node, where = at[may[hit]], where[hit]
            for i in range(0, size, 3):
                same = np.flatnonzero(self.threes[where, i // 3] == threes[node + i] & _LOW_THREE[min(3, size - i)])
                node, where = node[same], where[same]
            found.append((node, size, self.id[where], self.log_p[where]))
            count[node] += 1
            # only what a longer piece begins with goes on
            more = np.flatnonzero(self.begins[slot])
            at, name = at[more], name[more]
        first = np.concatenate(([0], np.cumsum(count)))
        e = Edges(first, np.repeat(np.arange(n), count), np.empty(first[-1], np.int64), np.empty(first[-1], np.int32), np.empty(first[-1]))
        place = first[:-1].copy()
        for node, size, ids, log_p in found:
            to = place[node]
            e.size[to], e.id[to], e.log_p[to] = size, ids, log_p
            place[node] += 1
        return e

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of some segmentations."""
        size = self.length[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(upto[-1] + 8 * self.eights.shape[1], dtype=np.uint8)
        places = np.ndarray(upto[-1] + 1, dtype="<u8", buffer=out, strides=(1,))
        # last eights first, and within these in order: what a write has over is written again by the pieces that follow
        for i in reversed(range(-(-int(size.max(initial=0)) // 8))):
            some = np.flatnonzero(size > 8 * i) if i else slice(None)
            places[upto[:-1][some] + 8 * i] = self.eights[ids[some], i]
        out = out[: upto[-1]]
        offsets = upto[offsets]
        lead = np.diff(offsets) > 0
        lead[lead] = out[offsets[:-1][lead]] == 32  # the mark that leads every text
        return np.delete(out, offsets[:-1][lead]), offsets - np.concatenate(([0], np.cumsum(lead)))


_LOW_THREE = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], dtype=np.int64)


def packed(points: np.ndarray, at: int | None = None) -> np.ndarray:
    """Three code points that follow each other in a number: of an array from each place on, of a matrix from column ``at``."""
    a, b, c = (points[:-2], points[1:-1], points[2:]) if at is None else (points[:, at], points[:, at + 1], points[:, at + 2])
    return a.astype(np.int64) | b.astype(np.int64) << 21 | c.astype(np.int64) << 42


def utf8_size(point: np.ndarray) -> np.ndarray:
    """Bytes of code points; of LITERAL those of the mark."""
    return np.where(point == LITERAL, 3, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))


class Rows:
    """A column that grows; ``now`` is what it holds."""

    def __init__(self, kind, first: int | None = None):
        self.held, self.now = np.empty(1 << 16, dtype=kind), None
        self.set(np.array([] if first is None else [first], dtype=kind))

    def set(self, values: np.ndarray) -> None:
        self.held[: len(values)] = values
        self.now = self.held[: len(values)]

    def extend(self, values: np.ndarray) -> None:
        n = len(self.now) + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.now, np.empty(n, dtype=self.held.dtype)])
        self.held[n - len(values) : n] = values
        self.now = self.held[:n]


class Lattices:
    """Distinct words with their edges, edge probabilities and places, laid end to end in the order in which they came.

    A worker keeps them from text to text; when there are CACHE_NODES nodes, words that didn't come again go.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        #: words by name
        self.order = np.zeros(0, np.int64)
        #: by word: both names, in how many steps it came, and its first node (one more tells the end)
        self._name, self._other, self._times, self._base = Rows(np.uint64), Rows(np.uint64), Rows(np.int32), Rows(np.int64, 0)
        #: by node: code point, its word's end, and its first edge (one more tells the end)
        self._points, self._end, self._first_edge = Rows(np.int32), Rows(np.int64), Rows(np.int64, 0)
        #: by edge: id, the node that it leads to (-1 for the word's end), log probability, and where its share of its node's
        #: unit begins
        self._ids, self._ahead, self._log_q, self._before = Rows(np.int32), Rows(np.int32), Rows(float), Rows(float)

    def __getattr__(self, name: str) -> np.ndarray:
        """What a column holds."""
        return self.__dict__[f"_{name}"].now

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The word of each span of bytes, whose blanks stand for marks."""
        if len(self.points) > CACHE_NODES:
            self._thin()
        name, other = tb.names(data, start, end, 2)
        first, back = tb.distinct(name, other)
        name, other = name[first], other[first]
        word = np.full(len(name), -1)
        if len(self.order):
            sorted_ = self.name[self.order]
            for side in ("left", "right"):  # two words may share a name, and are side by side then
                at = np.searchsorted(sorted_, name, side) - (side == "right")
                near = self.order[np.clip(at, 0, len(sorted_) - 1)]
                hit = (self.name[near] == name) & (self.other[near] == other)
                word[hit] = near[hit]
        new = np.flatnonzero(word < 0)
        if len(new):
            word[new] = len(self.other) + np.arange(len(new))
            self._name.extend(name[new])
            self._other.extend(other[new])
            self.order = np.argsort(self.name)
            self._times.extend(np.zeros(len(new), np.int32))
            self._add(data, start[first[new]], end[first[new]])
        self.times[word] += 1
        return word[back]

    def _thin(self) -> None:
        """Keep the words that came in most steps, of half the nodes at most."""
        least, size = 2, np.diff(self.base)
        while size[self.times >= least].sum() > CACHE_NODES // 2:
            least *= 2
        word = np.flatnonzero(self.times >= least)

        def spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places of what some numbers hold, end to end, and the new offsets."""
            count = first[of + 1] - first[of]
            upto = np.concatenate(([0], np.cumsum(count)))
            return np.repeat(first[of] - upto[:-1], count) + np.arange(upto[-1]), upto

        node, base = spread(self.base, word)
        edge, first_edge = spread(self.first_edge, node)
        moved = np.repeat(base[:-1] - self.base[word], np.diff(base))
        self._end.set(self.end[node] + moved)
        by_edge = np.repeat(moved, np.diff(first_edge))
        self._before.set(self.before[edge] + by_edge)
        ahead = self.ahead[edge]
        self._ahead.set(np.where(ahead < 0, ahead, ahead + by_edge))
        self._times.set(self.times[word] // 2)
        for column, at in ((self._points, node), (self._ids, edge), (self._log_q, edge), (self._name, word), (self._other, word)):
            column.set(column.now[at])
        self._base.set(base)
        self._first_edge.set(first_edge)
        self.order = np.argsort(self.name)

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.int32).copy()
        points[points == MARK] = LITERAL
        points[points == 32] = MARK
        base = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))[upto]
        n, nodes, edges = len(points), len(self.points), len(self.ids)
        own_end = np.repeat(base[1:], np.diff(base))
        e = self.vocabulary.lattice(points, own_end)
        # backward: total log probability from each node to its word's end, by distance from the end; place n is an end
        back = np.zeros(n + 1)
        left = own_end - np.arange(n)
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        count = np.diff(e.first)[order]
        upto = np.concatenate(([0], np.cumsum(count)))
        edge = np.repeat(e.first[:-1][order] - upto[:-1], count) + np.arange(upto[-1])
        ahead = e.node + e.size
        ahead = np.where(ahead < own_end[e.node], ahead, n)
        log_p, to = e.log_p[edge], ahead[edge]
        level = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            if a < b:
                lo, hi = upto[a], upto[b]
                back[order[a:b]] = np.logaddexp.reduceat(log_p[lo:hi] + back[to[lo:hi]], upto[a:b] - lo)
        log_q = e.log_p + back[ahead] - back[e.node]
        q = np.exp(log_q)
        starts = e.first[:-1]
        total = np.cumsum(q)
        inside = total - (total[starts] - q[starts])[e.node]
        before = np.concatenate(([0.0], (e.node + np.minimum(inside, 1.0))[:-1]))
        before[starts] = np.arange(n)
        for column, values in (
            (self._base, base[1:] + nodes), (self._points, points), (self._end, own_end + nodes), (self._first_edge, e.first[1:] + edges), (self._ids, e.id), (self._ahead, np.where(ahead < n, ahead + nodes, -1)),
            (self._log_q, log_q), (self._before, before + nodes),
        ):
            column.extend(values)

    def parted(self, node: np.ndarray, without: list[list[int]], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node an edge drawn from all but some, and the total probability of what is left then."""
        first, count = self.first_edge[node], self.first_edge[node + 1] - self.first_edge[node]
        lead = np.cumsum(count) - count
        of = np.repeat(np.arange(len(node)), count)
        edge = (first - lead)[of] + np.arange(len(of))
        q = np.exp(self.log_q[edge])
        q[np.array([e + int(lead[i]) - int(first[i]) for i, some in enumerate(without) for e in some])] = 0
        share = np.cumsum(q / np.add.reduceat(q, lead)[of])
        share -= np.where(lead > 0, share[lead - 1], 0.0)[of]
        share[np.maximum.reduceat(np.where(q > 0, np.arange(len(q)), 0), lead)] = 2.0
        hit = np.flatnonzero((q > 0) & (share > draw[of]))
        chosen = hit[np.searchsorted(of[hit], np.arange(len(node)))]
        q[chosen] = 0
        return edge[chosen], np.add.reduceat(q, lead)

    def forward(self, node: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sample from each node to its word's end: (walk, node, edge) of all steps, in order of walks. Draws depend on a
        walk's key and place."""
        live = np.flatnonzero(node >= 0)
        steps: list[tuple] = []
        now, key = node[live], placed(key[live], place[live])
        count = np.zeros(len(node), dtype=np.int64)
        while len(live):
            # from the longest edge, which is mostly the likeliest, back to the one that holds the draw
            edge, drawn = self.first_edge[now + 1] - 1, now + unit(tb.mix(key + np.uint64(len(steps))))
            back = np.flatnonzero(self.before[edge] > drawn)
            while len(back):
                edge[back] -= 1
                back = back[self.before[edge[back]] > drawn[back]]
            steps.append((live, now, edge))
            count[live] += 1
            after = self.ahead[edge]
            on = np.flatnonzero(after >= 0)
            live, now, key = live[on], after[on].astype(np.int64), key[on]
        at = np.cumsum(count) - count
        nodes, edges = np.empty((2, int(count.sum())), dtype=np.int64)
        for i, (w, x, e) in enumerate(steps):
            to = at[w] + i
            nodes[to], edges[to] = x, e
        return np.repeat(np.arange(len(count)), count), nodes, edges


class Paths:
    """A sampled path for each of some texts, end to end, and the values of the sets that part from its nodes.

    Path p belongs to text row[p], takes first[p] to first[p + 1], and may be parted from at its node at[p] and later,
    there but by the edges without[p].
    """

    def __init__(self, lattices: Lattices, keys: np.ndarray, number: int, row: np.ndarray, first: np.ndarray, node: np.ndarray, edge: np.ndarray, word: np.ndarray, value: np.ndarray, at: np.ndarray, without: list[list[int]], left: np.ndarray | None = None):
        """``left``: the total probability of what each path may be parted by at its node at[p]."""
        self.row, self.first, self.node, self.edge, self.word, self.at, self.without = row, first, node, edge, word, at, without
        each = lattices.log_q[edge]
        upto = np.concatenate(([0.0], np.cumsum(each)))
        self.log_prob = upto[first[1:]] - upto[first[:-1]]
        # the nodes that may be parted from, path by path
        size = first[1:] - first[:-1] - at
        lead = np.cumsum(size) - size
        of = np.repeat(np.arange(len(row)), size)
        node_at = (first[:-1] + at - lead)[of] + np.arange(len(of))
        # log of the total probability of a node's other edges; an only edge has a log probability of 0
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(each[node_at]), 0.0))
            if left is not None:
                rest[lead] = np.log(left)
        draw = unit(placed(keyed(keys[row], 2, number)[of], node_at - first[of]))
        values = below(value[of], upto[node_at] - upto[first[:-1]][of] + rest, draw)
        self.sets = np.full(len(node), -np.inf)
        self.sets[node_at] = values
        self.top, self.top_at = np.full(len(row), -np.inf), first[:-1].copy()
        if len(values):
            some = size > 0
            self.top[some] = np.maximum.reduceat(values, lead[some])
            hit = np.flatnonzero(values == self.top[of])
            begins = np.ones(len(hit), dtype=bool)
            begins[1:] = of[hit[1:]] != of[hit[:-1]]
            self.top_at[of[hit[begins]]] = node_at[hit[begins]]

    def take(self, p: int) -> int:
        """The place of the best open set of a path, which is closed."""
        i, a, b = int(self.top_at[p]), int(self.first[p]), int(self.first[p + 1])
        self.sets[i] = -np.inf
        self.top_at[p] = j = a + int(self.sets[a:b].argmax())
        self.top[p] = self.sets[j]
        return i


def samples(lattices: Lattices, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """Up to k distinct segmentations of each text, best first, one Paths for each number; and each text's (k + 1)-th value."""
    full = np.diff(offsets) > 0
    # a mark leads every text that isn't empty
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(full)))
    mark = data == 32
    start = np.zeros(len(data), dtype=bool)
    start[1:] = mark[1:] & ~mark[:-1]
    start[offsets[:-1][full]] = True
    begin = np.flatnonzero(start)
    word = lattices.numbers(data, begin, np.append(begin[1:], len(data))) if len(begin) else np.zeros(0, np.int64)
    first, rows = np.searchsorted(begin, offsets), np.arange(len(keys))
    word_row = np.repeat(rows, np.diff(first))
    word_at = np.arange(len(word_row)) - first[word_row]
    walk, node, edge = lattices.forward(lattices.base[word], keyed(keys, 1, 0)[word_row], word_at)
    value = -np.log(-np.log(uniform(keys, 0)))
    found = [Paths(lattices, keys, 0, rows, np.searchsorted(walk, first), node, edge, word_at[walk], value, np.zeros(len(rows), np.int64), [[]] * len(rows))]
    path_of = [rows]
    for number in range(1, k):
        tops = np.stack([np.where(at >= 0, f.top[at], -np.inf) if len(f.top) else np.full(len(rows), -np.inf) for f, at in zip(found, path_of)])
        which, value = tops.argmax(axis=0), tops.max(axis=0, initial=-np.inf)
        parted = np.flatnonzero(value > -np.inf)
        if not len(parted):
            break
        # each text's best open set, the edge by which it parts, and the walks that end its best path
        where, without, heads = [], [], []
        for r in parted.tolist():
            f = found[which[r]]
            p = int(path_of[which[r]][r])
            a, i = int(f.first[p]), f.take(p)
            without.append([*(f.without[p] if i - a == f.at[p] else []), int(f.edge[i])])
            where.append((int(f.node[i]), int(f.word[i]), i - a))
            heads.append((f.node[a : i + 1], f.edge[a : i + 1], f.word[a : i + 1]))
        node, here, at = np.array(where).T
        choice, left = lattices.parted(node, without, uniform(keys[parted], 3, number))
        after = lattices.ahead[choice]
        size = np.diff(first)[parted] - here
        ends = np.cumsum(size)
        lead = np.repeat(ends - size, size)
        walk_row = np.repeat(parted, size)
        walk_at = np.repeat(here, size) + np.arange(len(lead)) - lead
        begin = lattices.base[word[first[walk_row] + walk_at]]
        begin[ends - size] = after
        walk, node, edge = lattices.forward(begin, keyed(keys, 1, number)[walk_row], walk_at)
        cut = np.concatenate(([0], np.searchsorted(walk, ends))).tolist()
        of_word = walk_at[walk]
        parts = [[x for j, h in enumerate(heads) for x in (h[c], tail[cut[j] : cut[j + 1]])] for c, tail in enumerate((node, edge, of_word))]
        upto = np.concatenate(([0], np.cumsum(at + 1 + np.diff(cut))))
        node, edge, of_word = (np.concatenate(x) for x in parts)
        edge[upto[:-1] + at] = choice
        found.append(Paths(lattices, keys, number, parted, upto, node, edge, of_word, value[parted], at, without, left))
        own = np.full(len(rows), -1)
        own[parted] = np.arange(len(parted))
        path_of.append(own)
    last = np.full(len(rows), -np.inf)
    for f in found:
        last[f.row] = np.maximum(last[f.row], f.top)
    return found, last


def inclusion(f: Paths, last: np.ndarray) -> np.ndarray:
    """Each path's probability to be among the first k; with no path left over, all are included for sure."""
    with np.errstate(over="ignore"):
        return np.where(np.isneginf(last[f.row]), 1.0, -np.expm1(-np.exp(f.log_prob - last[f.row])))


def ids_of(lattices: Lattices, f: Paths) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the paths, and the offsets of each path's ids; a bare character becomes its bytes' pieces."""
    ids = lattices.ids[f.edge]
    if not len(bare := np.flatnonzero(ids < 0)):
        return ids, f.first
    point = lattices.points[f.node[bare]]
    size, point = utf8_size(point), np.where(point == LITERAL, MARK, point)
    more = np.concatenate(([0], np.cumsum(size - 1)))  # places that came in before
    times = np.ones(len(ids), dtype=np.int64)
    times[bare] = size
    out = np.repeat(ids, times) if more[-1] else ids
    for j in range(int(size.max())):
        some = np.flatnonzero(size > j)
        x, m = point[some], size[some]
        byte = np.array([0, 0, 0xC0, 0xE0, 0xF0])[m] | (x >> 6 * (m - 1)) if j == 0 else 0x80 | (x >> 6 * (m - 1 - j)) & 0x3F
        out[bare[some] + more[some] + j] = lattices.vocabulary.byte_id[byte]
    return out, f.first + more[np.searchsorted(bare, f.first)]


_lattices: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = Lattices(Vocabulary(installed(path)))
    return _lattices[path]


def encode(docs: DataFrame, path: str, k: int = SAMPLES) -> DataFrame:
    """doc_id, sample (from 0), ids (little-endian unsigned 32-bit), log_prob and inclusion for each row's samples."""

    def made(batches) -> Iterator[pa.RecordBatch]:
        for doc_id, number, ids, offsets, log_prob, included in _encoded(batches, lattices_of(path), k):
            packed = pa.Array.from_buffers(pa.large_binary(), len(log_prob), [None, pa.py_buffer(4 * offsets), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([doc_id, number, packed.cast(pa.binary()), pa.array(log_prob), pa.array(included)], ["doc_id", "sample", "ids", "log_prob", "inclusion"])

    return arrow(docs.select("doc_id", "text"), made, OUT)


def _encoded(batches, lattices: Lattices, k: int) -> Iterator[tuple]:
    """(doc_id, sample, ids, their offsets, log probability, inclusion score) of the samples of one number of some rows."""
    try:
        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text", 2 * tb.STEP_BYTES):
                doc_id = part.column(0).cast(pa.int64())
                keys = doc_id.fill_null(0).to_numpy().astype(np.uint64)
                found, last = samples(lattices, data, offsets, keys, k)
                for number, f in enumerate(found):
                    yield doc_id.take(pa.array(f.row)), pa.array(np.full(len(f.row), number, dtype=np.int32)), *ids_of(lattices, f), f.log_prob, inclusion(f, last)
    finally:
        lattices.clear()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, sample and text of rows (doc_id, sample, ids)."""

    def made(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = lattices_of(path).vocabulary
        for batch in batches:
            data, offsets = tb.buffer_of(batch.column(2).cast(pa.large_binary()))
            text, at = vocabulary.decoded(data.view("<u4"), offsets // 4)
            texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts.cast(pa.string())], ["doc_id", "sample", "text"])

    return arrow(encoded.select("doc_id", "sample", "ids"), made, "doc_id long, sample int, text string")


def digests(docs: DataFrame, path: str, k: int = SAMPLES) -> DataFrame:
    """One row per sample, with digests of its ids and of the text that they decode to."""

    def made(batches) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path)
        crc = lambda raw, at: pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
        for doc_id, number, ids, offsets, log_prob, included in _encoded(batches, lattices, k):
            text, at = lattices.vocabulary.decoded(ids, offsets)
            columns = [doc_id, number, pa.array(np.diff(offsets)), crc(ids.astype("<u4"), offsets), crc(text, at), pa.array(log_prob), pa.array(included)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sample", "n_tokens", "ids_crc32", "decoded_crc32", "log_prob", "inclusion"])

    return arrow(docs.select("doc_id", "text"), made, "doc_id long, sample int, n_tokens long, ids_crc32 long, decoded_crc32 long, log_prob double, inclusion double")


def op2_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
