"""Nearest-neighbour joins, projection, greedy coresets and coverage.

The bank of a join is dealt to cells around pivots and cut into blocks by distance from the pivot, so a block is a shell
[r_min, r_max] about its pivot. Queries go in blocks too, each query with a bound on its k-th distance, from a sample of
the bank. By the triangle inequality no row of a shell is nearer to q than its distance from the pivot's shell, so a block
of queries meets the shells that may hold one of its k nearest rows, and no others; within a pair of blocks one matrix
product (in singles, where their rounding is far below the bounds) tells which rows may be among the k, and their distances
are taken from differences in doubles.

Vectors move by tiles, a group of query blocks and a group of bank blocks each. There are GROUPS groups of either at most
(of queries more, so that a group has GROUP_BYTES at most), so each vector is shuffled GROUPS times, however many pairs of
blocks meet; in singles, if these hold all numbers of its block. A task holds its queries with the k nearest rows so far,
and the bank's blocks go past them one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import strictly_above
from ..sources.files import read_text, write_once, write_parquet
from ..sources.scratch import stored
from .order import higher_quantile, linear_quantiles
from .raster import per_image, resized

#: Farthest rows that a pass of the coreset brings to the driver, and centres that it measures at once.
POOL, CENTRES = 2048, 256
QUERY_BLOCK, TOGETHER, BANK_BLOCK = 256, 8, 2048
#: Most pivots, the rows of a cell that they aim at, and most rows and bytes of the sample that bounds k-th distances.
CELLS, CELL_ROWS, PROBES, PROBE_BYTES = 1024, 1024, 8192, 16_000_000
#: Groups of queries and of a bank, the least rows that they aim at, and most bytes of a group of queries.
GROUPS, GROUP_ROWS, GROUP_BYTES = 12, 512, 64_000_000
#: Pairs of rows measured at once by differences, and by a matrix product.
PAIRS, PRODUCTS = 1 << 16, 1 << 18
#: Rounding of singles, and the share of a bound that it may reach where products are taken in singles.
SINGLE, SHARE = 2.0**-23, 0.01
#: Bytes of a selection that is broadcast; more are shuffled.
BROADCAST_BYTES = 64_000_000


def _whole(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows whose id and vector are there, and whose vector is finite."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _singles(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x.astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    """Vectors as singles where these hold every number, else as doubles."""
    small = _singles(x)
    return (small if (small == x).all() else x).tobytes()


def _unpacked(values: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    raw = values.as_buffer()
    return np.frombuffer(raw, np.float32 if raw.size < 8 * rows * dims else float).astype(float, copy=False).reshape(rows, dims)


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean, of pairs of rows, by differences: equal rows have equal distances to the last digit."""
    out = np.empty(len(i))
    for x in range(0, len(i), PAIRS):
        d = a[i[x : x + PAIRS]] - b[j[x : x + PAIRS]]
        out[x : x + PAIRS] = np.sqrt((d * d).sum(axis=1))
    return out


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one matrix product, and how far off they may be."""
    norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    return norms - 2 * (a @ b.T), 1e-12 * norms * max(1, a.shape[1])


def least_distances(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of each row of a the least distance from a row of b, or ``below`` if that is less."""
    found, off = squares(a, b)
    most = np.minimum(below**2, (found + off).min(axis=1))
    i, j = np.nonzero(found - off <= most[:, None])
    out = below.copy()
    np.minimum.at(out, i, distances(a, b, i, j))
    return out


def k_nearest(a: np.ndarray, b: np.ndarray, k: int, below: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b, and all that are as near, by row, distance, row of b; of
    those at most as far as ``below`` says, and rounding."""
    found, off = squares(a, b)
    most = np.partition(found + off, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
    if below is not None:
        most = np.minimum(most, below**2 * (1 + 1e-12) + off.max(axis=1))
    i, j = np.nonzero(found - off <= most[:, None])
    d = distances(a, b, i, j)
    order = np.lexsort((j, d, i))
    return i[order], j[order], d[order]


@dataclass(frozen=True)
class Index:
    """A bank in cells: ``blocks`` (block, cell, r_min, r_max, rows, ids, values, times) are shells of cells around
    ``pivots``; ``probes`` are a sample of its vectors. A vector that a block holds more than k times is there with its k
    smallest ids; times say how many rows each stands for."""

    pivots: np.ndarray
    probes: np.ndarray
    blocks: DataFrame
    rows: int
    k: int


def indexed(bank: DataFrame, k: int | None, id_col: str = "vec_id", vector: str = "embedding", block: int = BANK_BLOCK, cell_rows: int = CELL_ROWS) -> Index | None:
    """An index for searches of up to k neighbours, or with all rows (k None); None of an empty bank. Rows are dealt by ranges of (cell, distance from
    the pivot, id), so a cell that holds any share of the bank is spread over tasks."""
    whole = _whole(bank, id_col, vector)
    n = whole.count()
    if not n:
        return None
    dims = whole.select(F.size("v").alias("d")).first()["d"]
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(min(PROBES, PROBE_BYTES // (8 * max(1, dims)), max(k or 1, n // 16))).select("v").toArrow()["v"].combine_chunks()
    probes = _vectors(sample, len(sample))
    pivots = np.unique(probes[: max(1, min(CELLS, n // cell_rows))], axis=0)
    held = bank.sparkSession.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), batch.num_rows)
            cell = squares(x, held.value)[0].argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(distances(x, held.value, np.arange(len(x)), cell)), *batch.columns], ["cell", "r", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of cell and distance, blocks of one cell each."""
        number, now = TaskContext.get().partitionId() << 40, None
        for cell, r, ids, x in _runs(batches, block):
            if now is not None and (now[0] != cell or len(now[2]) >= block):
                yield _block(number, *now)
                number, now = number + 1, None
            now = (cell, r, ids, x, np.ones(len(ids), np.int64)) if now is None else (cell, *(np.concatenate(p) for p in zip(now[1:], (r, ids, x, np.ones(len(ids), np.int64)))))
            now = (cell, *_collapsed(*now[1:], k)) if k else now
        if now is not None:
            yield _block(number, *now)

    rows = whole.mapInArrow(dealt, "cell int, r double, id long, v array<double>").repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    blocks = stored(rows.mapInArrow(packed, "block long, cell int, r_min double, r_max double, rows long, ids binary, values binary, times binary"))
    return Index(pivots, probes, blocks, n, k or n)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(cell, distances, ids, vectors) of runs of one cell, of so many rows at most."""
    for batch in batches:
        cell, r, ids = (batch.column(i).to_numpy() for i in range(3))
        x = _vectors(batch.column(3), batch.num_rows)
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
            for c in range(a, b, most):
                some = slice(c, min(b, c + most))
                yield int(cell[c]), r[some], ids[some], x[some]


def _collapsed(r: np.ndarray, ids: np.ndarray, x: np.ndarray, times: np.ndarray, k: int) -> tuple:
    """Rows with at most k of each vector, those of the smallest ids; the first one's times count for those left out."""
    if len(np.unique(r)) == len(r):  # equal vectors are as far from the pivot
        return r, ids, x, times
    _, of = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    first = np.searchsorted(of.ravel()[order], np.arange(of.max() + 1))
    place = np.arange(len(order)) - first[of.ravel()[order]]
    kept = order[place < k]
    out = times.copy()
    lost = np.bincount(of.ravel()[order[place >= k]], weights=times[order[place >= k]], minlength=len(first)).astype(np.int64)
    out[order[first]] += lost
    kept = kept[np.lexsort((ids[kept], r[kept]))]
    return r[kept], ids[kept], x[kept], out[kept]


def _block(number: int, cell: int, r: np.ndarray, ids: np.ndarray, x: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    fields = ([number], pa.int64()), ([cell], pa.int32()), ([r.min()], pa.float64()), ([r.max()], pa.float64()), ([len(ids)], pa.int64())
    raw = [pa.array([v], pa.binary()) for v in (ids.tobytes(), _packed(x), times.tobytes())]
    return pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in fields], *raw], ["block", "cell", "r_min", "r_max", "rows", "ids", "values", "times"])


def _asked(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(q_block, q_ids, q_values, q_below, cell, low, high): blocks of queries near each other, with the bounds on their k-th
    distances, and the cells that may hold something: the shells there that reach into [low, high]."""
    extents = {r["cell"]: (r["low"], r["high"]) for r in index.blocks.groupBy("cell").agg(F.min("r_min").alias("low"), F.max("r_max").alias("high")).collect()}  # CELLS rows
    held = queries.sparkSession.sparkContext.broadcast((index.pivots, index.probes, extents))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), batch.num_rows)
            home = np.zeros(len(x), np.int32)
            far = np.zeros(len(x))
            if len(x):
                found, _ = squares(x, held.value[0])
                home = found.argmin(axis=1).astype(np.int32)
                far = np.sqrt(np.maximum(0, found.min(axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(far), *batch.columns], ["home", "far", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pivots, probes, cells = held.value
        for batch in batches:
            for part in _near_each_other(batch):
                x = _vectors(part.column(3), part.num_rows)
                below = np.full(len(x), np.inf)
                if len(probes) >= k:
                    found, off = squares(x, probes)
                    below = np.sqrt(np.partition(found + off, k - 1, axis=1)[:, k - 1])
                found, off = squares(x, pivots)
                low, high = np.sqrt(np.maximum(0, found - off)) - below[:, None], np.sqrt(found + off) + below[:, None]
                wide = 1e-9 * (1 + np.abs(high).max(axis=0, initial=0, where=np.isfinite(high)))
                low, high = low.min(axis=0) - wide, high.max(axis=0) + wide
                met = [c for c, (r_min, r_max) in cells.items() if r_max >= low[c] and r_min <= high[c]]
                raw = [pa.array([v], pa.binary()) for v in (part.column(2).to_numpy().tobytes(), _packed(x), below.tobytes())]
                lists = [pa.array([v], pa.list_(t)) for v, t in ((met, pa.int32()), (low[met], pa.float64()), (high[met], pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *raw, *lists], ["q_block", "q_ids", "q_values", "q_below", "cell", "low", "high"])
                number += 1

    rows = _whole(queries, "id", "v").mapInArrow(dealt, "home int, far double, id long, v array<double>").repartitionByRange("home", "far", "id").sortWithinPartitions("home", "far", "id")
    return rows.mapInArrow(packed, "q_block long, q_ids binary, q_values binary, q_below binary, cell array<int>, low array<double>, high array<double>")


def _near_each_other(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch in order of home cells, where a few rows are together and the home changes, or at QUERY_BLOCK rows."""
    home, a = batch.column(0).to_numpy(), 0
    for b in [*(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]:
        while b - a >= QUERY_BLOCK or b - a >= TOGETHER or (b == len(home) and b > a):
            yield batch.slice(a, min(b - a, QUERY_BLOCK))
            a += min(b - a, QUERY_BLOCK)


def pairs_met(queries: DataFrame, index: Index, k: int, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The blocks of queries (q_block, q_ids, q_values, q_below), and which blocks of the index each of them meets (q_block,
    block)."""
    asked = stored(_asked(queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), index, k))
    shells = index.blocks.select("block", F.col("cell").alias("_cell"), "r_min", "r_max")
    reach = asked.select("q_block", F.explode(F.arrays_zip("cell", "low", "high")).alias("m")).select("q_block", "m.*")
    pairs = reach.join(shells, (F.col("cell") == F.col("_cell")) & (F.col("r_max") >= F.col("low")) & (F.col("r_min") <= F.col("high")))
    return asked.select("q_block", "q_ids", "q_values", "q_below"), pairs.select("q_block", "block")


class _Group:
    """Queries with what is known of their k nearest rows, while blocks of a bank go past."""

    def __init__(self, blocks: list[tuple], k: int, dims: int):
        """``blocks``: (ids, values, bounds, cells, low, high) of each block of queries."""
        self.ids, x, self.below = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        self.x = x.reshape(len(self.ids), dims)
        self.first = np.cumsum([0, *(len(b[0]) for b in blocks)])
        self.norm = (self.x * self.x).sum(axis=1)
        self.left = _singles(np.column_stack([-2 * self.x, np.ones(len(self.ids))]))
        cells = 1 + max((int(b[3].max(initial=-1)) for b in blocks), default=-1)
        self.low, self.high = np.full((len(blocks), cells), np.inf), np.full((len(blocks), cells), -np.inf)
        for i, b in enumerate(blocks):
            self.low[i, b[3]], self.high[i, b[3]] = b[4], b[5]
        self.d, self.near = np.full((len(self.ids), k), np.inf), np.zeros((len(self.ids), k), np.int64)
        self.least, self.same = np.full(len(self.ids), np.inf), np.zeros(len(self.ids), np.int64)

    def meet(self, cell: int, r_min: float, r_max: float, ids: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """A block of a bank: measured against the blocks of queries that its shell may concern."""
        if cell >= self.low.shape[1]:
            return
        met = (r_max >= self.low[:, cell]) & (r_min <= self.high[:, cell])
        norm = (y * y).sum(axis=1)
        right = _singles(np.column_stack([y, norm]))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], met, [False])))).reshape(-1, 2)
        step = max(1, PRODUCTS // len(y))
        for a, b in self.first[edges].tolist():
            for c in range(a, b, step):
                self._measure(c, min(b, c + step), ids, y, norm, right, times)

    def _measure(self, a: int, b: int, ids: np.ndarray, y: np.ndarray, norm: np.ndarray, right: np.ndarray, times: np.ndarray) -> None:
        x, below = self.x[a:b], self.below[a:b]
        if np.isfinite(below).all():
            i, j = self._reached(a, b, y, norm, right)
            d = distances(x, y, i, j)
        else:
            i, j, d = k_nearest(x, y, self.d.shape[1], below)
        on = np.flatnonzero(d <= below[i] * (1 + 1e-12))
        if not len(on):
            return
        i, j, d = i[on] + a, j[on], d[on]
        rows, of = np.unique(i, return_inverse=True)
        low = np.full(len(rows), np.inf)
        np.minimum.at(low, of, d)
        same = np.bincount(of, weights=(d == low[of]) * times[j], minlength=len(rows)).astype(np.int64)
        self.same[rows] = np.where(low < self.least[rows], same, self.same[rows] + np.where(low == self.least[rows], same, 0))
        self.least[rows] = np.minimum(self.least[rows], low)
        k = self.d.shape[1]
        of, d, near = np.concatenate([of, np.repeat(np.arange(len(rows)), k)]), np.concatenate([d, self.d[rows].ravel()]), np.concatenate([ids[j], self.near[rows].ravel()])
        order = np.lexsort((near, d, of))
        first = np.searchsorted(of[order], np.arange(len(rows)))
        kept = order[first[:, None] + np.arange(k)]  # each row has k entries at least, of which some may be absent
        self.d[rows], self.near[rows] = d[kept], near[kept]
        self.below[rows] = np.minimum(self.below[rows], self.d[rows, -1])

    def _reached(self, a: int, b: int, y: np.ndarray, norm: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row of a query, row of y) that may be within the bounds."""
        most, dims = self.below[a:b] ** 2 * (1 + 1e-12) - self.norm[a:b], max(1, y.shape[1])
        off = (dims + 8) * (SINGLE * (self.norm[a:b] + 2 * norm.max()) + 1e-36)  # what singles round, and what is too small for them
        if max(self.norm[a:b].max(), norm.max()) < 1e36 and 2 * off.max() <= SHARE * np.median(self.below[a:b]) ** 2:
            near = self.left[a:b] @ right.T <= np.nextafter(_singles(most + off), np.float32(np.inf))[:, None]
        else:
            off = 1e-12 * (self.norm[a:b] + norm.max()) * dims
            near = norm - 2 * (self.x[a:b] @ y.T) <= (most + 2 * off)[:, None]
        return np.divmod(np.flatnonzero(near), len(y))

    def found(self) -> Iterator[pa.RecordBatch]:
        i, place = np.nonzero(np.isfinite(self.d))
        for c in range(0, len(i), PAIRS):
            of, at = i[c : c + PAIRS], place[c : c + PAIRS]
            columns = [self.ids[of], self.near[of, at], self.d[of, at], at == 0, self.least[of], self.same[of]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["query_id", "bank_id", "distance", "first", "least", "same"])


def _tiles(asked: DataFrame, index: Index) -> DataFrame:
    """(tile, kind, ids, values, more, cells, low, high): of each tile its blocks of queries (kind 0; more: bounds), then
    its blocks of the bank (kind 1; more: times)."""
    rows = asked.agg(F.coalesce(F.sum(F.octet_length("q_ids") / 8), F.lit(0)).cast("long").alias("n")).first()["n"]
    few = lambda n: max(1, min(GROUPS, -(-n // GROUP_ROWS)))
    across, down = few(index.rows), max(few(rows), -(-rows * 8 * index.pivots.shape[1] // GROUP_BYTES))
    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", group("q_block", down).alias("g"), every(across).alias("h")).select(
        "g", "h", F.lit(0).alias("kind"), F.col("q_ids").alias("ids"), F.col("q_values").alias("values"), F.col("q_below").alias("more"), F.col("cell").alias("cells"), "low", "high"
    )
    one = lambda c: F.array(c)
    right = index.blocks.select("*", group("block", across).alias("h"), every(down).alias("g")).select(
        "g", "h", F.lit(1).alias("kind"), "ids", "values", F.col("times").alias("more"), one("cell").alias("cells"), one("r_min").alias("low"), one("r_max").alias("high")
    )
    tiles = left.union(right).select((F.col("g") * across + F.col("h")).alias("tile"), "kind", "ids", "values", "more", "cells", "low", "high")
    return tiles.repartition(down * across, "tile").sortWithinPartitions("tile", "kind")


def nearest(queries: DataFrame, bank: DataFrame | Index, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, bank_id, distance, ties): the k nearest bank rows of each query, ties to the smaller id; ties
    counts the bank rows at the least distance. A bank that is searched more than once may be given as its index."""
    spark = queries.sparkSession
    index = bank if isinstance(bank, Index) else indexed(bank, k, id_col, vector)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, bank_id long, distance double, ties long")
    if k > index.k:
        raise ValueError(f"the index is for {index.k} neighbours")
    asked = stored(_asked(queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), index, k))
    dims = index.pivots.shape[1]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, group = None, [], None
        for batch in batches:
            for tile, kind, *raw in zip(*(batch.column(i).to_pylist() for i in range(2)), *(batch.column(i) for i in range(2, 8))):
                if tile != now:
                    if group:
                        yield from group.found()
                    now, blocks, group = tile, [], None
                ids, more = (np.frombuffer(v.as_buffer(), dtype=t) for v, t in ((raw[0], np.int64), (raw[2], float if kind == 0 else np.int64)))
                values = _unpacked(raw[1], len(ids), dims)
                cells, low, high = (v.values.to_numpy() for v in raw[3:])
                if kind == 0:
                    blocks.append((ids, values.ravel(), more, cells, low, high))
                    continue
                if group is None and blocks:
                    group, blocks = _Group(blocks, k, dims), []
                if group:
                    group.meet(int(cells[0]), low[0], high[0], ids, values, more)
        if group:
            yield from group.found()

    rows = _tiles(asked, index).mapInArrow(measured, "query_id long, bank_id long, distance double, first boolean, least double, same long")
    own = Window.partitionBy("query_id")
    ranked = rows.withColumn("_least", F.min("least").over(own)).withColumn("rank", F.row_number().over(own.orderBy("distance", "bank_id")))
    tied = F.sum(F.when(F.col("first") & (F.col("least") == F.col("_least")), F.col("same"))).over(own)
    return ranked.withColumn("ties", tied).where(F.col("rank") <= k).select("query_id", "rank", "bank_id", "distance", "ties")


def projection(dims: int, to: int, seed: int = 43) -> np.ndarray:
    """A Gaussian matrix of a seed, scaled so that lengths are kept on average."""
    return np.random.default_rng(seed).standard_normal((dims, to)) / np.sqrt(to)


def projected(df: DataFrame, matrix: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``df`` with the column projected; vectors of another size than the matrix are null."""
    held = df.sparkSession.sparkContext.broadcast(matrix)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", projected array<double>"
    at = df.columns.index(vector)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, to = held.value.shape
        for batch in batches:
            column = batch.column(at)
            sizes = column.value_lengths().fill_null(-1).to_numpy()
            right = np.flatnonzero(sizes == dims)
            x = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            if np.isnan(x).any():  # nulls, too, are read as such
                whole = np.array([None not in v for v in column.take(pa.array(right)).to_pylist()], dtype=bool)
                right, x = right[whole], x[whole]
            offsets = np.zeros(batch.num_rows + 1, dtype=np.int32)
            offsets[right + 1] = to
            gone = np.ones(batch.num_rows, dtype=bool)
            gone[right] = False
            out = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array((x @ held.value).ravel()), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "projected"])

    return df.mapInArrow(made, schema)


LEAST = "block long, ids binary, least binary, most double"


def _lowered(blocks: DataFrame, state: DataFrame, index: Index, centres: np.ndarray, chosen: list[int], mean: bool = False) -> DataFrame:
    """``state`` (block, ids, least, most) after some centres: each row's least distance lowered to that from the centres (or
    set to the mean distance), and -1 for the rows that are chosen. Vectors are read only of blocks whose shell is nearer
    to a centre than its farthest row is to the centres so far."""
    if not mean:
        far = np.sqrt(((centres[:, None] - index.pivots[None]) ** 2).sum(axis=2)) if len(centres) * len(index.pivots) <= PAIRS else np.sqrt(np.maximum(0, squares(centres, index.pivots)[0]))
        reach = state.sparkSession.createDataFrame(pa.table({"cell": pa.array(range(len(index.pivots)), pa.int32()), "far": pa.array([np.unique(x) for x in far.T], pa.list_(pa.float64()))}))  # CELLS x POOL numbers
        shell = lambda x: F.greatest(F.lit(0.0), x - F.col("r_max"), F.col("r_min") - x) - 1e-6 * (1 + F.col("r_max") + x)
        least = blocks.select("block", "cell", "r_min", "r_max").join(F.broadcast(reach), "cell").select("block", F.array_min(F.transform("far", shell)).alias("nearest"))
        state = state.join(least, "block")
    else:
        state = state.withColumn("nearest", F.lit(-1.0))
    met = state.withColumn("open", F.col("nearest") < F.col("most"))
    dims = index.pivots.shape[1]
    reached = met.where("open").select("block", "least").join(blocks.select("block", "ids", "values"), "block")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, least, ids, values in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 4))):
                ids = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                least, x = np.frombuffer(least.as_buffer()), _unpacked(values, len(ids), dims)
                if mean:  # a few centres
                    every = np.arange(len(ids))
                    new = sum(distances(x, centres, every, np.full(len(ids), j)) for j in range(len(centres))) / len(centres)
                else:
                    new = least
                    for a in range(0, len(centres), CENTRES):
                        new = least_distances(x, centres[a : a + CENTRES], new)
                new = np.where((least < 0) | np.isin(ids, chosen), -1.0, new)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()]), pa.array([new.tobytes()]), pa.array([new.max()])], ["block", "ids", "least", "most"])

    lowered = reached.select("block", "least", "ids", "values").mapInArrow(made, LEAST)
    return lowered.union(met.where("NOT open").select("block", "ids", "least", "most"))


def _farthest(state: DataFrame, n: int) -> list:
    """The n rows (id, block, least) with the greatest distances, ties to the smaller id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for block, ids, least in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids, least = np.frombuffer(ids.as_buffer(), dtype=np.int64), np.frombuffer(least.as_buffer())
                on = least >= 0
                held = [np.concatenate(p) for p in zip(held, (ids[on], np.full(on.sum(), block), least[on]))]
                if len(held[0]) > n:
                    order = np.lexsort((held[0], -held[2]))[:n]
                    held = [p[order] for p in held]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in held], ["id", "block", "least"])

    found = state.where("most >= 0").select("block", "ids", "least").mapInArrow(made, "id long, block long, least double")
    return found.orderBy(F.desc("least"), "id").limit(n).collect()


def _picked(index: Index, rows: list) -> np.ndarray:
    """The vectors of some rows (id, block), in their order."""
    wanted, dims = {}, index.pivots.shape[1]
    for r in rows:
        wanted.setdefault(r["block"], []).append(r["id"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                at = np.flatnonzero(np.isin(ids, wanted[block]))
                x = _unpacked(values, len(ids), dims)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["id", "v"])

    found = index.blocks.where(F.col("block").isin(list(wanted))).select("block", "ids", "values").mapInArrow(made, "id long, v array<double>")
    by = {r["id"]: r["v"] for r in found.collect()}
    return np.array([by[r["id"]] for r in rows])


def _from_pool(ids: np.ndarray, x: np.ndarray, least: np.ndarray, more: bool, size: int) -> list[tuple[int, float]]:
    """Places and distances of the next centres, up to ``size``, among the rows with the greatest distances, in order.

    Distances only shrink, so while the farthest row of the pool comes before the pool's last row as it was, no row
    outside (``more``: there are some) can be farther.
    """
    out, last = [], (-least[-1], ids[-1])
    least = least.copy()
    while len(out) < size:
        i = int(np.lexsort((ids, -least))[0])
        if least[i] < 0 or (more and out and (-least[i], ids[i]) > last):
            break
        out.append((i, float(least[i])))
        least = np.minimum(least, distances(x, x, np.arange(len(x)), np.full(len(x), i)))
        least[i] = -1.0
    return out


def greedy_coreset(df: DataFrame, size: int, id_col: str = "vec_id", vector: str = "embedding", anchors: int = 10, pool: int = POOL) -> DataFrame:
    """(selection_order, id, distance) of a greedy k-centre selection of ``size`` rows, or of all if there are fewer.

    A row's distance begins as the mean distance from ``anchors`` rows chosen by hash, and shrinks to its distance from
    the centres chosen so far; each centre is the farthest row, ties to the smaller id. Chosen rows aren't chosen again.
    A pass over the rows brings the ``pool`` farthest ones to the driver, which goes on with these as long as none of the
    others can be farther; the next pass lowers all distances at once. So there are far fewer passes than centres. The
    vectors stay where they are; a pass writes eight bytes and an id for each row, and reads only vectors that it can change.
    """
    spark = df.sparkSession
    index = indexed(df, None, id_col, vector)
    if index is None:
        return spark.createDataFrame([], "selection_order int, id long, distance double")
    first = [r["v"] for r in _whole(df, id_col, vector).orderBy(F.xxhash64("id"), "id").limit(anchors).collect()]
    begun = index.blocks.select("block", "ids", F.col("times").alias("least"), F.lit(float("inf")).alias("most"))  # as many bytes, none of them read
    now, chosen = stored(_lowered(index.blocks, begun, index, np.asarray(first), [], mean=True)), []
    while len(chosen) < size:
        rows = _farthest(now, pool + 1)
        if not rows:
            break
        more, rows = len(rows) > pool, rows[:pool]
        ids, points = np.array([r["id"] for r in rows]), _picked(index, rows)
        found = _from_pool(ids, points, np.array([r["least"] for r in rows]), more, size - len(chosen))
        chosen += [(len(chosen) + n, int(ids[i]), d) for n, (i, d) in enumerate(found)]
        if len(chosen) < size:
            at = [i for i, _ in found]
            now = stored(_lowered(index.blocks, now, index, points[at], ids[at].tolist()), instead_of=now)
    return spark.createDataFrame(chosen, "selection_order int, id long, distance double")


def recovered(chosen: DataFrame, rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``rows`` of a selection (selection_order, id, distance) with its order and distance, such as the full vectors of a
    selection among projected ones; ids that have no row are an error."""
    n = chosen.count()
    found = F.broadcast(chosen) if n <= BROADCAST_BYTES // 64 else chosen
    met = stored(rows.join(found.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id")).drop("_id"))
    if met.select("selection_order").distinct().count() != n:
        raise ValueError("a selected id has no row")
    return met


def coverage(least: DataFrame, distance_col: str = "distance") -> DataFrame:
    """count, mean, median, p95 (linear), max and the share of zeros of nearest distances."""
    d = F.col(distance_col)
    sums = least.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.max(d).alias("max"), F.avg((d == 0).cast("double")).alias("zero_share"))
    quantiles = linear_quantiles(least, distance_col, {"median": 0.5, "p95": 0.95})
    return sums.crossJoin(F.broadcast(quantiles)).select("n", "mean", "median", "p95", "max", "zero_share")  # a row each


def image_scores(patches: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, patch, row, column, bank_id, reference_row, reference_column, score) of each image's farthest patch, the
    first on ties; of patches (image_id, patch, bank_id, distance) of a grid, numbered by rows."""
    place = F.struct((-F.col("distance")).alias("d"), "patch", "bank_id")
    top = patches.groupBy("image_id").agg(F.min(place).alias("m")).select("image_id", "m.patch", "m.bank_id", (-F.col("m.d")).alias("score"))
    at = lambda c: (F.expr(f"{c} div {width}") % height, F.col(c) % width)
    (row, column), (reference_row, reference_column) = at("patch"), at("bank_id")
    return top.select("image_id", "patch", row.alias("row"), column.alias("column"), "bank_id", reference_row.alias("reference_row"), reference_column.alias("reference_column"), "score")


def image_maps(patches: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """(image_id, map, total, most): each image's distances by patch, bilinear at size x size; absent patches are 0."""
    rows = patches.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("patch", "distance"))).alias("d"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.coalesce(F.try_element_at("d", i.cast("long")), F.lit(0.0)))
    return per_image(rows.select("image_id", whole.alias("v")), "image_id", "v", width, lambda a: _map_of(a, size), "map array<double>, total double, most double")


def _map_of(a: np.ndarray, size: int) -> dict:
    out = resized(a, size, size)
    return {"map": out.ravel().tolist(), "total": float(out.sum()), "most": float(out.max())}


@dataclass(frozen=True)
class Detector:
    """A memory of normal vectors (vec_id, embedding) and the threshold of distances from it."""

    memory: DataFrame
    threshold: float


def fit(normals: DataFrame, calibration: DataFrame, q: float) -> Detector:
    """The memory is all normals; the threshold the higher q-quantile of the calibration's distances."""
    memory = normals.select("vec_id", "embedding")
    found = higher_quantile(nearest(calibration, memory, 1), "distance", q).first()
    if found is None:
        raise ValueError("the calibration has no distance")
    return Detector(memory, float(found["threshold"]))


def save(detector: Detector, path: str) -> None:
    """Under a folder that must not exist: the memory as Parquet, the threshold as JSON with all its digits."""
    spark = detector.memory.sparkSession
    write_parquet(detector.memory, f"{path}/memory")
    write_once(spark, f"{path}/threshold.json", {"threshold": detector.threshold})


def load(spark, path: str) -> Detector:
    return Detector(spark.read.parquet(f"{path}/memory"), json.loads(read_text(spark, f"{path}/threshold.json"))["threshold"])


def inspected(detector: Detector, rows: DataFrame) -> DataFrame:
    """(vec_id, distance, flagged) of rows (vec_id, embedding)."""
    near = nearest(rows, detector.memory, 1)
    return near.select(F.col("query_id").alias("vec_id"), "distance", strictly_above(F.col("distance"), F.lit(detector.threshold)).alias("flagged"))
