"""Exact n-gram Jaccard self-join over size-banded tiles with hashed bitmap signatures.

A document is the set of its k-word shingles; two link when ``100 * |A & B| >= percent * |A | B|``.

1. Equal sets are one node, so copies are never compared with each other. A node is named by the first lane of a 128-bit
   digest of its set; where two sets share that lane, all of them are named by the second.
2. Nodes that could link share one of their first ``n - ceil(t * n) + 1`` shingles (prefix filter, exact for any common
   order). The order puts shingles of a single node first, which can't meet another and are dropped, and common ones
   last, so that a passage shared by many documents ties few of them. Each remaining shingle ties its nodes to the
   least of them, its hub: star edges, not pairs. Counts are combined before the shuffle and joined back in joins that
   Spark can split, so a shingle in a third of all documents fills no task.
3. Components of these edges are clusters: no link leaves one. Small clusters are one tile. In a large one each node
   first meets the hub that it shares most with, in tiles of the hub and some of its nodes, so a group of near copies
   mostly becomes one component at the cost of its rows. What lies outside the cluster's largest component is then cut
   into bands of size (a link spans two neighbouring bands at most) and these into blocks, and tiles compare these
   blocks with each other and with those of the largest component, whose nodes needn't meet again.
4. Within a tile, documents are ordered by size. Parities of hashed shingles in a bitmap bound the symmetric
   difference from below, hence the overlap from above; pairs that pass, and that aren't connected yet, are
   intersected exactly. A tile gives a spanning forest of its links, so its output is linear in its rows.
5. Components of these links, with the documents of each node, are the groups.

Defined results: null or wordless text has an empty set, links with nothing and is its own group; fewer than k words
are one shingle; repeated rows are equal sets; a null doc_id takes part, and is named only where the whole group has
none; doc_id may be of any type that can be ordered; an empty table gives an empty result; extra columns are ignored
by ``jaccard_groups`` and kept by ``keep_representatives``, whatever their names and types. There, of rows that repeat
doc_id and text, all stay or none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import arrow, durable, in_scope, small_side, table, text_or_empty
from .components import components

#: Nodes of a tile's block, where one of so many shingles counts as two, and bits of a signature.
TILE, HEAVY, BITS = 1024, 1000, 1024
#: Most first lanes that two sets may share; a third of all pairs of 10**13 sets would be needed for as many.
CLASHES = 100_000

CANDIDATES = "shingle long, node long, slack int, low boolean"
SETS = "node long, n long, shingles binary, bits binary"


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two lanes of a digest of a sorted set, as signed 64-bit values."""
    out = []
    for mixer, seed in ((tb.mix, 0x632BE59BD9B4E019), (tb.mix_other, 0x9E6C63D0876A9A47)):
        total = int(mixer(s + np.uint64(seed)).sum(dtype=np.uint64)) + seed * len(s)
        out.append(int(mixer(np.array([total & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def _node(s: np.ndarray, clashes: frozenset[int]) -> int:
    first, second = _digests(s)
    return second if first in clashes else first


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part, data, offsets in tb.steps(batch, "text"):
            yield part, list(tb.shingle_sets(tb.words(data, offsets), k))


def signature(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bit i is the parity of the number of shingles hashed to i: a flipped bit needs a shingle on one side only."""
    count = np.bincount((tb.mix(s ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8))


def nodes_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, node, other, n_shingles): both lanes of each row's set; null for an empty one."""

    def made(batches):
        for part, sets in _sets(batches, k):
            named = [_digests(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), *[pa.array([x[i] for x in named], pa.int64()) for i in (0, 1)], pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "node", "other", "n_shingles"]
            )

    return arrow(docs.select("text", "doc_id", "key"), made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, node long, other long, n_shingles long")


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def candidates_of(docs: DataFrame, k: int, percent: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(shingle, node, slack, low): the shingles that each set's prefix can draw from. These are all that are below a
    limit (twice the share of a prefix, so that a prefix mostly finds enough of them), and where they are too few the
    next ones in hash order. slack is by how many they exceed the prefix."""
    limit = np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100))

    def made(batches):
        for _, sets in _sets(batches, k):
            of = {_node(s, clashes): s for s in sets if len(s)}
            if not of:
                continue
            low = np.array([int(np.searchsorted(s, limit)) for s in of.values()])
            need = np.array([prefix_length(len(s), percent) for s in of.values()])
            size = np.maximum(low, need)
            shingle = np.concatenate([s[:n] for s, n in zip(of.values(), size)])
            slack = np.repeat((size - need).astype(np.int32), size)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(np.repeat(np.fromiter(of, dtype=np.int64, count=len(of)), size)), pa.array(slack), pa.array(shingle < limit)], ["shingle", "node", "slack", "low"])

    return arrow(docs.select("text"), made, CANDIDATES)


def hubs_of(docs: DataFrame, k: int, percent: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(node, hub, shared): star edges that tie all nodes whose prefixes share a shingle, and how many such shingles; of
    documents with distinct sets.

    The order of shingles puts those of one node first, as they meet no other, then the others by how many nodes have
    them, then those above the limit. So what a prefix takes of shared shingles is what its unshared ones leave over.
    """
    # shingled twice, as writing all rows down would cost more than that
    heads = durable(_heads(candidates_of(docs, k, percent, clashes)))
    hub = heads.groupBy("shingle").agg(F.min("node").alias("hub"))
    return heads.join(hub, "shingle").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))


def _heads(rows: DataFrame) -> DataFrame:
    """(shingle, node): what prefixes hold of shared shingles."""
    shared = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("times")).where("a < b").select("shingle", "times")
    own = Window.partitionBy("node")
    met = rows.join(shared, "shingle").withColumn("place", F.row_number().over(own.orderBy(F.desc("low"), "times", "shingle"))).withColumn("met", F.count("*").over(own))
    return met.where(F.col("place") <= F.col("met") - F.col("slack")).select("shingle", "node")


def sets_of(docs: DataFrame, k: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    def made(batches):
        for _, sets in _sets(batches, k):
            full = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s, clashes) for s in full], pa.int64()), pa.array([len(s) for s in full], pa.int64()), pa.array([s.tobytes() for s in full], pa.binary()), pa.array([signature(s).tobytes() for s in full], pa.binary())],
                ["node", "n", "shingles", "bits"],
            )

    return arrow(docs.select("text"), made, SETS)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tile_links(tile: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the tile's rows (node, n, side, comp, shingles, bits), where rows of one comp
    are connected already; if both sides occur, of the links between sides."""
    tile = tile.sort_values(["n", "node"], kind="stable")
    node, n, side = tile["node"].to_numpy(), tile["n"].to_numpy(), tile["side"].to_numpy()
    bits = np.stack([np.frombuffer(x, dtype=np.uint64) for x in tile["bits"]])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in tile["shingles"]]
    both = bool((side != side[0]).any())
    root, links = np.unique(tile["comp"].to_numpy(), return_inverse=True)[1], []
    # the larger of a pair has at most n * 100 / percent shingles
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n) - 1):
        a, b = i + 1, int(last[i])
        if a >= b:
            continue
        apart = np.bitwise_count(bits[a:b] ^ bits[i]).sum(axis=1, dtype=np.int64)
        size = n[a:b] + n[i]
        most = (size - apart) // 2
        near = (100 * most >= percent * (size - most)) & (root[a:b] != root[i])
        if both:
            near &= side[a:b] != side[i]
        for j in (np.flatnonzero(near) + a).tolist():
            if root[j] == root[i]:
                continue
            shared = overlap(sets[i], sets[j])
            if 100 * shared >= percent * (n[i] + n[j] - shared):
                links.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return links


def _found(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within the tiles (tile, cluster, node, n, side, comp, shingles, bits)."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x for _, one in rows.groupby("cluster") for x in tile_links(one, percent)], columns=["a", "b"], dtype="int64")

    return tiles.select("tile", "cluster", "node", "n", "side", "comp", "shingles", "bits").groupBy("tile").applyInPandas(found, "a long, b long")


def _counted(to: str) -> Column:
    """0 to a column less one."""
    return F.when(F.col(to) > 0, F.sequence(F.lit(0).cast("long"), F.col(to) - 1)).otherwise(F.array().cast("array<bigint>"))


def _small_tiles(members: DataFrame, weight: float, tile: int) -> DataFrame:
    """One tile for each cluster, where clusters share groups, as a group costs more than their few rows."""
    groups = max(1, int(2 * weight // tile))
    return members.withColumn("tile", F.concat_ws(":", F.lit("whole"), F.pmod(F.xxhash64("cluster"), F.lit(groups)))).withColumn("side", F.lit(0)).withColumn("comp", F.col("node"))


def _star_tiles(members: DataFrame, tile: int) -> DataFrame:
    """Tiles of a hub (side 0) and some of the nodes that share most with it."""
    stars = durable(members.where("hub is not null").groupBy("hub").agg(F.ceil(F.sum(_weight()) / tile).cast("long").alias("salts")))
    named = lambda at: F.concat_ws(":", F.lit("star"), F.col("hub"), at)
    own = members.join(stars, "hub").select("*", named(F.pmod(F.xxhash64("node"), F.col("salts"))).alias("tile"), F.lit(1).alias("side"))
    hubs = members.drop("hub").join(stars.withColumnRenamed("hub", "of"), F.col("node") == F.col("of")).withColumnRenamed("of", "hub")
    spread = hubs.withColumn("at", F.explode(_counted("salts"))).select("*", named(F.col("at")).alias("tile"), F.lit(0).alias("side"))
    columns = [*members.columns, "tile", "side"]
    return own.select(columns).union(spread.select(columns)).withColumn("comp", F.col("node"))


def _weight() -> Column:
    return 1 + F.col("n") / HEAVY


def _rest_tiles(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Tiles that compare all nodes but those of a cluster's largest component (``main``) with each other and with these,
    within bands of size and between neighbouring ones. members: (cluster, node, n, comp, main, ...)."""
    ratio = math.log(100.0 / percent * 1.001)
    sized = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("long"))
    blocks = lambda of: F.ceil(F.coalesce(F.sum(F.when(of, _weight())), F.lit(0)) / tile).cast("long")
    counts = durable(sized.groupBy("cluster", "band").agg(blocks(~F.col("main")).alias("rest_0"), blocks(F.col("main")).alias("main_0")))
    plan = counts
    for by, name in ((-1, "1"), (1, "-1")):
        plan = plan.join(counts.select("cluster", (F.col("band") + by).alias("band"), F.col("rest_0").alias(f"rest_{name}"), F.col("main_0").alias(f"main_{name}")), ["cluster", "band"], "left")
    plan = durable(plan.fillna(0))
    blocks_own = F.when(F.col("main"), F.col("main_0")).otherwise(F.col("rest_0"))
    met = sized.join(small_side(plan, plan.count()), ["cluster", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), blocks_own))

    def named(low_band, low_main, i, high_band, high_main, j):
        return F.concat_ws(":", F.col("cluster"), low_band, low_main, i, high_band, high_main, j)

    def tiles(step: int, main: bool) -> Column:
        """Of a row, with the blocks of the band ``step`` above, of the largest component or of the rest."""
        mine, band, other = F.col("main"), F.col("band"), F.lit(main)
        low = F.lit(step > 0) | (F.lit(step == 0) & (mine < other))
        same = F.lit(step == 0) & (mine == other)

        def one(j: Column) -> Column:
            within = named(band, mine, F.least(F.col("own"), j), band, mine, F.greatest(F.col("own"), j))
            up, down = named(band, mine, F.col("own"), band + step, other, j), named(band + step, other, j, band, mine, F.col("own"))
            side = F.when(same, F.when(F.col("own") <= j, 0).otherwise(1)).otherwise(F.when(low, 0).otherwise(1))
            return F.struct(F.when(same, within).when(low, up).otherwise(down).alias("tile"), side.alias("side"))

        empty = F.array().cast("array<struct<tile:string,side:int>>")
        out = F.transform(_counted(("main_" if main else "rest_") + str(step)), one)
        return F.when(mine, empty).otherwise(out) if main else out

    at = F.concat(*[tiles(step, main) for step in (0, 1, -1) for main in (False, True)])
    return met.withColumn("at", F.explode(at)).withColumn("tile", F.col("at.tile")).withColumn("side", F.col("at.side"))


def _large_links(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links of clusters that are more than one tile."""
    stars = durable(_found(_star_tiles(members, tile), percent))
    met = members.drop("hub").join(components(stars).withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    met = durable(met)
    sizes = met.groupBy("cluster", "comp").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"))
    rest = met.join(sizes, "cluster").withColumn("main", F.col("comp") == F.col("largest")).drop("largest")
    return stars.union(_found(_rest_tiles(rest, percent, tile), percent))


def links_of(docs: DataFrame, stands: DataFrame, k: int, percent: int, tile: int = TILE, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(a, b): links between nodes that connect what is connected. ``stands`` has the row (doc_id, key) that stands for
    each node; of ``docs`` (doc_id, key, text) only these are read."""
    same = (F.col("doc_id").eqNullSafe(F.col("of_id"))) & (F.col("key") == F.col("of_key"))
    named = [F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")]
    edges = durable(hubs_of(docs, k, percent, clashes))
    clusters = components(edges.select(F.col("node").alias("a"), F.col("hub").alias("b"))).select("node", F.col("root").alias("cluster"))
    best = edges.groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    known = durable(clusters.join(best, "node", "left").join(stands, "node"))
    if not (n := known.count()):
        return docs.sparkSession.createDataFrame([], "a long, b long")
    picked = docs.join(small_side(known.select(*named), n), same, "left_semi")
    members = durable(sets_of(picked, k, clashes).dropDuplicates(["node"]).join(small_side(known.select("node", "cluster", "hub"), n), "node"))
    weights = durable(members.groupBy("cluster").agg(F.sum(_weight()).alias("weight")))
    large = weights.where(F.col("weight") > tile).select("cluster")
    m = large.count()
    small = members.join(small_side(large, m), "cluster", "left_anti") if m else members
    links = _found(_small_tiles(small, weights.agg(F.sum("weight")).first()[0] or 0.0, tile), percent)
    return links.union(_large_links(members.join(small_side(large, m), "cluster"), percent, tile)) if m else links


def _groups(docs: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id and stays (whether the row stands for its group) of each row."""
    docs = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), "text")
    nodes = durable(nodes_of(docs, k))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row")

    def by_node(rows: DataFrame) -> DataFrame:
        return durable(rows.where("node is not null").groupBy("node").agg(F.min("other").alias("p"), F.max("other").alias("q"), row))

    stands = by_node(nodes)
    clashes = frozenset(r["node"] for r in stands.where("p <> q").select("node").limit(CLASHES + 1).collect())
    if len(clashes) > CLASHES:
        raise RuntimeError("too many sets share a first digest")
    if clashes:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("other")).otherwise(F.col("node")))
        stands = by_node(nodes)
    stands = stands.select("node", "row.doc_id", "row.key")
    # of equal sets only the row that stands for them is compared; which rows go, in a table of these few
    full = nodes.where("node is not null").join(stands.withColumnsRenamed({"doc_id": "of_id", "key": "of_key"}), "node")
    is_copy = ~(F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    copies = durable(full.where(is_copy).select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")).distinct())
    distinct = docs.join(small_side(copies, copies.count()), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_anti")
    roots = components(links_of(distinct, stands, k, percent, tile, clashes))
    met = durable(stands.join(roots, "node", "left").select("node", "doc_id", "key", F.coalesce("root", "node").alias("root")))
    of_root = met.groupBy("root").agg(row)
    of_node = met.select("node", "root").join(of_root, "root").select("node", "row")
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("key") == F.col("row.key"))
    full = nodes.where("node is not null").join(of_node, "node").select("doc_id", "key", "n_shingles", F.col("row.doc_id").alias("component_id"), same.alias("stays"))
    return full.union(nodes.where("node is null").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def jaccard_groups(docs: DataFrame, k: int, percent: int, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for each row of ``docs`` (doc_id, text)."""
    return in_scope(docs.sparkSession, lambda: _groups(docs, k, percent, tile)).select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all columns, of each group of near duplicates the one with the least doc_id."""
    away = in_scope(docs.sparkSession, lambda: _groups(docs, k, percent, TILE).where("not stays").select("doc_id", "key").distinct())
    named = away.select(F.col("doc_id").alias("away_id"), F.col("key").alias("away_key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"), F.col("doc_id").alias("own_id"), F.xxhash64(text_or_empty()).alias("own_key"))
    return whole.join(small_side(named, away.count()), F.col("own_id").eqNullSafe(F.col("away_id")) & (F.col("own_key") == F.col("away_key")), "left_anti").select("own_row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM w
), e AS (
  SELECT r, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.r < b.r GROUP BY a.r, b.r
), l AS (
  SELECT x, y FROM p JOIN s a ON a.r = x JOIN s b ON b.r = y WHERE 100 * shared >= 90 * (len(a.shingles) + len(b.shingles) - shared)
), reach AS (
  SELECT r AS x, r AS y FROM s
  UNION
  SELECT reach.x, z.y FROM reach JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) z ON z.x = reach.y
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN reach ON reach.x = s.r JOIN s t ON t.r = reach.y GROUP BY s.r, s.doc_id, len(s.shingles)
"""
