"""Prefix tries of conversations: which beginnings are shared, by how many, and what sharing them saves.

A conversation is a sequence of turns, a turn the digest of its role and text. Equal sequences become one row with their
number of conversations. The rows are dealt to subtries by the digest of their first turn. A subtrie of more than
``LIMIT`` different sequences is opened: its top is a node of the spine, and its rows are dealt anew by their next turn,
again and again. What is left are small subtries; they go to buckets by hash, and a task builds a bucket's tries in
memory, with a dictionary of pointers at each node, and sums them in postorder with a stack of its own, so that no depth
of conversation matters. The spine's sums are then joined from below, one round after the other.

So a first turn that any share of all conversations begins with is spread over tasks, and a sequence that any number of
conversations repeat is one row. The digest of a node's conversations needs their ids in order: these come as blocks of
joined ids from sorted ranges, so that the last step reads a few bytes for each id and holds one block. There are as many
rounds as turns in the longest beginning that more than ``LIMIT`` different conversations share.

Defined results: null roles and texts are empty; turns are in order of ``turn`` (null first), those of one turn in order
of role, then of their digest; rows with a null conversation take no part; repeated rows are turns of their own;
conversations without turns are members of the root; an empty table gives an empty result; extra columns are ignored. A
conversation is one row of digests, so its number of turns (not its text) bounds a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_TEXTS, arrow, durable, in_scope, small_side, table

#: Most different sequences of a subtrie that is built in one piece, and turns of a bucket of subtries.
LIMIT, BUCKET = 200, 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
NODES = "level int, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [x.split()[0] for x in NODES.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(text: Column) -> Column:
    """SHA-256 in 44 characters."""
    return F.base64(F.unhex(F.sha2(text, 256)))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text); turns are structs of digest and words, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", role.alias("role"), _digest(told).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t"))
    ordered = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns are those of the family's first conversation, h below ``shared`` by hash."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = convs.where(F.col("conv_id") == first).select(F.col("conv_id").alias("first"), F.slice("turns", 1, shared - 1).alias("head"))
    met = convs.withColumn("first", first).withColumn("h", h).join(heads, "first", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def joined_ids(rows: DataFrame) -> DataFrame:
    """(full, ends): SHA-256 of the comma-joined ids, in order, of each ``full``; of rows (full, conv_id).

    Sorted ranges of all rows give blocks of joined ids, so a value that most rows have is cut into many blocks; the last
    step reads a value's blocks in order, one at a time.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            full, ids = batch.column(0), batch.column(1).to_pylist()
            new = pc.not_equal(full[1:], full[:-1]).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            cuts = [0, *new.tolist(), len(ids)]
            text = [",".join(map(str, ids[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([full.take(pa.array(cuts[:-1])), pa.array([ids[a] for a in cuts[:-1]], pa.int64()), pa.array(text)], ["full", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for full, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if full == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = full, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["full", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["full", "ends"])

    cut = arrow(rows.select("full", "conv_id").repartitionByRange("full", "conv_id").sortWithinPartitions("full", "conv_id"), blocks, "full string, first long, ids string")
    return arrow(cut.repartition("full").sortWithinPartitions("full", "first"), hashed, "full string, ends string")


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, turns): one row for all conversations of a sequence, with the smallest id, their number and the
    digest of their ids."""
    named = durable(convs.withColumn("full", _digest(F.array_join("turns.digest", ""))))
    groups = durable(named.groupBy("full").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns")))
    many = groups.where("n > 1").select("full")
    # an id that stands alone is hashed where it is
    copies = named.select("full", "conv_id").join(small_side(many, many.count(), BROADCAST_TEXTS), "full", "left_semi")
    met = groups.join(joined_ids(copies), "full", "left")
    return met.select("conv_id", "n", F.coalesce("ends", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"), "turns")


def tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some subtries, from rows (key, parent_key, level, depth, conv_id, n, ends, digests, words), where digests
    begin with the top's turn. A top has its level and parent's key, every other node its parent's smallest member."""
    tops: dict[str, int] = {}
    kids: list[dict[str, int]] = []
    words, members, least, ends, parent, depth, origin = [], [], [], [], [], [], []

    def add(w: int, d: int, above: int, of: tuple) -> int:
        for column, x in ((kids, {}), (words, w), (members, 0), (least, None), (ends, NO_ENDS), (parent, above), (depth, d), (origin, of)):
            column.append(x)
        return len(kids) - 1

    for key, parent_key, level, d, conv, n, end, digests, w in zip(*(pdf[c] for c in ("key", "parent_key", "level", "depth", "conv_id", "n", "ends", "digests", "words"))):
        node = tops.get(key)
        if node is None:
            node = tops[key] = add(int(w[0]), d, -1, (level, parent_key))
        for i, digest in enumerate(digests):
            if i:
                child = kids[node].get(digest)
                if child is None:
                    child = kids[node][digest] = add(int(w[i]), d + i, node, (None, None))
                node = child
            members[node] += n
            least[node] = conv if least[node] is None else min(least[node], conv)
        ends[node] = end

    leaves, saved = [0] * len(kids), [0] * len(kids)
    stack = [(node, False) for node in tops.values()]
    while stack:
        node, is_summed = stack.pop()
        if is_summed:
            leaves[node] = sum(leaves[c] for c in kids[node].values()) or 1
            saved[node] = (members[node] - 1) * words[node] + sum(saved[c] for c in kids[node].values())
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in kids[node].values())
    rows = [
        (*origin[i], least[i], depth[i], least[parent[i]] if parent[i] >= 0 else None, members[i], len(kids[i]), leaves[i], saved[i], ends[i]) for i in range(len(kids))
    ]
    out = pd.DataFrame(rows, columns=NODE_COLUMNS)
    return out.astype({"level": "Int32", "parent_conv_id": "Int64"})


def trie(convs: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, turns), the root included."""
    spark = convs.sparkSession
    whole = durable(distinct_sequences(convs))
    turns = whole.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
    rest = whole.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("long").alias("depth"), "conv_id", "n", "ends", "turns")
    spines: list[DataFrame] = []
    small: list[DataFrame] = []
    while True:  # all rows of ``rest`` are below tops that are opened
        own = F.element_at("turns", F.greatest(F.col("depth"), F.lit(1)).cast("int"))["words"]
        is_end = F.size("turns") == F.col("depth")
        spines.append(durable(rest.groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.coalesce(F.max(F.when(is_end, F.col("ends"))), F.lit(NO_ENDS)).alias("ends"), F.coalesce(F.max(F.when(F.col("depth") > 0, own)), F.lit(0)).alias("words"),
        )))
        turn = F.element_at("turns", (F.col("depth") + 1).cast("int"))["digest"]
        below = rest.where(~is_end).select(_digest(F.concat("key", turn)).alias("key"), F.col("key").alias("parent_key"), (F.col("depth") + 1).alias("depth"), "conv_id", "n", "ends", "turns")
        large = durable(below.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select("key"))
        opened = large.count()
        to_open = small_side(large, opened, BROADCAST_TEXTS)
        small.append((below.join(to_open, "key", "left_anti") if opened else below).withColumn("level", F.lit(len(spines) - 1)))
        if not opened:
            break
        rest = durable(below.join(to_open, "key", "left_semi"))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), turns // bucket)
    tail = F.slice("turns", F.col("depth").cast("int"), F.size("turns"))
    dealt = reduce(DataFrame.union, small).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "parent_key", "level", "depth", "conv_id", "n", "ends", tail["digest"].alias("digests"), tail["words"].alias("words")
    )
    found = durable(dealt.groupBy("bucket").applyInPandas(tries, NODES))
    done: list[DataFrame] = []
    for level in reversed(range(len(spines))):
        kids = found.where(F.col("level") == level)
        kids = kids.unionByName(done[-1].drop("key")) if done else kids
        sums = kids.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
        done.append(durable(spines[level].join(sums, "key", "left").select(
            "key", F.lit(level - 1).cast("int").alias("level"), "parent_key", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), own.cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
        )))
    spine = reduce(DataFrame.union, done)
    names = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    tops = found.where("level is not null").unionByName(spine.drop("key")).join(small_side(names, names.count(), BROADCAST_TEXTS), "parent_key", "left")
    nodes = found.where("level is null").unionByName(tops.withColumn("parent_conv_id", F.col("above")).drop("above"))
    return nodes.select(*NODE_COLUMNS[2:])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return in_scope(spark, lambda: trie(rebuilt(durable(sequences(rows)))))


#: CRC-32 of a decimal number, by bits, as DuckDB has no function for it.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)))"""

SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_CRC} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (
  SELECT c.conv_id, o.i, digest, words FROM c JOIN o ON o.conv_id = c.base AND o.i <= h
  UNION ALL SELECT c.conv_id, o.i, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > h
), r AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM s),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS k, CAST(NULL AS VARCHAR) AS above, CAST(0 AS BIGINT) AS words FROM c
  UNION ALL SELECT conv_id, d, string_agg(digest, '') OVER w AS k, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), own AS (SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id),
n AS (
  SELECT k, min(above) AS above, min(d) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (d = last), '')) AS ends_sha256
  FROM p JOIN own USING (conv_id) GROUP BY k
), kids AS (SELECT above AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
sums AS (
  SELECT substr(m.k, 1, 64 * u.j) AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM m, LATERAL (SELECT unnest(range(0, m.depth + 1)) AS j) u GROUP BY 1
)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (k) LEFT JOIN n a ON a.k = m.above AND m.depth > 0
"""
