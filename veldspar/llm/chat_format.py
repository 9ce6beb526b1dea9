"""Chat formatting of reply trees.

Messages are nodes that point to the message they reply to. Paths from leaves to roots are found by iterative
self-joins that double their reach: after round i every node knows its ancestor 2**i replies above, and every leaf
2**i of its path's nodes, so a path of d messages takes log2(d) rounds and the rows written are the paths themselves.
Branches of a tree are ranked by the sum of their messages' scores, and the chosen ones are formatted as one
conversation each.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Within roles and texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|`` (in roles a line feed also becomes ``\\n``), so a control string in the output is always the template's own,
and ``unescaped`` restores any text. The loss mask is the spans of the texts of the trained role.

Defined results: null texts and roles are empty; rows that share a conversation and a turn follow each other in order of
role and text; a null conversation or turn is a value that sorts first; a reply to a missing message starts a tree; messages
that reply to each other in a circle, and those that reply to these, belong to no tree; an empty table gives an empty result; extra columns are
ignored. A conversation is one row of output, and so gathered in one task; its messages alone bound that task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, in_scope, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescaped_role(role: Column) -> Column:
    """A backslash before n is a line feed, before anything else it is dropped."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, up) for every node on the way from each leaf to its root, ``up`` replies above the leaf; of nodes
    (node, parent) with unique non-null nodes. Nodes whose way never ends are left out."""
    ids = nodes.select(F.col("node").alias("parent"))
    jumps = [durable(nodes.select("node", "parent").join(ids, "parent", "left_semi").select("node", F.col("parent").alias("above")))]
    n = jumps[0].count()  # no way has more replies
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= n:
        jumps.append(durable(jumps[-1].alias("a").join(jumps[-1].alias("b"), F.col("a.above") == F.col("b.node")).select("a.node", "b.above")))
    # what still has a node so far above it goes round in a circle, or replies to one that does
    endless = jumps.pop().select("node")
    circles = bool(jumps) and not endless.isEmpty()
    all_nodes = nodes.select("node").join(endless, "node", "left_anti") if circles else nodes.select("node")
    above = jumps[0].select(F.col("above").alias("node")).distinct() if jumps else endless
    way = durable(all_nodes.join(above, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for i, jump in enumerate(jumps):
        way = durable(way.union(way.join(jump, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << i)).alias("up"))))
    return way


def conversations(nodes: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """The best ``branches`` paths of each tree of messages (node, parent, tree, role, text, score), formatted.

    Returns tree, branch (rank from 1), leaf, n_turns, formatted, and spans: for each trained turn its number (from 0),
    the place and length of its text within its block, and its place in ``formatted``, in code points.
    """
    way = paths(nodes.select("node", "parent"))
    # branches are ranked by scores alone; texts meet only the paths that are chosen
    total = way.join(nodes.select("node", "tree", "score"), "node").groupBy("leaf").agg(F.min("tree").alias("tree"), F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    ranked = total.select("leaf", "tree", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")).alias("branch"))
    chosen = way.join(ranked.where(F.col("branch") <= branches), "leaf").join(nodes.select("node", "role", "text"), "node")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n")), escaped(text)
    turns = chosen.select("tree", "branch", "leaf", "up", head.alias("head"), body.alias("body"), (role == trained).alias("loss")).withColumn(
        "block", F.concat("head", "body", F.lit(CLOSE + "\n"))
    )
    order = Window.partitionBy("leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.length("block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = turns.withColumn("turn", F.row_number().over(order) - 1).withColumn("at", before)
    place = F.length("head").cast("long")
    size = F.length("body").cast("long")
    span = F.struct("turn", place.alias("begin"), size.alias("length"), (F.col("at") + place).alias("start"), (F.col("at") + place + size).alias("end"))
    rows = placed.groupBy("leaf").agg(
        F.min("tree").alias("tree"), F.min("branch").alias("branch"), F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("blocks"), F.array_sort(F.collect_list(F.when(F.col("loss"), span))).alias("spans"),
    )
    return rows.select("tree", "branch", "leaf", "n_turns", F.array_join("blocks.block", "").alias("formatted"), "spans")


def read_back(rows: DataFrame) -> DataFrame:
    """Add turns (role, text, unescaped) and loss_text (unescaped text under the mask), parsed from formatted and spans."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    out = rows.withColumn("parts", F.slice(blocks, F.lit(1), F.size(blocks) - 1))
    inner = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    head = lambda p: F.substring_index(inner(p), "\n", 1)
    turn = lambda p: F.struct(unescaped_role(head(p)).alias("role"), unescaped(F.substring(inner(p), F.length(head(p)) + 2, F.length(p))).alias("text"))
    masked = F.transform("spans", lambda s: unescaped(F.substring(F.element_at("parts", s["turn"] + 1), (s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return out.withColumn("turns", F.transform("parts", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("parts")


def chains(rows: DataFrame) -> DataFrame:
    """Messages (node, parent, tree, role, text, score) of conversations (conv_id, turn, role, text): each turn replies
    to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = durable(rows.select("conv_id", "role", "text", F.row_number().over(order).alias("i")))
    key = lambda i: F.concat(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")), F.lit(":"), i)
    return numbered.select(key(F.col("i")).alias("node"), F.when(F.col("i") > 1, key(F.col("i") - 1)).alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(0.0).alias("score"))


def digests(rows: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rows).select(
        F.col("tree").alias("conv_id"), F.col("n_turns").cast("long"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return in_scope(spark, lambda: digests(conversations(chains(rows.union(own)))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
