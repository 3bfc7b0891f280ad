"""Chat formatting of reply trees.

A tree's messages name their parent.  Self-joins that double the distance they cover give every
message its depth and the summed score of its path, leaves are ranked by the mean score of
their root-to-leaf path, and the chosen paths are marked by the same joins in reverse.
Each chosen path becomes one conversation.  Everything is DataFrame operations.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Backslashes in role and text are
doubled and control strings get a backslash behind their first character, so a text can never hold
one; dropping the first of each backslash pair undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiframe.llm.shared import Stored

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"
MESSAGE = ("tree", "node", "parent", "role", "text", "score")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def threads_to_trees(rows: DataFrame, thread: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it.

    Turns are in the order of ``turn`` (null first), then role and text where turns tie.  Repeated rows
    stay turns of their own.
    """
    order = Window.partitionBy(thread).orderBy(F.col(turn).asc_nulls_first(), role, text)
    return rows.select(
        F.col(thread).alias("tree"), F.row_number().over(order).cast("bigint").alias("node"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.lit(1.0).alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).select(*MESSAGE)


def best_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``(tree, path, depth, node)``: the messages on the ``top`` best root-to-leaf paths of each tree.

    ``messages`` has ``(tree, node, parent, role, text, score)``, ``(tree, node)`` unique; of repeated
    rows the first by parent, role and text counts.  A message whose parent is null or absent is a root.
    Paths are ranked by mean score, then by the smaller leaf; ``path`` counts from 1.  Messages on a
    cycle lead to no root and are on no path.  A null score counts as 0.  Null trees are one tree.
    """
    nodes = Stored(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes").frame
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    same_tree = F.col("tree").eqNullSafe(F.col("_t"))
    first = Stored(nodes.join(known, same_tree & (F.col("parent") == F.col("_n")), "left").select(
        "tree", "node", F.col("_n").alias("jump"), F.col("score").alias("sum"), F.lit(1).cast("bigint").alias("depth")), "jumps").frame
    reached, climbing = first.filter("jump is null"), first.filter("jump is not null")
    jumps = []  # the k-th holds (tree, node, ancestor 2^k above) of the messages that are as deep
    most = max(1, nodes.count()).bit_length() + 1
    while len(jumps) < most and not climbing.isEmpty():
        jumps.append(climbing.select("tree", "node", "jump"))
        above = reached.union(climbing).select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("jump").alias("_j"),
            F.col("sum").alias("_s"), F.col("depth").alias("_d"))
        moved = Stored(climbing.join(above, same_tree & (F.col("jump") == F.col("_n"))).select(
            "tree", "node", F.col("_j").alias("jump"), (F.col("sum") + F.col("_s")).alias("sum"),
            (F.col("depth") + F.col("_d")).alias("depth")), "jumps").frame
        reached, climbing = reached.union(moved.filter("jump is null")), moved.filter("jump is not null")
    parents = nodes.filter("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = reached.join(parents, same_tree & (F.col("node") == F.col("_n")), "left_anti")
    if top is None:
        best = leaves.withColumn("path", F.row_number().over(
            Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("depth")), "node")))
        marked = best.select("tree", F.col("path").cast("bigint").alias("path"), "node")
    else:
        ranks = F.slice(F.array_sort(F.collect_list("rank")), 1, top)
        # A bounded heap per tree: partial lists are cut to the best ``top`` before they are joined.
        salted = leaves.withColumn("rank", F.struct((-F.col("sum") / F.col("depth")).alias("s"), "node"))
        part = salted.groupBy("tree", F.pmod(F.xxhash64("node"), F.lit(64)).alias("_salt")).agg(ranks.alias("r"))
        one = part.groupBy("tree").agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, top).alias("r"))
        marked = one.select("tree", F.posexplode("r").alias("path", "rank")).select(
            "tree", (F.col("path") + 1).cast("bigint").alias("path"), F.col("rank.node").alias("node"))
    for jump in reversed(jumps):
        hop = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("jump").alias("_j"))
        marked = Stored(marked.union(
            marked.join(hop, same_tree & (F.col("node") == F.col("_n"))).select("tree", "path", F.col("_j").alias("node"))
        ).distinct(), "marked").frame
    depths = reached.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "depth")
    return marked.join(depths, same_tree & (F.col("node") == F.col("_n"))).select("tree", "path", "depth", "node")


def format_trees(messages: DataFrame, top: int | None = 1, trained: str = "assistant") -> DataFrame:
    """``(tree, path, n_turns, formatted, loss_spans)``, one row per chosen path.

    ``loss_spans`` are ``(start, length)`` in characters of ``formatted``, counted from 0, of the texts of
    role ``trained``.  Null role and text are empty.
    """
    unique = messages.groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    held = Stored(unique, "messages").frame
    paths = best_paths(held, top)
    said = held.select(F.col("tree").alias("_t"), F.col("node").alias("_n"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == trained).alias("trained"))
    turns = (
        paths.join(said, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        .groupBy("tree", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    tail = F.lit(f"{END}\n")
    # The running length places the loss spans.
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + F.length(tail)).alias("at"),
            F.when(t["trained"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("bigint").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "")
    return turns.select("tree", "path", F.size("turns").cast("bigint").alias("n_turns"),
                        text.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """Role and text of each turn, read from a formatted conversation."""
    role = r"(?s)\A([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    body = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")
    return F.transform(body, lambda t: F.struct(
        unescaped(F.regexp_extract(t, role, 1)).alias("role"),
        unescaped(F.regexp_replace(F.regexp_replace(t, role, ""), r"<\|im_end\|>\n\z", "")).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
