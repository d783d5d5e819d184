"""Chat formatting of reply trees.

Posts point to the post they answer.  Pointer doubling - self-joins that double
the reach each time - finds every leaf's path to its root and the score of that
path; branches rank by score, and each chosen path becomes one conversation.
A thread of n posts takes about 2 log2(n) joins of ids; texts move once.

Template, one turn: ``### role: text</turn>`` and a newline.  Inside texts
``\\``, ``#`` and ``<`` are written ``\\b``, ``\\h`` and ``\\l`` (roles also
write ``:`` as ``\\c``), so no control string can stand in a text and every
text reads back unchanged.

Defined results: null roles and texts are empty; a post whose parent is missing
is a root; posts on or behind a cycle lie on no root-to-leaf path and are left
out; of equal scores the longer path wins, then the larger leaf; rows without a
conversation id form a conversation of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    out = text
    for plain, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def linear(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn lists as reply trees: each turn answers the one before it; equal
    turn numbers follow each other by role and text."""
    w = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    node = F.row_number().over(w).cast("bigint")
    return rows.withColumn("node", node).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def format_trees(nodes: DataFrame, score: str | None = None, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """``nodes``: conv, node, parent, role, text and perhaps a score column (1 a
    post without one).  Returns conv, branch (1 is best), score, ``formatted``
    and ``loss``: [start, end) code points of the texts that are learned."""
    keyed = nodes.select(F.to_json(F.struct("conv")).alias("key"), "node", "parent", *([F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("own")] if score else [F.lit(1.0).alias("own")]))
    # a parent that does not exist is none
    links = keyed.alias("a").join(keyed.select("key", F.col("node").alias("parent"), F.lit(1).alias("there")).distinct().alias("b"), ["key", "parent"], "left")
    step = materialize(links.select("key", "node", F.when(F.col("there") == 1, F.col("parent")).alias("up"), F.col("own").alias("sum"), F.lit(1).cast("bigint").alias("n")), "chat-links")
    parents = step.where("up is not null").select("key", F.col("up").alias("node")).distinct()
    leaves = step.join(parents, ["key", "node"], "left_anti").select("key", "node")
    largest = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    # a round moves only the posts whose pointer has not passed the root yet
    ended = step.where("up is null")
    active = step.where("up is not null")
    jumps = [active]
    while 1 << (len(jumps) - 1) < largest and not active.isEmpty():
        above = active.unionByName(ended).select("key", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        moved = materialize(active.join(above, ["key", "up"]).select("key", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n")), "chat-jumps")
        ended = ended.unionByName(moved.where("up is null"))
        active = moved.where("up is not null")
        jumps.append(active)
    ranked = leaves.join(ended, ["key", "node"])
    order = W.partitionBy("key").orderBy(F.desc("sum"), F.desc("n"), F.desc("node"))
    if branches == 1:
        best = ranked.groupBy("key").agg(F.max(F.struct("sum", "n", "node")).alias("b")).select("key", F.lit(1).alias("branch"), F.col("b.sum").alias("score"), F.col("b.node").alias("leaf"))
    else:
        best = ranked.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches).select("key", "branch", F.col("sum").alias("score"), F.col("node").alias("leaf"))
    path = best.select("key", "branch", "score", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("dist"))
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select("key", "node", "up")
        path = materialize(path.unionByName(path.join(up, ["key", "node"]).select("key", "branch", "score", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))), "chat-paths")
    posts = nodes.select("conv", F.to_json(F.struct("conv")).alias("key"), "node", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = path.join(posts, ["key", "node"]).groupBy("conv", "key", "branch", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))
    # every turn: head, body and tail, then where its body lies
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(COLON)).alias("head"), escape(t["text"]).alias("body")))
    laid = turns.withColumn("parts", parts)
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(
        F.col("sizes"),
        zero,
        lambda acc, s: F.struct((acc["at"] + s["head"] + s["body"] + len(CLOSE)).cast("bigint").alias("at"), F.concat(acc["starts"], F.array((acc["at"] + s["head"]).cast("bigint"))).alias("starts")),
        lambda acc: acc["starts"],
    )
    laid = laid.withColumn("sizes", sizes).withColumn("starts", starts)
    spans = F.filter(
        F.zip_with("parts", "starts", lambda p, s: F.struct(p["role"].alias("role"), s.alias("start"), (s + F.length(p["body"])).cast("bigint").alias("end"))),
        lambda x: x["role"] == loss_role,
    )
    return laid.select(
        "conv",
        "branch",
        "score",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, ``turns`` (role, text) and ``loss_text`` from the formatted text alone."""
    cut = F.filter(F.split(F.col("formatted"), "</turn>\n"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), COLON, 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, F.lit(COLON)) + len(COLON))).alias("text"),
    )
    return formatted.select("*", F.transform(cut, turn).alias("turns"), F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss_texts"))
