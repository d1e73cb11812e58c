"""Conversations out of reply trees.

Messages name the message they reply to. Self-joins that double their reach
list the ancestors of every leaf: after k rounds all those less than 2^k steps
away, so the rounds grow with the logarithm of the depth. Each root-to-leaf
path gets the sum of its messages' scores, paths are ranked within their tree,
and the chosen ones are written as one text each.

The template is ``<|turn|>role``, a line feed, the text, ``<|end|>`` and a line
feed for each turn. Inside roles and texts a backslash, ``<`` and ``[`` are
written as a backslash and a letter, so no control string of this template, of
bracketed instruction templates or of tag-like templates can occur there; roles
also lose their line feeds so. The way back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

TURN, END = "<|turn|>", "<|end|>\n"
#: In the order of escaping; the way back takes them in reverse.
CODES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b")]
ROLE_CODES = [*CODES, ("\n", "\\n")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), codes, text)


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), codes[::-1], text)


def paths(messages: DataFrame, tree: str = "tree_id", node: str = "msg_id", parent: str = "parent_id") -> DataFrame:
    """(tree, leaf, node, up) for every message on the way from a leaf (up 0) to its root.

    A message is a root if its parent is null, itself, or not in its tree, and
    a leaf if no other message replies to it. Messages without an id are left
    out, a repeated id counts once with its least parent; what hangs on a cycle
    has no root and is left out. A null tree id is a tree like any other. A
    tree of d levels takes log2(d) rounds; the rows are one for each message on
    each path, so a wide tree gives as many paths as it has leaves.
    """
    rows = messages.where(F.col(f"`{node}`").isNotNull()).groupBy(F.col(f"`{tree}`").alias("t"), F.col(f"`{node}`").alias("n")).agg(F.min(F.col(f"`{parent}`")).alias("p"))
    rows = durable(rows)
    most = rows.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    same = "a.t <=> b.t AND a.p = b.n"
    ups = durable(rows.where("p IS NOT NULL AND p <> n").alias("a").join(rows.alias("b"), F.expr(same), "left_semi").select("t", "n", "p"))
    leaves = rows.alias("a").join(ups.alias("b"), F.expr("a.t <=> b.t AND a.n = b.p"), "left_anti").select("t", F.col("n").alias("leaf"), "n", F.lit(0).cast("long").alias("up"))
    roots = rows.alias("a").join(ups.alias("b"), F.expr("a.t <=> b.t AND a.n = b.n"), "left_anti").select("t", "n")
    reach, step = durable(leaves), 1
    while step <= most and not ups.isEmpty():
        further = reach.alias("a").join(ups.alias("b"), F.expr("a.t <=> b.t AND a.n = b.n")).select("a.t", "a.leaf", F.col("b.p").alias("n"), (F.col("a.up") + step).alias("up"))
        reach = durable(reach.unionByName(further))
        ups = durable(ups.alias("a").join(ups.alias("b"), F.expr("a.t <=> b.t AND a.p = b.n")).select("a.t", "a.n", "b.p"))
        step *= 2
    whole = reach.alias("a").join(roots.alias("b"), F.expr("a.t <=> b.t AND a.n = b.n"), "left_semi").select("t", "leaf").distinct()
    kept = reach.alias("a").join(whole.alias("b"), F.expr("a.t <=> b.t AND a.leaf = b.leaf"), "left_semi")
    return kept.select(F.col("t").alias(tree), F.col("leaf"), F.col("n").alias(node), "up")


def conversations(messages: DataFrame, tree: str = "tree_id", node: str = "msg_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = "score", branches: int | None = None, learn_from: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans.

    ``branches``: how many paths of a tree, by descending score and then leaf;
    None takes all. ``loss_spans``: (start, length) in code points of
    ``formatted`` for the text of each turn whose role is ``learn_from``.
    Null roles and texts are empty, null scores zero; of rows that repeat an id
    the least (role, text) counts. An empty table gives no rows. Other columns
    are ignored. A path becomes one text, so it must fit in the memory of a task.
    """
    lines = paths(messages, tree, node, parent).select(F.col(tree).alias("t"), "leaf", F.col(node).alias("n"), "up")
    value = F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    said = messages.select(F.col(f"`{tree}`").alias("t"), F.col(f"`{node}`").alias("n"), F.struct(F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), value.alias("score")).alias("m"))
    said = said.where("n IS NOT NULL").groupBy("t", "n").agg(F.min("m").alias("m"))
    turns = lines.alias("a").join(said.alias("b"), F.expr("a.t <=> b.t AND a.n = b.n")).select("a.t", "a.leaf", "a.up", "b.m.*")
    if branches is not None:
        ranked = turns.groupBy("t", "leaf").agg(F.sum("score").alias("s")).select("t", "leaf", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "leaf")).alias("r"))
        turns = turns.alias("a").join(ranked.where(F.col("r") <= branches).alias("b"), F.expr("a.t <=> b.t AND a.leaf = b.leaf"), "left_semi")
    head = F.concat(F.lit(TURN), escape(F.col("role"), ROLE_CODES), F.lit("\n"))
    turns = turns.select("t", "leaf", "up", "role", "score", head.alias("head"), escape(F.col("text")).alias("body"))
    so_far = Window.partitionBy("t", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.select("t", "leaf", "up", "score", F.concat("head", "body", F.lit(END)).alias("part"), F.when(F.col("role") == learn_from, F.struct((F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))
    whole = turns.groupBy("t", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "part", "span"))).alias("x"), F.sum("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("branch_score"), "leaf"))
    return whole.select(
        F.col("t").alias(tree), "leaf", rank.alias("branch_rank"), "branch_score", F.size("x").cast("long").alias("n_turns"),
        F.array_join(F.col("x.part"), "").alias("formatted"), F.filter(F.col("x.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substring(part, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        return F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(F.substring(part, at + 1, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
