"""Chat formatting of reply trees (DataFrame functions only).

Messages form trees: each names its parent. Self-joins double what is known: after round
``k`` a message knows its ancestor ``2 ** k`` steps up and the sum of the scores until there,
so sums over paths of ``d`` messages take ``log2 d`` rounds of the messages that are
deeper than what is known. Leaves are
found by an anti-join and ranked in their tree by the sum of their path's scores (ties: the
longer, then the smaller leaf). Only then the paths of the ``top`` best are enumerated, by the
same jumps: the pairs written are the chosen paths themselves, nothing more. Each becomes one
conversation.

The template marks turns by role::

    user       [INST]text[/INST]        system  [SYS]text[/SYS]
    assistant  <s>text</s>              others  [ROLE]role[:]text[/ROLE]

Control strings inside texts get one backslash behind their first character, and
one that has backslashes there already gets one more, so taking one away always
gives the text back. Loss spans are [start, end) in code points of the formatted
string and hold each assistant text (escaped), nothing else.

Defined results: null text and null role are empty; turns that tie are ordered by
role, then text, and repeated rows stay; a parent that isn't there makes a root; messages whose
parents run into a circle have no root and belong to no path; an empty table gives an empty result. One
conversation becomes one string, so its rows meet in one task: that is the output
itself. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What follows a control string's first character.
_REST = r"/?INST\]|/?SYS\]|/?ROLE\]|:\]|/?s>"
_FIRST = r"([\[<])"
_TURN = r"(?s)(?:\[(INST|SYS)\](.*?)\[/(?:INST|SYS)\]|<s>(.*?)</s>|\[ROLE\](.*?)\[:\](.*?)\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)(" + _REST + ")", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)(" + _REST + ")", r"$1$2$3")


def marks(role: Column) -> tuple[Column, Column]:
    """What stands before and behind a turn's text."""
    before = F.when(role == "user", "[INST]").when(role == "system", "[SYS]").when(role == "assistant", "<s>").otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[:]")))
    behind = F.when(role == "user", "[/INST]").when(role == "system", "[/SYS]").when(role == "assistant", "</s>").otherwise("[/ROLE]")
    return before, behind


def as_chain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before; score 1 a turn."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    numbered = base.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def jump_tables(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """conv, node, total, depth (of the path from the root) of messages that have a root, and the ancestors 1, 2, 4 ... steps up."""
    nodes = messages.select("conv", "node", "parent", F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("depth"))
    there = messages.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"))
    known = nodes.join(there, F.expr("conv <=> _conv AND parent = _node"), "left")
    state = materialize(known.select("conv", "node", F.col("_node").alias("above"), "total", "depth"), "jumps")
    most = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    # only messages that haven't reached their root yet go through another round
    done, open_, tables, step = state.filter("above IS NULL"), state.filter("above IS NOT NULL"), [], 1
    while step <= most and open_.limit(1).count():
        tables.append(open_)
        a, b = open_.alias("a"), done.unionByName(open_).alias("b")
        more = a.join(b, F.expr("a.conv <=> b.conv AND a.above = b.node")).select(
            F.col("a.conv").alias("conv"), F.col("a.node").alias("node"), F.col("b.above").alias("above"), (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.depth") + F.col("b.depth")).alias("depth")
        )
        state, step = materialize(more, "jumps"), 2 * step
        done, open_ = done.unionByName(state.filter("above IS NULL")), state.filter("above IS NOT NULL")
    # who still has an ancestor after as many steps as there are messages is on a circle or below one
    return done.select("conv", "node", "total", "depth"), tables


def chosen_paths(messages: DataFrame, top: int) -> DataFrame:
    """conv, rank, leaf, total, node, up (steps from the leaf): the paths of the ``top`` best leaves of each tree."""
    scored, tables = jump_tables(messages)
    inner = messages.filter("parent IS NOT NULL").select(F.col("conv").alias("_conv"), F.col("parent").alias("_node")).distinct()
    leaves = scored.join(inner, F.expr("conv <=> _conv AND node = _node"), "left_anti")
    best = Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    reach = materialize(ranked.select("conv", "rank", F.col("node").alias("leaf"), "total", "node", F.lit(0).cast("long").alias("up")), "paths")
    parts = [reach]
    for k, table in enumerate(tables):
        jump = table.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"), "above")
        more = reach.join(jump, F.expr("conv <=> _conv AND node = _node")).select("conv", "rank", "leaf", "total", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))
        parts.append(materialize(more, "paths"))
        reach = reach.unionByName(parts[-1])
    return reach


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv, rank, leaf, score, formatted, loss_spans of the ``top`` best branches of each tree.

    ``messages``: conv, node (unique in conv), parent (null at roots), role, text, score.
    """
    messages = materialize(messages, "messages")
    picked = chosen_paths(messages.select("conv", "node", "parent", "score"), top)
    before, behind = marks(F.col("role"))
    turns = messages.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"), before.alias("before"), escape(F.col("text")).alias("body"), behind.alias("behind"), (F.col("role") == "assistant").alias("learn"))
    # where a text begins: what all turns before it take, by a running sum, and its own mark
    so_far = Window.partitionBy("conv", "rank", "leaf", "total").orderBy(F.desc("up"))
    size = F.length("before") + F.length("body") + F.length("behind")
    placed = picked.join(turns, F.expr("conv <=> _conv AND node = _node")).withColumn("start", F.sum(size.cast("long")).over(so_far) - F.length("behind") - F.length("body"))
    ordered = placed.groupBy("conv", "rank", "leaf", "total").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("before", "body", "behind").alias("turn"), "learn", "start", (F.col("start") + F.length("body")).alias("end")))).alias("turns")
    )
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return ordered.select("conv", "rank", "leaf", F.col("total").alias("score"), F.array_join(F.col("turns.turn"), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string."""
    whole = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))

    def turn(x):
        kind = F.when(F.startswith(x, F.lit("[INST]")), "user").when(F.startswith(x, F.lit("[SYS]")), "system").when(F.startswith(x, F.lit("<s>")), "assistant")
        cut = F.when(kind == "user", F.substr(x, F.lit(7), F.length(x) - 13)).when(kind == "system", F.substr(x, F.lit(6), F.length(x) - 11)).when(kind == "assistant", F.substr(x, F.lit(4), F.length(x) - 7))
        inner = F.substr(x, F.lit(7), F.length(x) - 13)
        colon = F.instr(inner, "[:]")
        return F.struct(
            F.coalesce(kind, unescape(F.substr(inner, F.lit(1), colon - 1))).alias("role"),
            unescape(F.coalesce(cut, F.substr(inner, colon + 3, F.length(inner)))).alias("text"),
        )

    return F.transform(whole, turn)
