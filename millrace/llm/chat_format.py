"""Reply trees to chat-formatted conversations.

Messages form trees through their parents. Jump tables from iterative self-joins (each doubles the distance) give every
leaf its path's score and then enumerate the path's messages; branches are ranked by score and each chosen path becomes
one conversation. Joins carry identifiers only; texts join once, for the chosen paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>\n"
#: The name of the conversation whose turns have no id.
NO_ID = "none"


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string can stand in the text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    """Roles end at the line's end, so a line break in one is marked as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    # An escaped "<|" is "<\|" and a lone "\" is "\\", so "<\n" stands for a line break only where its "\" isn't doubled.
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("<\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Of (tree, node, parent, score): (tree, leaf, rank, node, depth) of the ``branches`` best root-to-leaf paths of each tree.

    A path's score is the sum of its messages' scores; ties go to the smaller leaf. depth is 0 at the root. A null or
    unknown parent makes a root; null scores count 0. Messages whose parents form a ring belong to no path. (tree, node)
    must be unique, as in the output of conversations(); a table without rows gives none.
    """
    nodes = materialise(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("sum"))
    # A jump table holds the messages that were not at their root before; those with a null ``up`` have arrived.
    jumps = [materialise(base, "chat-jumps")]
    arrived = jumps[0].where("up is null")
    most = max(1, nodes.count()).bit_length() + 1
    while len(jumps) <= most and not (going := jumps[-1].where("up is not null")).isEmpty():
        further = going.unionByName(arrived).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"))
        jumps.append(materialise(going.join(further, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum")), "chat-jumps"))
        arrived = arrived.unionByName(jumps[-1].where("up is null"))
    parents = base.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = arrived.join(parents, ["tree", "node"], "left_anti")
    best = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node"))).where(F.col("rank") <= branches)
    found = best.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up_by"))
    for k, jump in enumerate(jumps[:-1]):
        step = found.join(jump.where("up is not null").select("tree", "node", "up"), ["tree", "node"])
        found = found.unionByName(step.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by")))
        if k % 2:
            found = materialise(found, "chat-paths")
    top = found.groupBy("tree", "leaf").agg(F.max("up_by").alias("top"))
    return found.join(top, ["tree", "leaf"]).select("tree", "leaf", "rank", "node", (F.col("top") - F.col("up_by")).alias("depth"))


def render(path_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, rank, n_turns, formatted (the text), loss_spans (start, end) of assistant texts.

    ``messages`` has (tree, node, role, text); null roles and texts are empty. Spans count code points of ``formatted``.
    """
    own = path_rows.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    own = own.select("tree", "leaf", "rank", "depth", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    by = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size.cast("long")).over(by), F.lit(0)) + F.length("head")
    own = own.withColumn("at", before)
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("span"))
    rows = own.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans")
    )


def turns_of(formatted: Column) -> Column:
    """Reads a formatted conversation back: an array of (role, text)."""
    # Escaping leaves no mark inside a text, so every mark ends a turn.
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    whole = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(whole, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversations(turns: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text): reply-tree messages (tree, node, parent, role, text, score), each turn answering the one before.

    Turns are numbered by (turn, role, text), so repeated rows and equal turn numbers keep a fixed order and no row is
    lost; null turns come first; rows with a null conv_id form one conversation of their own. ``tree`` is the id as text,
    and NO_ID for the one without. Messages score 1 each. A conversation's turns are numbered and joined in one task, as
    its formatted text is one value.
    """
    own = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_ID)).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    own = own.withColumn("node", node)
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
