"""Chat formatting of reply trees: choose branches by score and render each as one conversation.

Messages are nodes (tree, node, parent). Self-joins that double their reach follow replies to the root: after k joins a node
knows its ancestor 2^k steps up and the scores between, so a tree of depth d takes log2(d) joins of one row a message. Branches
are ranked by these sums; only the chosen ones are listed message by message and become text with a mask over what the model is to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import cut, text_of

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings begin with "<|": a text's "<", any tildes and "|" get one more tilde, so none is left and all come back.
_ESCAPE, _UNESCAPE = (r"<(~*)\|", r"<$1~|"), (r"<~(~*)\|", r"<$1|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE[0]), F.lit(_ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE[0]), F.lit(_UNESCAPE[1]))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, rank, depth, node, role, text) of the `best` branches of each tree (None: all), root first.

    messages: tree, node, parent (null or unknown: a root), role, text, score (null: 0). Nodes are unique in a tree; a node
    on a cycle is on no path, nor is one that is null. Branches rank by the mean score of their messages, then by length, then
    by smaller leaf. A null tree is a tree of its own.
    """
    m = cut(messages.select(F.struct("tree").alias("t"), "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).where("node is not null"))
    size = m.count()
    known = m.select("t", F.col("node").alias("parent"), F.lit(True).alias("found"))
    linked = m.join(known, ["t", "parent"], "left").select("t", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("length"))
    # steps[k]: each message with its ancestor 2^k replies up, and the sum over the 2^k messages before that; null: the root is passed.
    steps = [cut(linked)]
    while 1 << len(steps) <= 2 * size and not (ahead := steps[-1].where("up is not null")).isEmpty():
        upper = steps[-1].select("t", F.col("node").alias("up"), F.col("up").alias("top"), F.col("sum").alias("above"), F.col("length").alias("more"))
        grown = ahead.join(upper, ["t", "up"]).select("t", "node", F.col("top").alias("up"), (F.col("sum") + F.col("above")).alias("sum"), (F.col("length") + F.col("more")).alias("length"))
        steps.append(cut(steps[-1].where("up is null").unionByName(grown)))
    inner = linked.where("up is not null").select("t", F.col("up").alias("node")).distinct()
    # A chain longer than all messages runs into a cycle: it never passes a root, and its leaf has no path.
    leaves = steps[-1].where("up is null").join(inner, ["t", "node"], "left_anti")
    order = Window.partitionBy("t").orderBy(F.desc(F.col("sum") / F.col("length")), F.desc("length"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    reached = cut(ranked.select("t", F.col("node").alias("leaf"), "rank", "length", "node", F.lit(0).cast("long").alias("below")))
    for k, step in enumerate(steps):
        jump = step.where("up is not null").select("t", "node", "up")
        more = reached.join(jump, ["t", "node"]).select("t", "leaf", "rank", "length", F.col("up").alias("node"), (F.col("below") + (1 << k)).alias("below"))
        reached = reached.unionByName(more) if k + 1 == len(steps) else cut(reached.unionByName(more))
    full = reached.join(m.select("t", "node", "role", "text"), ["t", "node"])
    return full.select(F.col("t.tree").alias("tree"), "leaf", "rank", (F.col("length") - F.col("below")).alias("depth"), "node", "role", "text")


def format_paths(chosen: DataFrame) -> DataFrame:
    """One row for each path: tree, leaf, rank, formatted, and loss_spans (start, length in code points of `formatted`).

    The mask covers each assistant message's text as escaped. Null roles and texts are empty.
    """
    turn = F.struct("depth", F.concat(F.lit(START), _escape_role(text_of("role")), F.lit("\n")).alias("head"), escape(text_of("text")).alias("body"), (text_of("role") == "assistant").alias("learn"))
    turns = chosen.groupBy(F.struct("tree", "leaf", "rank").alias("p")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = F.lit(END + "\n")
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], tail)), "")
    empty = F.expr("struct(0L as at, cast(array() as array<struct<start:bigint,length:bigint>>) as spans)")

    def lay(state: Column, x: Column) -> Column:
        body, head = F.length(x["body"]).cast("long"), F.length(x["head"]).cast("long")
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct((state["at"] + head + body + len(END) + 1).alias("at"), F.when(x["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return turns.select("p.*", text.alias("formatted"), F.aggregate("turns", empty, lay)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        cut_at = F.instr(body, F.lit("\n"))
        return F.struct(_unescape_role(F.substr(body, F.lit(1), cut_at - 1)).alias("role"), unescape(F.substr(body, cut_at + 1)).alias("text"))

    return F.transform(blocks, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def as_replies(conversations: DataFrame) -> DataFrame:
    """Reply trees from rows (conv_id, turn, role, text): each turn answers the one before it.

    Turns sort by (turn, role, text), nulls first; rows with a null conv_id make one conversation. A conversation is one text
    in the end, so numbering its turns in one task asks no more of it than the text does.
    """
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(at).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read from the formatted conversations alone."""
    read = formatted.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null roles and texts are empty; repeated rows are turns of their own; an empty table has no conversations; other columns are not read.
    """
    return digest(format_paths(paths(as_replies(conversations))))
