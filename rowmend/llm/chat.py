"""Chat formatting of reply trees: every root-to-leaf path becomes one conversation.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A backslash before the bar of every `<|`, also where backslashes already stand between: no mark is left, and
    `unescape` takes exactly one backslash away again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: line ends and percent signs are percent-coded, then marks are escaped."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Conversations as reply trees without branches: (tree, id, parent, role, text, score).

    Turns are ordered by turn (null first), role, text; each answers the one before.  A null conversation is one of its own.
    """
    rows = turns.select(F.struct(F.col(conv_col)).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    number = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("id", number.cast("bigint"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for every leaf the messages on the way to its root, `up` replies above it.

    Self-joins double the reach: the n-th round adds the ancestors 2 ** n to 2 ** (n + 1) - 1 above from those found so far,
    so a path of 10,000 replies takes 14 rounds and every row of the result is made once.  Joins are on tree and message,
    so a long conversation is spread over all tasks.  A parent that is not in the tree counts as none; messages that
    answer each other in a circle have no leaf and are left out.
    """
    nodes = cut_lineage(messages.select("tree", "id", "parent"))
    above = nodes.select("tree", F.col("id").alias("parent")).distinct()
    up = cut_lineage(nodes.join(above, ["tree", "parent"]).select("tree", F.col("id").alias("node"), F.col("parent").alias("to")))
    answered = up.select("tree", F.col("to").alias("id")).distinct()
    leaves = nodes.join(answered, ["tree", "id"], "left_anti")
    paths = cut_lineage(leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("up")))
    for round_ in range(nodes.count().bit_length()):
        if up.isEmpty():
            break
        found = paths.join(up, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**round_).alias("up"))
        paths = cut_lineage(paths.unionByName(found))
        further = up.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        up = cut_lineage(up.join(further, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")))
    return paths


def format_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One conversation per root-to-leaf path: (tree, leaf, score, rank, n_turns, formatted, loss_spans).

    `messages` has (tree struct, id, parent, role, text, score), one row for each tree and id.  A path's score is the mean of its
    messages' scores (null as 0); paths of a tree are ranked from the highest, ties by leaf id; `best` keeps only the first
    ranks.  Every turn reads start mark, role, line end, text, end mark, line end; null roles and texts are empty.
    `loss_spans` holds start and end (code points from 0, end exclusive) of the assistant texts in `formatted`, as they
    stand there.  Columns beyond those named are ignored; an empty table gives an empty table.
    """
    paths = reply_paths(messages)
    rows = messages.select("tree", F.col("id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    turns = paths.join(rows, ["tree", "node"])
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("tree", "leaf", "up", "role", "score", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"), F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), F.col("piece")))), lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == LEARNED_ROLE, span))).alias("loss_spans"),
    )
    ranked = whole.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if best is None else ranked.where(F.col("rank") <= best)


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, place, role, text, learned): the turns of formatted conversations, parsed from `formatted` alone, and
    whether the loss mask covers exactly the text of the turn."""
    parts = formatted.select("tree", "leaf", F.posexplode(F.split("formatted", r"<\|im_start\|>", -1)).alias("place", "part")).where("place > 0")
    role = F.substring_index("part", "\n", 1)
    body = F.substr(F.col("part"), F.length(role) + 2, F.length("part") - F.length(role) - 1 - len(END) - 1)
    parts = parts.select("tree", "leaf", "place", role.alias("role"), body.alias("body"), (F.length("part") + len(START)).cast("bigint").alias("width"))
    before = W.partitionBy("tree", "leaf").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("width").over(before), F.lit(0)) + len(START) + F.length("role") + 1
    parts = parts.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    spans = formatted.select("tree", "leaf", F.explode("loss_spans").alias("s")).select("tree", "leaf", "s.start", "s.end", F.lit(True).alias("hit"))
    parts = parts.join(spans, ["tree", "leaf", "start", "end"], "left")
    return parts.select("tree", "leaf", "place", unescape_role(F.col("role")).alias("role"), unescape(F.col("body")).alias("text"), F.coalesce("hit", F.lit(False)).alias("learned"))
