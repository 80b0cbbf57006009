"""Chat formatting of reply trees (operator 13).

Messages of a tree name the message they answer.  Iterative self-joins double
the reach of every message's link to its ancestors, so a tree of depth d takes
about log2(d) joins; they move ids and scores only.  Where a link has passed
the root, the message knows its depth and the score of its path.  Leaves are
ranked by the score of their path, and the chosen paths are written out by the
same links, the longest first, each step joining every path row with what lies
2**k messages above it.  Then the messages join their path rows and each path
becomes one text.

The template marks a turn as ``<turn:ROLE>`` and a line end before, and
``</turn>`` and a line end after its text.  Where a text has such a mark, with
any number of backslashes after ``<``, one backslash more is put there, so no
mark can appear inside a text and taking one away gives the text back.  In a
role ``%``, ``>`` and line ends are percent-encoded.  The loss mask lists
spans of the output (code points, end exclusive), one for each trained turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks, written

#: The role whose texts are trained.
TRAINED = "assistant"
END = "</turn>\n"
#: What a role may not hold, and what stands for it; the sign that marks a code comes first.
ROLE_CODES = (("%", "%25"), (">", "%3E"), ("\n", "%0A"))

_MASK = "array<struct<first:long,last:long>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*/?turn)", r"<\1", text)


def _head(role: Column) -> Column:
    for sign, code in ROLE_CODES:
        role = F.replace(role, F.lit(sign), F.lit(code))
    return F.concat(F.lit("<turn:"), role, F.lit(">\n"))


def _role(text: str) -> str:
    for sign, code in reversed(ROLE_CODES):
        text = text.replace(code, sign)
    return text


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Conversations ``(conv_id, turn, role, text)`` as messages, each turn answering the one before.

    Turns are ordered by (turn, role, text), nulls first, and numbered from 1;
    repeated rows are turns each.  A row with a null ``conv_id`` belongs to no
    conversation and is a message without a tree.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    told = rows.where("tree is not null").withColumn("node", F.row_number().over(order).cast("long"))
    told = told.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    none = F.lit(None).cast("long")
    return told.unionByName(rows.where("tree is null").withColumn("node", none).withColumn("parent", none)).drop("turn").withColumn("score", F.lit(0.0))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per (tree, node): that of the largest (score, parent, role, text); rows without a tree or node stay as they are."""
    named = messages.where("tree is not null and node is not null")
    best = named.groupBy("tree", "node").agg(F.max(F.struct("score", "parent", "role", "text")).alias("m")).select("tree", "node", "m.*")
    return best.unionByName(messages.where("tree is null or node is null").select(best.columns))


def _doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(tree, node, depth, total)`` of the messages below a root, and for each k the links to the message 2**k above."""
    edges = messages.where("tree is not null and node is not null").select(
        "tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")
    )
    there = edges.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    state = written(
        edges.join(there, ["tree", "parent"], "left").select("tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), "total"),
        "reply-links",
    )
    jumps, before = [], None
    while True:
        open_ = state.where("up is not null")
        left = open_.count()
        if left in (0, before):  # depths have no gap below a root, so what no longer shrinks hangs on a cycle
            break
        before = left
        jumps.append(open_.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        further = open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")
        )
        state = written(state.where("up is null").unionByName(further), "reply-links")
    return state.where("up is null").drop("up"), jumps


def branches(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """``(tree, leaf, branch, position, node)``: the messages of the chosen root-to-leaf paths, positions from 0.

    A leaf is a message that none answers.  The paths of a tree are ranked by
    the mean score of their messages (a null score counts 0), then the longer,
    then the smaller leaf; ``branch`` is that rank from 1, and ``per_tree``
    keeps the first ones.  A message whose parent is missing is a root.
    Messages on a cycle of replies, or below one, are on no path.
    """
    depths, jumps = _doubled(messages)
    answered = messages.where("tree is not null and node is not null").select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    leaves = depths.join(answered, ["tree", "node"], "left_anti").withColumn("branch", F.row_number().over(order))
    if per_tree is not None:
        leaves = leaves.where(F.col("branch") <= per_tree)
    path = written(leaves.select("tree", F.col("node").alias("leaf"), "branch", F.col("depth").alias("position"), "node"), "reply-paths")
    for k in reversed(range(len(jumps))):
        step = path.join(jumps[k], ["tree", "node"]).select("tree", "leaf", "branch", (F.col("position") - F.lit(1 << k)).alias("position"), F.col("up").alias("node"))
        path = written(path.unionByName(step), "reply-paths")
    return path


def format_conversations(messages: DataFrame, per_tree: int | None = None, trained: str = TRAINED) -> DataFrame:
    """``(tree, leaf, branch, formatted, loss)``: every chosen path as one text with its loss mask.

    ``messages`` has ``(tree, node, parent, role, text, score)``, each (tree,
    node) once (see :func:`distinct_messages`).  The mask covers the texts of
    the role ``trained``; a message that several chosen paths share is trained
    in the first of them only.  A null role is an empty one, a null text is
    empty.  A message without a tree or without an id is a path of its own
    with a null leaf.  An empty table gives no rows; other columns are ignored.
    """
    rows = messages.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"
    )
    path = branches(rows, per_tree)
    first = path.groupBy("tree", "node").agg(F.min("branch").alias("first"))
    text = escaped(F.col("text"))
    turns = rows.join(first, ["tree", "node"]).select(
        "tree", "node", "first", _head(F.col("role")).alias("head"), text.alias("body"), (F.col("role") == trained).alias("trained")
    )
    told = path.join(turns, ["tree", "node"]).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("first_char", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(
        F.col("trained") & (F.col("first") == F.col("branch")),
        F.struct(F.col("first_char").alias("first"), (F.col("first_char") + F.length("body")).alias("last")),
    )
    whole = told.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("position", "piece", span.alias("span")))).alias("turns"))
    paths = whole.select(
        "tree", "leaf", "branch", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).cast(_MASK).alias("loss")
    )
    head = _head(F.col("role"))
    alone = rows.where("tree is null or node is null").select(
        "tree", F.lit(None).cast("long").alias("leaf"), F.lit(1).alias("branch"), F.concat(head, text, F.lit(END)).alias("formatted"),
        F.when(F.col("role") == trained, F.array(F.struct(F.length(head).alias("first"), (F.length(head) + F.length(text)).alias("last"))))
        .otherwise(F.array()).cast(_MASK).alias("loss"),
    )
    return paths.unionByName(alone)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted text; ValueError where it isn't one."""
    at = 0
    while at < len(formatted):
        mark = formatted.find(">\n", at)
        end = formatted.find(END, mark)
        if not formatted.startswith("<turn:", at) or mark < 0 or end < 0:
            raise ValueError(f"no turn at character {at}")
        yield _role(formatted[at + 6 : mark]), unescaped(formatted[mark + 2 : end])
        at = end + len(END)


def _digests(batches):
    for batch in batches:
        out = []
        for tree, formatted, loss in text_chunks(batch, ["tree", "formatted", "loss"]):
            n, turns, trained, chars = 0, hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns_of(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescaped(formatted[span["first"] : span["last"]])
                chars += len(text)
                trained.update(text.encode())
            out.append((tree, n, turns.hexdigest(), chars, trained.hexdigest(), len(formatted)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of formatted texts, read from them and their masks."""
    return formatted.select("tree", "formatted", "loss").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Conversations formatted as reply chains and read back; one row per conversation, and one for each row without a ``conv_id``."""
    return read_back(format_conversations(written(reply_chain(conversations), "messages")))
