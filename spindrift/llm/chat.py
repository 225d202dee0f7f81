"""Chat formatting over reply trees (operator 2).

Messages point to the message they answer. Root-to-leaf paths are enumerated by iterative self-joins whose number
follows the logarithm of the deepest path: round k joins the table of 2^k-th ancestors, with the scores on the way,
with itself. By these tables every leaf climbs to its root, largest step first, one row a leaf; branches are ranked by
score within their tree, and only the chosen ones are unfolded into their messages. Each is formatted as one
conversation, with a loss mask over the texts of one role.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed

#: The template: HEAD role MIDDLE text TAIL for each turn. Inside roles and texts a backslash stands before each
#: character that a control string could start with, so neither HEAD nor TAIL can arise there.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)
_ROLE_CONTROL, _TEXT_CONTROL, _ESCAPED = re.compile(r"([\\<#:])"), re.compile(r"([\\<#])"), re.compile(r"\\(.)", re.DOTALL)
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(_SPAN))])
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def format_turns(turns: list[tuple[str | None, str | None]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """One conversation as text, and the code point spans of the trained role's texts (null: empty)."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head = HEAD + _ROLE_CONTROL.sub(r"\\\1", role or "") + MIDDLE
        body = _TEXT_CONTROL.sub(r"\\\1", text or "")
        if role == trained:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    return turns


@F.pandas_udf(_FORMATTED)
def _format(turns: pd.Series, trained: pd.Series) -> pd.DataFrame:
    made = [format_turns([(t["role"], t["text"]) for t in own], who) for own, who in zip(turns, trained, strict=True)]
    return pd.DataFrame({"formatted": [m[0] for m in made], "loss": [[{"start": a, "end": b} for a, b in m[1]] for m in made]})


@F.pandas_udf(_TURNS)
def parsed(formatted: pd.Series) -> pd.Series:
    """The turns of formatted conversations (null: none)."""
    return pd.Series([[{"role": r, "text": t} for r, t in read_turns(x or "")] for x in formatted], dtype=object)


@F.pandas_udf(T.StringType())
def under_mask(formatted: pd.Series, loss: pd.Series) -> pd.Series:
    """What stands under the loss mask, unescaped, nothing between the spans."""
    return pd.Series(["".join(_ESCAPED.sub(r"\1", x[s["start"] : s["end"]]) for s in spans) for x, spans in zip(formatted, loss, strict=True)], dtype=object)


def _ancestors(messages: DataFrame, id: str, parent: str, score: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes, steps): the messages (id, own score), and tables (id, above, total): the 2^k-th ancestor of each message
    that has one, and the sum of the scores from the message up to below it."""
    own = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    nodes = messages.select(F.col(id).alias("id"), F.col(parent).alias("parent"), own.alias("own"))
    known = nodes.select(F.col("id").alias("known"))
    up = checkpointed(nodes.where("parent is not null").join(known, F.col("parent") == F.col("known"), "left_semi").select("id", F.col("parent").alias("above"), F.col("own").alias("total")))
    total = nodes.count()
    steps = []
    while not up.isEmpty():
        steps.append(up)
        if 1 << len(steps) > total:
            break  # only cycles reach so far
        far = up.select(F.col("id").alias("mid"), F.col("above").alias("far"), F.col("total").alias("more"))
        up = checkpointed(up.join(far, F.col("above") == F.col("mid")).select("id", F.col("far").alias("above"), (F.col("total") + F.col("more")).alias("total")))
    return nodes, steps


def _leaves(nodes: DataFrame) -> DataFrame:
    answered = nodes.select(F.col("parent").alias("known")).where("known is not null").distinct()
    return nodes.join(answered, F.col("id") == F.col("known"), "left_anti").select(F.col("id").alias("leaf"))


def _unfolded(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    paths = leaves.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(steps))):
        more = paths.join(steps[k].select(F.col("id").alias("low"), "above"), F.col("id") == F.col("low")).select("leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        paths = checkpointed(paths.unionAll(more))
    return paths


def reply_paths(messages: DataFrame, id: str = "id", parent: str = "parent") -> DataFrame:
    """(leaf, id, up): every message on the path from each leaf to its root, ``up`` steps above the leaf.

    A message whose parent is null or missing from the table is a root. Ids must be unique and not null. Messages
    on a reply cycle have no root: they, and what hangs from them, are on no path. Rows grow with the summed length
    of the paths; the rounds with the logarithm of the longest.
    """
    nodes, steps = _ancestors(messages, id, parent)
    return _unfolded(_leaves(nodes), steps)


def _branches(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(leaf, root, branch_score): each leaf's root and the mean score of the messages between, one row a leaf."""
    now = _leaves(nodes).select("leaf", F.col("leaf").alias("at"), F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("n"))
    for k in reversed(range(len(steps))):
        step = steps[k].select(F.col("id").alias("low"), "above", "total")
        moved = now.join(step, F.col("at") == F.col("low"), "left")
        now = checkpointed(moved.select("leaf", F.coalesce("above", "at").alias("at"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), (F.col("n") + F.when(F.col("low").isNotNull(), 1 << k).otherwise(0)).alias("n")))
    root = nodes.select(F.col("id").alias("root"), "own")
    if steps:  # what hangs from a cycle has no root
        root = root.join(steps[0].select(F.col("id").alias("root")), "root", "left_anti")
    return now.join(root, F.col("at") == F.col("root")).select("leaf", "root", ((F.col("sum") + F.col("own")) / F.col("n")).alias("branch_score"))


def chosen_branches(messages: DataFrame, paths: DataFrame, score: str, best: int | None, id: str = "id") -> DataFrame:
    """(leaf, root, branch_score, branch_rank) of unfolded paths: branches ranked within their tree by the mean score of
    their messages (null scores count 0), equal scores by leaf; the ``best`` first of each tree, or all if None."""
    scored = paths.join(messages.select(F.col(id).alias("id"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("own")), "id")
    return _ranked(scored.groupBy("leaf").agg(F.max_by("id", "up").alias("root"), F.avg("own").alias("branch_score")), best)


def _ranked(branches: DataFrame, best: int | None) -> DataFrame:
    """The ``best`` branches of each tree; one of very many is cut down in each task before its branches meet."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("branch_score"), "leaf"))
    ranked = branches.select("leaf", "root", "branch_score").withColumn("branch_rank", rank)
    return ranked if best is None else ranked.where(F.col("branch_rank") <= best)


def format_conversations(messages: DataFrame, best: int | None = 1, trained: str = "assistant", id: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """(leaf, root, branch_score, branch_rank, formatted, loss): one row for each chosen branch.

    ``messages`` has unique ids; further columns are ignored. Null roles and texts are empty. A conversation is
    one value, so its formatted text must fit in a row (2 GB); texts meet only within their own conversation. Branches
    are ranked before any is unfolded: rows grow with the chosen paths, not with those of all leaves. An empty table
    gives no rows.
    """
    nodes, steps = _ancestors(messages, id, parent, score)
    chosen = checkpointed(_ranked(_branches(nodes, steps), best))
    paths = _unfolded(chosen.select("leaf"), steps)
    said = messages.select(F.col(id).alias("id"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = paths.join(chosen, "leaf").join(said, "id").groupBy("leaf", "root", "branch_score", "branch_rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    made = turns.withColumn("made", _format("turns", F.lit(trained)))
    return made.select("leaf", "root", "branch_score", "branch_rank", "made.formatted", "made.loss")


def threaded(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (id, parent, conv_id, role, text, score) of linear conversations, each answering the row before it.

    Rows go by turn, then role, then text (nulls first), so repeated turns and repeated rows all stay. Rows whose
    conv_id is null are one conversation.
    """
    order = [F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first()]
    at = F.row_number().over(Window.partitionBy(conv_id).orderBy(*order))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    name = lambda n: F.concat_ws("#", key, n.cast("string"))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), at.alias("at"))
    return rows.select(name(F.col("at")).alias("id"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "conv_id", "role", "text", F.lit(0.0).alias("score"))
