"""Reply trees to formatted conversations.

Messages form trees by ``parent_id``. Iterative self-joins with doubling steps find, for
every node, the sum of scores and the number of messages up to its root, in as many rounds
as the depth has binary digits. Leaves are ranked by the mean score of their path, and the
chosen paths are laid out again by doubling, so no round needs more rows than the result.
Each chosen path is one conversation, formatted turn by turn.

The template writes a turn as ``<s>``, the role, a line feed, the text, ``</s>``. Inside
role and text a backslash follows each ``<``, ``[`` and backslash, and a line feed of a
role becomes ``<n``; so no control string (all begin with ``<`` or ``[``) can appear in
them, and the change is undone by reading from left to right.

Defined results: null text or role is empty. Rows without a tree (or node) id belong to no
conversation; a null turn comes first. A parent that is missing, null or of another
tree makes its child a root. Messages on a cycle have no root and belong to no path.
Repeated rows of one message (same tree and node) are one message, the smallest by score,
role and text; ties between leaves go to the longer path, then to the smaller node id. An
empty table gives empty results. Texts of any length stay one cell of a turn row; a
conversation is never gathered into one row. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestream.llm.shared import keep

#: What opens and closes a turn.
OPEN, CLOSE = "<s>", "</s>"
#: Roles whose text a model learns from.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "<n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, "<n", "\n"))


def messages(rows: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None) -> DataFrame:
    """Clean message table: tree, node, parent, role, text, score; one row per message."""
    named = rows.select(
        F.col(f"`{tree}`").cast("long").alias("tree"),
        F.col(f"`{node}`").cast("long").alias("node"),
        F.col(f"`{parent}`").cast("long").alias("parent"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        (F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    ).filter("tree is not null and node is not null")
    one = named.groupBy("tree", "node").agg(F.min(F.struct("score", "role", "text", "parent")).alias("m"))
    return one.select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def chain(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Message table of linear conversations: rows by turn, each replying to the one before.

    Rows of one turn stand in order of role and text and all stay.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(
        F.col(f"`{tree}`").cast("long").alias("tree"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).filter("tree is not null")
    numbered = named.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Per round k, for the nodes still below an ancestor: the ancestor 2^k steps up, and
    the score and number of the messages up to it.

    ``up`` is null once the root is passed; such a node is done and leaves the rounds. A
    round that ends no node shows that all that are left hang on cycles.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = (
        nodes.select("tree", "node", "parent", "score")
        .join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
        .select("tree", "node", F.col("p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("count"))
    )
    rounds = [keep(linked, "jumps")]
    open_before = None
    while True:
        left = rounds[-1].filter("up is not null")
        still = left.count()
        if still == 0 or still == open_before:
            return rounds
        passed = left
        for done in rounds:
            passed = passed.unionByName(done.filter("up is null"))
        passed = passed.select(
            F.col("tree").alias("t"), F.col("node").alias("at"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("count").alias("n")
        )
        step = left.join(passed, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("at"))).select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("count") + F.col("n")).alias("count")
        )
        open_before = still
        rounds.append(keep(step, "jumps"))


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each tree: tree, branch, position, node.

    Position counts from the root, from 0. Branch 0 has the highest mean score.
    """
    tables = _jumps(nodes)
    last = reduce(DataFrame.unionByName, [t.filter("up is null") for t in tables])
    parents = tables[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = last.join(parents, ["tree", "node"], "left_anti")
    rank = F.struct((-F.col("total") / F.col("count")).alias("a"), (-F.col("count")).alias("b"), F.col("node").alias("node"))
    leaves = leaves.select("tree", rank.alias("rank"), "count")
    if branches == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct("rank", "count")).alias("m"))
        chosen = best.select("tree", F.lit(0).alias("branch"), F.col("m.rank.node").alias("node"), F.col("m.count").alias("count"))
    else:
        # first within salted parts of a tree, so that a tree of many leaves is no single task
        parted = leaves.withColumn("part", F.pmod(F.xxhash64("rank"), F.lit(64)))
        near = F.row_number().over(Window.partitionBy("tree", "part").orderBy("rank"))
        far = F.row_number().over(Window.partitionBy("tree").orderBy("rank"))
        few = parted.withColumn("k", near).filter(F.col("k") <= branches).withColumn("k", far).filter(F.col("k") <= branches)
        chosen = few.select("tree", (F.col("k") - 1).alias("branch"), F.col("rank.node").alias("node"), "count")
    path = chosen.select("tree", "branch", "node", (F.col("count") - 1).alias("position"))
    for k in range(len(tables) - 1, -1, -1):
        ups = tables[k].filter("up is not null").select("tree", "node", "up")
        own = F.struct("node", "position")
        higher = F.struct(F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        both = F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, higher))
        path = path.join(ups, ["tree", "node"], "left").select("tree", "branch", F.explode(both).alias("m"))
        path = path.select("tree", "branch", "m.node", "m.position")
    return path.select("tree", "branch", "position", "node")


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per turn of each path: tree, branch, position, ``formatted``, and the loss mask of it.

    ``loss_from`` and ``loss_to`` are places (code points) in ``formatted`` between which a
    model learns; they are equal where it learns nothing. Pieces in order of position,
    joined without anything between, are the conversation.
    """
    rows = chosen.join(nodes, ["tree", "node"])
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    learned = F.col("role").isin(*LEARNED)
    return rows.select(
        "tree", "branch", "position", role.alias("r"), text.alias("t"), head.alias("head"), learned.alias("learned")
    ).select(
        "tree",
        "branch",
        "position",
        F.concat("head", "t", F.lit(CLOSE)).alias("formatted"),
        F.length("head").cast("long").alias("loss_from"),
        (F.length("head") + F.when(F.col("learned"), F.length("t")).otherwise(0)).cast("long").alias("loss_to"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Role and text of formatted turns, and the text under the loss mask, all unescaped."""
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    cut = F.instr(inner, "\n")
    loss = F.expr("substring(formatted, cast(loss_from + 1 as int), cast(loss_to - loss_from as int))")
    return formatted.select(
        "tree",
        "branch",
        "position",
        "formatted",
        unescape_role(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"),
        unescape(loss).alias("loss"),
    )


DIGEST = "tree long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parsed: DataFrame) -> DataFrame:
    """Digest of each conversation, streamed over sorted turns: one turn in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for tree, branch, formatted, role, text, loss in zip(
                *[batch.column(c).to_pylist() for c in ("tree", "branch", "formatted", "role", "text", "loss")], strict=True
            ):
                if now is None or now[0] != (tree, branch):
                    if now is not None:
                        done.append(now)
                    now = [(tree, branch), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
            yield _digest_rows(done)
            done = []
        if now is not None:
            yield _digest_rows([now])

    by = parsed.select("tree", "branch", "position", "formatted", "role", "text", "loss")
    sorted_rows = by.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "position")
    return sorted_rows.mapInArrow(run, DIGEST)


def _digest_rows(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d[0][0] for d in done], pa.int64()),
            pa.array([d[0][1] for d in done], pa.int32()),
            pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2].hexdigest() for d in done], pa.string()),
            pa.array([d[3] for d in done], pa.int64()),
            pa.array([d[4].hexdigest() for d in done], pa.string()),
            pa.array([d[5] for d in done], pa.int64()),
        ],
        ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


def run_chains(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format linear conversations and keep the turns in the shared folder; returns what was written."""
    nodes = keep(chain(rows, tree, turn, role, text), "messages")
    return keep(format_paths(nodes, paths(nodes)), "formatted")
