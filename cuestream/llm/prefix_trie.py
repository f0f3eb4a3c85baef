"""Prefix trie of conversations, with the total of every subtree by parallel tree contraction.

A node stands for the first d turns (role and text) that some conversations share; the root
is the empty prefix. Prefixes are named by 128 bits of hash, put together from stretches of
turns, so that no conversation is walked turn by turn in one task.

Subtree totals come from contracting the tree in rounds of joins:

* rake: a node without children left is finished, and its total goes to its parent;
* compress: of the nodes with one child left, an independent set is taken out. Its own
  value goes to its parent, its child hangs on that parent, and the node waits.

Which nodes of a chain are taken is read from one bit of their depth, another in each
round, so that a chain halves; a node whose parent is taken stays. When nothing is left,
the rounds are undone from the last to the first: a node that was taken out has the value
it had, plus the total of the child it had, which by then is known. Both directions work on
tables that shrink from round to round; parents of many children are met by aggregation,
never by a join on the parent, and all other joins are between unique keys.

Defined results: a null role or text is empty, a null turn comes first, turns of one number
stand in order of role and text, and repeated rows are turns of their own. Rows without a
conversation id belong to none. A conversation without turns is a member of the root alone.
An empty table has no node. Texts are hashed whole, whatever their length. Only the named
columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestream.llm.shared import keep, numbered

STRETCH = 32
#: Characters of member ids that a digest meets at a time.
BLOCK_CHARS = 1 << 16


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, place, n, t1, t2, chars): the turns of each conversation by number from 1, as hashes."""
    named = rows.select(
        F.col(f"`{conv}`").cast("long").alias("c"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).filter("c is not null")
    return numbered(named, "c", ["turn", "role", "text"], "turns").select(
        "c", (F.col("pos") + 1).alias("place"), "n",
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"),
        F.length("text").cast("long").alias("chars"),
    )


def unchanged(turns: DataFrame) -> DataFrame:
    """(c, d, t1, t2, chars, last) of conversations as they are."""
    return turns.select("c", F.col("place").alias("d"), "t1", "t2", "chars", (F.col("place") == F.col("n")).alias("last"))


def with_shared_heads(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation behind the first ``head`` turns of conversation ``base`` in place of its own.

    ``base`` and ``head`` (at most ``most``) are functions of column ``c``. A conversation
    without a turn afterwards has one row of depth 0.
    """
    turns = keep(turns, "turns")
    convs = turns.groupBy("c").agg(F.max("n").alias("n")).select("c", "n", base.alias("b"), head.cast("long").alias("h"))
    sizes = convs.select(F.col("c").alias("of"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, F.col("b") == F.col("of"), "left").select(
        "c", "n", "b", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")
    )
    convs = keep(convs, "conversations")
    short = F.col("n") <= F.col("h")
    names = ("t1", "t2", "chars")
    first = turns.filter(F.col("place") <= most).select(F.col("c").alias("of"), "place", *names)
    heads = convs.join(first, (F.col("b") == F.col("of")) & (F.col("place") <= F.col("h"))).select(
        "c", F.col("place").alias("d"), *names, (short & (F.col("place") == F.col("m"))).alias("last")
    )
    more = convs.select(F.col("c").alias("of"), "h", "m")
    own = turns.join(more, F.col("c") == F.col("of")).filter(F.col("place") > F.col("h")).select(
        "c", (F.col("m") + F.col("place") - F.col("h")).alias("d"), *names, (F.col("place") == F.col("n")).alias("last")
    )
    none = F.lit(0).cast("long")
    bare = convs.filter(short & (F.col("m") == 0)).select("c", none.alias("d"), *[none.alias(x) for x in names], F.lit(True).alias("last"))
    return heads.unionByName(own).unionByName(bare)


# ---------------------------------------------------------------- nodes


def prefix_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (c, d from 1, t1, t2, ...) with p1, p2, which name the sequence of turns up to d.

    Within a stretch of turns the hashes so far are hashed; what lies before it is one
    prefix of whole stretches, named in the same way.
    """
    at = F.floor((F.col("d") - 1) / STRETCH)
    w = Window.partitionBy("c", "at").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    sofar = F.collect_list(F.struct("t1", "t2")).over(w)
    inner = rows.withColumn("at", at).withColumn("sofar", sofar)
    inner = inner.select(*rows.columns, "at", F.xxhash64("sofar").alias("p1"), F.xxhash64(F.lit(1), "sofar").alias("p2"))
    full = inner.filter(F.col("d") % STRETCH == 0)
    if full.isEmpty():
        return inner.drop("at")
    inner = keep(inner, "stretches")
    full = inner.filter(F.col("d") % STRETCH == 0)
    before = prefix_ids(full.select("c", (F.col("at") + 1).alias("d"), F.col("p1").alias("t1"), F.col("p2").alias("t2")))
    before = before.select(F.col("c").alias("of"), F.col("d").alias("upto"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    met = inner.join(before, (F.col("c") == F.col("of")) & (F.col("at") == F.col("upto")), "left")
    both = F.struct("b1", "b2", "p1", "p2")
    return met.select(
        *rows.columns,
        F.when(F.col("of").isNull(), F.col("p1")).otherwise(F.xxhash64(both)).alias("p1"),
        F.when(F.col("of").isNull(), F.col("p2")).otherwise(F.xxhash64(F.lit(1), both)).alias("p2"),
    )


def nodes_of(members: DataFrame) -> DataFrame:
    """(c, d, p1, p2, n_convs, chars, pc, pd): the nodes below the root, named by their smallest member and depth."""
    found = members.filter("d > 0").groupBy("p1", "p2", "d").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")
    )
    found = keep(found, "nodes")
    before = members.filter("d > 0").select(F.col("c").alias("of"), F.col("d").alias("upto"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    linked = found.join(before, (F.col("c") == F.col("of")) & (F.col("d") - 1 == F.col("upto")), "left").drop("of", "upto")
    linked = keep(linked, "linked")
    names = found.select(F.col("p1").alias("m1"), F.col("p2").alias("m2"), F.col("d").alias("md"), F.col("c").alias("pc"))
    below = linked.filter("d > 1").join(
        names, (F.col("q1") == F.col("m1")) & (F.col("q2") == F.col("m2")) & (F.col("d") - 1 == F.col("md"))
    )
    columns = ("c", "d", "p1", "p2", "n_convs", "chars", "pc")
    first = linked.filter("d = 1").withColumn("pc", F.lit(None).cast("long"))
    return below.select(*columns).unionByName(first.select(*columns)).withColumn("pd", F.col("d") - 1)


def ends_digests(members: DataFrame) -> DataFrame:
    """(p1, p2, d, ends_sha256) of nodes at which conversations end: their ids in order, joined by commas.

    Ranges of members are written out as pieces of the joined text; one digest then takes
    the pieces of a node in turn, a thousandth of the rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0

        def piece():
            return [*key, first, ",".join(ids)]

        for batch in batches:
            out = []
            for *now, c in zip(*[batch.column(x).to_pylist() for x in ("p1", "p2", "d", "c")], strict=True):
                if ids and (now != key or size > BLOCK_CHARS):
                    out.append(piece())
                    ids, size = [], 0
                if not ids:
                    key, first = now, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _rows(out, ("p1", "p2", "d", "first"), "ids")
        if ids:
            yield _rows([piece()], ("p1", "p2", "d", "first"), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(x).to_pylist() for x in ("p1", "p2", "d", "ids")], strict=True):
                if now != key:
                    if key is not None:
                        out.append([*key, sha.hexdigest()])
                    key, sha = now, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _rows(out, ("p1", "p2", "d"), "ends_sha256")
        if key is not None:
            yield _rows([[*key, sha.hexdigest()]], ("p1", "p2", "d"), "ends_sha256")

    order = ("p1", "p2", "d", "c")
    ends = members.filter("last").select(*order)
    blocks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "p1 long, p2 long, d long, first long, ids string")
    dealt = blocks.repartition("p1", "p2", "d").sortWithinPartitions("p1", "p2", "d", "first")
    return dealt.mapInArrow(digest, "p1 long, p2 long, d long, ends_sha256 string")


def _rows(rows: list[list], numbers: tuple[str, ...], text: str) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(numbers))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*numbers, text])


# ---------------------------------------------------------------- contraction


def subtree_sums(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(c, d, values): of every node the sums over its subtree.

    ``nodes``: c, d, pc, pd (null above the root), k (children) and the values.
    """
    bits = max(1, int(nodes.agg(F.max("d")).first()[0] or 0).bit_length())
    ids = [F.col("c") == F.col("id_c"), F.col("d") == F.col("id_d")]
    live, finished, taken = nodes.select("c", "d", "pc", "pd", "k", *values), [], []
    while True:
        done = F.col("k") == 0
        finished.append(live.filter(done).select("c", "d", *values))
        raked = live.filter("pd is not null").groupBy(F.col("pc").alias("id_c"), F.col("pd").alias("id_d")).agg(
            *[F.sum(F.when(done, F.col(v)).otherwise(0)).alias(f"more_{v}") for v in values],
            F.count(F.when(~done, 1)).alias("left"),
            F.min(F.when(~done, F.struct("c", "d"))).alias("child"),
        )
        inner = live.filter(~done).join(raked, ids).select(
            "c", "d", "pc", "pd", F.col("left").alias("k"), "child", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values]
        )
        inner = keep(inner, "inner")
        if inner.isEmpty():
            break
        turn = F.shiftright("d", len(taken) % bits).bitwiseAND(F.lit(1)) == 1
        chosen = inner.filter((F.col("k") == 1) & F.col("pd").isNotNull() & turn)
        below = chosen.select(F.col("child.c").alias("id_c"), F.col("child.d").alias("id_d"))
        out = keep(chosen.join(below, ids, "left_anti"), "taken")
        taken.append(out)
        gone = out.select(F.col("c").alias("id_c"), F.col("d").alias("id_d"))
        lifted = out.select(F.col("child.c").alias("id_c"), F.col("child.d").alias("id_d"), F.col("pc").alias("new_c"), F.col("pd").alias("new_d"))
        gained = out.groupBy(F.col("pc").alias("id_c"), F.col("pd").alias("id_d")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        rest = inner.join(gone, ids, "left_anti").join(lifted, ids, "left").drop("id_c", "id_d").join(gained, ids, "left")
        moved = F.col("new_d").isNotNull()
        live = rest.select(
            "c", "d",
            F.when(moved, F.col("new_c")).otherwise(F.col("pc")).alias("pc"),
            F.when(moved, F.col("new_d")).otherwise(F.col("pd")).alias("pd"),
            "k", *[(F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0))).alias(v) for v in values],
        )
        live = keep(live, "live")
    known = finished[-1]
    every = list(finished)
    for k in range(len(taken) - 1, -1, -1):
        # the child of a node taken in round k was finished, or taken, in a later round
        child = known.select(F.col("c").alias("id_c"), F.col("d").alias("id_d"), *[F.col(v).alias(f"more_{v}") for v in values])
        met = taken[k].join(child, [F.col("child.c") == F.col("id_c"), F.col("child.d") == F.col("id_d")])
        back = keep(met.select("c", "d", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values]), "back")
        every.append(back)
        known = known.unionByName(back).unionByName(finished[k])
    return reduce(DataFrame.unionByName, every)


# ---------------------------------------------------------------- whole operator


def trie(rebuilt: DataFrame) -> DataFrame:
    """``rebuilt``: (c, d, t1, t2, chars, last). A row per node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens`` counts the code points of turns that a cache of shared prefixes would
    not meet again: all but one of the conversations that share the turn, over the subtree.
    """
    rebuilt = keep(rebuilt, "rebuilt")
    zero = F.lit(0).cast("long")
    bare = rebuilt.filter("d = 0").withColumn("p1", zero).withColumn("p2", zero)
    members = keep(prefix_ids(rebuilt.filter("d > 0")).unionByName(bare), "members")
    whole = members.filter("last").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).first()
    below = nodes_of(members)
    top = F.lit(whole["c"]).cast("long")
    root = members.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0").select(
        top.alias("c"), zero.alias("d"), zero.alias("p1"), zero.alias("p2"), F.lit(whole["n"]).cast("long").alias("n_convs"),
        zero.alias("chars"), F.lit(None).cast("long").alias("pc"), F.lit(None).cast("long").alias("pd"),
    )
    nodes = keep(below.withColumn("pc", F.when(F.col("d") == 1, top).otherwise(F.col("pc"))).unionByName(root), "nodes")
    kids = nodes.filter("pd is not null").groupBy(F.col("pc").alias("id_c"), F.col("pd").alias("id_d")).agg(F.count(F.lit(1)).alias("k"))
    ids = [F.col("c") == F.col("id_c"), F.col("d") == F.col("id_d")]
    k = F.coalesce(F.col("k"), zero)
    valued = nodes.join(kids, ids, "left").select(
        "c", "d", "p1", "p2", "pc", "pd", "n_convs", k.alias("k"), F.when(k == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    valued = keep(valued, "valued")
    sums = subtree_sums(valued, ("n_leaves", "saved_tokens"))
    sums = sums.select(F.col("c").alias("id_c"), F.col("d").alias("id_d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    ends = ends_digests(members).select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), F.col("d").alias("ed"), "ends_sha256")
    named = valued.join(sums, ids).join(
        ends, (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")) & (F.col("d") == F.col("ed")), "left"
    )
    return named.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs",
        F.col("k").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
