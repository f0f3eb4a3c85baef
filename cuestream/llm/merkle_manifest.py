"""Merkle manifest of a dataset by slot pivots: one hash that changes with any row, and a proof for each row.

A row's leaf hashes its fields, each with its length. The leaves of a group (a language)
stand in order of document id; every ``FANOUT`` consecutive nodes have a parent that hashes
their concatenation, and the node that is left is the group's subroot. The subroots, in
order of group, are the leaves of one more tree, whose end is the root.

Nodes are numbered without a task per group. A level is one aggregation: conditional
aggregates spread the children of a parent into ``FANOUT`` slot columns, whose
concatenation is hashed. The proof of a node is the same row without its own slot: what
stands left and right of it. Paths are handed down from the root, level by level, and only
the last step, from the lowest parents to their leaves, has a row per document; it hashes
the proof and folds the leaf up along it within the row. Each level is written to the
shared folder and is an eighth of the one below.

Defined results: a null field is ``-`` and differs from the empty text. Rows that share a
document id stand in order of their leaf; equal rows are equal leaves, each with a slot of
its own. A null id stands first; a null group is a group, first among groups. A group of
one row is its own subroot. An empty table has no rows and no root. A text of any length is
one leaf. Only the named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import keep, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
SIBLINGS = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field with its length, so that no two rows run together into the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# ---------------------------------------------------------------- one tree per group


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """``nodes``: g, pos, n, node (a struct with ``digest``). The parents of every level, lowest first.

    A parent row has g, pos, ``under`` (nodes of its group on the level below), ``n`` (on
    its own), digest, and the slots c0, c1, ... of its children. A group of one node on the
    lowest level gets a parent of the same digest, so that every leaf is in a slot.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    tables: list[DataFrame] = []
    while True:
        slot = F.pmod("pos", F.lit(fanout))
        spread = [F.max(F.when(slot == s, F.col("node"))).alias(f"c{s}") for s in range(fanout)]
        parents = nodes.groupBy("g", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.max("n").alias("under"), *spread)
        joined = F.concat(*[F.coalesce(F.col(f"c{s}.digest"), F.lit("")) for s in range(fanout)])
        digest = F.when(F.col("under") > 1, F.sha2(joined, 256)).otherwise(F.col("c0.digest"))
        row = parents.select(
            "g", "pos", "under", F.ceil(F.col("under") / fanout).alias("n"), digest.alias("digest"), *[f"c{s}" for s in range(fanout)]
        )
        tables.append(keep(row, f"level{len(tables)}"))
        most = -(-most // fanout)
        if most <= 1:
            return tables
        nodes = tables[-1].filter("n > 1").select("g", "pos", "n", F.struct("digest").alias("node"))


def subroots(tables: list[DataFrame]) -> DataFrame:
    """(g, digest) of the node that is left of each group."""
    ends = [t.filter("n = 1").select("g", "digest") for t in tables]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def children(parents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row per child of parents that carry ``path``: g, pos, node, the child's own ``path``, and the other columns."""
    slots = []
    for s in range(fanout):
        left = F.concat(*[F.coalesce(F.col(f"c{k}.digest"), F.lit("")) for k in range(s)], F.lit(""))
        right = F.concat(*[F.coalesce(F.col(f"c{k}.digest"), F.lit("")) for k in range(s + 1, fanout)], F.lit(""))
        slots.append(
            F.when(
                F.col(f"c{s}").isNotNull(),
                F.struct(F.lit(s).alias("s"), F.col(f"c{s}").alias("node"), left.alias("left"), right.alias("right")),
            )
        )
    rest = [c for c in parents.columns if c not in ("g", "pos", "under", "n", "digest", "path", *[f"c{s}" for s in range(fanout)])]
    rows = parents.select("g", "pos", "under", "path", *rest, F.explode(F.array_compact(F.array(*slots))).alias("x"))
    own = F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right")))
    path = F.when(F.col("under") > 1, F.concat(own, F.col("path"))).otherwise(F.col("path"))
    return rows.select("g", (F.col("pos") * fanout + F.col("x.s")).alias("pos"), F.col("x.node").alias("node"), path.alias("path"), *rest)


def hand_down(tables: list[DataFrame], ends: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """A row per leaf: g, node, ``path`` from it to the root, and what ``ends`` (g, path, ...) says of its group."""
    rest = [c for c in ends.columns if c != "g"]
    named = ends.select(F.col("g").alias("of"), *rest)
    known = None
    for table in reversed(tables):
        tops = table.filter("n = 1").join(named, F.col("g").eqNullSafe(F.col("of"))).drop("of")
        if known is None:
            rows = tops
        else:
            higher = known.select(F.col("g").alias("of"), F.col("pos").alias("at"), *rest)
            lower = table.filter("n > 1").join(higher, F.col("g").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")))
            rows = lower.drop("of", "at").unionByName(tops)
        known = children(rows, fanout)
    return known


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


# ---------------------------------------------------------------- manifest


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    doc_id: str = "doc_id",
    group: str = "lang",
    changed: Callable[[dict[str, Column]], Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, ``path`` (siblings left and right, from leaf to root) and ``changed``.

    ``changed`` maps the fields to a leaf of other content (null: as it was), which
    ``verify`` then folds in place of the leaf.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    other = changed(values) if changed else F.lit(None).cast("string")
    leaves = docs.select(
        F.col(f"`{group}`").cast("string").alias("g"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        leaf(list(values.values())).alias("digest"),
        other.alias("changed"),
    )
    placed = numbered(leaves, "g", ["doc_id", "digest"], "leaves")
    below = levels(placed.select("g", "pos", "n", F.struct("digest", "doc_id", "changed").alias("node")), fanout)
    ends = keep(subroots(below), "subroots")
    groups = numbered(ends.select(F.lit(0).alias("all"), "g", "digest"), "all", ["g"], "groups")
    above = levels(groups.select(F.lit(0).alias("g"), "pos", "n", F.struct("digest", F.col("g").alias("named")).alias("node")), fanout)
    top = subroots(above).select("g", F.array().cast(SIBLINGS).alias("path"), F.col("digest").alias("root"))
    tops = hand_down(above, top, fanout)
    tops = keep(tops.select(F.col("node.named").alias("g"), "path", "root", F.col("node.digest").alias("subroot")), "tops")
    return hand_down(below, tops, fanout).select(
        F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", "root", "path",
        F.col("node.changed").alias("changed"),
    )


def verify(proofs: DataFrame) -> DataFrame:
    """Digest of each proof, and whether the row's (changed) leaf leads to the root along it."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
