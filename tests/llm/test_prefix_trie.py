"""Prefix trie against a plain trie, and its defined results."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuestream.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c long, d string"


def plain(convs):
    """``convs``: conversation -> list of (role, text). A row per node."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    totals = {}
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        totals[key] = (sum(totals[k][0] for k in kids[key]) or 1, saved + sum(totals[k][1] for k in kids[key]))
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(key)))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(m), len(key), parent, len(m), len(kids[key]), *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[x] for x in names) for r in df.collect()), key=str)


def table(spark, convs):
    rows = [(c, i, role, text, 0, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    convs = {c: [(rng.choice("ab"), rng.choice(["", "x", "yé"])) for _ in range(rng.randint(1, 6))] for c in range(60)}
    assert got(T.trie(T.unchanged(T.turns_of(table(spark, convs))))) == plain(convs)


def test_chains_of_many_turns(spark):
    base = [("u", f"t{i}") for i in range(150)]
    convs = {1: base, 2: base[:97], 3: base[:64] + [("u", "other")] * 40, 9: base}
    assert got(T.trie(T.unchanged(T.turns_of(table(spark, convs))))) == plain(convs)


def test_shared_heads(spark):
    rng = random.Random(3)
    own = {c: [(rng.choice("ab"), f"{c % 5} {i}") for i in range(rng.randint(1, 7))] for c in [*range(0, 40), *range(100, 130)]}
    own |= {c: [("a", "alone")] for c in range(201, 212)}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    want = {c: own.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}
    head = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(6))
    turns = T.turns_of(table(spark, own))
    rebuilt = T.with_shared_heads(turns, F.col("c") - F.col("c") % 100, head, 5)
    assert any(not t for t in want.values())
    assert got(T.trie(rebuilt)) == plain(want)


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [
        (1, None, None, "first", 1, "a"), (1, 2, "b", None, 1, "a"), (1, 2, "a", "z", 1, "a"), (1, 2, "a", "z", 1, "a"), (None, 1, "a", "lost", 1, "a"),
        (-4, 5, "", "first", 1, "a"), (-4, 7, "a", "z" * 500_000, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {1: [("", "first"), ("a", "z"), ("a", "z"), ("b", "")], -4: [("", "first"), ("a", "z" * 500_000)]}
    assert got(T.trie(T.unchanged(T.turns_of(df)))) == plain(want)
    assert T.trie(T.unchanged(T.turns_of(df.limit(0)))).collect() == []


def test_digest_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_CHARS", 50)
    convs = {c: [("u", "same")] for c in range(-20, 300)}
    assert got(T.trie(T.unchanged(T.turns_of(table(spark, convs))))) == plain(convs)
