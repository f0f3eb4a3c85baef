"""Merkle manifest against a plain tree, and its defined results."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuestream.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, g int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows, fanout=8):
    """Per row (doc_id, leaf, subroot, root, proof digest)."""
    leaf = lambda r: H(*map(field, r[:5]))

    def tree(nodes):
        """The end of the tree, and of each node the siblings left and right on its way there."""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            groups = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for k, i in enumerate(at):
                mine = groups[i // fanout]
                paths[k].append(("".join(mine[: i % fanout]), "".join(mine[i % fanout + 1 :])))
            nodes, at = [H(*g) for g in groups], [i // fanout for i in at]
        return (nodes or [None])[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[lang] = (mine, *tree([leaf(r) for r in mine]))
    root, tops = tree([own[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        mine, sub, paths = own[lang]
        for r, p in zip(mine, paths, strict=True):
            out.append((r[0], leaf(r), sub, root, H(*(a + b for a, b in p + top))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in M.verify(df).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 130])
def test_proofs_match_a_plain_tree(spark, n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice([None, "de", "en", "ä", ""]), i, f"text {i} " + "ÄB" * (i % 4), "x", 1) for i in range(n)]
    assert got(M.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_other_fanout_and_one_group(spark):
    rows = [(i, None, None, None, str(i), "x", 1) for i in range(30)]
    assert got(M.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3)) == plain(rows, 3)


def test_nulls_ties_repeats_long_texts_and_empty_table(spark):
    rows = [
        (None, None, None, None, None, None, None), (None, "", "", 0, "", "", 0), (5, "a", "en", 1, "one", "p", 1), (5, "a", "en", 1, "one", "q", 2),
        (5, "a", "en", 1, "two", "p", 1), (-7, "a", "en", None, "x" * 2_000_000, "p", 1), (8, None, "en", 3, "", "p", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(M.manifest(df)) == plain(rows)
    assert M.verify(M.manifest(df.limit(0))).collect() == []


def test_tampering_is_found_where_it_changes_something(spark):
    rows = [(i, "s", "en", 1, ("Upper" if i % 2 else "lower") if i != 9 else None, "x", 1) for i in range(40)]

    def small(fields):
        hit = F.pmod(F.crc32(fields["doc_id"].cast("string").cast("binary")), F.lit(3)) == 0
        return F.when(hit, M.leaf([M.lower_ascii(v) if c == "text" else v for c, v in fields.items()]))

    out = {r.doc_id: r for r in M.verify(M.manifest(spark.createDataFrame(rows, SCHEMA), changed=small)).collect()}
    bad = {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 0 and i % 2 and i != 9}
    assert bad and {i for i, r in out.items() if not r.verified} == bad
    assert all((r.folded_root == r.root) == r.verified for r in out.values())
    assert len({r.folded_root for i, r in out.items() if i in bad}) == len(bad)
