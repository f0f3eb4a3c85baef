"""Repeated substrings against a plain scan of all windows."""

import random

import numpy as np
import pytest

from cuestream.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for p in range(len(t) - 99):
            first.setdefault(t[p : p + 100], (d, p))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (d, p):
                gone[p : p + 100] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkléü", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (18, 25, 60, 15)] + ["z" * 300, "ab" * 120]
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "y" * 700]
    for _ in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], text(rng.randint(0, 6))]
        out.append(rng.choice([" ", ""]).join(parts))
    out += [out[20], out[21], out[21] + "!", "!" + out[22], text(4000), passages[2] * 6]
    rng.shuffle(out)
    return [(7 * i - 200, t) for i, t in enumerate(out)]


def test_every_removed_byte_matches(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows] + [(None, rows[30][1], "y", 2)], "doc_id long, text string, places string, of int")
    got = S.dedup(docs).collect()
    want = brute([(d, (t or "").encode()) for d, t in rows])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got if r.doc_id is not None} == want
    assert sum(n for _, n, _, _ in want.values()) > 1000
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_repeated_rows_and_empty_table(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=400))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.dedup(docs).collect()) == [(1, 0), (1, 0), (2, 400)]
    assert S.dedup(docs.limit(0)).count() == 0


def test_stretches_of_a_long_text_join(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8))
    whole = S.samples(text)
    monkeypatch.setattr(S, "STRETCH", 700)
    cut = S.samples(text)
    cover = lambda s: sorted((int(p), int(a)) for a, lo, hi, _ in zip(*s) for p in range(lo, hi + 1))
    assert cover(whole) == cover(cut) and len(cover(whole)) == 5000 - 99


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            keys = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 40)))
            n = len(keys)
            runs.append(S.Run(S.Run.pack(keys, [b""] * n, [0] * n, [0] * n, list(range(n)), [0] * n)))
        out = [(runs[r].keys[i], n) for r, i, n in S.merge(runs)]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r.keys)
        assert all(n == S.shared(a, b, 0) for (a, _), (b, n) in zip(out, out[1:]))
