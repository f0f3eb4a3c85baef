"""Relative Lempel-Ziv dedup against all pairs of windows, and its defined results."""

import random

import pytest

from cuestream.llm import lempel_ziv_dedup as Z

SCHEMA = "doc_id long, text string, row int, words string, h long"


def plain(rows, window=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in Z.dedup(df, **how).collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 5)
            words += p[a : a + rng.randint(5, 60)] if rng.random() < 0.7 else [f"w{rng.randint(0, 30)}" for _ in range(20)]
        rows.append((rng.randint(-3, n), " ".join(words).replace(" ", "\n", 2)))
    return rows


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_removed_word_matches(spark, seed, hot):
    rows = corpus(seed)
    want = plain(rows)
    assert sum(r[2] for r in want) > 100
    assert got(spark, rows, hot=hot) == want


def test_windows_of_stretches_cover_each_window_once():
    text = (" ".join(f"w{i}" for i in range(300))).encode()
    starts = [first + i for first, part in Z.stretches(text, 100) for i in range(len(part) - 12)]
    assert starts == list(range(288))


def test_factors_are_greedy_and_cross_their_ends():
    ref = Z.Reference()
    a, b = [b"a%d" % i for i in range(20)], [b"b%d" % i for i in range(20)]
    ref.add(a, [])
    ref.add(a[10:] + b, [])
    assert list(ref.factors(a + b)) == [(0, 20), (10, 40)]
    assert list(ref.factors(a[:12] + b[:12])) == []


def test_nulls_ties_repeats_long_texts_and_empty_table(spark):
    p = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [
        (3, p), (3, p), (3, "own " + p), (2, None), (None, p), (None, p), (1, ""), (4, p.replace(" ", " \t\n")), (9, " \n "), (7, "w1 " * 40), (8, "w1 " * 40),
        (20, long), (21, "y " + long), (5, "A " + p.upper()),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:0]) == []
