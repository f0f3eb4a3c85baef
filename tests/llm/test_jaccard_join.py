"""The join against all pairs in plain Python."""

import random

import numpy as np
import pytest

from cuestream.llm import jaccard_join as J


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [
        [j for j in range(len(rows)) if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
        for i in range(len(rows))
    ]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            for j in js:
                if rows[label[j]][0] < rows[label[i]][0]:
                    label[i], changed = label[j], True
    return {rows[i][0]: (rows[label[i]][0], len(near[i])) for i in range(len(rows))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=n) for n in (120, 80, 40, 5000)]
    out = []
    for words in base:
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)]
    out += [out[0], out[0].upper(), None, "", " \n", "two words", "two  WORDS", "two other", "a b c d e", "a b c d e"]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [J.BLOCK, 4])
def test_links_and_classes_match_all_pairs(spark, rows, block):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, class_id int, rep string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs, block=block).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(d, t, None) for d, t in rows] + [(None, "no id", 1)], "doc_id long, text string, keep_id int")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, (c, _) in brute(rows).items() if c == d} | {None}
    assert {r.doc_id for r in kept.collect()} == want


def test_repeated_rows_are_copies_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert J.join(docs.limit(0)).count() == 0


def test_pruning_rule_is_the_beta_posterior():
    # by integration: prior uniform, likelihood binomial
    x = (np.arange(200000) + 0.5) / 200000
    for n, m in ((10, 4), (50, 33), (100, 70)):
        density = x**m * (1 - x) ** (n - m)
        chance = density[x >= 0.8].sum() / density.sum()
        assert (J.least_matches(0.8, chance * 0.999, n) <= m) and (J.least_matches(0.8, chance * 1.001, n) > m)


def test_rows_that_share_an_id_keep_one_of_each_group(spark):
    a, b = "one two three four five six seven", "other words of some other text here"
    docs = spark.createDataFrame([(5, a, 1), (7, a, 2), (2, b, 3), (5, b, 4), (5, a, 5)], "doc_id long, text string, node int")
    assert sorted((r.doc_id, r.text) for r in J.keep_one(docs).collect()) == [(2, b), (5, a), (5, a)]
