"""Similarities of packed tokens, what edits are counted in, and how pairs are dealt."""

import random
import time

import duckdb

from cuestream.catalog.sqlviews import nw
from cuestream.operators import align as AL


def words(rng, n, letters, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_similarities_of_every_length_and_group(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(AL, "GROUP_BITS", 64)
    left, right = words(rng, 25, "abß日𝄞", 20), words(rng, 30, "abß日𝄞", 40)
    got = AL.token_similarity(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            want = float(a == b) if not a or not b else max(0.0, 1 - plain_distance(a, b) / max(len(a), len(b)))
            assert abs(got[i, j] - want) < 1e-12


def test_tables_in_parts_equal_whole_ones(monkeypatch):
    rng = random.Random(4)
    left, right = words(rng, 60, "abc", 5), words(rng, 50, "abc", 5)
    whole = AL.align_tokens(left, right)
    monkeypatch.setattr(AL, "CELLS", 40)
    assert AL.align_tokens(left, right) == whole


def test_edits_in_bytes_as_the_sql_counts_them():
    assert AL.token_similarity(["ß"], ["s", "ß", ""]).tolist() == [[0.0, 1.0, 0.0]]
    assert AL.token_similarity(["enß"], ["en"]).tolist() == [[1 - 1 / 3]]
    assert AL.token_similarity(["enß"], ["en"], "bytes").tolist() == [[1 - 2 / 3]]
    rng = random.Random(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE pr (p BIGINT, a VARCHAR[], b VARCHAR[])")
    want = []
    for p in range(12):
        a, b = words(rng, 9, "abßé", 6), words(rng, 7, "abßé", 6)
        con.execute("INSERT INTO pr VALUES (?, ?, ?)", [p, a, b])
        got = AL.align_tokens(a, b, unit="bytes")
        want.append((p, round(sum(s for _, _, s in got) / len(got), 9)))
    assert con.sql(f"WITH RECURSIVE {nw('pr')} SELECT p, round(score, 9) FROM nw_score ORDER BY p").fetchall() == want


def test_long_lines_take_their_share_of_time():
    rng = random.Random(6)
    left, right = words(rng, 200, "abcdefghijklmnop", 160), words(rng, 200, "abcdefghijklmnop", 160)
    start = time.perf_counter()
    AL.align_tokens(left, right)
    assert time.perf_counter() - start < 6


def test_pairs_are_dealt_over_the_cores(spark):
    rows = [(k, ["a", "b"], ["a", "c"]) for k in range(200)]
    pairs = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").coalesce(1)
    out = AL.align_pairs(pairs, ["k"], "a", "b")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, AL.alignment_score(out, ["k"]).collect())) == [(k, 0.5) for k in range(200)]


def test_distances_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(AL, "LANES", 5)
    for letters, longest in (("ab", 200), ("abß日𝄞", 70), ("abc", 129)):
        tokens = sorted(filter(None, words(rng, 30, letters, longest)), key=len) + ["a" * 200, "b" * 256]
        i, j = AL.np.triu_indices(len(tokens), 1)
        want = [plain_distance(tokens[a], tokens[b]) for a, b in zip(i, j)]
        assert AL._distances(tokens, i, j).tolist() == want
        monkeypatch.setattr(AL, "PLACES", 0)
        assert AL._distances(tokens, i, j).tolist() == want
        monkeypatch.undo()


def test_lists_aligned_together_equal_single_ones(monkeypatch):
    rng = random.Random(8)
    pairs = [(words(rng, rng.randint(0, 9), "abßé", 90), words(rng, rng.randint(0, 9), "abßé", 9)) for _ in range(40)]
    for unit in ("characters", "bytes"):
        single = []
        for a, b in pairs:
            similar = AL._Similarities(b, unit)  # rows one by one
            single.append(AL.align_tokens(a, b, unit=unit, similar=similar))
        for chars in (1, 300, 1 << 20):
            monkeypatch.setattr(AL, "PILE_CHARS", chars)
            assert list(AL.align_many(iter(pairs), unit)) == single


def test_each_pair_of_tokens_is_compared_once(monkeypatch):
    counted, plain = [], AL._distances
    monkeypatch.setattr(AL, "_distances", lambda t, i, j: counted.append(len(i)) or plain(t, i, j))
    lines = [f"line {k} of a text" * (k % 3 + 1) for k in range(20)]
    AL.align_tokens(lines, sorted(lines, reverse=True))
    assert counted == [190]
    assert [s for _, _, s in AL.align_tokens(lines, lines)] == [1.0] * 20
