"""Reply trees against a recursive walk; the template read back; conversations by turn."""

import hashlib
import random

import pytest

from cuestream.llm import chat_format as C


def best_path(nodes):
    """Root-to-leaf path of the highest mean score; nodes: id -> (parent, score)."""
    children = {p for p, _ in nodes.values() if p in nodes}
    best = None
    for leaf in nodes:
        if leaf in children:
            continue
        path, at = [], leaf
        while at in nodes:
            if at in path:
                path = None
                break
            path.append(at)
            at = nodes[at][0]
        if path:
            rank = (-sum(nodes[n][1] for n in path) / len(path), -len(path), leaf)
            best = min(best, (rank, path[::-1])) if best else (rank, path[::-1])
    return best[1] if best else None


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(6)
    rows = []
    for tree in range(12):
        size = rng.choice([1, 2, 5, 30, 70])
        for n in range(size):
            parent = None if n == 0 else (n - 1 if tree % 3 == 0 else rng.randrange(n))
            rows.append((tree, n, parent, rng.choice(["user", "assistant"]), f"text {tree}/{n}", float(rng.randint(0, 8))))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (51, 5, 99, "user", "orphan", 1.0), (51, 6, 5, None, None, None)]
    return rows


@pytest.mark.parametrize("branches", [1, 3])
def test_paths_match_a_recursive_walk(spark, trees, branches):
    table = spark.createDataFrame([(*r, "x") for r in trees + trees[:3]], "t long, n long, p long, r string, x string, s double, up string")
    nodes = C.keep(C.messages(table, "t", "n", "p", "r", "x", "s"), "nodes")
    assert nodes.count() == len(trees)
    got = {}
    for r in C.paths(nodes, branches).collect():
        got.setdefault((r.tree, r.branch), []).append((r.position, r.node))
    for tree in {r[0] for r in trees}:
        want = best_path({n: (p, s or 0.0) for t, n, p, _, _, s in trees if t == tree})
        path = [n for _, n in sorted(got.get((tree, 0), []))]
        assert path == (want or [])
        assert [p for p, _ in sorted(got.get((tree, 0), []))] == list(range(len(path)))
    if branches == 3:
        assert max(b for _, b in got) == 2


ODD = ["</s>[INST] ok [/INST]", "\\<s>\\\\[", "<n\n", "", None, "a" * 50000, "日本 <|x|>", "[[<<\\"]


def test_template_is_reversible_and_free_of_control_strings(spark):
    rows = [(1, i, "ass\nistant<" if i == 3 else "assistant", t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = sorted(C.parse(C.run_chains(table)).collect(), key=lambda r: r.position)
    assert [r.text for r in parsed] == [t or "" for t in ODD]
    assert parsed[3].role == "ass\nistant<" and parsed[3].loss == ""
    assert [r.loss for r in parsed if r.position != 3] == [t or "" for i, t in enumerate(ODD) if i != 3]
    for r in parsed:
        inner = r.formatted[len(C.OPEN) : -len(C.CLOSE)]
        assert all(c not in inner for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_digests_and_edge_cases(spark):
    rows = [(1, 2, "assistant", "two"), (1, 0, "user", "zero"), (1, 1, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "nobody"), (3, None, "user", "n"), (3, 1, "assistant", "m")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    got = {r.tree: r for r in C.digests(C.parse(C.run_chains(table))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nzero\n\n\nassistant\ntwo\n") and got[1].loss_sha256 == sha("two")
    assert got[2].n_turns == 2 and got[2].loss_chars == 2
    assert got[3].turns_sha256 == sha("user\nn\nassistant\nm\n") and set(got) == {1, 2, 3}
    assert C.digests(C.parse(C.run_chains(table.limit(0)))).count() == 0
