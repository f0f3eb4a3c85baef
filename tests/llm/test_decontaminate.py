"""Decontamination against a brute-force scan; several blocks give what one gives."""

import re

import pytest

from cuestream.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "the quick brown fox jumps over the lazy dog again and again today"
ITEMS = [(1, PASSAGE), (2, "short item words"), (3, PASSAGE), (4, None), (5, ""), (6, "?!"), (7, "ÄÖ é 日本 x1 y2 z3 a b c d e f g"), (1, "another text of item one")]
DOCS = [
    (1, "Nothing here."),
    (2, f"Before. {PASSAGE.upper()} after"),
    (3, "quick brown fox jumps over the lazy dog again, and: again"),
    (4, "quick brown fox jumps over the lazy dog again"),
    (5, "SHORT-item  words"),
    (6, None),
    (7, ""),
    (8, "b c ÄÖ é 日本 x1 y2 z3 a b c d e f g short item words short item words"),
    (9, "x " * 30000 + PASSAGE + " y" * 30000),
    (2, f"Before. {PASSAGE.upper()} after"),
    (None, PASSAGE),
    (10, "äö É 日本 x1 y2 z3 a b c d e f g"),
]


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, n=10):
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        v = words(t)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                items.add(str(item))
    return len(w), hit, sorted(items)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, 0, "s") for d, t in DOCS], "doc_id long, text string, spans int, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 8])
def test_hits_match_brute_force(tables, block_words):
    got = D.find_hits(*tables, block_words=block_words).withColumn("n_hit", D.count_hit_words()).collect()
    assert len(got) == len(DOCS)
    for r in got:
        text = next(t for d, t in DOCS if d == r.doc_id)
        n, hit, items = brute(text)
        spans = {p for s in r.spans for p in range(s["first"], s["last"] + 1)}
        assert (r.n_words, spans, r.n_hit, list(r["items"])) == (n, hit, len(hit), items)


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 8])
def test_documents_and_spans_are_removed(tables, block_words):
    docs, bench = tables
    kept = D.clean_documents(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in DOCS if not brute(t)[1])
    cut = {r.doc_id: r.text for r in D.clean_spans(docs, bench, block_words=block_words).collect()}
    assert cut[1] == "Nothing here." and cut[2] == "Before.  after" and cut[5] == "" and cut[6] is None
    assert not any(brute(t)[1] for d, t in cut.items() if d in (2, 3, 5, 9))


def test_empty_tables(spark, tables):
    docs, bench = tables
    assert D.find_hits(docs.limit(0), bench).count() == 0
    assert all(not r.spans for r in D.find_hits(docs, bench.limit(0)).collect())
    assert D.clean_documents(docs, bench.limit(0)).count() == len(DOCS)


def test_items_without_an_id_mark_words_and_have_no_name(spark):
    docs = spark.createDataFrame([(1, "before some leaked words after"), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "some leaked words"), (9, "leaked words")], "item_id long, text string")
    for size in (D.BLOCK_WORDS, 4):
        hits = {r.doc_id: r for r in D.find_hits(docs, bench, block_words=size).collect()}
        assert list(hits[1]["items"]) == ["9"] and not hits[2].spans
        covered = {i for s in hits[1].spans for i in range(s["first"], s["last"] + 1)}
        assert covered == {1, 2, 3}
        assert [r.doc_id for r in D.clean_documents(docs, bench, block_words=size).collect()] == [2]
