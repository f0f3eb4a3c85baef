"""Rule ledger: base measures against plain Python, edge cases, policies and ablations."""

import re

from pyspark.sql import types as T

from cuestream.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "a b c a b c",
    "x x x x x",
    "a b a b a b a b",
    "same line here\nsame line here\nother\n\n \nsame line here",
    "#tag *b* $5 % & | <i>",
    "LOUD WORDS HERE " * 30,
    "ünï çödé 日本語  non-breaking wide",
    " ".join(f"w{i % 37}" for i in range(5000)),
    " ".join(f"u{i}" for i in range(60)),
]


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {p + j for p in at for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered),
        len(re.findall("[A-Z]", t)),
    )


def test_measures_match_plain_python(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ledger string, kept boolean")
    got = Q.evaluate(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[m] for m in Q.MEASURES) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r["_ledger"] == "x"
        assert bool(r.failed_bits & 1) == (r.n_words < 50)


def test_policies_share_one_ledger_and_ablations_count_bits(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = Q.evaluate(docs).cache()
    bits = {r.doc_id: r.failed_bits for r in ledger.collect()}
    for policy in (Q.BASE, Q.STANDARD):
        kept = {r.doc_id for r in Q.apply_policy(ledger, policy).filter("kept").collect()}
        assert kept == {d for d, b in bits.items() if not b & policy.mask()}
        for r in Q.ablations(ledger, policy).collect():
            bit = 1 << next(x.bit for x in Q.RULES if x.name == r.rule)
            assert r.n_failed == sum(1 for b in bits.values() if b & bit)
            assert r.n_only == sum(1 for b in bits.values() if b & policy.mask() == bit)
            assert r.n_kept_without == sum(1 for b in bits.values() if not b & policy.mask() & ~bit)


def test_reject_keeps_columns_and_clean_rows(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, clean, "en", 3), (2, "short", None, None), (None, clean, None, 1), (3, None, "en", 2)],
        "doc_id long, text string, n_words string, failed_bits long",
    )
    out = Q.reject(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted([r for r in docs.collect() if r.text == clean], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert Q.evaluate(empty).count() == 0 and Q.reject(empty).count() == 0
    assert {r.n_failed for r in Q.ablations(Q.evaluate(empty)).collect()} == {0}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").repartition(2)
    plan = Q.apply_policy(Q.evaluate(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
