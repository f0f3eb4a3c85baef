"""Syllables in two counts over one text, against the rule in steps."""

import random
import re

from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions.register import register_functions


def plain(s):
    words = 0 if s == "" else s.count(" ") + 1
    voiced = re.sub(r"(?:[b-df-hj-km-np-tv-xz]es|ed|[b-df-hj-km-np-tv-xz]e)(?= |$)", "", re.sub("[^a-z ]", "", s))
    return max(1, len(re.findall("[aeiouy]{1,2}", voiced)) + words - len(re.findall("[b-df-hj-np-tv-xz]*[aeiouy][a-z]*", voiced)))


def test_counts_match_the_steps(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("eeeesdlyabtö1") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 4))) for _ in range(4000)]
    texts += ["", "freed", "e", "ed", "es", "le les", "the played games", "日本 1"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    register_functions(spark)
    got = df.select("s", X.syllables("s").alias("a"), F.expr("syllables(s)").alias("b")).collect()
    assert all(r["a"] == r["b"] == plain(r["s"]) for r in got)


def test_a_weight_makes_its_text_once(spark):
    df = spark.createDataFrame([("a",)], "s string").select(X.speech_weight("s").alias("w"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 3


def test_counts_of_a_batch_match_the_steps(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("eeeesdlyabtö1") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 4))) for _ in range(4000)]
    texts += ["", "freed", "e", "ed", "es", "le les", "the played games", "日本 1", "a", "", "e"]
    for rows in (texts, [""], ["e"], []):
        got = X.syllable_counts.func(X.pa.array(rows, X.pa.string()))
        assert got.to_pylist() == [plain(t) for t in rows]
    # a slice, and a row that is missing
    assert X.syllable_counts.func(X.pa.array(["one two", None, "the games"])[1:]).to_pylist() == [1, plain("the games")]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3)
    assert all(r["a"] == r["b"] for r in df.select(X.syllables("s").alias("a"), X.syllable_counts("s").alias("b")).collect())
