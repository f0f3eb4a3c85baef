"""Words spread over their cue without a shuffle."""

import time

from pyspark.sql import functions as F

from cuestream.operators import estimate as E


def test_words_of_a_cue_are_timed_in_place(spark):
    rows = [(1, 0, "aa b cccc", 1_000, 8_000, "x"), (1, 1, "", 0, 5, "y"), (2, 0, None, 0, 5, "z"), (2, 1, "one", 9, 4, "v"), (3, 0, "日本", 0, 10, "w")]
    cues = spark.createDataFrame(rows, "track_id long, cue_id long, text string, start_us long, end_us long, tag string")
    words = E.interpolate_words(cues, carry=["tag"])
    want = [
        (1, 0, 0, "aa", 1_000, 3_000, "x"), (1, 0, 1, "b", 3_000, 4_000, "x"), (1, 0, 2, "cccc", 4_000, 8_000, "x"),
        (2, 1, 0, "one", 9, 9, "v"), (3, 0, 0, "日", 0, 5, "w"), (3, 0, 1, "本", 5, 10, "w"),
    ]
    assert sorted(map(tuple, words.collect())) == want
    assert "Exchange" not in words._jdf.queryExecution().sparkPlan().toString() and "Window" not in words._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_long_line_take_their_share_of_time(spark):
    n = 40_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.repeat(F.lit("x"), (i % 3 + 1).cast("int"))), " ")
    cue = spark.range(1).select(F.lit(1).alias("track_id"), F.col("id").alias("cue_id"), text.alias("text"), F.lit(0).alias("start_us"), F.lit(8_000_000).alias("end_us"))
    begin = time.perf_counter()
    got = E.interpolate_words(cue).agg(F.count("*"), F.max("end_us"), F.sum(F.col("end_us") - F.col("start_us"))).first()
    assert time.perf_counter() - begin < 15
    assert got[0] == n and got[1] == 8_000_000 and abs(got[2] - 8_000_000) < n


def test_times_that_are_missing(spark):
    rows = [(1, 0, "a bb", None, 9), (1, 1, "a bb", 3, None), (1, 2, "a bb", None, None)]
    cues = spark.createDataFrame(rows, "track_id long, cue_id long, text string, start_us long, end_us long")
    got = sorted(tuple(r) for r in E.interpolate_words(cues).select("cue_id", "word_idx", F.coalesce("start_us", F.lit(-1)), F.coalesce("end_us", F.lit(-1))).collect())
    assert got == [(0, 0, -1, -1), (0, 1, -1, 9), (1, 0, 3, 3), (1, 1, 3, 3), (2, 0, -1, -1), (2, 1, -1, -1)]


CUES = "track_id long, cue_id long, text string, start_us long, end_us long"
WORDS = "track_id long, cue_id long, word_idx long, text string, start_us long, end_us long, source string"


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_refreshed_words_are_read_once(spark):
    cues = spark.createDataFrame([(1, 0, "a b", 0, 10), (1, 1, "c d", 10, 20), (1, 2, "e", 20, 30), (1, 2, "f", 30, 40), (None, 3, "g", 0, 4)], CUES)
    words = spark.createDataFrame(
        [(1, 0, 1, "B", 6, 7, "asr"), (1, 0, 0, "A", 1, 2, "estimate"), (1, 1, 0, "C", 11, 12, "estimate"), (1, 1, 1, "D", 13, 14, None),
         (1, 2, 0, "E", 21, 22, "human"), (1, 7, 0, "Z", 1, 2, "human"), (1, 8, 0, "Y", 1, 2, "estimate"), (None, 3, 0, "G", 1, 2, "human")], WORDS)
    out = E.refresh_words(cues, words)
    assert scans(out) == 2
    got = sorted((r.track_id or 0, r.cue_id, r.word_idx, r.text, r.start_us, r.end_us) for r in out.collect())
    assert got == [
        (0, 3, 0, "g", 0, 4), (1, 0, 0, "A", 1, 2), (1, 0, 1, "B", 6, 7), (1, 1, 0, "c", 10, 15), (1, 1, 1, "d", 15, 20),
        (1, 2, 0, "E", 21, 22), (1, 7, 0, "Z", 1, 2),
    ]
    kept = {(r.cue_id, r.text) for r in E.refresh_words(cues, words, preserve_words=False).collect()}
    assert kept == {(0, "a"), (0, "b"), (1, "c"), (1, "d"), (2, "E"), (3, "g"), (7, "Z")}


def test_usable_words_are_read_once(spark):
    cues = spark.createDataFrame([(1, k, "a bb", 10, 40) for k in range(9)] + [(1, 9, "", 0, 5), (1, 10, None, 0, 5)], CUES)
    lists = {
        0: [(0, "a", 10, 20), (1, "bb", 19, 41)],  # fits, with a tolerance of one
        1: [(0, "a", 10, 10), (1, "bb", 20, 30)],  # the first is empty
        2: [(0, "a", 10, 20), (1, "bb", 20, 20)],  # a later one may be
        3: [(0, "a", 10, 20), (1, "bb", 8, 30)],  # out of order, and outside
        4: [(0, "a", 10, 20)],  # too few
        5: [(0, "a", 10, 20), (1, " ", 20, 21), (2, "bb", 20, 30)],  # blank words do not count
        6: [(1, "bb", 20, 30), (0, "a", 12, 15)],
        7: [(0, "a", None, None), (1, "bb", 20, 30)],
    }
    words = spark.createDataFrame([(1, c, *w, "asr") for c, ws in lists.items() for w in ws], WORDS)
    out = E.usable_words(cues, words)
    assert scans(out) == 2
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.cue_id, r.word_idx)):
        got.setdefault(r.cue_id, []).append((r.stored, r.text, r.start_us, r.end_us))
    spread = [(False, "a", 10, 20), (False, "bb", 20, 40)]
    assert [got.get(k) for k in (1, 3, 4, 8, 9, 10)] == [spread, spread, spread, spread, None, None]
    assert got[0] == [(True, "a", 10, 20), (True, "bb", 19, 41)] and got[2] == [(True, "a", 10, 20), (True, "bb", 20, 20)]
    assert got[5] == [(True, "a", 10, 20), (True, "bb", 20, 30)] and got[6] == [(True, "a", 12, 15), (True, "bb", 20, 30)]
    assert got[7] == [(True, "a", None, None), (True, "bb", 20, 30)]
