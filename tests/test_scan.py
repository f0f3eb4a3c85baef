"""Both plans of an ordered scan give the same rows, also for a key with a third of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from cuestream.operators import postprocess as P
from cuestream.operators.debounce import debounce, greedy_mask
from cuestream.operators.estimate import anchored_timeline, time_scenes_sequentially
from cuestream.plans import scan as S
from cuestream.plans.joins import interval_join, nearest_join


@pytest.fixture(scope="module", autouse=True)
def many_chunks(spark):
    """Keep small range partitions apart, so that a hot key really splits."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = 1 if i % 3 == 0 else rng.randrange(2, 40)
        t = 5 if i % 9 == 0 else rng.randrange(0, 4000)
        data.append((key, t, i, rng.choice([None, rng.randrange(100)]), t + rng.randrange(0, 90)))
    return spark.createDataFrame(data, "k int, t long, id long, v int, e long")


def steps():
    return {
        "a": S.max_before("v"), "b": S.max_upto("v"), "c": S.sum_before("v"), "d": S.sum_upto("v"), "e1": S.last_before("v"),
        "f": S.last_upto("v"), "g": S.first_after("v"), "h": S.prev_row("v"), "i": S.next_row("v"), "j": S.position(),
        "l": S.group_sum("v"), "m": S.group_max("v"), "_n": S.group_count(), "o": S.group_min("v"),
    }


def test_chunked_scan_equals_plain_scan(skewed):
    plain = S.OrderedScan.over(skewed, ["k"], ["t", "id"], hot=False).add(**steps()).done()
    chunked = S.OrderedScan.over(skewed, ["k"], ["t", "id"], hot=True)
    assert chunked.df.filter("k = 1").select(S.CHUNK).distinct().count() > 1
    assert rows(plain, *plain.columns) == rows(chunked.add(**steps()).done(), *plain.columns)


def test_hot_groups_are_found_by_size(skewed):
    assert S.has_hot_group(skewed, ["k"], 200)
    assert not S.has_hot_group(skewed, ["k"], 2_000)


def test_two_scans_in_a_row(skewed):
    def run(hot):
        scan = S.OrderedScan.over(skewed, ["k"], ["t", "id"], hot=hot).add(x=S.last_before("v"))
        return scan.let(y=F.coalesce("x", F.lit(0)) + F.col("t")).add(z=S.sum_upto("y")).done()

    assert rows(run(False), "id", "x", "y", "z") == rows(run(True), "id", "x", "y", "z")


def test_sliding_equals_one_window(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.rand(3).alias("x"))
    stages = (
        {"m": lambda w: F.round(F.avg("x").over(w.rowsBetween(-4, 4)), 9)},
        {"n": lambda w: F.max("m").over(w.rowsBetween(-2, 2))},
    )
    df = spark.createDataFrame(df.collect(), df.schema)
    one = S.sliding(df, ["k"], "i", 6, *stages)
    many = S.sliding(df, ["k"], "i", 6, *stages, chunk_rows=20)
    assert rows(one, "k", "i", "m", "n") == rows(many, "k", "i", "m", "n")


@pytest.mark.parametrize("gap", [1, 7, 40, 900])
def test_debounce_plans_and_brute_force(skewed, gap):
    got = {hot: rows(debounce(skewed, ["k"], "t", "id", gap, hot=hot), "k", "id") for hot in (False, True)}
    want = []
    data = sorted(skewed.collect(), key=lambda r: (r.k, r.t, r.id))
    last = {}
    for r in data:
        if r.k not in last or r.t - last[r.k] >= gap:
            last[r.k] = r.t
            want.append((r.k, r.id))
    assert got[False] == got[True] == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_greedy_mask_with_entry():
    assert greedy_mask(np.array([4, 5, 10, 13, 20, 23]), 10, 3).tolist() == [False, False, False, True, False, True]


def test_nearest_join_against_brute_force(skewed):
    left = skewed.filter("v is not null").select("k", "t", "id")
    right = skewed.filter("v is null").select("k", F.col("t").alias("beat"), F.col("id").alias("rid"))
    beats = {}
    for r in right.collect():
        beats.setdefault(r.k, []).append(r.beat)
    want = sorted(
        ((r.id, min(beats[r.k], key=lambda b: (abs(b - r.t), b)) if r.k in beats else None) for r in left.collect()),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )
    for hot in (False, True):
        got = nearest_join(left, right, ["k"], "t", "beat", "id", "rid", hot=hot).withColumn("b", F.col("nearest.beat"))
        assert rows(got, "id", "b") == want


def test_interval_join_against_brute_force(skewed):
    points = skewed.select("k", F.col("t").alias("p")).distinct()
    spans = skewed.select("k", "id", "t", "e")
    got = interval_join(points, spans, ["k"], "p", F.col("t") - 3, F.col("e"), 25)
    want = [(p.k, p.p, s.id) for p in points.collect() for s in spans.collect() if p.k == s.k and s.t - 3 <= p.p <= s.e]
    assert rows(got, "k", "p", "id") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def cues_of(skewed):
    return skewed.select(F.col("k").alias("track_id"), F.col("id").alias("cue_id"), F.col("t").alias("start_us"), F.col("e").alias("end_us"))


def test_post_process_hot_equals_plain(skewed):
    options = P.PostProcessOptions(min_line_us=30, apply_lead_in=True, lead_in_us=10, gap_fill_us=20)
    cues = cues_of(skewed)
    out = [rows(P.post_process(cues, options, F.lit(4100), hot), "cue_id", "start_us", "end_us") for hot in (False, True)]
    assert out[0] == out[1]


def test_overlaps_against_a_plain_loop(skewed):
    got = rows(P.resolve_overlaps(cues_of(skewed), hot=True), "cue_id", "start_us", "end_us")
    want, latest = [], {}
    for r in sorted(skewed.collect(), key=lambda r: (r.k, r.t, r.id)):
        before = latest.get(r.k, 0)
        start = min(before, r.e) if r.t < before else r.t
        latest[r.k] = max(before, r.e)
        want.append((r.id, start, max(start, r.e)))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("hot", [False, True])
def test_cursor_recurrences_against_plain_loops(spark, hot):
    rng = random.Random(3)
    data = []
    for track in (1, 2, 3):
        for seq in range(60 if track == 1 else 20):
            pick = lambda p, hi: rng.randrange(hi) if rng.random() < p else None
            data.append((track, seq, 100 + rng.randrange(900), pick(0.2, 30_000), pick(0.2, 30_000), pick(0.3, 50), rng.random() < 0.2))
    df = spark.createDataFrame(data, "track_id int, seq int, len long, at_us long, until_us long, pause_after_us long, locked boolean")
    df = df.withColumns({"length_us": F.lit(None).cast("long"), "start_us": F.coalesce("at_us", F.lit(0)), "end_us": F.coalesce("until_us", F.lit(0))})
    got = rows(anchored_timeline(df, F.col("len"), 25, 20, hot), "track_id", "seq", "start_us", "end_us")
    want, cursor = [], {}
    for track, seq, length, at, until, pause, _ in data:
        start = at if at is not None else cursor.get(track, 0)
        end = max(start + 20, until if until is not None else start + max(20, length))
        cursor[track] = end + (pause if pause is not None else 25)
        want.append((track, seq, start, end))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))

    got = rows(time_scenes_sequentially(df, F.col("len"), 0, 0, hot), "track_id", "seq", "start_us", "end_us")
    want, cursor = [], {}
    for track, seq, length, at, until, _, locked in data:
        c, s, e = cursor.get(track, 0), at or 0, until or 0
        if locked and e > s:
            cursor[track] = max(c, e)
            want.append((track, seq, s, e))
        else:
            cursor[track] = c + length
            want.append((track, seq, c, c + length))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_whole_queries_with_every_group_hot(spark, sf_dir):
    """Chunking forced everywhere leaves the results of whole operators as they are."""
    from cuestream import catalog

    catalog.load()
    names = ("tim14_post_process", "tim21_suggest_compensation", "seq01_debounce", "seq08_coalesce_edits", "str06_presence")
    plain = {n: rows(df := catalog.QUERIES[n](spark, sf_dir), *df.columns) for n in names}
    spark.conf.set("spark.cuestream.maxGroupRows", "3")
    try:
        hot = {n: rows(df := catalog.QUERIES[n](spark, sf_dir), *df.columns) for n in names}
    finally:
        spark.conf.unset("spark.cuestream.maxGroupRows")
    assert plain == hot


def test_estimates_hot_equal_plain(skewed):
    from cuestream.operators.estimate import estimate_line_timings

    lines = skewed.select(F.col("k").alias("track_id"), F.col("id").alias("seq"), F.lit("").alias("sig"), F.lit("x").alias("text"))
    got = [rows(estimate_line_timings(lines, hot=hot), "track_id", "seq", "start_us", "end_us") for hot in (False, True)]
    assert got[0] == got[1]
