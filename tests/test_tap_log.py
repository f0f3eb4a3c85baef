"""Tap logs split into chunks, against the plain run."""

import random

import pytest

from conftest import rows
from cuestream.operators import tap_log as T
from cuestream.plans.groups import fold_groups

SCHEMA = "track_id long, seq long, type string, time_us long, line_index long, amount long"


def plain(log, lines):
    out = []
    for track in sorted(lines):
        state = T.TapState(lines[track])
        for r in sorted((r for r in log if r[0] == track), key=lambda r: r[1]):
            state.apply(*r[2:])
        out += [(track, line, at, seq, state.compensation, state.gap) for line, at, seq in state.taps]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def log(seed, n, weights, step=60_000):
    rng = random.Random(seed)
    names = [*T.KINDS, "OTHER"]
    return [
        (rng.choice([1, 1, 1, 2]), i, rng.choices(names, weights)[0], i * step + rng.randint(0, 90_000), rng.randint(0, 30), rng.randint(-90_000, 90_000))
        for i in range(n)
    ]


@pytest.mark.parametrize(
    "weights", [(9, 2, 3, 0, 1, 1, 0, 1), (9, 2, 3, 0, 1, 1, 3, 0), (5, 3, 9, 0.05, 1, 1, 2, 0), (9, 1, 1, 0, 0, 0, 0, 0), (1, 4, 9, 0, 1, 0, 2, 0)]
)
@pytest.mark.parametrize("lines", [{1: 1000, 2: 7}, {1: 40, 2: 1000}])
def test_chunks_match_the_plain_run(spark, monkeypatch, weights, lines):
    monkeypatch.setattr(T, "CHUNK", 32)
    data = log(len(lines) + int(weights[2]), 900, weights)
    counts = spark.createDataFrame(list(lines.items()), "track_id long, n_lines long")
    got = T.fold_tap_log(spark.createDataFrame(data, SCHEMA), counts)
    assert rows(got, "track_id", "line_index", "time_us", "tap_seq", "compensation_us", "gap_us") == plain(data, lines)


@pytest.mark.parametrize("small", [0, 8, 100])
def test_short_and_long_sessions_together(spark, monkeypatch, small):
    monkeypatch.setattr(T, "CHUNK", 32)
    monkeypatch.setattr(T, "SMALL_CHUNKS", small)
    data = [*log(5, 700, (9, 2, 3, 0.05, 1, 1, 2, 1)), (3, 0, "TAP", 5, 0, 0), (None, 0, "TAP", 5, 0, 0)]
    counts = spark.createDataFrame([(1, 1000), (2, 7), (4, 3), (5, None)], "track_id long, n_lines long")
    got = T.fold_tap_log(spark.createDataFrame(data, SCHEMA), counts)
    assert rows(got, "track_id", "line_index", "time_us", "tap_seq", "compensation_us", "gap_us") == plain(data, {1: 1000, 2: 7})


def test_short_sessions_are_not_cut(spark, monkeypatch):
    """A session whose few commands lie in many ranges of numbers is one group, not one for each range."""
    data = [(r[0], 5000 * r[1], *r[2:]) for r in log(6, 300, (9, 2, 3, 0.05, 1, 1, 2, 1))]
    cut = []
    monkeypatch.setattr(T, "fold_groups", lambda df, *a: cut.append(df) or fold_groups(df, *a))
    counts = spark.createDataFrame([(1, 1000), (2, 7)], "track_id long, n_lines long")
    got = T.fold_tap_log(spark.createDataFrame(data, SCHEMA), counts)
    assert rows(got, "track_id", "line_index", "time_us", "tap_seq", "compensation_us", "gap_us") == plain(data, {1: 1000, 2: 7})
    assert cut[0].count() == 0


def test_effects_hold_or_say_that_they_do_not():
    rng = random.Random(8)
    applied = 0
    for _ in range(3000):
        lines, entry = rng.choice([6, 50]), rng.randint(0, 6)
        session = T.Session(lines, 0, T.GAP)
        session.times, session.places = [rng.randint(0, 400_000) for _ in range(entry)], list(range(1, entry + 1))
        session.count = entry
        state = T.TapState(lines)
        state.taps, state.next_line, state.seq = [[i, t, i + 1] for i, t in enumerate(session.times)], entry, entry
        data = [r[2:] for r in log(rng.random(), 12, (6, 2, 4, 0, 1, 1, 2 if rng.random() < 0.5 else 0, 0), 30_000) if r[2] != "OTHER"]
        kinds = [T.KINDS.index(r[0]) for r in data]
        effect = T.Effect(max(0, entry + rng.choice([0, 0, 1, -1])), lines, 0, T.GAP).run(kinds, *[[r[k] for r in data] for k in (1, 2, 3)])
        for r in data:
            state.apply(*r)
        if session.apply(effect.pack()):
            applied += 1
            assert [[i, t, p] for i, (t, p) in enumerate(zip(session.times, session.places, strict=True))] == state.taps
            assert (session.count, session.compensation, session.gap) == (state.seq, state.compensation, state.gap)
    assert applied > 300


def test_building_starts_no_job_and_empty_log(spark):
    counts = spark.createDataFrame([(1, 5)], "track_id long, n_lines long")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    df = T.fold_tap_log(spark.createDataFrame([], SCHEMA), counts)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert df.collect() == []
