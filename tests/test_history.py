"""Undo and redo split into chunks, against two plain stacks."""

import random

import numpy as np
import pytest

from conftest import rows
from cuestream.operators import history as H
from cuestream.plans.groups import fold_groups

SCHEMA = "track_id long, seq long, op string, extra string"


def plain(log, limit=None):
    out = []
    for track in {r[0] for r in log}:
        past, future, settled = [], [], []
        for _, seq, op, _ in sorted((r for r in log if r[0] == track), key=lambda r: r[1]):
            if op == "do":
                past, future = [*past, seq], []
            elif op == "undo" and past:
                future.insert(0, past.pop())
            elif op == "redo" and future:
                past.append(future.pop(0))
            if limit is not None and len(past) > limit:
                settled.append(past.pop(0))
        out += [(track, s, False) for s in settled] + [(track, s, True) for s in past]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def log(seed, n, weights):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), i * rng.choice([1, 1]), rng.choices(["do", "undo", "redo", "other"], weights)[0], "x") for i in range(n)]


@pytest.mark.parametrize("limit", [None, 0, 3, 20])
@pytest.mark.parametrize("weights", [(5, 3, 2, 1), (1, 10, 9, 0), (9, 1, 1, 1)])
def test_chunks_match_stacks(spark, monkeypatch, limit, weights):
    monkeypatch.setattr(H, "CHUNK", 16)
    data = log(len(weights) + (limit or 0), 700, weights)
    got = rows(H.replay_history(spark.createDataFrame(data, SCHEMA), limit), "track_id", "seq", "undoable")
    assert got == plain(data, limit)


def test_tables_hold_for_every_entry():
    rng = np.random.default_rng(2)
    for limit in (None, 2, 9):
        for _ in range(60):
            ops = rng.choice([H.DO, H.UNDO, H.REDO], 12, p=[0.15, 0.45, 0.4])
            table = H.ChunkTable.unpack(H.ChunkTable(ops, limit).pack())
            for past in range(limit + 1 if limit is not None else 16):
                for future in range(0, 16 if limit is None else limit - past + 1):
                    p, f, s = past, future, 0
                    for op in ops.tolist():
                        if op == H.DO:
                            p, f = p + 1, 0
                            if limit is not None and p > limit:
                                p, s = p - 1, s + 1
                        elif op == H.UNDO and p:
                            p, f = p - 1, f + 1
                        elif op == H.REDO and f:
                            p, f = p + 1, f - 1
                    assert table.leave(past, future, 0) == (p, f, s)


def test_building_starts_no_job_and_empty_log(spark):
    tracker = spark.sparkContext.statusTracker()
    empty = spark.createDataFrame([], SCHEMA)
    before = len(tracker.getJobIdsForGroup(None))
    df = H.replay_history(empty)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert df.collect() == []


@pytest.mark.parametrize("limit", [None, 0, 3])
def test_short_logs_are_not_cut(spark, monkeypatch, limit):
    """A log whose few commands lie in many ranges of numbers is one group, not one for each range."""
    data = log(7, 400, (5, 3, 2, 1))
    spread_out = [(t, 5000 * seq, op, x) for t, seq, op, x in data]
    cut = []
    monkeypatch.setattr(H, "fold_groups", lambda df, *a: cut.append(df) or fold_groups(df, *a))
    got = rows(H.replay_history(spark.createDataFrame(spread_out, SCHEMA), limit), "track_id", "seq", "undoable")
    assert got == plain(spread_out, limit)
    assert all(df.count() == 0 for df in cut)


def test_short_and_long_logs_together(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 8)
    data = log(3, 900, (4, 3, 3, 0))
    sizes = [sum(r[0] == t for r in data) for t in (1, 2, None)]
    assert min(sizes) < 300 < max(sizes)
    monkeypatch.setattr(H, "SMALL_CHUNKS", 300 // 8)
    got = rows(H.replay_history(spark.createDataFrame(data, SCHEMA), 4), "track_id", "seq", "undoable")
    assert got == plain(data, 4)
