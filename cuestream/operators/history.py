"""Undo and redo over a command log, split inside a log.

A log's state is a pair: how many commands can be undone, and how many redone. After a
command the second is zero, so what follows it depends on one number, and how that number
leaves a chunk of the log is a function that moves it by one at most for each step of its
input: a short table, and a straight line beyond. In front of a chunk's first command both
numbers count; their sum is fixed there, and for each sum a walk between two walls is a
clipped shift. Chunks tabulate both in parallel, one pass over the tables of a log (a
row for each ``CHUNK`` numbers of its sequence) tells every chunk its entry, and the chunks
then give each command its level. The command in effect at a level is the last that reached
it; levels above the final depth are undone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.plans.groups import NO_KEY, fold_groups, long_groups, numbers

CHUNK = 4096
SMALL_CHUNKS = 16
DO, UNDO, REDO = 0, 1, 2


def _runs(ops: np.ndarray) -> list[tuple[int, int]]:
    if not len(ops):
        return []
    edges = np.flatnonzero(np.diff(ops, prepend=-1))
    return list(zip(ops[edges].tolist(), np.diff(np.append(edges, len(ops))).tolist(), strict=True))


class ChunkTable:
    """How (undoable, redoable, settled) leaves a chunk, for any state that enters it."""

    def __init__(self, ops: np.ndarray, limit: int | None):
        at = np.flatnonzero(ops == DO)
        first = int(at[0]) if len(at) else len(ops)
        # before the first command: of every sum of both numbers, where the walk from either wall ends
        self.shift = int((ops[:first] == UNDO).sum() - (ops[:first] == REDO).sum())
        total = np.arange(first + 1)
        low, high = np.zeros(first + 1, np.int64), total.copy()
        for op, k in _runs(ops[:first]):
            low, high = (np.minimum(total, x + k) if op == UNDO else np.maximum(0, x - k) for x in (low, high))
        self.low, self.high = low, high
        # from the first command on: of every number of undoable commands
        self.after = None
        if len(at):
            rest = ops[first:]
            size = limit + 1 if limit is not None else int((rest == UNDO).sum()) + 1
            past, future, settled = np.arange(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for op, k in _runs(rest):
                if op == DO:
                    past, future = past + k, np.zeros(size, np.int64)
                    if limit is not None:
                        over = np.maximum(0, past - limit)
                        past, settled = past - over, settled + over
                else:
                    m = np.minimum(past, k) if op == UNDO else -np.minimum(future, k)
                    past, future = past - m, future + m
            self.after = (past, future, settled)

    def pack(self) -> bytes:
        parts = [np.array([self.shift, len(self.low), -1 if self.after is None else len(self.after[0])])]
        parts += [np.diff(x, prepend=0) for x in (self.low, self.high, *(self.after or ()))]
        return zlib.compress(np.concatenate(parts).astype("<i8").tobytes(), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> ChunkTable:
        self = cls.__new__(cls)
        x = np.frombuffer(zlib.decompress(raw), "<i8")
        self.shift, n, m = x[:3].tolist()
        self.low, self.high = np.cumsum(x[3 : 3 + n]), np.cumsum(x[3 + n : 3 + 2 * n])
        self.after = None if m < 0 else tuple(np.cumsum(x[3 + 2 * n + i * m : 3 + 2 * n + (i + 1) * m]) for i in range(3))
        return self

    def leave(self, past: int, future: int, settled: int) -> tuple[int, int, int]:
        total, last = past + future, len(self.low) - 1
        # with room for the whole walk, the far wall moves along with the sum
        low = int(self.low[min(total, last)])
        high = int(self.high[min(total, last)]) + max(0, total - last)
        future = min(high, max(low, future + self.shift))
        past = total - future
        if self.after is not None:
            k = min(past, len(self.after[0]) - 1)
            more = past - k
            past, future, settled = int(self.after[0][k]) + more, int(self.after[1][k]), settled + int(self.after[2][k])
        return past, future, settled


def _numbered(log: DataFrame) -> DataFrame:
    kinds = F.when(F.col("op") == "do", DO).when(F.col("op") == "undo", UNDO).when(F.col("op") == "redo", REDO)
    rows = log.select("track_id", F.col("seq").cast("long").alias("seq"), kinds.alias("op")).filter("op is not null")
    return rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK))


def _replay_small(rows: DataFrame, limit: int | None) -> DataFrame:
    """Logs read one after the other, each on a plain stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past, future, settled = None, [], [], 0
        for batch in batches:
            ids, seqs, flags = [], [], []

            def done() -> None:
                ids.extend([None if now == NO_KEY else now] * len(past))
                seqs.extend(past)
                flags.extend([i >= settled for i in range(len(past))])

            tracks = pc.fill_null(batch.column("track_id").cast(pa.int64()), NO_KEY).to_pylist()
            for track, seq, op in zip(tracks, batch.column("seq").to_pylist(), batch.column("op").to_pylist(), strict=True):
                if track != now:
                    if now is not None:
                        done()
                    now, past, future, settled = track, [], [], 0
                if op == DO:
                    past.append(seq)
                    future.clear()
                elif op == UNDO and len(past) > settled:
                    future.append(past.pop())
                elif op == REDO and future:
                    past.append(future.pop())
                if limit is not None and len(past) - settled > limit:
                    settled = len(past) - limit
            yield _effective(ids, seqs, flags)
        if now is not None:
            yield _effective([None if now == NO_KEY else now] * len(past), past, [i >= settled for i in range(len(past))])

    def _effective(ids: list, seqs: list, flags: list) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array(seqs, pa.int64()), pa.array(flags, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["track_id", "seq", "undoable"])

    dealt = rows.select("track_id", "seq", "op").repartition("track_id").sortWithinPartitions("track_id", "seq")
    return dealt.mapInArrow(run, "track_id long, seq long, undoable boolean")


def replay_history(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Commands in effect after undos and redos: ``(track_id, seq, undoable)``.

    ``log(track_id, seq, op)`` with op ``do``, ``undo`` or ``redo`` and one row per ``seq`` of
    a log; a batch is one ``do`` row. With a ``limit``, older commands stay in effect but
    cannot be undone; without one, every command can.
    """
    short, rows = long_groups(_numbered(log), "track_id", SMALL_CHUNKS * CHUNK)

    def tabulate(key: tuple, table: pa.Table) -> pa.RecordBatch:
        packed = ChunkTable(numbers(table, "op"), limit).pack()
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([packed], pa.binary())], ["track_id", "chunk", "packed"]
        )

    tables = fold_groups(rows, ["track_id", "chunk"], ["seq"], "track_id long, chunk long, packed binary", tabulate)
    state = "track_id long, chunk long, past long, future long, settled long"

    def chain(batches):
        now, at = (), (0, 0, 0)
        for batch in batches:
            out = []
            for track, chunk, packed in zip(*[batch.column(c).to_pylist() for c in ("track_id", "chunk", "packed")], strict=True):
                if (track,) != now:
                    if now:
                        out.append((*now, None, *at))
                    now, at = (track,), (0, 0, 0)
                out.append((track, chunk, *at))
                at = ChunkTable.unpack(packed).leave(*at)
            yield _rows(out)
        if now:
            yield _rows([(*now, None, *at)])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        names = ("track_id", "chunk", "past", "future", "settled")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], list(names))

    # a row for each chunk of a log, with a table of at most as many entries as the chunk has rows
    states = tables.repartition("track_id").sortWithinPartitions("track_id", "chunk").mapInArrow(chain, state)
    entries = states.filter("chunk is not null")
    ends = states.filter("chunk is null").select(F.col("track_id").alias("of"), "settled", (F.col("past") + F.col("settled")).alias("depth"))

    none = F.lit(None).cast("long")
    told = rows.select("track_id", "chunk", "seq", "op", none.alias("past"), none.alias("future"), none.alias("settled")).unionByName(
        entries.select("track_id", "chunk", none.alias("seq"), F.lit(None).cast("int").alias("op"), "past", "future", "settled")
    )

    def levels(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        past, future, settled = (table.column(c)[0].as_py() for c in ("past", "future", "settled"))
        found: dict[int, int] = {}
        for seq, op in zip(table.column("seq")[1:].to_pylist(), table.column("op")[1:].to_pylist(), strict=True):
            if op == DO:
                past, future = past + 1, 0
                if limit is not None and past > limit:
                    past, settled = past - 1, settled + 1
                found[settled + past] = seq
            elif op == UNDO and past:
                past, future = past - 1, future + 1
            elif op == REDO and future:
                past, future = past + 1, future - 1
        if not found:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
            ["track_id", "level", "seq"],
        )

    # the entry of a chunk comes before its rows
    reached = fold_groups(told, ["track_id", "chunk"], ["seq"], "track_id long, level long, seq long", levels)
    last = reached.groupBy("track_id", "level").agg(F.max("seq").alias("seq"))
    met = last.join(ends, F.col("track_id").eqNullSafe(F.col("of")) & (F.col("level") <= F.col("depth")))
    cut = met.select("track_id", "seq", (F.col("level") > F.col("settled")).alias("undoable"))
    return _replay_small(short, limit).unionByName(cut)
