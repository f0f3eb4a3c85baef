"""Tap logs: commands that build, correct and take back the taps of a session.

Taps are a stack, one line after the other. What a chunk of commands does to the stack it
enters is short: it takes some taps off, changes some of those that stay, and puts its own
on top. It depends on the entry only through the number of taps (which lines a nudge means,
the bottom of the stack, the last line) and through the times of the taps that come to lie
on top, against which a new tap is judged. So each chunk is run alone, from a guessed number
and as if no tap were too close to an unknown one, and notes what it took for granted.
A pass over a session's chunks then holds the real stack, compares, and applies what a chunk
does as a whole; a chunk whose guess was wrong is run again there, from its own commands,
which travel along compressed. The result is that of the plain run in any case; the work per
command is done by chunks, in parallel.

Most sessions are short. One of up to ``SMALL_CHUNKS`` chunks' worth of commands is the plain
run, as it is read; only longer ones are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.functions.timecode import ms
from cuestream.plans.groups import fold_groups, long_groups, numbers

CHUNK = 4096
SMALL_CHUNKS = 16
CLOSE = ms(40)
GAP = ms(150)
KINDS = ("TAP", "REDO_LAST_TAP", "UNDO", "RESET", "SET_COMPENSATION", "SET_GAP", "NUDGE")
TAP, REDO, UNDO, RESET, COMPENSATION, SET_GAP, NUDGE = range(len(KINDS))


class TapState:
    """Session of the tap log, command by command: taps by line, the next line, and the two settings."""

    def __init__(self, line_count: int, compensation: int = 0, gap: int = GAP):
        self.line_count, self.compensation, self.gap = line_count, compensation, gap
        self.taps: list[list[int]] = []
        self.next_line = self.seq = 0

    def apply(self, kind: str, time: int, line: int, amount: int) -> None:
        at = max(0, time - self.compensation)
        if kind == "TAP":
            if self.next_line >= self.line_count or (self.taps and at - self.taps[-1][1] < CLOSE):
                return
            self.seq += 1
            self.taps.append([self.next_line, at, self.seq])
            self.next_line += 1
        elif kind == "REDO_LAST_TAP" and self.taps:
            self.seq += 1
            self.taps[-1] = [self.taps[-1][0], at, self.seq]
        elif kind == "UNDO" and self.taps:
            self.taps.pop()
            self.next_line -= 1
        elif kind == "RESET":
            self.__init__(self.line_count, self.compensation, self.gap)
        elif kind == "SET_COMPENSATION":
            self.compensation = amount
        elif kind == "SET_GAP":
            self.gap = amount
        elif kind == "NUDGE" and 0 <= line < len(self.taps):
            self.taps[line][1] = max(0, self.taps[line][1] + amount)


class Effect:
    """What a chunk does to the stack, from a number of taps on entry that was guessed.

    ``base``: taps of the entry that stay. ``changed``: line -> (add, floor, place), the time
    of such a tap becomes max(floor, time + add), or just ``floor`` if add is None, and its
    place in the order of taps is ``place`` (0: as it was). ``own``: taps put on top.
    ``granted``: (line, add, floor, most), times that had to be at most ``most``.
    """

    def __init__(self, entry: int, lines: int, compensation: int, gap: int):
        self.entry = self.base = self.top = entry
        self.lines, self.compensation, self.gap = lines, compensation, gap
        self.changed: dict[int, tuple[int | None, int, int]] = {}
        self.own: list[list[int]] = []
        self.granted: list[tuple[int, int, int, int]] = []
        self.count, self.exact = 0, False

    def run(self, kinds: list[int], times: list[int], lines: list[int], amounts: list[int]) -> Effect:
        for kind, time, line, amount in zip(kinds, times, lines, amounts, strict=True):
            now = max(0, time - self.compensation)
            if kind == TAP:
                self.tap(now)
            elif kind == REDO:
                if self.own:
                    self.count += 1
                    self.own[-1] = [now, self.count]
                elif self.base:
                    self.count += 1
                    self.changed[self.base - 1] = (None, now, self.count)
                else:
                    self.exact = True
            elif kind == UNDO:
                if self.own:
                    self.own.pop()
                elif self.base:
                    self.base -= 1
                    self.changed.pop(self.base, None)
                else:
                    self.exact = True
            elif kind == COMPENSATION:
                self.compensation = amount
            elif kind == SET_GAP:
                self.gap = amount
            elif kind == NUDGE:
                self.nudge(line, amount)
        return self

    def tap(self, now: int) -> None:
        depth = self.base + len(self.own)
        if depth >= self.lines:
            self.exact = True
            return
        if self.own:
            close = now - self.own[-1][0] < CLOSE
        elif self.base:
            add, floor, _ = self.changed.get(self.base - 1, (0, 0, 0))
            close = add is None and now - floor < CLOSE
            if add is not None:
                self.granted.append((self.base - 1, add, floor, now - CLOSE))
        else:
            close, self.exact = False, True
        if not close:
            self.count += 1
            self.own.append([now, self.count])
            self.top = max(self.top, depth + 1)

    def nudge(self, line: int, amount: int) -> None:
        self.exact = True
        if line >= self.base:
            if line - self.base < len(self.own):
                tap = self.own[line - self.base]
                tap[0] = max(0, tap[0] + amount)
        elif line >= 0:
            add, floor, place = self.changed.get(line, (0, 0, 0))
            self.changed[line] = (None if add is None else add + amount, max(0, floor + amount), place)

    def pack(self) -> bytes:
        changed = [(line, add is None, add or 0, floor, place) for line, (add, floor, place) in self.changed.items()]
        head = [self.entry, self.base, self.top, self.exact, self.count, self.compensation, self.gap, len(changed), len(self.granted), len(self.own)]
        flat = [*head, *(x for r in (*changed, *self.granted, *self.own) for x in r)]
        return np.array(flat, "<i8").tobytes()


class Session:
    """The real stack of a session, as times and places in the order of taps."""

    def __init__(self, lines: int, compensation: int, gap: int):
        self.lines, self.compensation, self.gap = lines, compensation, gap
        self.times: list[int] = []
        self.places: list[int] = []
        self.count = 0

    def apply(self, packed: bytes) -> bool:
        """Apply a chunk's effect; False if what it took for granted does not hold."""
        x = np.frombuffer(packed, "<i8")
        entry, base, top, exact, count, compensation, gap, n, m, k = x[:10].tolist()
        changed = x[10 : 10 + 5 * n].reshape(-1, 5).tolist()
        granted = x[10 + 5 * n : 10 + 5 * n + 4 * m].reshape(-1, 4).tolist()
        own = x[10 + 5 * n + 4 * m :].reshape(k, 2)
        shift = len(self.times) - entry
        # without nudges, and away from both ends of the stack, the number of taps does not matter
        if shift and (exact or base + shift <= 0 or top + shift > self.lines):
            return False
        if any(max(floor, self.times[line + shift] + add) > most for line, add, floor, most in granted):
            return False
        del self.times[base + shift :], self.places[base + shift :]
        for line, fixed, add, floor, place in changed:
            self.times[line + shift] = floor if fixed else max(floor, self.times[line + shift] + add)
            if place:
                self.places[line + shift] = self.count + place
        self.times += own[:, 0].tolist()
        self.places += (own[:, 1] + self.count).tolist()
        self.count, self.compensation, self.gap = self.count + count, compensation, gap
        return True

    def replay(self, commands: bytes) -> None:
        effect = Effect(len(self.times), self.lines, self.compensation, self.gap)
        kinds, *rest = np.frombuffer(zlib.decompress(commands), "<i8").reshape(4, -1).tolist()
        # from the real stack nothing is unknown
        effect.changed = {i: (None, t, 0) for i, t in enumerate(self.times)}
        self.apply(effect.run(kinds, *rest).pack())


COMMANDS = ("kind", "time_us", "line_index", "amount")
TAPS = "track_id bigint, line_index bigint, time_us bigint, tap_seq bigint, compensation_us bigint, gap_us bigint"


def fold_tap_log(log: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Final taps per session of a command log ``(track_id, seq, type, time_us, line_index, amount)``.

    In a long log a reset forgets all but the two settings, so only the commands after the last
    one are folded and the settings before it come from an aggregate. Memory of the last pass is
    the stack of one session, not its commands.
    """
    short, cut = long_groups(log, "track_id", SMALL_CHUNKS * CHUNK)
    return _fold_short(short, line_counts).unionByName(_fold_long(cut, line_counts))


def _numbered(log: DataFrame) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("type")) - 1
    return log.select(
        "track_id", F.col("seq").cast("long").alias("seq"), kind.cast("long").alias("kind"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COMMANDS[1:]],
    ).filter("kind >= 0")


def _fold_short(log: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Sessions read one after the other; a row with the number of lines comes before the commands."""
    none = F.lit(None).cast("long")
    lines = line_counts.select("track_id", F.col("n_lines").cast("long").alias("lines"), none.alias("seq"), *[none.alias(c) for c in COMMANDS])
    mixed = lines.filter("lines is not null").unionByName(_numbered(log).withColumn("lines", none)).filter("track_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for track, lines, kind, *rest in zip(*[batch.column(c).to_pylist() for c in ("track_id", "lines", *COMMANDS)], strict=True):
                if track != now:
                    if state is not None:
                        out.append((now, state))
                    now, state = track, None
                if lines is not None:
                    state = TapState(lines)
                elif state is not None:
                    state.apply(KINDS[kind], *rest)
            yield _taken(out)
        if state is not None:
            yield _taken([(now, state)])

    def _taken(sessions: list[tuple[int, TapState]]) -> pa.RecordBatch:
        found = [(track, *tap, s.compensation, s.gap) for track, s in sessions for tap in s.taps]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], pa.int64()) for i in range(6)], [f.split()[0] for f in TAPS.split(", ")]
        )

    dealt = mixed.withColumn("track_id", F.col("track_id").cast("long")).repartition("track_id")
    return dealt.sortWithinPartitions("track_id", F.col("lines").isNull(), "seq").mapInArrow(run, TAPS)


def _fold_long(log: DataFrame, line_counts: DataFrame) -> DataFrame:
    last = log.groupBy("track_id").agg(F.max(F.when(F.col("type") == "RESET", F.col("seq"))).alias("_reset"))
    seen = log.join(last, "track_id")
    live = F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))
    old = seen.filter(~live).groupBy("track_id").agg(
        *[
            F.max_by("amount", F.when(F.col("type") == kind, F.col("seq"))).alias(name)
            for kind, name in (("SET_COMPENSATION", "_comp"), ("SET_GAP", "_gap"))
        ]
    )
    told = line_counts.select("track_id", F.col("n_lines").cast("long").alias("lines")).join(old, "track_id", "left")
    starts = told.select(
        "track_id", "lines", F.coalesce("_comp", F.lit(0)).cast("long").alias("comp"), F.coalesce("_gap", F.lit(GAP)).cast("long").alias("gap")
    )
    rows = _numbered(seen.filter(live)).withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    commands = COMMANDS

    def sketch(key: tuple, table: pa.Table) -> pa.RecordBatch:
        """Net change of the number of taps and its lowest point, far from both ends, and the last settings."""
        kinds = numbers(table, "kind")
        far = 1 << 40
        effect = Effect(far, 2 * far, 0, 0).run(*[numbers(table, c).tolist() for c in commands])
        set_last = [numbers(table, "amount")[kinds == k][-1:].tolist() or [None] for k in (COMPENSATION, SET_GAP)]
        out = (*key, effect.base + len(effect.own) - far, effect.base - far, *[x[0] for x in set_last])
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in out], ["track_id", "chunk", "net", "low", "set_comp", "set_gap"])

    sketches = fold_groups(rows, ["track_id", "chunk"], ["seq"], "track_id long, chunk long, net long, low long, set_comp long, set_gap long", sketch)
    guess_schema = "track_id long, chunk long, depth long, lines long, comp long, gap long"
    guess_names = [f.split()[0] for f in guess_schema.split(", ")]

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth, comp, gap = (), 0, 0, 0
        for batch in batches:
            out = []
            names = ("track_id", "chunk", "net", "low", "set_comp", "set_gap", "lines", "comp", "gap")
            for track, chunk, net, low, set_comp, set_gap, lines, comp0, gap0 in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (track,) != now:
                    now, depth, comp, gap = (track,), 0, comp0, gap0
                out.append((track, chunk, depth, lines, comp, gap))
                depth = min(lines, max(depth + net, net - low))
                comp, gap = comp if set_comp is None else set_comp, gap if set_gap is None else set_gap
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], guess_names)

    # a row of six numbers for each chunk of a session
    known = sketches.join(starts, "track_id").repartition("track_id").sortWithinPartitions("track_id", "chunk")
    entries = known.mapInArrow(guess, guess_schema)
    none = F.lit(None).cast("long")
    extra = ("depth", "lines", "comp", "gap")
    mixed = rows.select("track_id", "chunk", "seq", *commands, *[none.alias(x) for x in extra]).unionByName(
        entries.select("track_id", "chunk", none.alias("seq"), *[none.alias(c) for c in commands], *extra)
    )

    def effects(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        depth, lines, comp, gap = (table.column(x)[0].as_py() for x in extra)
        if lines is None:
            return None  # a session without a number of lines
        rest = [table.column(c)[1:].to_pylist() for c in commands]
        packed = Effect(depth, lines, comp, gap).run(*rest).pack()
        raw = zlib.compress(np.array(rest, "<i8").tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v], pa.int64()) for v in (*key, lines, comp, gap)], pa.array([packed], pa.binary()), pa.array([raw], pa.binary())],
            ["track_id", "chunk", "lines", "comp", "gap", "packed", "raw"],
        )

    # the entry of a chunk comes before its commands
    done = fold_groups(
        mixed, ["track_id", "chunk"], ["seq"], "track_id long, chunk long, lines long, comp long, gap long, packed binary, raw binary", effects
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, session = None, None
        for batch in batches:
            names = ("track_id", "lines", "comp", "gap", "packed", "raw")
            for track, lines, comp, gap, packed, raw in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if session is None or track != now:
                    if session is not None:
                        yield _taps(now, session)
                    now, session = track, Session(lines, comp, gap)
                if not session.apply(packed):
                    session.replay(raw)
        if session is not None:
            yield _taps(now, session)

    return done.repartition("track_id").sortWithinPartitions("track_id", "chunk").mapInArrow(chain, TAPS)


def _taps(track: int | None, s: Session) -> pa.RecordBatch:
    n = len(s.times)
    columns = ([track] * n, list(range(n)), s.times, s.places, [s.compensation] * n, [s.gap] * n)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["track_id", "line_index", "time_us", "tap_seq", "compensation_us", "gap_us"]
    )
