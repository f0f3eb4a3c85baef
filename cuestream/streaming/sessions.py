"""Stateful streams keyed by session or track: tap logs and incremental audio analysis."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuestream.functions.timecode import ms
from cuestream.operators.tap_log import TapState
from cuestream.sources.audio import CHUNK, FFT, frame_bands

TAP_OUT = "track_id bigint, as_of_seq bigint, line_index bigint, time_us bigint, tap_seq bigint"


def tap_stream(log: DataFrame) -> DataFrame:
    """Taps per session after each micro-batch of commands.

    ``log(track_id, seq, type, time_us, line_index, amount, n_lines)``; rows of
    a micro-batch are applied in ``seq`` order. Take the rows of the highest
    ``as_of_seq`` per session for the final state. A micro-batch of one session
    is sorted in memory, so bound it at the source (``max_files``).
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        if state.exists:
            lines, comp, gap, taps, next_line, seq = json.loads(state.get[0])
            session = TapState(lines, comp, gap)
            session.taps, session.next_line, session.seq = taps, next_line, seq
        else:
            session = TapState(int(rows["n_lines"].iloc[0]), 0, ms(150))
        for row in rows.itertuples(index=False):
            session.apply(row.type, int(row.time_us), int(row.line_index), int(row.amount))
        state.update((json.dumps([session.line_count, session.compensation, session.gap, session.taps, session.next_line, session.seq]),))
        taps = pd.DataFrame(session.taps, columns=["line_index", "time_us", "tap_seq"])
        yield taps.assign(track_id=key[0], as_of_seq=int(rows["seq"].iloc[-1]))

    return log.groupBy("track_id").applyInPandasWithState(update, TAP_OUT, "session string", "append", GroupStateTimeout.NoTimeout)


FRAME_OUT = "track_id bigint, frame bigint, bands array<int>"


#: Chunks of a track that one state looks after.
RANGE = 64
HELD = "idx array<bigint>, rate array<bigint>, done array<int>, samples array<array<float>>"
AS_FIRST, AS_SECOND = 1, 2


def frame_stream(chunks: DataFrame) -> DataFrame:
    """Spectral frames from a stream of 512-sample chunks ``(track_id, chunk_idx, sample_rate, samples)``.

    A frame needs a chunk and its successor. A track is split into ranges of ``RANGE`` chunks,
    each with a state of its own; the first chunk of a range goes to the range before as well,
    as successor of its last. A chunk stays in state until both neighbours have met it, so
    chunks may arrive in any order, and a state holds one range at most.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track, part = key
        held: dict[int, list] = {}
        if state.exists:
            held = {i: [r, d, x] for i, r, d, x in zip(*state.get, strict=True)}
        fresh: set[int] = set()
        for pdf in batches:
            for i, r, x in zip(pdf.chunk_idx, pdf.sample_rate, pdf.samples, strict=True):
                other = AS_FIRST if i // RANGE != part else AS_SECOND if i % RANGE == 0 else 0
                held[int(i)] = [int(r), other, [float(v) for v in x]]
                fresh.add(int(i))
        ready = sorted({f for i in fresh for f in (i - 1, i) if f in held and f + 1 in held and not held[f][1] & AS_FIRST})
        ready = [f for f in ready if len(held[f][2]) == CHUNK and len(held[f + 1][2]) == CHUNK]
        if ready:
            frames = np.zeros((len(ready), FFT))
            for n, f in enumerate(ready):
                frames[n] = held[f][2] + held[f + 1][2]
                held[f][1] |= AS_FIRST
                held[f + 1][1] |= AS_SECOND
            yield pd.DataFrame({"track_id": track, "frame": ready, "bands": list(frame_bands(frames, held[ready[0]][0]))})
        left = {i: v for i, v in held.items() if v[1] != AS_FIRST | AS_SECOND}
        state.update((list(left), [v[0] for v in left.values()], [v[1] for v in left.values()], [v[2] for v in left.values()]))

    home = F.floor(F.col("chunk_idx") / RANGE)
    before = F.when((F.col("chunk_idx") % RANGE == 0) & (F.col("chunk_idx") > 0), home - 1)
    dealt = chunks.select("track_id", "chunk_idx", "sample_rate", "samples", F.explode(F.array_compact(F.array(home, before))).alias("part"))
    return dealt.groupBy("track_id", "part").applyInPandasWithState(update, FRAME_OUT, HELD, "append", GroupStateTimeout.NoTimeout)


def peak_stream(samples: DataFrame, bucket: str = "10 milliseconds", lateness: str = "1 second") -> DataFrame:
    """Peaks per tumbling bucket of a sample stream ``(track_id, ts, value)``."""
    out = samples.withWatermark("ts", lateness).groupBy("track_id", F.window("ts", bucket)).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")
    )
    return out.select("track_id", F.col("window.start").alias("bucket_start"), "min", "max", "rms")
