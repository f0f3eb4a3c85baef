"""Speech recogniser segments to cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions.timecode import us_from_ms


def segments_to_cues(segments: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Clean, bounded cues from ``(track_id, seg_idx, text, t0_ms, t1_ms)``.

    Empty texts and starts at or past the duration drop out; ends are cut to it.
    """
    df = segments if tracks is None else segments.join(tracks.select("track_id", "duration_us"), "track_id", "left")
    start = F.greatest(F.lit(0), us_from_ms(F.col("t0_ms")))
    end = F.greatest(start, us_from_ms(F.col("t1_ms")))
    if tracks is not None:
        end = F.least(end, F.col("duration_us"))
    out = df.select(
        "track_id", "seg_idx", X.norm_display("text").alias("text"), start.alias("start_us"), end.alias("end_us"),
        *(["duration_us"] if tracks is not None else []),
    ).filter(F.col("text") != "")
    if tracks is not None:
        out = out.filter(F.col("duration_us").isNull() | (F.col("start_us") < F.col("duration_us"))).drop("duration_us")
    return out


def with_untimed_fallback(cues: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Add one cue spanning the track for transcripts ``(track_id, text, duration_us)`` without timed cues."""
    bare = transcripts.join(cues.select("track_id").distinct(), "track_id", "left_anti").select(
        "track_id",
        F.lit(0).cast("long").alias("seg_idx"),
        X.norm_display("text").alias("text"),
        F.lit(0).cast("long").alias("start_us"),
        F.greatest(F.lit(0), F.col("duration_us")).cast("long").alias("end_us"),
    )
    return cues.unionByName(bare.filter(F.col("text") != ""))
