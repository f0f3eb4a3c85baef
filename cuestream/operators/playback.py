"""What is on screen at a time: active cue, visible cues, word progress, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.joins import asof_join, interval_join
from cuestream.plans.scan import OrderedScan, position

KEYS = ["track_id"]
MIN_WORD_US = 120_000


def active_cue(points: DataFrame, cues: DataFrame, point_id: str, hot: bool | None = None) -> DataFrame:
    """Index of the last cue starting at or before each point, -1 when there is none."""
    listed = OrderedScan.over(
        cues.select("track_id", "cue_id", "start_us"), KEYS, ["start_us", "cue_id"], hot=hot
    ).add(_i=position())
    out = asof_join(points, listed.done(), KEYS, "t_us", "start_us", point_id, "cue_id", backward="_hit", hot=hot)
    return out.withColumns(
        {"cue_index": F.coalesce(F.col("_hit._i") - 1, F.lit(-1)), "cue_id": F.col("_hit.cue_id")}
    ).drop("_hit")


def visible_cues(
    points: DataFrame, cues: DataFrame, enter_us: int = 0, exit_us: int = 0, width_us: int = 10_000_000
) -> DataFrame:
    """Pairs of a point and the cues shown then, margins included, both ends closed."""
    return interval_join(
        points, cues, KEYS, "t_us", F.col("start_us") - enter_us, F.col("end_us") + exit_us, width_us
    )


def containing_cue(points: DataFrame, cues: DataFrame, width_us: int = 10_000_000) -> DataFrame:
    """First cue, in time order, that contains each point; null when none does."""
    hits = interval_join(points, cues, KEYS, "t_us", F.col("start_us"), F.col("end_us"), width_us)
    first = hits.groupBy("track_id", "t_us").agg(F.min_by("cue_id", F.struct("start_us", "cue_id")).alias("cue_id"))
    return points.join(first, ["track_id", "t_us"], "left")


def word_fill(mode: str, t: Column, w0: Column, w1: Column, c0: Column, c1: Column) -> Column:
    """Karaoke fill (0 to 1) and state of a word at time t."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def out(fill: Column, state: Column) -> Column:
        return F.struct(fill.alias("fill"), state.alias("state"))

    if mode == "none":
        return out(one, F.lit("active"))
    if mode == "line":
        progress = F.greatest(zero, F.least(one, (t - c0) / F.greatest(F.lit(1), c1 - c0)))
        state = F.when(t >= c1, "done").when(t >= c0, "active").otherwise("upcoming")
        return out(progress, state)
    if mode == "word":
        state = F.when(t >= w1, "done").when(t >= w0, "active").otherwise("upcoming")
        return out(F.when(t >= w0, one).otherwise(zero), state)
    fill = F.greatest(zero, F.least(one, (t - w0) / F.greatest(F.lit(MIN_WORD_US), w1 - w0)))
    return out(fill, F.when(fill >= 1, "done").when(fill > 0, "active").otherwise("upcoming"))


def word_progress(
    points: DataFrame,
    words: DataFrame,
    modes: tuple[str, ...] = ("progressive",),
    enter_us: int = 0,
    exit_us: int = 0,
    width_us: int = 10_000_000,
) -> DataFrame:
    """Fill of every word of the cues visible at each point, one row per mode.

    ``words`` carry their cue's span as ``cue_start_us`` and ``cue_end_us``.
    """
    shown = interval_join(
        points, words, KEYS, "t_us", F.col("cue_start_us") - enter_us, F.col("cue_end_us") + exit_us, width_us
    )
    t, w0, w1 = F.col("t_us"), F.col("start_us"), F.col("end_us")
    c0, c1 = F.col("cue_start_us"), F.col("cue_end_us")
    per_mode = F.array(*[F.struct(F.lit(m).alias("mode"), word_fill(m, t, w0, w1, c0, c1).alias("f")) for m in modes])
    return shown.withColumn("_x", F.explode(per_mode)).select(
        "track_id", "t_us", "cue_id", "word_idx", F.col("_x.mode").alias("mode"), F.col("_x.f.fill").alias("fill"), F.col("_x.f.state").alias("state")
    )
