"""Onsets, tempo and beats from band energies, one row per (track, frame, band)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions.timecode import round_half_up
from cuestream.operators.debounce import debounce
from cuestream.plans.joins import nearest_on_grid
from cuestream.plans.scan import sliding

KEYS = ["track_id"]
MIN_BPM, MAX_BPM = 60, 190
PRIOR_CENTRE, PRIOR_SIGMA = 120, 0.9
#: Frames from which on a tempo has its full confidence; with fewer it falls in proportion.
SURE_FRAMES = 64
DIGITS = 9


def onset_envelope(spectrum: DataFrame) -> DataFrame:
    """Sum over bands of the rise against the previous frame; the first frame is zero."""
    rise = {"_d": lambda w: F.greatest(F.lit(0.0), F.col("value") - F.lag("value").over(w))}
    delta = sliding(spectrum, ["track_id", "band"], "frame", 1, rise)
    return delta.groupBy("track_id", "frame").agg(F.round(F.sum(F.coalesce("_d", F.lit(0.0))), DIGITS).alias("onset"))


def adaptive_residual(w) -> Column:
    return F.greatest(F.lit(0.0), F.col("onset") - F.avg("onset").over(w.rowsBetween(-4, 4)) * F.lit(0.9))


def local_peaks(w) -> Column:
    r = F.col("residual")
    return F.when((r > 0) & (r >= F.max("residual").over(w.rowsBetween(-2, 2))), r).otherwise(0.0)


def prepare_onsets(onsets: DataFrame) -> DataFrame:
    """Adaptive threshold, peak picking, smoothing and scaling to a maximum of one.

    Adds ``residual``, ``peak``, ``smooth`` and ``x``. The three windows reach
    eight frames together and run in one shuffle. Tracks of any length are treated alike.
    """
    steps = (
        {"residual": adaptive_residual},
        {"peak": local_peaks},
        {"smooth": lambda w: F.avg("peak").over(w.rowsBetween(-2, 2))},
    )
    df = sliding(onsets, KEYS, "frame", 8, *steps)
    top = df.groupBy("track_id").agg(F.max("smooth").alias("_top"))
    x = F.when(F.col("_top") > 0, F.col("smooth") / F.col("_top")).otherwise(F.col("smooth"))
    return df.join(top, "track_id").withColumn("x", x).drop("_top")


def lag_range(frame_us: int, min_bpm: int = MIN_BPM, max_bpm: int = MAX_BPM) -> tuple[int, int]:
    seconds = frame_us / 1e6
    return max(2, math.floor(60 / max_bpm / seconds)), math.ceil(60 / min_bpm / seconds)


def tempo_prior(bpm: float) -> float:
    return math.exp(-0.5 * (math.log2(bpm / PRIOR_CENTRE) / PRIOR_SIGMA) ** 2)


def lag_products(prepared: DataFrame, frame_us: int, min_bpm: int = MIN_BPM, max_bpm: int = MAX_BPM) -> DataFrame:
    """Mean lagged product per (track, lag).

    The lagged values come from ``lead`` inside haloed chunks, so the input is
    shuffled once and never multiplied by the number of lags.
    """
    lo, hi = lag_range(frame_us, min_bpm, max_bpm)
    lags = list(range(lo, hi + 1))
    leads = {f"_p{k}": (lambda w, k=k: F.col("x") * F.lead("x", k).over(w)) for k in lags}
    df = sliding(prepared.select("track_id", "frame", "x"), KEYS, "frame", hi, leads)
    sums = df.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("x").alias("peak"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in lags]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in lags])
    out = sums.select("track_id", "n", "peak", F.explode(rows).alias("r")).select("track_id", "n", "peak", "r.lag", "r.s")
    fits = (F.col("peak") > 0) & (F.col("lag") <= F.col("n") - 1)
    return out.filter(fits).select("track_id", "lag", (F.col("s") / (F.col("n") - F.col("lag"))).alias("product"), "n")


def estimate_tempo(prepared: DataFrame, frame_us: int, min_bpm: int = MIN_BPM, max_bpm: int = MAX_BPM) -> DataFrame:
    """Best lag per track under the tempo prior; silent tracks, and those shorter than any lag, get zero."""
    lo, hi = lag_range(frame_us, min_bpm, max_bpm)
    products = lag_products(prepared, frame_us, min_bpm, max_bpm)
    seconds = frame_us / 1e6
    octaves = F.log2(F.lit(60.0) / (F.col("lag") * F.lit(seconds)) / PRIOR_CENTRE) / PRIOR_SIGMA
    score = F.col("product") * F.exp(F.lit(-0.5) * octaves * octaves)
    best = products.filter((F.col("n") - 1 > lo) & F.lit(hi > lo)).groupBy("track_id").agg(
        F.max(F.struct(F.round(score, 12).alias("score"), (-F.col("lag")).alias("neg"))).alias("b"), F.max("n").alias("n")
    )
    length = F.least(F.lit(1.0), F.col("n") / SURE_FRAMES)
    tracks = prepared.select("track_id").distinct()
    bpm = F.round(F.lit(60.0) / (-F.col("b.neg") * F.lit(seconds)), 1)
    return tracks.join(best, "track_id", "left").select(
        "track_id",
        F.coalesce(bpm, F.lit(0.0)).alias("bpm"),
        # without a lag there is no score, which least and greatest would pass over
        F.when(F.col("b").isNull(), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.score") * 4)) * length)
        .alias("confidence"),
    )


def beat_grid(onsets: DataFrame, tempo: DataFrame, frame_us: int) -> DataFrame:
    """Beat spacing and the phase that puts beats on the strongest onsets, per track."""
    seconds = frame_us / 1e6
    lag = F.greatest(F.lit(1), round_half_up(F.lit(60.0) / F.col("bpm") / F.lit(seconds)))
    known = tempo.filter(F.col("bpm") > 0).withColumn("lag", lag)
    by_phase = (
        onsets.join(known, "track_id")
        .groupBy("track_id", "bpm", "confidence", "lag", (F.col("frame") % F.col("lag")).alias("phase"))
        .agg(F.round(F.sum("onset"), 6).alias("s"), F.max("frame").alias("last"))
    )
    best = by_phase.groupBy("track_id", "bpm", "confidence", "lag").agg(
        F.max(F.struct("s", (-F.col("phase")).alias("neg"))).alias("b"), (F.max("last") + 1).alias("n_frames")
    )
    return best.select(
        "track_id",
        "bpm",
        "confidence",
        (-F.col("b.neg")).alias("phase"),
        (F.col("lag") * frame_us).alias("interval_us"),
        (-F.col("b.neg") * frame_us).alias("first_us"),
        (F.col("n_frames") * frame_us).alias("total_us"),
    )


def beats(grid: DataFrame) -> DataFrame:
    times = F.sequence(F.col("first_us"), F.col("total_us") - 1, F.col("interval_us"))
    fits = grid.filter(F.col("first_us") < F.col("total_us"))
    return fits.select("track_id", F.posexplode(times).alias("beat_idx", "beat_us")).withColumn("beat_idx", F.col("beat_idx").cast("long"))


def beat_strength(points: DataFrame, grid: DataFrame, tolerance_us: int) -> DataFrame:
    """Metrical weight of the beat near each point: 1, 0.6 or 0.35, and 0 away from beats."""
    g = grid.select("track_id", "first_us", "interval_us", "total_us")
    n = F.ceil((F.col("total_us") - F.col("first_us")) / F.col("interval_us"))
    near = nearest_on_grid(F.col("t_us"), F.col("first_us"), F.col("interval_us"), n, tolerance_us)
    i = round_half_up((F.col("_beat") - F.col("first_us")) / F.col("interval_us"))
    strength = F.when(F.col("_beat").isNull(), 0.0).when(i % 4 == 0, 1.0).when(i % 2 == 0, 0.6).otherwise(0.35)
    df = points.join(g, "track_id", "left").withColumn("_beat", near).withColumn("strength", strength)
    return df.drop("first_us", "interval_us", "total_us", "_beat")


def onset_anchors(prepared: DataFrame, vocal: DataFrame, frame_us: int, hot: bool | None = None) -> DataFrame:
    """Clear onsets at least 350 ms apart, scored with the vocal share around them."""
    ends = prepared.groupBy("track_id").agg(F.max("frame").alias("_last"))
    sides = {"_p": lambda w: F.lag("x").over(w), "_n": lambda w: F.lead("x").over(w)}
    df = sliding(prepared.select("track_id", "frame", "x"), KEYS, "frame", 1, sides).join(ends, "track_id")
    v = F.col("x")
    local = (v >= 0.16) & (v >= F.col("_p")) & (v >= F.col("_n")) & (F.col("frame") > 0) & (F.col("frame") < F.col("_last"))
    gap = max(1, int(350_000 / frame_us))
    kept = debounce(df.filter(local).select("track_id", "frame", "x"), KEYS, "frame", "frame", gap, hot=hot)
    share = vocal.select("track_id", "frame", "vocal")
    strength = F.least(F.lit(1.0), F.lit(0.62) * v + F.lit(0.38) * F.coalesce("vocal", F.lit(0.5)))
    return kept.join(share, ["track_id", "frame"], "left").select(
        "track_id", "frame", (F.col("frame") * frame_us).alias("time_us"), strength.alias("strength")
    )
