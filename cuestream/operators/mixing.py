"""Sample-level joins of series keyed by integer frame: mixing, overlap-add, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import sliding


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def _with_next(series: DataFrame, name: str) -> DataFrame:
    """Each sample with its successor; the last one is its own successor."""
    nxt = sliding(series, ["track_id"], "frame", 1, {"_nx": lambda w: F.lead("value").over(w)})
    return nxt.select(
        "track_id", F.col("frame").alias("_at"), F.col("value").alias(f"{name}_0"),
        F.coalesce("_nx", F.col("value")).alias(f"{name}_1"),
    )


def sample_at(points: DataFrame, series: DataFrame, position: Column, name: str = "sample") -> DataFrame:
    """Linear interpolation of a series at a fractional position; null outside it.

    One equi join: the successor travels with each sample.
    """
    pos = points.withColumn("_pos", position).withColumn("_at", F.floor("_pos"))
    joined = pos.join(_with_next(series, "_v"), ["track_id", "_at"], "left")
    frac = F.col("_pos") - F.col("_at")
    value = F.col("_v_0") * (1 - frac) + F.col("_v_1") * frac
    return joined.withColumn(name, value).drop("_pos", "_at", "_v_0", "_v_1")


def mix_voiceover(
    music: DataFrame,
    voice: DataFrame,
    music_rate: float,
    voice_rate: float,
    voice_offset_us: int = 0,
    music_gain: float = 1.0,
    voice_gain: float = 1.0,
    extend_to_us: int | None = None,
) -> DataFrame:
    """Mix a voice series over a music series at the music's rate, clipped to [-1, 1].

    With ``extend_to_us`` the output runs on past shorter music up to that time.
    """
    g_music, g_voice = (max(0.0, min(2.0, g)) for g in (music_gain, voice_gain))
    base = music.select("track_id", "frame", F.col("value").alias("_bg"))
    if extend_to_us is not None:
        end = -(-extend_to_us * music_rate // 1_000_000)
        ends = music.groupBy("track_id").agg(F.max("frame").alias("_last")).filter(F.col("_last") < end - 1)
        more = F.explode(F.sequence(F.col("_last") + 1, F.lit(int(end) - 1).cast("long")))
        base = base.unionByName(ends.select("track_id", more.alias("frame"), F.lit(0.0).alias("_bg")))
    seconds = F.col("frame") / F.lit(float(music_rate)) - F.lit(voice_offset_us / 1e6)
    both = sample_at(base, voice, seconds * F.lit(float(voice_rate)), "_speech")
    mixed = F.col("_bg") * g_music + F.coalesce("_speech", F.lit(0.0)) * g_voice
    return both.select("track_id", "frame", _clip(mixed).alias("value"))


def render_standalone(
    voice: DataFrame,
    voice_rate: float,
    out_rate: float,
    offset_us: int,
    gain: float,
    range_start_us: int,
    range_end_us: int,
) -> DataFrame:
    """Voice alone over a fixed output range, silence where it does not play."""
    rate = max(8_000, int(out_rate + 0.5))
    frames = -(-max(0, range_end_us - range_start_us) * rate // 1_000_000)
    tracks = voice.select("track_id").distinct()
    grid = tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame"))
    seconds = F.lit((range_start_us - offset_us) / 1e6) + F.col("frame") / F.lit(float(rate))
    out = sample_at(grid, voice, seconds * F.lit(float(voice_rate)), "_s")
    value = F.coalesce("_s", F.lit(0.0)) * max(0.0, min(2.0, gain))
    return out.select("track_id", "frame", _clip(value).alias("value"))


def overlap_add(samples: DataFrame) -> DataFrame:
    """Sum clips placed at ``start_frame`` on one timeline, then clip once at the end."""
    at = F.col("start_frame") + F.col("frame")
    total = samples.groupBy("track_id", at.alias("frame")).agg(F.sum("value").alias("_v"))
    return total.select("track_id", "frame", _clip(F.col("_v")).alias("value"))


def resample(series: DataFrame, lengths: DataFrame, source_rate: float, target_rate: float) -> DataFrame:
    """Change the sample rate: overlap-weighted box filter down, linear interpolation up.

    ``lengths(track_id, n)`` gives the number of source samples. Downsampling
    sends each source sample to the outputs it overlaps, so it needs one
    aggregation and no range join.
    """
    if source_rate == target_rate:
        return series
    ratio = source_rate / target_rate
    out_len = F.greatest(F.lit(1), F.floor(F.col("n") * target_rate / source_rate + 0.5))
    if ratio > 1:
        src = series.join(lengths, "track_id").withColumn("_m", out_len)
        s = F.col("frame")
        first, last = F.floor(s / ratio), F.ceil((s + 1) / ratio) - 1
        hit = src.withColumn("_o", F.explode(F.sequence(first, F.greatest(first, last)))).filter(F.col("_o") < F.col("_m"))
        lo = F.col("_o") * F.lit(ratio)
        hi = F.least(F.col("n").cast("double"), (F.col("_o") + 1) * F.lit(ratio))
        weight = F.greatest(F.lit(0.0), F.least(hi, s + 1) - F.greatest(lo, s))
        agg = hit.withColumn("_w", weight).groupBy("track_id", F.col("_o").alias("frame")).agg(
            F.sum(F.col("value") * F.col("_w")).alias("_x"), F.sum("_w").alias("_w")
        )
        return agg.select("track_id", "frame", F.when(F.col("_w") > 0, F.col("_x") / F.col("_w")).otherwise(0.0).alias("value"))
    grid = lengths.withColumn("_m", out_len).select("track_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("frame"))
    # past the last sample the series holds its value
    held = F.least(F.col("frame") * F.lit(ratio), (F.col("n") - 1).cast("double"))
    return sample_at(grid, series, held, "value").select("track_id", "frame", "value")
