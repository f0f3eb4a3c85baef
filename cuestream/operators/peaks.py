"""Waveform peaks: fixed buckets, range queries, level of detail, silence runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import OrderedScan, position

KEYS = ["track_id"]
SAMPLE_KEYS = ["track_id", "frame"]


def mono(samples: DataFrame) -> DataFrame:
    """Mean over channels per frame."""
    return samples.groupBy(*SAMPLE_KEYS).agg(F.avg("value").alias("value"))


def _fill_buckets(peaks: DataFrame) -> DataFrame:
    """Zero rows for buckets without samples, up to the last one of each track."""
    ends = peaks.groupBy("track_id").agg(F.max("bucket").alias("_b"))
    grid = ends.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("bucket"))
    return grid.join(peaks, ["track_id", "bucket"], "left").na.fill(0.0, ["min", "max", "rms"])


def compute_peaks(samples: DataFrame, samples_per_bucket: int) -> DataFrame:
    """min, max and rms per bucket of one-row-per-sample input; buckets without samples are zero."""
    bucket = F.floor(F.col("frame") / samples_per_bucket)
    stats = samples.groupBy("track_id", bucket.alias("bucket")).agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"),
    )
    return _fill_buckets(stats)


def peaks_from_chunks(pcm_chunks: DataFrame, samples_per_bucket: int, chunk_samples: int) -> DataFrame:
    """Peaks of array chunks without exploding samples.

    Each Arrow batch is reduced to per-bucket partials with numpy; a bucket that
    spans two chunks is completed by the aggregation.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for track, idx, samples in zip(pdf.track_id, pdf.chunk_idx, pdf.samples, strict=True):
                x = np.asarray(samples, dtype=np.float64)
                if not len(x):
                    continue
                b = (int(idx) * chunk_samples + np.arange(len(x))) // samples_per_bucket
                cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                rows.append(
                    pd.DataFrame(
                        {
                            "track_id": track,
                            "bucket": b[cut],
                            "lo": np.minimum.reduceat(x, cut),
                            "hi": np.maximum.reduceat(x, cut),
                            "sq": np.add.reduceat(x * x, cut),
                            "n": np.diff(np.r_[cut, len(x)]),
                        }
                    )
                )
            if rows:
                yield pd.concat(rows)

    key = pcm_chunks.schema["track_id"].dataType.simpleString()
    schema = f"track_id {key}, bucket bigint, lo double, hi double, sq double, n bigint"
    part = pcm_chunks.select("track_id", "chunk_idx", "samples").mapInPandas(partials, schema)
    stats = part.groupBy("track_id", "bucket").agg(
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.sqrt(F.sum("sq") / F.sum("n")).alias("rms")
    )
    return _fill_buckets(stats)


def peak_amplitude(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("track_id").agg(F.max(F.greatest(F.abs("min"), F.abs("max"))).alias("peak"))


def peaks_in_ranges(peaks: DataFrame, ranges: DataFrame, bucket_us: int) -> DataFrame:
    """Peak of each time range, both border buckets included; ranges outside the track are zero.

    ``ranges(track_id, range_id, start_us, end_us)``. Only buckets the track has
    take part, so the range is cut to its length.
    """
    first = F.greatest(F.lit(0), F.floor(F.col("start_us") / bucket_us))
    last = F.ceil(F.col("end_us") / bucket_us)
    wanted = ranges.withColumns({"_f": first, "_l": last})
    ends = peaks.groupBy("track_id").agg(F.max("bucket").alias("_m"))
    wanted = wanted.join(ends, "track_id", "left").withColumn("_l", F.least("_l", "_m"))
    hit = wanted.filter(F.col("_l") >= F.col("_f")).select(
        "track_id", "range_id", F.explode(F.sequence("_f", "_l")).alias("bucket")
    )
    agg = (
        hit.join(peaks, ["track_id", "bucket"])
        .groupBy("track_id", "range_id")
        .agg(F.min("min").alias("min"), F.max("max").alias("max"), F.avg("rms").alias("rms"))
    )
    return ranges.join(agg, ["track_id", "range_id"], "left").na.fill(0.0, ["min", "max", "rms"])


def decimate(peaks: DataFrame, windows: DataFrame, pixels: int, bucket_us: int) -> DataFrame:
    """One peak per output pixel of each window ``(track_id, start_us, end_us)``."""
    step = (F.col("end_us") - F.col("start_us")) / F.lit(pixels)
    p = F.col("range_id")
    ranges = (
        windows.filter(F.col("end_us") > F.col("start_us"))
        .withColumn("range_id", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))))
        .select("track_id", "range_id", (F.col("start_us") + p * step).alias("s"), (F.col("start_us") + (p + 1) * step).alias("e"))
        .toDF("track_id", "range_id", "start_us", "end_us")
    )
    return peaks_in_ranges(peaks, ranges, bucket_us).select(
        "track_id", F.col("range_id").cast("long").alias("pixel"), "min", "max", "rms"
    )


def silence_runs(
    peaks: DataFrame, bucket_us: int, min_length_us: int = 2_500_000, hot: bool | None = None
) -> DataFrame:
    """Runs of quiet buckets, quiet being relative to the track's peak amplitude."""
    loud = peak_amplitude(peaks)
    quiet = peaks.join(loud, "track_id").filter(
        F.col("rms") < F.greatest(F.lit(0.004), F.col("peak") * F.lit(0.035))
    )
    ranked = OrderedScan.over(quiet.select("track_id", "bucket"), KEYS, ["bucket"], hot=hot).add(_r=position())
    runs = ranked.done().groupBy("track_id", (F.col("bucket") - F.col("_r")).alias("_i")).agg(
        (F.min("bucket") * bucket_us).alias("start_us"), ((F.max("bucket") + 1) * bucket_us).alias("end_us")
    )
    return runs.drop("_i").filter(F.col("end_us") - F.col("start_us") >= min_length_us)


def band_means(spectrum: DataFrame) -> DataFrame:
    return spectrum.groupBy("track_id", "band").agg(F.avg("value").alias("mean"))


def energy_at(points: DataFrame, spectrum: DataFrame, means: DataFrame, frame_us: int) -> DataFrame:
    """Band value at each point relative to the band's mean, at most 1.6; zero outside the track."""
    at = points.withColumn("frame", F.floor(F.col("t_us") / frame_us))
    df = at.join(spectrum, ["track_id", "frame", "band"], "left").join(means, ["track_id", "band"], "left")
    value = F.coalesce("value", F.lit(0.0))
    energy = F.least(F.lit(1.6), value / F.greatest(F.lit(8.0), F.coalesce("mean", F.lit(1.0))))
    return df.withColumns({"value": value, "energy": energy}).drop("mean", "frame")


def vocal_activity(spectrum: DataFrame, vocal: Column) -> DataFrame:
    """Share of the vocal bands in each frame, then its centred mean over seven frames."""
    from cuestream.plans.scan import sliding

    share = spectrum.groupBy("track_id", "frame").agg(
        F.sum("value").alias("_all"), F.sum(F.when(vocal, F.col("value")).otherwise(0.0)).alias("_v")
    )
    raw = share.select("track_id", "frame", F.when(F.col("_all") > 0, F.col("_v") / F.col("_all")).otherwise(0.0).alias("raw"))
    smooth = {"vocal": lambda w: F.avg("raw").over(w.rowsBetween(-3, 3))}
    return sliding(raw, KEYS, "frame", 3, smooth)
