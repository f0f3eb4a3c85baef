"""Tap synchronisation: taps to cue spans, progress, and latency compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.functions.text import word_count
from cuestream.functions.timecode import ms
from cuestream.plans.joins import nearest_join
from cuestream.plans.scan import OrderedScan, first_after, group_count, position

KEYS = ["track_id"]


def apply_taps(
    lines: DataFrame,
    taps: DataFrame,
    gap_us: int = ms(150),
    max_line_us: int = ms(6000),
    duration_us: int | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Tapped lines start at their tap and end before the next tapped line.

    The 400 ms floor comes after the track bound and may exceed it.
    """
    marks = taps.select("track_id", F.col("line_index").alias("seq"), F.col("time_us").alias("_tap"))
    df = lines.join(marks, ["track_id", "seq"], "left")
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot).add(_next=first_after("_tap"))
    tap = F.col("_tap")
    end = F.coalesce(F.col("_next") - gap_us, tap + ms(600) + word_count("text") * ms(260))
    end = F.least(end, tap + max_line_us)
    if duration_us is not None:
        end = F.least(end, F.lit(duration_us))
    end = F.greatest(end, tap + ms(400))
    old = {c: F.col(c) if c in lines.columns else F.lit(None) for c in ("start_us", "end_us", "source", "confidence")}
    hit = tap.isNotNull()
    return scan.done().withColumns(
        {
            "start_us": F.when(hit, tap).otherwise(old["start_us"]).cast("long"),
            "end_us": F.when(hit, end).otherwise(old["end_us"]).cast("long"),
            "source": F.when(hit, "tap").otherwise(old["source"]),
            "confidence": F.when(hit, 1.0).otherwise(old["confidence"]).cast("double"),
        }
    ).drop("_tap", "_next")


def tap_progress(lines: DataFrame, taps: DataFrame) -> DataFrame:
    total = lines.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_lines"))
    done = taps.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_taps"))
    both = total.join(done, "track_id", "full").na.fill(0, ["n_lines", "n_taps"])
    ratio = F.when(F.col("n_lines") == 0, 1.0).otherwise(
        F.least(F.lit(1.0), F.col("n_taps") / F.greatest(F.col("n_lines"), F.lit(1)))
    )
    return both.select("track_id", "n_lines", "n_taps", ratio.alias("progress"))


def suggest_compensation(
    taps: DataFrame, beats: DataFrame, max_search_us: int = ms(400), hot: bool | None = None
) -> DataFrame:
    """Upper median of the signed tap-to-beat distances per track; needs three of them."""
    near = nearest_join(taps, beats.select("track_id", "beat_us"), KEYS, "time_us", "beat_us", "tap_id", "beat_us", hot=hot)
    deltas = near.select("track_id", "tap_id", (F.col("time_us") - F.col("nearest.beat_us")).alias("delta_us"))
    close = deltas.filter(F.abs("delta_us") <= max_search_us)
    ranked = OrderedScan.over(close, KEYS, ["delta_us", "tap_id"], hot=hot).add(_r=position(), _n=group_count())
    middle = F.col("_r") == F.floor(F.col("_n") / 2) + 1
    return ranked.done().filter((F.col("_n") >= 3) & middle).select(
        "track_id", F.col("delta_us").alias("compensation_us"), F.col("_n").alias("n_taps")
    )
