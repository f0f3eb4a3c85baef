"""Views that read the driver's tables as cues, scenes, spans, signals and taps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.functions.text import trim_all
from cuestream.functions.timecode import round_half_up
from cuestream.plans.session import spread

HOUR_US = 3_600_000_000
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def epoch_us(ts: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = epoch_us("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("cue_id"),
        "event_type",
        start.alias("start_us"),
        (start + round_half_up(F.col("value") * F.lit(6e7))).alias("end_us"),
    )


def doc_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(
        F.col("doc_id").alias("track_id"),
        *extra,
        F.posexplode(F.split("text", "\n")).alias("seq", "text"),
    )
    shown = lines.filter(F.col("text").rlike(r"(?U)[^\s\x{FEFF}]"))
    return shown.withColumns({"seq": F.col("seq").cast("long"), "text": trim_all(F.col("text"))})


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").alias("seq"),
        F.when(role == "user", "A").when(role == "assistant", "B").alias("speaker"),
        "text",
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (hour frame, event type band), zero-filled over the whole hour range."""
    events = table(spark, sf_dir, "events").select(
        F.floor(epoch_us("ts") / HOUR_US).alias("hour"), F.col("event_type").alias("band"), "value"
    )
    sums = events.groupBy("hour", "band").agg(F.sum(F.col("value").cast("decimal(20,4)")).alias("v"))
    # one row: the hour range and the few event types there are
    bounds = events.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.collect_set("band").alias("bands"))
    frames = bounds.select("lo", "bands", F.explode(F.sequence("lo", "hi")).alias("hour"))
    grid = frames.select("lo", "hour", F.explode("bands").alias("band"))
    return grid.join(sums, ["hour", "band"], "left").select(
        # one track; computed, because a literal join key would be folded away
        (F.col("lo") - F.col("lo")).alias("track_id"),
        (F.col("hour") - F.col("lo")).alias("frame"),
        "band",
        F.coalesce(F.col("v"), F.lit(0)).cast("double").alias("value"),
    )


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return clicks.select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("tap_id"), epoch_us("ts").alias("time_us")
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"),
        F.col("source").alias("kind"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.sha2("text", 256).alias("content_hash"),
    )
