"""Declarative specs to cues and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions.timecode import ms, round_half_up, us_from_seconds
from cuestream.operators.estimate import anchored_timeline
from cuestream.plans.scan import OrderedScan, position

SECTION_KINDS = ("INTRO", "VERSE", "PRE_CHORUS", "CHORUS", "HOOK", "REFRAIN", "BRIDGE", "BREAKDOWN", "INSTRUMENTAL", "OUTRO")


def explode_scenes(specs: DataFrame) -> DataFrame:
    """One row per scene of each spec ``(track_id, raw_json)``."""
    v = F.try_parse_json("raw_json")
    df = specs.select("track_id", v.alias("_v")).select(
        "track_id",
        F.coalesce(F.try_variant_get("_v", "$.voice.wpm", "double"), F.lit(155.0)).alias("wpm"),
        us_from_seconds(F.coalesce(F.try_variant_get("_v", "$.voice.pauseMs", "double"), F.lit(250.0)) / 1000).alias("pause_us"),
        F.posexplode(F.try_variant_get("_v", "$.scenes", "array<variant>")).alias("seq", "s"),
    )

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("s", f"$.{path}", kind)

    def seconds(path: str) -> Column:
        return us_from_seconds(get(path, "double"))

    return df.select(
        "track_id",
        F.col("seq").cast("long").alias("seq"),
        "wpm",
        "pause_us",
        get("id", "string").alias("id"),
        get("text", "string").alias("text"),
        F.nullif(get("layout", "string"), F.lit("caption")).alias("layout"),
        F.nullif(F.trim(get("section", "string")), F.lit("")).alias("section"),
        get("speaker", "string").alias("speaker"),
        get("subtext", "string").alias("subtext"),
        get("value", "string").alias("value"),
        get("items", "array<string>").alias("items"),
        F.coalesce(F.size(get("chart", "array<variant>")), F.lit(0)).alias("n_bars"),
        seconds("start").alias("at_us"),
        seconds("end").alias("until_us"),
        seconds("duration").alias("length_us"),
        seconds("pauseAfter").alias("pause_after_us"),
        F.coalesce(get("locked", "boolean"), F.lit(False)).alias("locked"),
    )


def section_kind(label: Column) -> Column:
    name = F.regexp_replace(F.upper(F.trim(label)), r"[\s-]+", "_")
    return F.when(name.isin(*SECTION_KINDS), name).otherwise("UNKNOWN")


def compile_specs(specs: DataFrame, hot: bool | None = False) -> DataFrame:
    """Specs to timed cues with sections by label. A spec is one cell, so its scenes are a bounded group."""
    scenes = explode_scenes(specs)
    reading = X.reading_time_us(
        "text", F.col("wpm"), layout=F.col("layout"), items=F.col("items"), chart_size=F.col("n_bars"), subtext=F.col("subtext")
    )
    scenes = scenes.withColumn("pause_after_us", F.coalesce("pause_after_us", "pause_us"))
    timed = anchored_timeline(scenes, reading, hot=hot)
    labels = scenes.filter("section is not null").groupBy("track_id", "section").agg(F.min("seq").alias("_first"))
    labels = labels.withColumn("section_kind", section_kind(F.col("section")))
    ranked = OrderedScan.over(labels, ["track_id", "section_kind"], ["_first"], hot=hot).add(occurrence=position())
    numbered = OrderedScan.over(ranked.done(), ["track_id"], ["_first"], hot=hot).add(section_no=position()).done()
    explicit = F.col("at_us").isNotNull() | F.col("until_us").isNotNull() | F.col("length_us").isNotNull()
    out = timed.join(numbered.drop("_first"), ["track_id", "section"], "left")
    return out.select(
        "track_id",
        "seq",
        F.coalesce("id", F.concat(F.lit("scn_"), F.col("seq").cast("string"))).alias("cue_id"),
        X.norm_display("text").alias("text"),
        "layout",
        "speaker",
        "start_us",
        "end_us",
        "section_no",
        "section",
        "section_kind",
        "occurrence",
        F.when(explicit, "human").otherwise("estimate").alias("source"),
        F.when(explicit, 1.0).otherwise(0.75).alias("confidence"),
        "locked",
    )


def cue_specs(cues: DataFrame) -> DataFrame:
    """Scene JSON per cue, defaults left out, times in seconds with two decimals."""

    def seconds(us: Column) -> Column:
        return round_half_up(us / F.lit(1e4)) / F.lit(100.0)

    scene = F.struct(
        F.col("cue_id").alias("id"),
        F.nullif(F.col("layout"), F.lit("caption")).alias("layout"),
        "text",
        seconds(F.col("start_us")).alias("start"),
        seconds(F.greatest(F.col("start_us") + ms(100), F.col("end_us"))).alias("end"),
        "speaker",
        "section",
        F.when(F.col("locked"), F.lit(True)).alias("locked"),
    )
    return cues.select("track_id", "seq", F.to_json(scene).alias("scene_json"))


def cues_to_specs(cues: DataFrame, kind: str) -> DataFrame:
    """Whole specs. A spec is one JSON cell, so a track must fit one, which caps it far above real sizes."""
    scenes = cue_specs(cues).join(cues.select("track_id", "seq", "start_us"), ["track_id", "seq"])
    ordered = F.array_sort(F.collect_list(F.struct("start_us", "seq", "scene_json")))
    body = F.array_join(F.transform(ordered, lambda x: x["scene_json"]), ",")
    return scenes.groupBy("track_id").agg(
        F.concat(F.lit(f'{{"kind":"{kind}","version":1,"scenes":['), body, F.lit("]}")).alias("raw_json")
    )
