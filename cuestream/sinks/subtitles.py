"""Subtitle sinks.

Every format is produced as rows ``(track_id, line_no, line)``, so a track of
any length spreads over tasks and no file is built inside one cell.
``write_lines`` range-partitions and sorts those rows, so part files in order
are the document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions import timecode as C
from cuestream.plans.scan import OrderedScan, position

APP = "cuestream"


def select_cues(cues: DataFrame, offset_us: int = 0, skip_untimed: bool = False) -> DataFrame:
    """Rows every sink shares: non-blank text, the offset added without touching stored times."""
    df = cues.filter(X.trim_all(F.col("text")) != "")
    if skip_untimed:
        df = df.filter((F.col("start_us") > 0) | (F.col("end_us") > 0))
    return df.withColumns(
        {
            "end_us": F.greatest(F.col("start_us"), F.col("end_us") + offset_us),
            "start_us": F.greatest(F.lit(0), F.col("start_us") + offset_us),
        }
    )


def number_cues(cues: DataFrame, hot: bool | None = None) -> DataFrame:
    """1-based index per track in start order."""
    return OrderedScan.over(cues, ["track_id"], ["start_us", "cue_id"], hot=hot).add(index=position()).done()


def _with_words(cues: DataFrame, word: Column, separator: str) -> Column:
    """Rendered words of a cue, or its text when it has none. ``word`` is a function of the word struct."""
    if "words" not in cues.columns:
        return F.col("text")
    shown = F.filter("words", lambda w: X.trim_all(w["text"]) != "")
    tags = F.array_join(F.transform(shown, word), separator)
    return F.when(tags != "", tags).otherwise(F.col("text"))


def _angled(us: Column) -> Column:
    stamp = C.lrc_stamp(us)
    return F.concat(F.lit("<"), F.substring(stamp, 2, 100).substr(F.lit(1), F.length(stamp) - 2), F.lit(">"))


def lrc_lines(cues: DataFrame) -> DataFrame:
    return cues.select("track_id", "start_us", "cue_id", F.concat(C.lrc_stamp(F.col("start_us")), "text").alias("line"))


def enhanced_lrc_lines(cues: DataFrame) -> DataFrame:
    body = _with_words(cues, lambda w: F.concat(_angled(w["start_us"]), w["text"]), "")
    return cues.select("track_id", "start_us", "cue_id", F.concat(C.lrc_stamp(F.col("start_us")), body).alias("line"))


def srt_lines(numbered: DataFrame) -> DataFrame:
    span = F.concat(C.srt_stamp(F.col("start_us")), F.lit(" --> "), C.srt_stamp(F.col("end_us")))
    block = F.concat_ws("\n", F.col("index").cast("string"), span, F.col("text"), F.lit(""))
    return numbered.select("track_id", "start_us", "cue_id", "index", block.alias("line"))


def vtt_lines(numbered: DataFrame) -> DataFrame:
    span = F.concat(C.vtt_stamp(F.col("start_us")), F.lit(" --> "), C.vtt_stamp(F.col("end_us")))
    body = _with_words(numbered, lambda w: F.concat(F.lit("<"), C.vtt_stamp(w["start_us"]), F.lit(">"), w["text"]), " ")
    block = F.concat_ws("\n", F.concat(F.lit("cue-"), F.col("index").cast("string")), span, body, F.lit(""))
    return numbered.select("track_id", "start_us", "cue_id", "index", block.alias("line"))


def ass_colour(hex_colour: str, alpha: int = 0) -> str:
    """``#RGB`` or ``#RRGGBB`` to the alpha-blue-green-red form of ASS."""
    plain = hex_colour.replace("#", "")
    plain = "".join(c * 2 for c in plain) if len(plain) == 3 else plain
    if len(plain) < 6:
        return "&H00FFFFFF"
    return f"&H{alpha:02X}{plain[4:6]}{plain[2:4]}{plain[:2]}".upper()


def ass_lines(cues: DataFrame) -> DataFrame:
    def tag(w: Column) -> Column:
        cs = F.greatest(F.lit(1), C.round_half_up((w["end_us"] - w["start_us"]) / 10_000))
        return F.concat(F.lit("{\\kf"), cs.cast("string"), F.lit("}"), w["text"])

    body = F.replace(_with_words(cues, tag, " "), F.lit("\n"), F.lit("\\N"))
    fade = F.when(F.col("speaker") == "B", "{\\fad(120,120)}").otherwise("") if "speaker" in cues.columns else F.lit("")
    line = F.concat(
        F.lit("Dialogue: 0,"), C.ass_stamp(F.col("start_us")), F.lit(","), C.ass_stamp(F.col("end_us")),
        F.lit(",Default,,0,0,0,,"), fade, body,
    )
    return cues.select("track_id", "start_us", "cue_id", line.alias("line"))


def plain_lines(cues: DataFrame) -> DataFrame:
    return cues.filter(X.trim_all(F.col("text")) != "").select("track_id", "start_us", "cue_id", F.col("text").alias("line"))


def timed_json_lines(cues: DataFrame) -> DataFrame:
    """One JSON object per cue; confidence is that of its least sure word, 1 without words."""
    known = [c for c in ("section_id", "speaker", "translation") if c in cues.columns]
    lowest = F.coalesce(F.array_min(F.transform("words", lambda w: w["confidence"])), F.lit(1.0)) if "words" in cues.columns else F.lit(1.0)
    entry = F.struct(
        "text",
        F.col("start_us").alias("start"),
        F.col("end_us").alias("end"),
        *known,
        *([F.col("source").alias("timingSource")] if "source" in cues.columns else []),
        lowest.alias("confidence"),
        *([F.transform("words", lambda w: F.struct(w["text"].alias("text"), F.greatest(F.lit(0), w["start_us"]).alias("start"), F.greatest(F.lit(0), w["end_us"]).alias("end"), w["confidence"].alias("confidence"))).alias("words")] if "words" in cues.columns else []),
    )
    return cues.select("track_id", "start_us", "cue_id", F.to_json(entry).alias("line"))


def lrc_header(meta: DataFrame, offset_us: int = 0) -> DataFrame:
    """Header tag lines per track from ``(track_id, title, artist, album)``; the offset only when not zero."""

    def tag(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"[{name}:"), value, F.lit("]")))

    tags = [tag("ti", F.col("title")), tag("ar", F.col("artist")), tag("al", F.col("album")), F.lit(f"[by:{APP}]")]
    if offset_us:
        tags.append(F.lit(f"[offset:{math.floor(-offset_us / 1000 + 0.5)}]"))
    tags.append(F.lit(""))
    rows = meta.select("track_id", F.posexplode(F.array_compact(F.array(*tags))).alias("n", "line"))
    return rows.select("track_id", (F.col("n") - 100).cast("long").alias("start_us"), F.lit("").alias("cue_id"), "line")


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text files partitioned by track; rows are range-sorted, so part files in name order are in document order."""
    ordered = lines.repartitionByRange("track_id", "start_us", "cue_id").sortWithinPartitions("track_id", "start_us", "cue_id")
    ordered.select("track_id", "line").write.mode(mode).partitionBy("track_id").text(path)


def project_bundles(projects: DataFrame, assets: DataFrame, kind: str, version: int = 3) -> DataFrame:
    """Document plus asset manifest, without payloads, as one JSON text per project.

    ``projects(project_id, project_json)``, ``assets(project_id, asset_id, kind,
    bytes, content_hash)``. A bundle lists at most 200 assets by its own schema.
    """
    entry = F.to_json(F.struct(F.col("asset_id").alias("id"), "kind", "bytes", F.col("content_hash").alias("contentHash")))
    listed = assets.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("asset_id", entry.alias("j")))).alias("a"))
    body = F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<asset_id:bigint,j:string>>")), lambda x: x["j"]), ",")
    return projects.join(listed, "project_id", "left").select(
        "project_id",
        F.concat(
            F.lit(f'{{"kind":"{kind}","formatVersion":{version},"project":'), "project_json", F.lit(',"assets":['), body, F.lit("]}")
        ).alias("bundle_json"),
    )
