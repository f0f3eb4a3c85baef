"""Equi-join operators: signature and word matching, references, hashes and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions.timecode import ms
from cuestream.operators.estimate import interpolate_words, protected
from cuestream.plans.scan import OrderedScan, last_before, position
from cuestream.plans.session import cut_lineage


def merge_parsed_timings(
    cues: DataFrame, parsed: DataFrame, match: str = "first", hot: bool | None = None
) -> DataFrame:
    """Give cues the span of the parsed cue with the same signature.

    ``match='first'`` lets every repeat take the first occurrence; ``'nth'``
    pairs repeats in order. Protected cues and cues without a match keep theirs.
    """
    src = parsed if "sig" in parsed.columns else parsed.withColumn("sig", X.norm_match("text"))
    src = src.filter(F.col("start_us").isNotNull() & (F.col("sig") != ""))
    cues = cues if "sig" in cues.columns else cues.withColumn("sig", X.norm_match("text"))
    span = F.struct("start_us", F.coalesce("end_us", F.col("start_us") + ms(2000)).alias("end_us"))
    on = ["track_id", "sig"]
    if match == "first":
        found = src.groupBy(*on).agg(F.min_by(span, "cue_seq").alias("_m"))
    else:
        on = [*on, "_nth"]
        keys = ["track_id", "sig"]
        found = OrderedScan.over(src, keys, ["cue_seq"], hot=hot).add(_nth=position()).done().select(*on, span.alias("_m"))
        cues = OrderedScan.over(cues, keys, ["seq"], hot=hot).add(_nth=position()).done()
    joined = cues.join(found, on, "left")
    hit = F.col("_m").isNotNull() & ~protected(cues)
    return joined.withColumns(
        {
            "start_us": F.when(hit, F.col("_m.start_us")).otherwise(F.col("start_us")),
            "end_us": F.when(hit, F.col("_m.end_us")).otherwise(F.col("end_us")),
            "source": F.when(hit, "align").otherwise(F.col("source")),
            "confidence": F.when(hit, 0.8).otherwise(F.col("confidence")),
        }
    ).drop("_m", "_nth")


def merge_word_timings(cues: DataFrame, parsed_words: DataFrame) -> DataFrame:
    """Word spans from the first parsed word of equal signature in the same cue.

    Unmatched words sit at the end of the last matched one; a cue without any
    match gets interpolated words.
    """
    cue = ["track_id", "cue_id"]
    first = (
        parsed_words.withColumn("_key", X.norm_match("text"))
        .filter(F.col("_key") != "")
        .groupBy(*cue, "_key")
        .agg(F.min_by(F.struct("start_us", F.greatest("end_us", "start_us").alias("end_us")), "word_idx").alias("_m"))
    )
    tokens = cues.select(
        *cue,
        F.col("start_us").alias("_c0"),
        F.posexplode(X.highlight_tokens("text")).alias("word_idx", "text"),
    ).withColumn("_key", X.norm_match("text"))
    joined = tokens.join(first, [*cue, "_key"], "left")
    scan = OrderedScan.over(joined, cue, ["word_idx"], hot=False).add(_last=last_before("_m.end_us"))
    held = F.greatest(F.col("_c0"), F.coalesce(F.col("_last"), F.col("_c0")))
    hit = F.col("_m").isNotNull()
    matched = scan.done().select(
        *cue,
        F.col("word_idx").cast("long").alias("word_idx"),
        "text",
        F.when(hit, F.col("_m.start_us")).otherwise(held).alias("start_us"),
        F.when(hit, F.col("_m.end_us")).otherwise(held).alias("end_us"),
        F.when(hit, 0.85).otherwise(0.4).alias("confidence"),
        F.when(hit, "align").otherwise("estimate").alias("source"),
    )
    touched = joined.filter(hit).select(*cue).distinct()
    plain = interpolate_words(cues.join(touched, cue, "left_anti"), carry=["confidence", "source"])
    return matched.join(touched, cue, "left_semi").unionByName(plain)


def union_references(sites: Sequence[DataFrame]) -> DataFrame:
    """Distinct non-null ids over all reference sites (each a one-column table)."""
    out = None
    for site in sites:
        ids = site.toDF("asset_id").filter("asset_id is not null")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def unreferenced_assets(assets: DataFrame, sites: Sequence[DataFrame]) -> DataFrame:
    """Assets no site refers to: the ones garbage collection removes."""
    return assets.join(union_references(sites), "asset_id", "left_anti")


def flag_missing_audio(projects: DataFrame, assets: DataFrame) -> DataFrame:
    present = assets.select(F.col("asset_id").alias("audio_id")).distinct().withColumn("_there", F.lit(True))
    gone = F.col("audio_id").isNotNull() & F.col("_there").isNull()
    return projects.join(present, "audio_id", "left").withColumn("audio_missing", gone).drop("_there")


def relink_by_hash(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Accept an offered file only when its content hash is the expected one."""
    want = expected.select("asset_id", F.col("content_hash").alias("expected_hash"))
    out = files.join(want, "asset_id", "left")
    verdict = (
        F.when(F.col("expected_hash").isNull(), "unknown")
        .when(F.col("content_hash") == F.col("expected_hash"), "accepted")
        .otherwise("mismatch")
    )
    return out.withColumn("verdict", verdict)


def relink_missing(projects: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Replace a missing audio asset by the first present manifest asset of equal hash."""
    here = present.select("asset_id").distinct()
    options = (
        manifest.join(here, "asset_id", "left_semi")
        .groupBy("content_hash")
        .agg(F.min_by("asset_id", "position").alias("_other"))
    )
    there = here.select(F.col("asset_id").alias("audio_id"), F.lit(True).alias("_there"))
    df = projects.join(there, "audio_id", "left").join(options, "content_hash", "left")
    linked = F.when(F.col("_there"), F.col("audio_id")).otherwise(F.coalesce(F.col("_other"), F.col("audio_id")))
    missing = F.col("audio_id").isNotNull() & F.col("_there").isNull() & F.col("_other").isNull()
    return df.withColumns({"linked_id": linked, "audio_missing": missing}).drop("_there", "_other")


def fill_blank_names(projects: DataFrame, meta: DataFrame, key: str = "file", names: Sequence[str] = ("title", "artist")) -> DataFrame:
    """Names of a project from its imported file where it has none; a name it has stays, blank ones become empty."""
    found = meta.select(F.col(key).alias("_of"), *[F.col(n).alias(f"_{n}") for n in names])

    def filled(name: str) -> Column:
        own = F.when(~F.coalesce(F.col(name), F.lit("")).rlike(r"(?U)^[\s\x{FEFF}]*$"), F.col(name))
        return F.coalesce(own, F.col(f"_{name}"), F.lit(""))

    met = projects.join(found, F.col(key) == F.col("_of"), "left")
    return met.withColumns({n: filled(n) for n in names}).drop("_of", *[f"_{n}" for n in names])


def lookup_with_default(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str, default_key) -> DataFrame:
    """Left lookup where an unknown key takes the default row of a dimension.

    Spark sees the dimension's size and broadcasts it only where it is small.
    """
    known = dimension.select(F.col(dim_key).alias(key), F.lit(True).alias("_known"))
    resolved = F.when(F.col("_known"), F.col(key)).otherwise(F.lit(default_key))
    out = facts.join(known, key, "left").withColumn(dim_key, resolved).drop("_known")
    return out.join(dimension, dim_key).select(*facts.columns, *dimension.columns)


def first_fit(tiers: Sequence[dict], value: str, **demands: Column) -> Column:
    """First tier whose limits all reach the demands, else the last tier."""
    out = None
    for tier in tiers:
        fits = F.lit(True)
        for limit, demand in demands.items():
            fits = fits & (demand <= tier[limit])
        result = F.lit(tier[value])
        out = F.when(fits, result) if out is None else out.when(fits, result)
    return out.otherwise(F.lit(tiers[-1][value]))


# H.264 levels with their macroblock rate and frame size limits.
AVC_LEVELS = [
    {"level": 0x1E, "rate": 40_500, "frame": 1_620},
    {"level": 0x1F, "rate": 108_000, "frame": 3_600},
    {"level": 0x20, "rate": 216_000, "frame": 5_120},
    {"level": 0x28, "rate": 245_760, "frame": 8_192},
    {"level": 0x29, "rate": 245_760, "frame": 8_192},
    {"level": 0x2A, "rate": 522_240, "frame": 8_704},
    {"level": 0x32, "rate": 589_824, "frame": 22_080},
    {"level": 0x33, "rate": 983_040, "frame": 36_864},
    {"level": 0x34, "rate": 2_073_600, "frame": 36_864},
]
AVC_PROFILES = {"baseline": "42e0", "main": "4d40", "high": "6400"}


def avc_codec_string(width: Column, height: Column, fps: Column, profile: str = "high") -> Column:
    blocks = F.ceil(width / 16) * F.ceil(height / 16)
    level = first_fit(AVC_LEVELS, "level", rate=blocks * fps, frame=blocks)
    return F.concat(F.lit("avc1." + AVC_PROFILES[profile]), F.lower(F.hex(level)))


def match_scene_ids(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """Identity of each scene: its explicit id, else the line at its index, else a new id.

    ``scenes(track_id, idx, id)`` and ``lines(track_id, idx, line_id)``, with no
    id used twice. Going through the scenes in order is not needed: an explicit
    id goes to its first user, unless the line carrying that id was already
    taken as a fallback by an earlier scene k, and whether k fell back is the
    same question asked about k. Each round follows these references twice as
    far, so the rounds grow with the logarithm of the longest chain.
    """
    key = ["track_id", "idx"]
    first = scenes.filter("id is not null").groupBy("track_id", "id").agg(F.min("idx").alias("_first"))
    owner = lines.select("track_id", F.col("line_id").alias("id"), F.col("idx").alias("_owner"))
    df = (
        scenes.join(first, ["track_id", "id"], "left")
        .join(owner, ["track_id", "id"], "left")
        .join(lines, key, "left")
    )
    taken = first.select("track_id", F.col("id").alias("line_id"), F.col("_first").alias("_claimed"))
    df = df.join(taken, ["track_id", "line_id"], "left")
    df = df.withColumn(
        "_pick",
        F.when(F.col("id").isNull() | (F.col("_first") < F.col("idx")), F.lit(False)).when(
            F.col("_owner").isNull() | (F.col("_owner") >= F.col("idx")), F.lit(True)
        ),
    ).withColumn("_ref", F.when(F.col("_pick").isNull(), F.col("_owner")))
    while True:
        df = cut_lineage(df)
        if not df.filter(F.col("_pick").isNull()).take(1):
            break
        seen = df.select("track_id", F.col("idx").alias("_ref"), F.col("_pick").alias("_rp"), F.col("_ref").alias("_rr"))
        df = (
            df.join(seen, ["track_id", "_ref"], "left")
            .withColumn("_pick", F.coalesce(F.col("_pick"), F.col("_rp")))
            .withColumn("_ref", F.when(F.col("_pick").isNull(), F.col("_rr")))
            .drop("_rp", "_rr")
        )
    free = F.col("line_id").isNotNull() & (F.col("_claimed").isNull() | (F.col("_claimed") >= F.col("idx")))
    return df.select(
        *key,
        F.when(F.col("_pick"), F.col("id"))
        .when(free, F.col("line_id"))
        .otherwise(F.concat(F.lit("scn_"), F.col("idx").cast("string")))
        .alias("scene_id"),
        F.when(F.col("_pick"), "explicit").when(free, "index").otherwise("new").alias("matched_by"),
    )
