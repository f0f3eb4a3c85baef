"""Content-addressed assets and project tables: dedupe, chunks, signatures, summaries, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions.timecode import round_half_up
from cuestream.plans.scan import OrderedScan, group_count, group_min, top_k

KEYS = ["track_id"]
FIELD, RECORD = "\x1f", "\x1e"


def dedupe_by_hash(records: DataFrame, order: str = "created_at") -> DataFrame:
    """First stored record per content hash. Copies collapse map-side before the shuffle."""
    row = F.struct(*records.columns)
    first = records.groupBy("content_hash").agg(F.min_by(row, F.struct(order, "asset_id")).alias("r"))
    return first.select("r.*")


def repeated_signatures(lines: DataFrame, min_length: int = 3) -> DataFrame:
    """Signatures that recur inside a track. ``lines`` carry ``sig``."""
    long_enough = lines.filter(F.length("sig") >= min_length)
    return long_enough.groupBy("track_id", "sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)


def repetition_groups(lines: DataFrame, min_length: int = 3, hot: bool | None = None) -> DataFrame:
    """Ids of every repeated line, one row per id, with its group's size and first id."""
    long_enough = lines.filter(F.length("sig") >= min_length).select("track_id", "sig", "seq")
    scan = OrderedScan.over(long_enough, ["track_id", "sig"], ["seq"], hot=hot).add(n=group_count(), first_seq=group_min("seq"))
    return scan.done().filter(F.col("n") >= 2)


def content_signature(lines: DataFrame, voice_b: str | None = None) -> DataFrame:
    """Fingerprint per track of line order, id, spoken text and start; ends do not count.

    The fingerprint is a sum of per-line hashes that include the line's place,
    so it needs no concatenation of a whole track and merges map-side.
    """
    spoken = lines.filter(F.trim("spoken") != "")
    tag = F.when(F.lit(voice_b is not None) & (F.col("speaker") == "B"), "B").otherwise("") if "speaker" in lines.columns else F.lit("")
    head = F.lit(f"vb:{voice_b}" if voice_b else "")
    text = F.concat_ws(FIELD, head, F.col("seq").cast("string"), F.col("cue_id").cast("string"), "spoken", F.col("start_us").cast("string"), tag)
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return spoken.groupBy("track_id").agg(F.sum(part).cast("string").alias("signature"))


def stale_tracks(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Tracks whose stored signature no longer matches."""
    old = stored.select("track_id", F.col("signature").alias("_old"))
    changed = ~F.col("signature").eqNullSafe(F.col("_old"))
    return current.join(old, "track_id", "full").select("track_id", changed.alias("stale"))


#: Hexadecimal digits of an entry's hash that name its bucket, so 4096 buckets a bundle.
BUCKET_DIGITS = 3


def bundle_id(descriptors: DataFrame) -> DataFrame:
    """Order-independent id per bundle, 24 characters of a two-level hash of ``id, sha, bytes`` entries.

    Entries fall into buckets by the first digits of their own hash. The sorted entries of
    a bucket are hashed, then the bucket hashes in bucket order. The rule is the same for
    every number of entries, and a task holds one bucket, not a bundle.
    """
    entry = F.concat_ws(FIELD, F.col("id").cast("string"), "sha256", F.col("bytes").cast("string"))
    named = descriptors.select("bundle", entry.alias("_e")).withColumn("_b", F.substring(F.sha2("_e", 256), 1, BUCKET_DIGITS))
    buckets = named.groupBy("bundle", "_b").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_e")), RECORD), 256).alias("h"), F.count(F.lit(1)).alias("k")
    )
    whole = buckets.groupBy("bundle").agg(
        F.sum("k").alias("n_entries"), F.array_sort(F.collect_list(F.struct("_b", "h"))).alias("hs")
    )
    digest = F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), RECORD), 256)
    return whole.select("bundle", "n_entries", F.substring(digest, 1, 24).alias("bundle_id"))


def split_into_chunks(files: DataFrame, chunk_bytes: int) -> DataFrame:
    """Fixed-size pieces of a binary column with index, byte count and hash."""
    size = F.octet_length("content")
    n = F.greatest(F.lit(1), F.ceil(size / chunk_bytes)).cast("int")
    pieces = files.filter(size > 0).select("file", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    piece = F.substring(F.col("content"), F.col("idx") * chunk_bytes + 1, F.lit(chunk_bytes))
    out = pieces.select("file", "idx", piece.alias("piece"))
    return out.withColumns({"bytes": F.octet_length("piece").cast("long"), "sha256": F.sha2(F.col("piece"), 256)})


def verify_chunks(chunks: DataFrame, manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """Verdict per file: manifest total, then presence, size and hash of each piece."""
    want = manifest.select("file", "idx", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    have = chunks.select("file", "idx", "bytes", "sha256")
    pairs = want.join(have, ["file", "idx"], "left")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    per_file = pairs.groupBy("file").agg(
        F.sum("_b").alias("_total"),
        n(F.col("bytes").isNull()).alias("_missing"),
        n(F.col("bytes") != F.col("_b")).alias("_size"),
        n((F.col("bytes") == F.col("_b")) & (F.col("sha256") != F.col("_h"))).alias("_hash"),
    )
    verdict = (
        F.when(F.col("_total").isNull(), "no parts")
        .when(F.col("_total") != F.col("total_bytes"), "inconsistent size")
        .when(F.col("_missing") > 0, "missing part")
        .when(F.col("_size") > 0, "unexpected part size")
        .when(F.col("_hash") > 0, "failed integrity check")
        .otherwise("ok")
    )
    return declared.join(per_file, "file", "left").select("file", verdict.alias("verdict"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """Files from their pieces, in order; a file is one cell, as it was before splitting."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "piece")))
    joined = F.aggregate("_p", F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    return chunks.groupBy("file").agg(parts.alias("_p")).select("file", joined.alias("content"))


def summarise_projects(projects: DataFrame, cues: DataFrame) -> DataFrame:
    """Listing with counts, flags and length, newest first."""
    per = cues.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"), F.max("end_us").alias("_last"))
    df = projects.join(per, "project_id", "left")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Untitled project"))
    length = F.greatest(F.coalesce("audio_us", F.lit(0)), F.coalesce("voice_us", F.lit(0)), F.coalesce("_last", F.lit(0)))
    out = df.select(
        "project_id",
        title.alias("title"),
        "updated_us",
        F.coalesce("_n", F.lit(0)).alias("line_count"),
        F.col("audio_us").isNotNull().alias("has_audio"),
        F.col("voice_us").isNotNull().alias("has_voiceover"),
        length.cast("long").alias("duration_us"),
    )
    return out.orderBy(F.col("updated_us").desc(), "project_id")


def export_estimates(settings: DataFrame, realtime_factor: float = 3) -> DataFrame:
    """Output bytes, frames, wall-clock estimate and warnings per export row."""
    seconds = F.greatest(F.lit(0.0), (F.col("range_end_us") - F.col("range_start_us")) / F.lit(1e6))
    bits = seconds * F.col("video_bitrate") + F.when(F.col("include_audio"), seconds * F.col("audio_bitrate")).otherwise(0.0)
    span = (F.col("range_end_us") - F.col("range_start_us")) / F.lit(1e6)
    warnings = F.array_compact(
        F.array(
            F.when((F.col("width") * F.col("height") >= 3840 * 2160) & (span > 60), "4k_over_a_minute"),
            F.when(span > 600, "over_ten_minutes"),
            F.when(span * F.col("fps") > 30_000, "many_frames"),
        )
    )
    return settings.withColumns(
        {
            "output_bytes": round_half_up(bits / 8),
            "frames": round_half_up(seconds * F.col("fps")),
            "eta_seconds": round_half_up(seconds * F.lit(float(realtime_factor))),
            "warnings": F.array_join(warnings, ","),
        }
    )


def palette(pixels: DataFrame, count: int = 4) -> DataFrame:
    """Dominant colours per image, darkest first: mean colour of the fullest 4-bit RGB buckets.

    Ties in size go to the smaller bucket number.
    """
    seen = pixels.filter(F.col("a") >= 64)
    key = F.shiftleft(F.shiftright("r", 4), 8) + F.shiftleft(F.shiftright("g", 4), 4) + F.shiftright("b", 4)
    sums = seen.groupBy("image", key.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(f"_{c}") for c in "rgb"]
    )
    best = top_k(sums, ["image"], [F.col("n").desc(), F.col("bucket")], max(3, count))
    mean = {c: F.floor(F.col(f"_{c}") / F.col("n")) for c in "rgb"}
    light = F.round((F.col("_r") * 0.2126 + F.col("_g") * 0.7152 + F.col("_b") * 0.0722) / F.col("n"), 6)
    colour = F.concat(F.lit("#"), *[F.lpad(F.hex(mean[c]), 2, "0") for c in "rgb"])
    return best.select("image", "bucket", "n", colour.alias("colour"), light.alias("luminance"))
