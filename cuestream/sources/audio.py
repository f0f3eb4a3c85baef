"""Audio files: intake audit on metadata, WAV decoding to mono chunks, spectral frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.plans.scan import sliding

# File kinds by extension, and intake limits.
AUDIO_EXTENSIONS = (
    "mp3", "mp2", "wav", "wave", "flac", "m4a", "m4b", "aac", "ogg", "oga", "opus", "webm", "aiff", "aif", "aifc", "caf", "mp4",
    "mov", "m4v", "3gp", "3g2", "mkv", "mka", "avi", "amr", "gsm", "wma", "ape", "wv", "tta", "mpc", "dsf", "dff", "eac3", "ac3",
    "dts", "qoa", "mod", "xm", "s3m", "it", "mpa", "m1a", "m2a", "au", "snd", "voc", "mpg", "mpeg",
)
IMAGE_EXTENSIONS = (
    "png", "jpg", "jpeg", "webp", "avif", "gif",
)
TEXT_EXTENSIONS = (
    "lrc", "srt", "vtt", "ass", "ssa", "txt", "json",
)
MAX_BYTES, SOFT_BYTES = 250 * 1024 * 1024, 80 * 1024 * 1024
MAX_DURATION_US, SOFT_DURATION_US = 1_200_000_000, 360_000_000

CHUNK = 512
FFT = 1024
BANDS = 32


def file_kind(name: Column, mime: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    base = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return (
        F.when(ext.isin(*AUDIO_EXTENSIONS) | base.rlike("^(audio|video)/") | (base == "application/ogg"), "audio")
        .when(ext.isin(*IMAGE_EXTENSIONS) | F.startswith(mime, F.lit("image/")), "image")
        .when(ext.isin(*TEXT_EXTENSIONS) | F.startswith(mime, F.lit("text/")) | (mime == "application/json"), "lyrics")
        .otherwise("unknown")
    )


def intake_verdict(kind: Column, size: Column) -> Column:
    """Empty, unsupported or too large files are refused; unknown kinds pass on to the decoder."""
    return (
        F.when(size == 0, "AUDIO_EMPTY")
        .when(kind.isin("lyrics", "image", "project"), "AUDIO_UNSUPPORTED_FORMAT")
        .when(size > MAX_BYTES, "AUDIO_TOO_LARGE")
        .when(size > SOFT_BYTES, "warn_large")
        .otherwise("ok")
    )


def duration_verdict(duration_us: Column) -> Column:
    return (
        F.when(duration_us <= 0, "AUDIO_EMPTY")
        .when(duration_us > MAX_DURATION_US, "AUDIO_TOO_LONG")
        .when(duration_us > SOFT_DURATION_US, "warn_long")
        .otherwise("ok")
    )


def audit_files(spark: SparkSession, path: str) -> DataFrame:
    """Verdict per file from metadata alone; contents are not read.

    Spark's file scan leaves out files of zero bytes; where those must be
    reported, apply ``intake_verdict`` to a listing table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = file_kind(F.col("path"), F.lit(""))
    return files.select("path", "length", kind.alias("kind"), intake_verdict(kind, F.col("length")).alias("verdict"))


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames x channels), rate and channel count of a RIFF/WAVE file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        start = at + 8
        if start + size > len(data):
            raise ValueError("chunk extends beyond the file")
        if data[at : at + 4] == b"fmt ":
            if size < 16:
                raise ValueError("format chunk is incomplete")
            code, channels, rate, _, align, bits = np.frombuffer(data, np.dtype("<u2,<u2,<u4,<u4,<u2,<u2"), 1, start)[0].item()
            fmt = (code, channels, rate, align, bits)
        elif data[at : at + 4] == b"data" and body is None:
            body = data[start : start + size]
        at = start + size + (size & 1)
    if fmt is None or body is None:
        raise ValueError("format or data chunk is missing")
    code, channels, rate, align, bits = fmt
    if min(channels, rate, align) < 1 or code not in (1, 3) or bits not in (8, 16, 24, 32, 64) or (code == 3 and bits < 32) or (code == 1 and bits == 64):
        raise ValueError("unsupported encoding")
    width = bits // 8
    if align < channels * width:
        raise ValueError("block alignment is invalid")
    frames = len(body) // align
    raw = np.frombuffer(body, np.uint8, frames * align).reshape(frames, align)[:, : channels * width]
    raw = np.ascontiguousarray(raw)
    if code == 3:
        x = raw.view("<f4" if bits == 32 else "<f8").astype(np.float64)
    elif bits == 8:
        x = (raw.astype(np.float64) - 128) / 128
    elif bits == 24:
        b = raw.reshape(frames, channels, 3).astype(np.int32)
        whole = b[:, :, 0] | (b[:, :, 1] << 8) | (b[:, :, 2] << 16)
        x = np.where(whole & 0x800000, whole - 0x1000000, whole) / 8_388_608
    else:
        x = raw.view("<i2" if bits == 16 else "<i4") / float(2 ** (bits - 1))
    return np.where(np.isfinite(x), np.clip(x, -1, 1), 0.0), rate, channels


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Mono chunks of 512 samples from WAV files; files that cannot be decoded carry their error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return wav_chunks(files.select(F.col("path").alias("track_id"), "content"))


def wav_chunks(files: DataFrame) -> DataFrame:
    """``(track_id, content)`` to ``(track_id, chunk_idx, n_samples, sample_rate, samples, error)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for track, content in zip(pdf.track_id, pdf.content, strict=True):
                try:
                    x, rate, _ = decode_wav(bytes(content))
                except ValueError as problem:
                    yield pd.DataFrame({"track_id": [track], "chunk_idx": [0], "n_samples": [0], "sample_rate": [0], "samples": [[]], "error": [str(problem)]})
                    continue
                mono = x.mean(axis=1).astype(np.float32) if len(x) else np.zeros(0, np.float32)
                starts = range(0, max(1, len(mono)), CHUNK)
                yield pd.DataFrame(
                    {
                        "track_id": track,
                        "chunk_idx": np.arange(len(starts)),
                        "n_samples": len(mono),
                        "sample_rate": rate,
                        "samples": [mono[s : s + CHUNK] for s in starts],
                        "error": None,
                    }
                )

    key = files.schema["track_id"].dataType.simpleString()
    schema = f"track_id {key}, chunk_idx bigint, n_samples bigint, sample_rate bigint, samples array<float>, error string"
    return files.mapInPandas(run, schema)


def mel_edges(rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (top * np.arange(BANDS + 1) / BANDS / 2595) - 1)
    return np.clip(np.floor(hz / (rate / FFT) + 0.5), 1, FFT // 2).astype(int)


def band_matrix(rate: int) -> np.ndarray:
    """Mean of the bins between neighbouring edges, as a (bins x bands) matrix."""
    edges = mel_edges(rate)
    out = np.zeros((FFT // 2 + 1, BANDS))
    for b in range(BANDS):
        lo, hi = edges[b], max(edges[b] + 1, edges[b + 1])
        out[lo:hi, b] = 1.0 / (hi - lo)
    return out


def frame_bands(frames: np.ndarray, rate: int) -> np.ndarray:
    """Quantised log band energies (0 to 255) of windowed frames."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(FFT) / (FFT - 1)))
    energy = (np.abs(np.fft.rfft(frames * window, axis=1)) / FFT) @ band_matrix(rate)
    return np.floor(np.clip(255 * np.log10(1 + energy * 400) / 3, 0, 255) + 0.5).astype(int)


def mel_frames(chunks: DataFrame) -> DataFrame:
    """Hopping frames (1024 samples, hop 512) of chunk rows as ``(track_id, frame, bands)``.

    A frame is a chunk and its successor, so neighbouring chunk rows are joined
    by a haloed window and each frame is computed on its own.
    """
    good = chunks.filter(F.size("samples") > 0)
    nxt = {"_nx": lambda w: F.lead("samples").over(w)}
    pairs = sliding(good, ["track_id"], "chunk_idx", 1, nxt, chunk_rows=4096)
    n_frames = F.greatest(F.lit(1), F.floor((F.col("n_samples") - FFT) / CHUNK) + 1)
    wanted = pairs.filter(F.col("chunk_idx") < n_frames).select(
        "track_id", F.col("chunk_idx").alias("frame"), "sample_rate",
        F.concat("samples", F.coalesce("_nx", F.array().cast("array<float>"))).alias("x"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rate, part in pdf.groupby("sample_rate"):
                frames = np.zeros((len(part), FFT))
                for i, x in enumerate(part["x"]):
                    frames[i, : len(x)] = x[:FFT]
                yield pd.DataFrame({"track_id": part["track_id"].to_numpy(), "frame": part["frame"].to_numpy(), "bands": list(frame_bands(frames, int(rate)))})

    key = chunks.schema["track_id"].dataType.simpleString()
    return wanted.mapInPandas(run, f"track_id {key}, frame bigint, bands array<int>")


def spectrum_rows(frames: DataFrame) -> DataFrame:
    """Long form ``(track_id, frame, band, value)`` of ``mel_frames`` output."""
    long = frames.select("track_id", "frame", F.posexplode("bands").alias("band", "v"))
    return long.select("track_id", "frame", F.col("band").cast("long").alias("band"), F.col("v").cast("double").alias("value"))
