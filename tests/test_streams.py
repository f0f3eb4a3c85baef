"""Streams drained in several micro-batches give what the batch operators give."""

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from cuestream.catalog import streams as ST
from cuestream.catalog.sequences import tap_log
from cuestream.operators.ordered import fold_tap_log
from cuestream.sources.audio import mel_frames
from cuestream.streaming import metrics as ME
from cuestream.streaming import presence as PR
from cuestream.streaming import runner as RU
from cuestream.streaming import sessions as SE

def ordered_files(df, path, order, n):
    """Write n files whose names follow the order, so micro-batches arrive in it."""
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)
    return path


def test_tap_stream_equals_fold(spark, sf_dir, tmp_path):
    log = tap_log(spark, sf_dir)
    counts = log.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_lines"))
    full = log.join(counts, "track_id")
    path = ordered_files(full, str(tmp_path / "log"), "seq", 1)
    stream = RU.stream_files(spark, path, spark.read.parquet(path), max_files=1)
    out = RU.drain_to_table(SE.tap_stream(stream), "taps")
    last = out.groupBy("track_id").agg(F.max("as_of_seq").alias("m"))
    final = out.join(last, "track_id").filter("as_of_seq = m")
    assert rows(final, "track_id", "line_index", "time_us") == rows(fold_tap_log(log, counts), "track_id", "line_index", "time_us")


def test_frame_stream_equals_batch(spark, tmp_path):
    x = np.sin(np.arange(512 * 9) / 7.0) * 0.4
    data = [(t, i, 512 * 9, 22_050, [float(v) for v in x[i * 512 : (i + 1) * 512]]) for t in (1, 2) for i in range(9)]
    chunks = spark.createDataFrame(data, "track_id long, chunk_idx long, n_samples long, sample_rate long, samples array<float>")
    path = str(tmp_path / "chunks")
    chunks.repartition(5, "chunk_idx").write.parquet(path)
    out = RU.drain_to_table(SE.frame_stream(RU.stream_files(spark, path, chunks, max_files=1)), "frames")
    text = F.array_join(F.col("bands").cast("array<string>"), ",").alias("b")
    assert rows(out.select("track_id", "frame", text), "track_id", "frame", "b") == rows(mel_frames(chunks).select("track_id", "frame", text), "track_id", "frame", "b")


def test_frame_stream_split_into_ranges(spark, tmp_path):
    n = SE.RANGE * 2 + 9
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, 512 * n)
    data = [(t, i, 512 * n, 22_050, [float(v) for v in x[i * 512 : (i + 1) * 512] * t]) for t in (1, 2) for i in range(n)]
    chunks = spark.createDataFrame(data, "track_id long, chunk_idx long, n_samples long, sample_rate long, samples array<float>")
    path = str(tmp_path / "chunks")
    chunks.repartition(4, "chunk_idx").write.parquet(path)
    out = RU.drain_to_table(SE.frame_stream(RU.stream_files(spark, path, chunks, max_files=1)), "frames")
    text = F.array_join(F.col("bands").cast("array<string>"), ",").alias("b")
    got = rows(out.select("track_id", "frame", text), "track_id", "frame", "b")
    assert got == rows(mel_frames(chunks).select("track_id", "frame", text), "track_id", "frame", "b") and len(got) == 2 * (n - 1)


def test_roll_up_stream_equals_batch_for_closed_windows(spark, sf_dir, tmp_path):
    ev = ME.sanitise_entries(ST.entries(ST.events_of(spark, sf_dir))).filter("reason is null")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    path = ordered_files(ev, str(tmp_path / "ev"), "ts", 4)
    stream = RU.stream_files(spark, path, spark.read.parquet(path), max_files=1)
    got = rows(RU.drain_to_table(ME.roll_up(stream, "6 hours"), "roll"), "window_start", "event", "bucket", "n")
    want = rows(ME.roll_up(ev, "6 hours"), "window_start", "event", "bucket", "n")
    assert got and set(got) <= set(want)


def test_live_tabs(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    data = [(1, "a", "opened", at(0)), (1, "b", "opened", at(4)), (1, "a", "heartbeat", at(5)), (1, "b", "closed", at(6))]
    df = spark.createDataFrame(data, "project_id long, tab_id string, type string, ts timestamp")
    path = str(tmp_path / "m")
    df.coalesce(1).write.parquet(path)
    out = RU.drain_to_table(PR.live_tabs_stream(RU.stream_files(spark, path, df)), "tabs").orderBy("at_us").collect()
    assert out[0].live == 1 and out[0].primary_tab == "a"
    batch = df.select("project_id", "tab_id", F.monotonically_increasing_id().alias("seq"), "type", F.unix_micros("ts").alias("at_us"))
    timeline = [(r.live, r.conflict) for r in PR.presence_timeline(batch).orderBy("at_us").collect()]
    assert timeline == [(1, False), (2, True), (1, False), (0, False)]


def test_forward_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "bad_bucket")], "i long, event string, reason string")
    write = ME.forward_sink(str(tmp_path / "out"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_peak_windows_equal_peak_buckets(spark):
    from cuestream.operators.peaks import compute_peaks

    data = [(1, i, float(np.sin(i / 5.0))) for i in range(200)]
    samples = spark.createDataFrame(data, "track_id long, frame long, value double")
    timed = samples.withColumn("ts", F.timestamp_micros(F.col("frame") * 1_000))
    got = SE.peak_stream(timed).withColumn("bucket", F.floor(F.unix_micros("bucket_start") / 10_000))
    cols = ["bucket", *[F.round(c, 9).alias(c) for c in ("min", "max", "rms")]]
    want = compute_peaks(samples, 10)
    assert rows(got.select(*cols), "bucket", "min", "max", "rms") == rows(want.select(*cols), "bucket", "min", "max", "rms")
