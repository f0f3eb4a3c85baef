"""Peaks, spectra, rhythm and CTC over events (v_signal, v_taps) and embeddings (v_logits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import SIGNAL, SPANS, TAPS, rnd
from cuestream.operators import ctc, debounce, peaks, rhythm
from cuestream.plans.scan import sliding, top_k

HOUR = A.HOUR_US
T0 = 1_704_067_200_000_000
FRAME_US = 23_220
MINUTE = 60_000_000


def samples(spark, sf_dir):
    """Event values as samples: one frame per minute and user, averaged like channels."""
    ev = A.table(spark, sf_dir, "events")
    minute = F.floor((A.epoch_us("ts") - F.lit(T0)) / MINUTE)
    centred = ev.select(F.col("user_id").alias("track_id"), minute.alias("frame"), ((F.col("value") - 50) / 100).alias("value"))
    return peaks.mono(centred)


BUCKET = 360
SAMPLES = f"""samples AS (SELECT user_id AS track_id, CAST((epoch_us(ts) - {T0}) // {MINUTE} AS BIGINT) AS frame, avg((value - 50) / 100) AS value FROM events GROUP BY ALL)"""
PEAKS = f"""{SAMPLES}, raw AS (SELECT track_id, frame // {BUCKET} AS bucket, min(value) AS mn, max(value) AS mx, sqrt(avg(value * value)) AS rms FROM samples GROUP BY ALL),
grid AS (SELECT track_id, unnest(range(0, m + 1)) AS bucket FROM (SELECT track_id, CAST(max(bucket) AS BIGINT) AS m FROM raw GROUP BY track_id)),
pk AS (SELECT track_id, bucket, coalesce(mn, 0.0::DOUBLE) AS mn, coalesce(mx, 0.0::DOUBLE) AS mx, coalesce(rms, 0.0::DOUBLE) AS rms FROM grid LEFT JOIN raw USING (track_id, bucket))"""


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("agg01_peak_buckets", f"WITH {PEAKS} SELECT track_id, bucket, round(mn, 9) AS min, round(mx, 9) AS max, round(rms, 9) AS rms FROM pk")
def agg01(spark, sf_dir):
    return rounded(peaks.compute_peaks(samples(spark, sf_dir), BUCKET), "min", "max", "rms")


BUCKET_US = BUCKET * MINUTE
DAY = 86_400_000_000


@query(
    "agg02_range_peaks",
    f"""WITH {PEAKS}, r AS (SELECT DISTINCT track_id, bucket // 7 AS range_id FROM pk), q AS (SELECT *, range_id * 130 * 3600000000 - 7200000000 AS s, range_id * 130 * 3600000000 + 90 * 3600000000 AS e FROM r),
    b AS (SELECT q.track_id, range_id, min(mn) AS mn, max(mx) AS mx, avg(rms) AS rms FROM q JOIN pk ON pk.track_id = q.track_id
      AND bucket BETWEEN greatest(0, floor(s / {BUCKET_US}::DOUBLE)) AND ceil(e / {BUCKET_US}::DOUBLE) GROUP BY ALL)
    SELECT q.track_id, CAST(range_id AS BIGINT) AS range_id, round(coalesce(mn, 0.0), 9)::DOUBLE AS min, round(coalesce(mx, 0.0), 9)::DOUBLE AS max, round(coalesce(rms, 0.0), 9)::DOUBLE AS rms FROM q LEFT JOIN b USING (track_id, range_id)""",
)
def agg02(spark, sf_dir):
    pk = peaks.compute_peaks(samples(spark, sf_dir), BUCKET)
    n = F.col("range_id")
    ranges = pk.select("track_id", F.floor(F.col("bucket") / 7).alias("range_id")).distinct()
    ranges = ranges.withColumns({"start_us": n * 130 * HOUR - 2 * HOUR, "end_us": n * 130 * HOUR + 90 * HOUR})
    out = peaks.peaks_in_ranges(pk, ranges, BUCKET_US)
    return rounded(out.select("track_id", "range_id", "min", "max", "rms"), "min", "max", "rms")


@query(
    "agg03_decimate",
    f"""WITH {PEAKS.replace("pk AS (", "pk AS MATERIALIZED (")}, w AS MATERIALIZED (SELECT track_id, (max(bucket) + 1) * {BUCKET_US} AS len FROM pk GROUP BY track_id),
    q AS (SELECT track_id, p AS pixel, p * (len / 64::DOUBLE) AS s, (p + 1) * (len / 64::DOUBLE) AS e FROM w, range(0, 64) t(p)),
    qb AS MATERIALIZED (SELECT track_id, pixel, unnest(range(CAST(floor(s / {BUCKET_US}::DOUBLE) AS BIGINT), CAST(ceil(e / {BUCKET_US}::DOUBLE) AS BIGINT) + 1)) AS bucket FROM q),
    b AS (SELECT track_id, pixel, min(mn) AS mn, max(mx) AS mx, avg(rms) AS rms FROM qb JOIN pk USING (track_id, bucket) GROUP BY ALL)
    SELECT q.track_id, pixel, round(coalesce(mn, 0.0), 9)::DOUBLE AS min, round(coalesce(mx, 0.0), 9)::DOUBLE AS max, round(coalesce(rms, 0.0), 9)::DOUBLE AS rms FROM q LEFT JOIN b USING (track_id, pixel)""",
)
def agg03(spark, sf_dir):
    pk = peaks.compute_peaks(samples(spark, sf_dir), BUCKET)
    windows = pk.groupBy("track_id").agg(F.lit(0).cast("long").alias("start_us"), ((F.max("bucket") + 1) * BUCKET_US).alias("end_us"))
    return rounded(peaks.decimate(pk, windows, 64, BUCKET_US), "min", "max", "rms")


@query(
    "tim13_silence_runs",
    f"""WITH {PEAKS}, t AS (SELECT *, max(greatest(abs(mn), abs(mx))) OVER (PARTITION BY track_id) AS peak FROM pk),
    q AS (SELECT track_id, bucket, bucket - row_number() OVER (PARTITION BY track_id ORDER BY bucket) AS i FROM t WHERE rms < greatest(0.004, peak * 0.035))
    SELECT track_id, CAST(min(bucket) * {BUCKET_US} AS BIGINT) AS start_us, CAST((max(bucket) + 1) * {BUCKET_US} AS BIGINT) AS end_us FROM q GROUP BY track_id, i
    HAVING (max(bucket) + 1 - min(bucket)) * {BUCKET_US} >= {12 * HOUR}""",
)
def tim13(spark, sf_dir):
    return peaks.silence_runs(peaks.compute_peaks(samples(spark, sf_dir), BUCKET), BUCKET_US, 12 * HOUR)


@query("agg06_band_means", f"WITH {SIGNAL} SELECT track_id, band, round(avg(value), 6) AS mean FROM signal GROUP BY ALL")
def agg06(spark, sf_dir):
    return rounded(peaks.band_means(A.signal(spark, sf_dir)), "mean", digits=6)


@query(
    "sig03_vocal_activity",
    f"""WITH {SIGNAL}, r AS (SELECT frame, CASE WHEN sum(value) > 0 THEN sum(CASE WHEN band IN ('click', 'view') THEN value ELSE 0 END) / sum(value) ELSE 0 END AS raw FROM signal GROUP BY frame)
    SELECT CAST(0 AS BIGINT) AS track_id, frame, round(avg(raw) OVER (ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS vocal FROM r""",
)
def sig03(spark, sf_dir):
    out = peaks.vocal_activity(A.signal(spark, sf_dir), F.col("band").isin("click", "view"))
    return rounded(out.select("track_id", "frame", "vocal"), "vocal")


ONSET = f"""{SIGNAL},
ons AS (SELECT frame, round(sum(greatest(0, coalesce(d, 0))), 9) AS onset FROM (SELECT frame, value - lag(value) OVER (PARTITION BY band ORDER BY frame) AS d FROM signal) GROUP BY frame),
res AS (SELECT *, greatest(0, onset - avg(onset) OVER (ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) * 0.9::DOUBLE) AS residual FROM ons),
pks AS (SELECT *, CASE WHEN residual > 0 AND residual >= max(residual) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN residual ELSE 0 END AS peak FROM res),
smo AS (SELECT *, avg(peak) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM pks),
prep AS (SELECT *, smooth / max(smooth) OVER () AS x FROM smo)"""
TID = "CAST(0 AS BIGINT) AS track_id"


def onsets(spark, sf_dir):
    return rhythm.onset_envelope(A.signal(spark, sf_dir))


@query("sig04_onset_envelope", f"WITH {ONSET} SELECT {TID}, frame, onset FROM ons")
def sig04(spark, sf_dir):
    return onsets(spark, sf_dir)


@query("sig05_adaptive_threshold", f"WITH {ONSET} SELECT {TID}, frame, round(residual, 6) AS residual FROM res")
def sig05(spark, sf_dir):
    out = sliding(onsets(spark, sf_dir), ["track_id"], "frame", 4, {"residual": rhythm.adaptive_residual})
    return rounded(out.drop("onset"), "residual", digits=6)


@query("sig06_non_maximum_suppression", f"WITH {ONSET} SELECT {TID}, frame, round(peak, 6) AS peak FROM pks")
def sig06(spark, sf_dir):
    steps = ({"residual": rhythm.adaptive_residual}, {"peak": rhythm.local_peaks})
    out = sliding(onsets(spark, sf_dir), ["track_id"], "frame", 6, *steps)
    return rounded(out.select("track_id", "frame", "peak"), "peak", digits=6)


@query("sig07_smooth_and_scale", f"WITH {ONSET} SELECT {TID}, frame, round(x, 9) AS x FROM prep")
def sig07(spark, sf_dir):
    return rounded(rhythm.prepare_onsets(onsets(spark, sf_dir)).select("track_id", "frame", "x"), "x")


_LO, _HI = rhythm.lag_range(FRAME_US)
_SEC = f"({FRAME_US} / 1e6::DOUBLE)"
TEMPO = f"""{ONSET}, lags AS (SELECT unnest(range({_LO}, {_HI + 1})) AS lag),
ac AS (SELECT lag, sum(a.x * b.x) / count(*) AS product FROM lags JOIN prep a ON true JOIN prep b ON b.frame = a.frame + lag GROUP BY lag),
sc AS (SELECT lag, round(product * exp(-0.5 * pow(log2(60.0 / (lag * {_SEC}) / 120) / 0.9, 2)), 12) AS score FROM ac),
best AS (SELECT lag, score FROM sc ORDER BY score DESC, lag LIMIT 1),
tempo AS (SELECT round(60.0::DOUBLE / (lag * {_SEC}), 1) AS bpm, greatest(0.0, least(1.0, score * 4)) AS confidence FROM best),
g0 AS (SELECT bpm, confidence, CAST(greatest(1, floor(60.0::DOUBLE / bpm / {_SEC} + 0.5)) AS BIGINT) AS lag FROM tempo),
ph AS (SELECT frame % lag AS phase, round(sum(onset), 6) AS s FROM ons, g0 GROUP BY 1),
grid AS (SELECT bpm, confidence, phase, lag * {FRAME_US} AS interval_us, phase * {FRAME_US} AS first_us, (SELECT (max(frame) + 1) * {FRAME_US} FROM ons) AS total_us
   FROM g0, (SELECT phase FROM ph ORDER BY s DESC, phase LIMIT 1))"""


@query("sig08_tempo", f"WITH {TEMPO} SELECT {TID}, bpm, round(confidence, 9)::DOUBLE AS confidence FROM tempo")
def sig08(spark, sf_dir):
    out = rhythm.estimate_tempo(rhythm.prepare_onsets(onsets(spark, sf_dir)), FRAME_US)
    return rounded(out, "confidence")


@query("sig08_lag_products", f"WITH {TEMPO} SELECT {TID}, CAST(lag AS INTEGER) AS lag, round(product, 9) AS product FROM ac")
def sig08_lags(spark, sf_dir):
    out = rhythm.lag_products(rhythm.prepare_onsets(onsets(spark, sf_dir)), FRAME_US)
    return rounded(out.select("track_id", "lag", "product"), "product")


def grid_of(spark, sf_dir):
    on = onsets(spark, sf_dir)
    return rhythm.beat_grid(on, rhythm.estimate_tempo(rhythm.prepare_onsets(on), FRAME_US), FRAME_US)


@query("sig09_phase", f"WITH {TEMPO} SELECT {TID}, CAST(phase AS BIGINT) AS phase, CAST(interval_us AS BIGINT) AS interval_us FROM grid")
def sig09(spark, sf_dir):
    return grid_of(spark, sf_dir).select("track_id", "phase", "interval_us")


@query(
    "sig10_beat_grid",
    f"WITH {TEMPO} SELECT {TID}, row_number() OVER (ORDER BY b) - 1 AS beat_idx, b AS beat_us FROM (SELECT unnest(range(CAST(first_us AS BIGINT), CAST(total_us AS BIGINT), CAST(interval_us AS BIGINT))) AS b FROM grid)",
)
def sig10(spark, sf_dir):
    return rhythm.beats(grid_of(spark, sf_dir))


@query(
    "sig11_beat_strength",
    f"""WITH {TEMPO}, p AS (SELECT event_id, event_id * 1613 AS t FROM events), k AS (SELECT p.*, g.*, {rnd("(t - first_us) / interval_us::DOUBLE")} AS i, CAST(ceil((total_us - first_us) / interval_us::DOUBLE) AS BIGINT) AS n FROM p, grid g),
    c AS (SELECT event_id, list_filter([i, i - 1, i + 1], lambda j: j >= 0 AND j < n AND abs(first_us + j * interval_us - t) <= 90000)[1] AS j FROM k)
    SELECT event_id, CASE WHEN j IS NULL THEN 0.0 WHEN j % 4 = 0 THEN 1.0 WHEN j % 2 = 0 THEN 0.6 ELSE 0.35 END::DOUBLE AS strength FROM c""",
)
def sig11(spark, sf_dir):
    points = A.table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") - F.col("event_id")).alias("track_id"), (F.col("event_id") * 1613).alias("t_us")
    )
    return rhythm.beat_strength(points, grid_of(spark, sf_dir), 90_000).select("event_id", "strength")


@query(
    "sig12_energy_at",
    f"""WITH {SIGNAL}, m AS (SELECT band, avg(value) AS mean FROM signal GROUP BY band), p AS (SELECT event_id, event_type AS band, event_id * 1700 - 50000 AS t FROM events)
    SELECT event_id, round(coalesce(s.value, 0.0), 6)::DOUBLE AS value, round(least(1.6, coalesce(s.value, 0.0) / greatest(8, m.mean)), 9)::DOUBLE AS energy FROM p LEFT JOIN signal s
    ON s.band = p.band AND s.frame = CAST(floor(t / {FRAME_US}::DOUBLE) AS BIGINT) LEFT JOIN m ON m.band = p.band""",
)
def sig12(spark, sf_dir):
    spectrum = A.signal(spark, sf_dir)
    points = A.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("band"), (F.col("event_id") - F.col("event_id")).alias("track_id"), (F.col("event_id") * 1700 - 50_000).alias("t_us")
    )
    out = peaks.energy_at(points, spectrum, peaks.band_means(spectrum), FRAME_US)
    return rounded(rounded(out.select("event_id", "value", "energy"), "value", digits=6), "energy")


ANCHORS = f"""{ONSET},
voc AS (SELECT frame, avg(raw) OVER (ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS vocal FROM
   (SELECT frame, CASE WHEN sum(value) > 0 THEN sum(CASE WHEN band IN ('click', 'view') THEN value ELSE 0 END) / sum(value) ELSE 0 END AS raw FROM signal GROUP BY frame)),
loc AS (SELECT frame, x, row_number() OVER (ORDER BY frame) AS rn FROM (SELECT frame, x, lag(x) OVER (ORDER BY frame) AS p, lead(x) OVER (ORDER BY frame) AS n FROM prep)
   WHERE x >= 0.16 AND x >= p AND x >= n),
gr AS (SELECT rn, frame, x, frame AS kept, true AS keep FROM loc WHERE rn = 1
  UNION ALL SELECT l.rn, l.frame, l.x, CASE WHEN l.frame - g.kept >= 15 THEN l.frame ELSE g.kept END, l.frame - g.kept >= 15 FROM gr g JOIN loc l ON l.rn = g.rn + 1),
anc AS (SELECT {TID}, gr.frame, gr.frame * {FRAME_US} AS time_us, least(1.0, 0.62 * x + 0.38 * coalesce(vocal, 0.5)) AS strength FROM gr LEFT JOIN voc USING (frame) WHERE keep)"""


def anchors(spark, sf_dir):
    spectrum = A.signal(spark, sf_dir)
    vocal = peaks.vocal_activity(spectrum, F.col("band").isin("click", "view"))
    return rhythm.onset_anchors(rhythm.prepare_onsets(rhythm.onset_envelope(spectrum)), vocal, FRAME_US)


@query("sig13_onset_anchors", f"WITH RECURSIVE {ANCHORS} SELECT track_id, frame, time_us, round(strength, 9)::DOUBLE AS strength FROM anc")
def sig13(spark, sf_dir):
    return rounded(anchors(spark, sf_dir), "strength")


@query(
    "sig16_strongest_anchors",
    f"WITH RECURSIVE {ANCHORS} SELECT track_id, frame, time_us, round(strength, 9)::DOUBLE AS strength FROM anc ORDER BY strength DESC, frame LIMIT 24",
)
def sig16(spark, sf_dir):
    kept = top_k(anchors(spark, sf_dir), ["track_id"], [F.col("strength").desc(), F.col("frame")], 24)
    return rounded(kept, "strength")


@query(
    "sig16_newest_per_key",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS n FROM orders QUALIFY n <= 3",
)
def sig16_newest(spark, sf_dir):
    from pyspark.sql.window import Window as W

    newest = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    orders = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = orders.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= 3)
    return ranked.select("o_custkey", "o_orderkey", F.col("n").cast("long").alias("n"))


BLANK = 0
VOCAB = "CASE WHEN token % 8 = 1 THEN '|' WHEN token % 16 = 3 THEN '' ELSE chr(CAST(97 + token % 26 AS INTEGER)) END"


def logits(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("long").alias("track_id"), F.col("vec_id").alias("frame"), F.col("embedding").alias("scores")
    )


CTC_SQL = f"""b AS (SELECT vec_id AS frame, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings),
tok AS (SELECT frame, CAST(token AS BIGINT) AS token FROM (SELECT *, lag(token, 1, {BLANK}) OVER (ORDER BY frame) AS p FROM b) WHERE token <> {BLANK} AND token <> p)"""


@query("sig14_ctc_decode", f"WITH {CTC_SQL} SELECT {TID}, frame, token FROM tok")
def sig14(spark, sf_dir):
    return ctc.greedy_decode(logits(spark, sf_dir), BLANK).select("track_id", "frame", "token")


@query(
    "sig15_ctc_words",
    f"""WITH {CTC_SQL}, c AS (SELECT *, {VOCAB} AS ch FROM tok), w AS (SELECT *, sum(CASE WHEN ch = '|' THEN 1 ELSE 0 END) OVER (ORDER BY frame) AS g FROM c),
    o AS (SELECT g, string_agg(CASE WHEN ch <> '|' THEN ch END, '' ORDER BY frame) AS text, min(frame) AS f0, max(frame) AS f1 FROM w GROUP BY g)
    SELECT {TID}, CAST(g AS BIGINT) AS word_idx, text, f0 * 20000 AS start_us, (f1 + 1) * 20000 AS end_us FROM o WHERE text <> ''""",
)
def sig15(spark, sf_dir):
    token = F.col("token")
    char = F.when(token % 8 == 1, "|").when(token % 16 == 3, "").otherwise(F.chr(97 + token % 26))
    words = ctc.assemble_words(ctc.greedy_decode(logits(spark, sf_dir), BLANK), char, 20_000)
    return words.drop("confidence")


HOP, LENGTH = 7 * HOUR, 8 * HOUR


def window_words(spark, sf_dir):
    """Each span as a word of every overlapping eight-hour window that covers its start."""
    rel = A.spans(spark, sf_dir).select(
        "track_id", F.col("cue_id").alias("idx"), F.col("event_type").alias("text"), (F.col("start_us") - F.lit(T0)).alias("start_us")
    )
    last = F.floor(F.col("start_us") / HOP)
    first = F.greatest(F.lit(0), F.ceil((F.col("start_us") - LENGTH + 1) / HOP))
    windows = rel.withColumn("k", F.explode(F.sequence(first, last)))
    return windows.withColumn("window_start_us", F.col("k") * HOP).drop("k")


WINDOWS = f"""{SPANS}, rel AS (SELECT track_id, cue_id AS idx, event_type AS text, start_us - {T0} AS start_us FROM spans),
ww AS (SELECT r.*, k * {HOP} AS window_start_us FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((start_us - {LENGTH} + 1) / {HOP}::DOUBLE)) AS BIGINT), CAST(start_us // {HOP} AS BIGINT) + 1)) AS k FROM rel) r),
st AS (SELECT * FROM (SELECT *, max(window_start_us) OVER (PARTITION BY track_id) AS tail FROM ww) WHERE start_us < window_start_us + {HOP} OR window_start_us = tail)"""


@query("agg13_stitch_windows", f"WITH {WINDOWS} SELECT track_id, idx, text, start_us, window_start_us FROM st")
def agg13(spark, sf_dir):
    return ctc.stitch_windows(window_words(spark, sf_dir), HOP).select("track_id", "idx", "text", "start_us", "window_start_us")


@query(
    "agg11_distinct_words",
    f"WITH {WINDOWS} SELECT track_id, idx, text, start_us FROM st QUALIFY row_number() OVER (PARTITION BY track_id, lower(text), start_us // {HOUR} ORDER BY start_us, idx) = 1",
)
def agg11(spark, sf_dir):
    stitched = ctc.stitch_windows(window_words(spark, sf_dir), HOP)
    return ctc.distinct_words(stitched, HOUR).select("track_id", "idx", "text", "start_us")


@query(
    "seq01_debounce",
    f"""WITH RECURSIVE {TAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY time_us, tap_id) AS rn FROM taps),
    r AS (SELECT track_id, tap_id, rn, time_us AS kept, true AS keep FROM o WHERE rn = 1
      UNION ALL SELECT o.track_id, o.tap_id, o.rn, CASE WHEN o.time_us - r.kept >= {40 * HOUR} THEN o.time_us ELSE r.kept END, o.time_us - r.kept >= {40 * HOUR} FROM r JOIN o ON o.track_id = r.track_id AND o.rn = r.rn + 1)
    SELECT track_id, tap_id FROM r WHERE keep""",
)
def seq01(spark, sf_dir):
    taps = A.taps(spark, sf_dir)
    return debounce.debounce(taps, ["track_id"], "time_us", "tap_id", 40 * HOUR).select("track_id", "tap_id")
