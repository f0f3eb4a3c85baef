"""Post-processing of event spans (v_spans), with thresholds scaled to that data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import TRACKS
from cuestream.operators import postprocess as P

MINUTE = 60_000_000
GAP, MIN_LINE, IDLE, LEAD = 10 * MINUTE, 30 * MINUTE, 1440 * MINUTE, 5 * MINUTE
OPTIONS = P.PostProcessOptions(
    min_line_us=MIN_LINE, apply_lead_in=True, lead_in_us=LEAD, gap_fill_us=GAP, idle_min_us=IDLE
)
OUT = ["track_id", "cue_id", "start_us", "end_us"]


def tracks_of(spans):
    return spans.groupBy("track_id").agg((F.max("start_us") + A.HOUR_US).alias("duration_us"))


def timed(spark, sf_dir):
    """Spans with their track's duration; every fourth event plays a locked cue."""
    spans = A.spans(spark, sf_dir).withColumn("locked", F.col("event_type") == "signup")
    return spans.join(tracks_of(spans), "track_id")


TIMED = TRACKS + """,
timed AS (SELECT s.*, event_type = 'signup' AS locked, duration_us FROM spans s JOIN tracks USING (track_id))"""


def _clamp(src: str, dst: str) -> str:
    return f"""
{dst} AS (SELECT * REPLACE (greatest(start_us, 0) AS start_us,
    greatest(greatest(start_us, 0), least(end_us, duration_us)) AS end_us) FROM {src})"""


def _minimum(src: str, dst: str) -> str:
    return f"""
{dst} AS (SELECT * REPLACE (CASE WHEN end_us - start_us < {MIN_LINE} THEN start_us + {MIN_LINE} ELSE end_us END AS end_us) FROM {src})"""


def _overlap(src: str, dst: str) -> str:
    return f"""
{dst}_p AS (SELECT *, greatest(0, coalesce(max(end_us) OVER (PARTITION BY track_id ORDER BY start_us, cue_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pe FROM {src}),
{dst}_m AS (SELECT * EXCLUDE (pe) REPLACE (CASE WHEN start_us < pe THEN least(pe, end_us) ELSE start_us END AS start_us) FROM {dst}_p),""" + _clamp(
        f"{dst}_m", dst
    )


def _lead(src: str, dst: str, order: str) -> str:
    return f"""
{dst} AS (SELECT * REPLACE (CASE WHEN locked THEN start_us ELSE
    greatest(coalesce(lag(end_us) OVER (PARTITION BY track_id ORDER BY {order}), 0), start_us - {LEAD}) END AS start_us) FROM {src})"""


def _fill(src: str, dst: str) -> str:
    return f"""
{dst}_n AS (SELECT *, lead(start_us) OVER (PARTITION BY track_id ORDER BY start_us, cue_id) AS ns FROM {src}),
{dst} AS (SELECT * EXCLUDE (ns) REPLACE (CASE WHEN NOT locked AND ns > end_us AND ns - end_us <= {GAP} THEN ns ELSE end_us END AS end_us) FROM {dst}_n)"""


PICK = " SELECT track_id, cue_id, start_us, end_us FROM "


@query("tim05_sort", f"WITH {TIMED}{PICK} timed ORDER BY track_id, start_us, cue_id")
def tim05(spark, sf_dir):
    return P.sort_cues(A.spans(spark, sf_dir)).select(*OUT)


@query("tim06_clamp", f"WITH {TIMED},{_clamp('timed', 'c')}{PICK} c")
def tim06(spark, sf_dir):
    return P.clamp_timings(timed(spark, sf_dir), F.col("duration_us")).select(*OUT)


@query("tim07_minimum_duration", f"WITH {TIMED},{_minimum('timed', 'm')}{PICK} m")
def tim07(spark, sf_dir):
    return P.enforce_minimum_duration(A.spans(spark, sf_dir), MIN_LINE).select(*OUT)


@query("tim08_lead_in", f"WITH {TIMED},{_lead('timed', 'l', 'start_us, cue_id')}{PICK} l")
def tim08(spark, sf_dir):
    spans = A.spans(spark, sf_dir).withColumn("locked", F.col("event_type") == "signup")
    return P.apply_lead_in(spans, LEAD).select(*OUT)


@query("tim09_fill_gaps", f"WITH {TIMED},{_fill('timed', 'f')}{PICK} f")
def tim09(spark, sf_dir):
    spans = A.spans(spark, sf_dir).withColumn("locked", F.col("event_type") == "signup")
    return P.fill_gaps(spans, GAP).select(*OUT)


@query("tim10_resolve_overlaps", f"WITH {TIMED},{_overlap('timed', 'o')}{PICK} o")
def tim10(spark, sf_dir):
    return P.resolve_overlaps(timed(spark, sf_dir), F.col("duration_us")).select(*OUT)


IDLE_SQL = f"""WITH {TIMED},
cur AS (SELECT track_id, start_us, greatest(0, coalesce(max(end_us) OVER (PARTITION BY track_id ORDER BY start_us, cue_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM timed WHERE end_us > start_us),
reg AS (SELECT track_id, cursor AS start_us, start_us AS end_us FROM cur
  UNION ALL SELECT t.track_id, coalesce(m.last, 0), t.duration_us FROM tracks t LEFT JOIN
    (SELECT track_id, max(end_us) AS last FROM spans WHERE end_us > start_us GROUP BY track_id) m USING (track_id))
SELECT * FROM reg WHERE end_us - start_us >= {IDLE}"""


@query("tim12_idle_regions", IDLE_SQL)
def tim12(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    return P.idle_regions(spans, tracks_of(spans), IDLE)


CHAIN = (
    TIMED
    + ", t0 AS (SELECT *, start_us AS s0 FROM timed),"
    + _clamp("t0", "c1")
    + ","
    + _minimum("c1", "m1")
    + ","
    + _overlap("m1", "o1")
    + ","
    + _lead("o1", "l1", "s0, cue_id")
    + ","
    + _fill("l1", "f1")
    + ","
    + _overlap("f1", "o2")
)


@query("tim14_post_process", f"WITH {CHAIN}{PICK} o2")
def tim14(spark, sf_dir):
    return P.post_process(timed(spark, sf_dir), OPTIONS, F.col("duration_us")).select(*OUT)


@query(
    "dq09_timing_audit",
    f"""WITH {CHAIN}, a AS (SELECT *, max(end_us) OVER (PARTITION BY track_id ORDER BY start_us, cue_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o2)
    SELECT track_id, count(*) AS n_cues, count(*) FILTER (end_us < start_us) AS n_inverted,
      count(*) FILTER (start_us < pe) AS n_overlapping, count(*) FILTER (end_us - start_us < {MIN_LINE}) AS n_short,
      count(*) FILTER (start_us < 0 OR end_us > duration_us) AS n_outside
    FROM a GROUP BY track_id""",
)
def dq09(spark, sf_dir):
    cues = timed(spark, sf_dir)
    hot = P.has_hot_group(cues, P.KEYS)
    clean = P.post_process(cues, OPTIONS, F.col("duration_us"), hot)
    return P.timing_audit(clean, F.col("duration_us"), MIN_LINE, hot)


SNAP_TOL = 30 * MINUTE
SNAP_SQL = f"""WITH words AS (
  SELECT user_id AS track_id, epoch_us(ts) // 86400000000 AS cue_id, event_id AS word_idx, epoch_us(ts) AS start_us,
    epoch_us(ts) + CAST(floor(value * 6e7 + 0.5) AS BIGINT) AS end_us FROM events WHERE event_type = 'click'),
beats AS (SELECT user_id AS track_id, epoch_us(ts) AS beat_us FROM events WHERE event_type = 'view'),
b AS (SELECT w.*, x.beat_us AS b FROM words w ASOF LEFT JOIN beats x ON w.track_id = x.track_id AND w.start_us >= x.beat_us),
n AS (SELECT b.*, x.beat_us AS a FROM b ASOF LEFT JOIN beats x ON b.track_id = x.track_id AND b.start_us < x.beat_us),
s AS (SELECT *, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN start_us - b <= a - start_us THEN b ELSE a END AS near FROM n),
h AS (SELECT *, CASE WHEN abs(near - start_us) <= {SNAP_TOL} THEN near ELSE start_us END AS s FROM s),
r AS (SELECT *, max(greatest(s, end_us)) OVER (PARTITION BY track_id, cue_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
   bool_or(s <> start_us) OVER (PARTITION BY track_id, cue_id) AS moved FROM h)
SELECT track_id, CAST(cue_id AS BIGINT) AS cue_id, word_idx, CASE WHEN moved THEN greatest(s, coalesce(pe, -1)) ELSE start_us END AS start_us,
   CASE WHEN moved THEN greatest(end_us, s, coalesce(pe, -1)) ELSE end_us END AS end_us FROM r"""


def click_words(spark, sf_dir):
    return A.spans(spark, sf_dir).filter(F.col("event_type") == "click").select(
        "track_id",
        F.floor(F.col("start_us") / 86_400_000_000).alias("cue_id"),
        F.col("cue_id").alias("word_idx"),
        "start_us",
        "end_us",
    )


def view_beats(spark, sf_dir):
    views = A.spans(spark, sf_dir).filter(F.col("event_type") == "view")
    return views.select("track_id", F.col("start_us").alias("beat_us"))


@query("tim11_snap_to_beats", SNAP_SQL)
def tim11(spark, sf_dir):
    return P.snap_words_to_beats(click_words(spark, sf_dir), view_beats(spark, sf_dir), SNAP_TOL)
