"""Estimated and measured timelines over document lines, dialogue and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import DIALOGUE, DOC_LINES, SPANS, TAPS, rnd, sig
from cuestream.catalog.text import n_words, reading_sql, weight_sql
from cuestream.catalog.timing import view_beats
from cuestream.functions import text as X
from cuestream.operators import edits as ED
from cuestream.operators import estimate as E
from cuestream.operators import taps as TP
from cuestream.plans.session import cut_lineage

TOK = "[^\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+"


def lines_with_locks(spark, sf_dir):
    """Document lines as untimed cues; every seventh line is a locked human cue."""
    return A.doc_lines(spark, sf_dir).withColumns(
        {
            "cue_id": F.col("seq"),
            "locked": F.col("seq") % 7 == 3,
            "start_us": F.col("seq") * 1_000_000,
            "end_us": F.col("seq") * 1_000_000 + 500_000,
            "source": F.when(F.col("seq") % 7 == 3, "human").otherwise("estimate"),
            "confidence": F.lit(1.0),
        }
    )


EST = f"""{DOC_LINES},
w AS (SELECT *, seq % 7 = 3 AS keep, {weight_sql("sg")} AS w FROM (SELECT *, {sig("text")} AS sg FROM doc_lines)),
t AS (SELECT *, sum(w) OVER (PARTITION BY track_id) AS tw, count(*) OVER (PARTITION BY track_id) AS n FROM w),
u AS (SELECT *, greatest(900000, n * 3000000 - 400000 - 250000 * (n - 1)) AS usable FROM t),
s AS (SELECT *, greatest(900000, {rnd("usable * w / tw::DOUBLE")}) AS share FROM u),
c AS (SELECT *, 400000 + coalesce(sum(CASE WHEN NOT keep THEN share + 250000 END) OVER (PARTITION BY track_id ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s),
est AS (SELECT track_id, seq AS cue_id, seq, text, keep, CAST(CASE WHEN keep THEN seq * 1000000 ELSE pos END AS BIGINT) AS start_us,
   CAST(CASE WHEN keep THEN seq * 1000000 + 500000 ELSE pos + share END AS BIGINT) AS end_us FROM c)"""


@query("tim01_estimate_lines", f"WITH {EST} SELECT track_id, seq, start_us, end_us FROM est")
def tim01(spark, sf_dir):
    timed = E.estimate_line_timings(lines_with_locks(spark, sf_dir), hot=False)
    return timed.select("track_id", "seq", "start_us", "end_us")


def words_sql(src: str, dst: str, size: str = "length_grapheme") -> str:
    return f"""
{dst}_t AS MATERIALIZED (SELECT track_id, cue_id, start_us AS c0, end_us AS c1, tk, i FROM
   (SELECT *, unnest(tks) AS tk, unnest(range(0, len(tks))) AS i FROM (SELECT *, regexp_extract_all(text, '{TOK}') AS tks FROM {src}))),
{dst}_w AS MATERIALIZED (SELECT *, greatest(1, {size}(tk)) AS w, sum(greatest(1, {size}(tk))) OVER (PARTITION BY track_id, cue_id) AS tw,
   count(*) OVER (PARTITION BY track_id, cue_id) AS n FROM {dst}_t),
{dst}_s AS (SELECT *, {rnd("greatest(0, c1 - c0) * w / tw::DOUBLE")} AS share FROM {dst}_w),
{dst}_a AS (SELECT *, c0 + coalesce(sum(share) OVER (PARTITION BY track_id, cue_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {dst}_s),
{dst} AS (SELECT track_id, cue_id, CAST(i AS BIGINT) AS word_idx, tk AS text, CAST(s AS BIGINT) AS start_us,
   CAST(greatest(CASE WHEN i = n - 1 THEN c1 ELSE s + share END, s) AS BIGINT) AS end_us FROM {dst}_a)"""


@query("tim02_interpolate_words", f"WITH {EST}, {words_sql('est', 'wd')} SELECT * FROM wd")
def tim02(spark, sf_dir):
    timed = E.estimate_line_timings(lines_with_locks(spark, sf_dir), hot=False)
    return E.interpolate_words(timed)


def half_words(spark, sf_dir, broken=False):
    """Estimated cues plus stored words for even cues, some of them no longer fitting."""
    timed = E.estimate_line_timings(A.doc_lines(spark, sf_dir).withColumn("cue_id", F.col("seq")), hot=False)
    # read as the cues and for their words
    timed = cut_lineage(timed.select("track_id", "cue_id", "text", "start_us", "end_us"))
    words = E.interpolate_words(timed.filter(F.col("cue_id") % 2 == 0))
    source = F.when(F.col("cue_id") % 4 == 0, "asr").when(F.col("cue_id") % 6 == 0, "human").otherwise("estimate")
    words = words.withColumn("source", source)
    shift = F.when(F.col("cue_id") % 8 == 0, 40_000_000).otherwise(0)
    return timed, words.withColumns({"start_us": F.col("start_us") + shift, "end_us": F.col("end_us") + shift})


EST_FREE = EST.replace("seq % 7 = 3 AS keep", "false AS keep")
HALF = f"""{EST_FREE.replace("est AS (", "est AS MATERIALIZED (")}, even AS MATERIALIZED (SELECT * FROM est WHERE cue_id % 2 = 0), {words_sql("even", "ew")},
stored AS MATERIALIZED (SELECT * REPLACE (start_us + CASE WHEN cue_id % 8 = 0 THEN 40000000 ELSE 0 END AS start_us,
   end_us + CASE WHEN cue_id % 8 = 0 THEN 40000000 ELSE 0 END AS end_us) FROM ew)"""


@query(
    "tim03_refresh_words",
    f"""WITH {HALF}, rest AS (SELECT * FROM est WHERE NOT (cue_id % 4 = 0 OR cue_id % 6 = 0)), {words_sql("rest", "rw")}
    SELECT * FROM rw UNION ALL SELECT * FROM stored WHERE cue_id % 4 = 0 OR cue_id % 6 = 0""",
)
def tim03(spark, sf_dir):
    return E.refresh_words(*half_words(spark, sf_dir))


@query(
    "tim04_usable_words",
    f"""WITH {HALF}, o AS (SELECT s.*, e.start_us AS c0, e.end_us AS c1, e.text AS ct, lag(s.start_us) OVER (PARTITION BY track_id, cue_id ORDER BY word_idx) AS ps
      FROM stored s JOIN est e USING (track_id, cue_id)),
    g AS MATERIALIZED (SELECT track_id, cue_id FROM o GROUP BY ALL HAVING count(*) = len(regexp_extract_all(any_value(ct), '{TOK}')) AND
      bool_and(start_us >= c0 - 1 AND end_us <= c1 + 1 AND end_us >= start_us AND (ps IS NULL OR start_us >= ps - 1) AND (ps IS NOT NULL OR end_us > start_us))),
    rest AS MATERIALIZED (SELECT * FROM est ANTI JOIN g USING (track_id, cue_id)), {words_sql("rest", "rw", "length")}
    SELECT *, false AS stored FROM rw UNION ALL SELECT *, true FROM stored SEMI JOIN g USING (track_id, cue_id)""",
)
def tim04(spark, sf_dir):
    return E.usable_words(*half_words(spark, sf_dir))


SEQ_SQL = f"""WITH RECURSIVE {DIALOGUE},
s AS (SELECT track_id, seq, {reading_sql("text")} AS dur, seq % 5 = 4 AS locked, seq * 4000000 AS ls, seq * 4000000 + 9000000 AS le,
   row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM dialogue),
r AS (SELECT track_id, seq, rn, CAST(CASE WHEN locked THEN ls ELSE 150000 END AS BIGINT) AS start_us, CAST(CASE WHEN locked THEN le ELSE 150000 + dur END AS BIGINT) AS end_us,
   CAST(CASE WHEN locked THEN greatest(150000, le + 300000) ELSE 150000 + dur + 300000 END AS BIGINT) AS cur FROM s WHERE rn = 1
 UNION ALL SELECT s.track_id, s.seq, s.rn, CASE WHEN s.locked THEN s.ls ELSE r.cur END, CASE WHEN s.locked THEN s.le ELSE r.cur + s.dur END,
   CASE WHEN s.locked THEN greatest(r.cur, s.le + 300000) ELSE r.cur + s.dur + 300000 END FROM r JOIN s ON s.track_id = r.track_id AND s.rn = r.rn + 1)
SELECT track_id, seq, start_us, end_us FROM r"""


@query("tim15_sequential_scenes", SEQ_SQL)
def tim15(spark, sf_dir):
    scenes = A.dialogue(spark, sf_dir).withColumns(
        {
            "locked": F.col("seq") % 5 == 4,
            "start_us": F.col("seq") * 4_000_000,
            "end_us": F.col("seq") * 4_000_000 + 9_000_000,
        }
    )
    return E.time_scenes_sequentially(scenes, X.reading_time_us("text")).select("track_id", "seq", "start_us", "end_us")


def anchored_scenes(spark, sf_dir):
    n = F.col("seq")
    return A.dialogue(spark, sf_dir).withColumns(
        {
            "at_us": F.when(n % 6 == 3, n * 9_000_000),
            "until_us": F.when(n % 4 == 1, n * 7_000_000),
            "length_us": F.when(n % 5 == 2, F.lit(100_000).cast("long")),
            "pause_after_us": F.when(n % 3 == 0, F.lit(1_000_000).cast("long")),
        }
    )


ANCHOR_CTE = f"""{DIALOGUE},
sc AS (SELECT *, CASE WHEN seq % 6 = 3 THEN seq * 9000000 END AS at_us, CASE WHEN seq % 4 = 1 THEN seq * 7000000 END AS until_us,
   CASE WHEN seq % 5 = 2 THEN 100000 ELSE {reading_sql("text")} END AS len, CASE WHEN seq % 3 = 0 THEN 1000000 ELSE 250000 END AS pause,
   row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM dialogue),
anch AS (SELECT track_id, seq, rn, CAST(coalesce(at_us, 0) AS BIGINT) AS start_us,
    CAST(greatest(coalesce(at_us, 0) + 200000, coalesce(until_us, coalesce(at_us, 0) + len)) AS BIGINT) AS end_us, pause FROM sc WHERE rn = 1
  UNION ALL SELECT s.track_id, s.seq, s.rn, CAST(coalesce(s.at_us, r.end_us + r.pause) AS BIGINT),
    CAST(greatest(coalesce(s.at_us, r.end_us + r.pause) + 200000, coalesce(s.until_us, coalesce(s.at_us, r.end_us + r.pause) + s.len)) AS BIGINT), s.pause
  FROM anch r JOIN sc s ON s.track_id = r.track_id AND s.rn = r.rn + 1)"""


@query("tim16_anchored_scenes", f"WITH RECURSIVE {ANCHOR_CTE} SELECT track_id, seq, start_us, end_us FROM anch")
def tim16(spark, sf_dir):
    scenes = anchored_scenes(spark, sf_dir)
    return E.anchored_timeline(scenes, X.reading_time_us("text")).select("track_id", "seq", "start_us", "end_us")


MEASURED_SQL = f"""WITH RECURSIVE {DIALOGUE},
l AS (SELECT track_id, seq, seq * 5000000 AS s0, seq * 5000000 + length(text) * 10000 AS e0,
   CASE WHEN speaker = 'A' THEN seq * 6000000 - 500000 END AS ms, CASE WHEN speaker = 'A' THEN seq * 6000000 + length(text) * 20000 END AS me,
   row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM dialogue),
m AS (SELECT *, greatest(0, ms) AS m0, greatest(1200000, e0 - s0) AS span FROM l),
p AS (SELECT *, greatest(m0 + 100000, me) AS m1 FROM m),
r AS (SELECT track_id, seq, rn, CAST(CASE WHEN ms IS NULL THEN 0 ELSE m0 END AS BIGINT) AS start_us, CAST(CASE WHEN ms IS NULL THEN span ELSE m1 END AS BIGINT) AS end_us FROM p WHERE rn = 1
  UNION ALL SELECT p.track_id, p.seq, p.rn, CAST(CASE WHEN ms IS NULL THEN r.end_us + 300000 ELSE m0 END AS BIGINT),
    CAST(CASE WHEN ms IS NULL THEN r.end_us + 300000 + span ELSE m1 END AS BIGINT) FROM r JOIN p ON p.track_id = r.track_id AND p.rn = r.rn + 1)
SELECT track_id, seq, start_us, end_us FROM r"""


@query("tim17_measured_cues", MEASURED_SQL)
def tim17(spark, sf_dir):
    n, size = F.col("seq"), F.length("text")
    lines = A.dialogue(spark, sf_dir).withColumns(
        {"cue_id": n, "start_us": n * 5_000_000, "end_us": n * 5_000_000 + size * 10_000}
    )
    measured = lines.filter(F.col("speaker") == "A").select(
        "track_id", "cue_id", (n * 6_000_000 - 500_000).alias("start_us"), (n * 6_000_000 + size * 20_000).alias("end_us")
    )
    return E.apply_measured_cues(lines, measured).select("track_id", "seq", "start_us", "end_us")


CLIP_SQL = f"""WITH {DIALOGUE}, c AS (SELECT track_id, seq, CAST(length(text) % 400 * 50 AS BIGINT) AS n_frames FROM dialogue),
a AS (SELECT *, coalesce(sum(n_frames + 6615) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2646 AS f,
   sum(n_frames + 6615) OVER (PARTITION BY track_id) AS t FROM c WHERE n_frames > 0)
SELECT track_id, seq, n_frames, CAST(f AS BIGINT) AS start_frame, CAST(f + n_frames AS BIGINT) AS end_frame, {rnd("f / 22050.0::DOUBLE * 1000000")} AS start_us,
  {rnd("(f + n_frames) / 22050.0::DOUBLE * 1000000")} AS end_us, {rnd("(t - 6615 + 2646 + 5292) / 22050.0::DOUBLE * 1000000")} AS total_us FROM a"""


@query("tim18_stitch_clips", CLIP_SQL)
def tim18(spark, sf_dir):
    clips = A.dialogue(spark, sf_dir).select(
        "track_id", "seq", (F.length("text") % 400 * 50).cast("long").alias("n_frames")
    )
    return E.stitch_clips(clips, 22_050)


def tap_lines(spark, sf_dir):
    """Each user's events are lines; clicks are the taps that open them."""
    spans = A.spans(spark, sf_dir)
    return spans.select("track_id", F.col("cue_id").alias("seq"), F.concat("event_type", F.lit(" event line")).alias("text"))


def tap_marks(spark, sf_dir):
    return A.taps(spark, sf_dir).withColumn("line_index", F.col("tap_id"))


TAP_SQL = f"""WITH {SPANS}, l AS (SELECT track_id, cue_id AS seq, event_type || ' event line' AS text, CASE WHEN event_type = 'click' THEN start_us END AS tap FROM spans),
n AS (SELECT *, first_value(tap IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM l)
SELECT track_id, seq, text, tap AS start_us, CASE WHEN tap IS NOT NULL THEN greatest(least(coalesce(nx - 150000, tap + 600000 + 3 * 260000), tap + 6000000), tap + 400000) END AS end_us,
  CASE WHEN tap IS NOT NULL THEN 'tap' END AS source, CASE WHEN tap IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM n"""


@query("tim19_apply_taps", TAP_SQL)
def tim19(spark, sf_dir):
    return TP.apply_taps(tap_lines(spark, sf_dir), tap_marks(spark, sf_dir))


@query(
    "tim20_tap_progress",
    f"""WITH {SPANS} SELECT track_id, count(*) AS n_lines, count(*) FILTER (event_type = 'click') AS n_taps,
      least(1.0::DOUBLE, count(*) FILTER (event_type = 'click')::DOUBLE / count(*)) AS progress FROM spans GROUP BY track_id""",
)
def tim20(spark, sf_dir):
    return TP.tap_progress(tap_lines(spark, sf_dir), tap_marks(spark, sf_dir))


COMP_TOL = 6 * A.HOUR_US
COMP_SQL = f"""WITH {TAPS}, beats AS (SELECT user_id AS track_id, epoch_us(ts) AS beat_us FROM events WHERE event_type = 'view'),
b AS (SELECT t.*, x.beat_us AS b FROM taps t ASOF LEFT JOIN beats x ON t.track_id = x.track_id AND t.time_us >= x.beat_us),
n AS (SELECT b.*, x.beat_us AS a FROM b ASOF LEFT JOIN beats x ON b.track_id = x.track_id AND b.time_us < x.beat_us),
d AS (SELECT track_id, tap_id, time_us - CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN time_us - b <= a - time_us THEN b ELSE a END AS delta FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY delta, tap_id) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM d WHERE abs(delta) <= {COMP_TOL})
SELECT track_id, delta AS compensation_us, n AS n_taps FROM k WHERE n >= 3 AND r = n // 2 + 1"""


@query("tim21_suggest_compensation", COMP_SQL)
def tim21(spark, sf_dir):
    return TP.suggest_compensation(A.taps(spark, sf_dir), view_beats(spark, sf_dir), COMP_TOL)


def edit_cues(spark, sf_dir):
    n, size = F.col("seq"), F.length("text")
    return A.dialogue(spark, sf_dir).withColumns(
        {
            "cue_id": n.cast("string"),
            "start_us": n * 5_000_000,
            "end_us": n * 5_000_000 + size * 10_000,
            "locked": n % 3 == 0,
            "source": F.lit("estimate"),
        }
    )


EDIT_OPS = (
    "set_start", "nudge_end", "move", "lock", "delete", "duplicate", "insert_after", "unlock", "set_end", "nudge_start",
)


def edit_list(cues):
    ops = F.array(*[F.lit(o) for o in EDIT_OPS])
    slot = F.pmod(F.col("seq") + F.col("track_id"), F.lit(12))
    return (
        cues.withColumn("_k", slot)
        .filter(F.col("_k") < len(EDIT_OPS))
        .select(
            "track_id",
            "cue_id",
            F.element_at(ops, F.col("_k").cast("int") + 1).alias("op"),
            F.when(F.col("_k") == 0, F.lit(777)).when(F.col("_k") == 8, F.lit(1_000_000)).otherwise(-250_000).cast("long").alias("amount"),
            F.lit("new line").alias("value"),
        )
    )


EDIT_CUES = f"""{DIALOGUE}, cues AS (SELECT track_id, seq, CAST(seq AS VARCHAR) AS cue_id, text, seq * 5000000 AS start_us, seq * 5000000 + length(text) * 10000 AS end_us,
   seq % 3 = 0 AS locked, 'estimate' AS source FROM dialogue)"""
_K = "(seq + track_id) % 12"
EDIT_SQL = f"""WITH {EDIT_CUES}, k AS (SELECT *, {_K} AS k FROM cues WHERE {_K} <> 4),
s AS (SELECT *, CASE WHEN k = 0 THEN 777 WHEN k IN (2, 9) THEN greatest(0, start_us - 250000) ELSE start_us END AS ns FROM k),
e AS (SELECT *, CASE WHEN k = 8 THEN greatest(ns, 1000000) WHEN k = 1 THEN greatest(ns, end_us - 250000) WHEN k = 2 THEN ns + end_us - start_us ELSE end_us END AS ne FROM s),
a AS (SELECT track_id, cue_id, seq + 0.0 AS slot, text, ns AS start_us, ne AS end_us, CASE WHEN k = 3 THEN true WHEN k = 7 THEN false ELSE locked END AS locked,
   CASE WHEN k IN (0, 2, 8) THEN 'human' ELSE source END AS source FROM e
  UNION ALL SELECT track_id, cue_id || '+copy', seq + 0.25, text, end_us + 200000, end_us + 200000 + end_us - start_us, false, 'estimate' FROM e WHERE k = 5
  UNION ALL SELECT track_id, cue_id || '+new', seq + 0.25, 'new line', end_us + 200000, end_us + 2200000, false, 'estimate' FROM e WHERE k = 6)
SELECT track_id, cue_id, text, start_us, end_us, locked, source, row_number() OVER (PARTITION BY track_id ORDER BY slot, cue_id) - 1 AS seq FROM a"""


@query("tim22_bulk_edits", EDIT_SQL)
def tim22(spark, sf_dir):
    cues = edit_cues(spark, sf_dir)
    return ED.apply_edits(cues, edit_list(cues))


SPLIT_SQL = f"""WITH {EDIT_CUES}, t AS (SELECT *, regexp_extract_all(text, '{TOK}') AS tk, seq % 4 * 3 AS k FROM cues),
l AS (SELECT *, k > 0 AND k < len(tk) AS ok, array_to_string(tk[1:k], ' ') AS lt, array_to_string(tk[k + 1:], ' ') AS rt FROM t),
p AS (SELECT *, {rnd("start_us + (end_us - start_us) * length(lt) / greatest(1, length(lt) + length(rt))::DOUBLE")} AS pos FROM l)
SELECT track_id, cue_id, 0 AS part, text, start_us, end_us FROM p WHERE NOT ok
UNION ALL SELECT track_id, cue_id, 1, lt, start_us, pos FROM p WHERE ok UNION ALL SELECT track_id, cue_id, 2, rt, pos, end_us FROM p WHERE ok"""


@query("tim23_split_cues", SPLIT_SQL)
def tim23(spark, sf_dir):
    cues = edit_cues(spark, sf_dir).select("track_id", "cue_id", "seq", "text", "start_us", "end_us")
    splits = cues.select("track_id", "cue_id", (F.col("seq") % 4 * 3).cast("int").alias("word_index"))
    return ED.split_cues(cues, splits).drop("seq")


MERGE_SQL = f"""WITH RECURSIVE {EDIT_CUES}, o AS (SELECT *, seq % 5 IN (1, 2, 4) AS flag, row_number() OVER (PARTITION BY track_id ORDER BY start_us, cue_id) AS rn FROM cues),
r AS (SELECT track_id, rn, flag AND EXISTS (SELECT 1 FROM o n WHERE n.track_id = o.track_id AND n.rn = 2) AS act, false AS gone FROM o WHERE rn = 1
  UNION ALL SELECT o.track_id, o.rn, NOT r.act AND o.flag AND EXISTS (SELECT 1 FROM o n WHERE n.track_id = o.track_id AND n.rn = o.rn + 1), r.act
   FROM r JOIN o ON o.track_id = r.track_id AND o.rn = r.rn + 1)
SELECT o.track_id, o.cue_id, CASE WHEN act THEN trim(regexp_replace(trim(o.text) || ' ' || trim(n.text), '\\s+', ' ', 'g')) ELSE o.text END AS text,
  CASE WHEN act THEN least(o.start_us, n.start_us) ELSE o.start_us END AS start_us, CASE WHEN act THEN greatest(o.end_us, n.end_us) ELSE o.end_us END AS end_us,
  CASE WHEN act THEN o.locked AND n.locked ELSE o.locked END AS locked, o.source
FROM o JOIN r USING (track_id, rn) LEFT JOIN o n ON n.track_id = o.track_id AND n.rn = o.rn + 1 WHERE NOT gone"""


@query("tim24_merge_with_next", MERGE_SQL)
def tim24(spark, sf_dir):
    cues = edit_cues(spark, sf_dir).withColumn("flag", (F.col("seq") % 5).isin(1, 2, 4))
    return ED.merge_with_next(cues, "flag")


EXTENT_SQL = f"""WITH {SPANS}, l AS (SELECT track_id, max(end_us) - 1704067200000000 AS last, min(start_us) - 1704067200000000 AS first FROM spans GROUP BY track_id)
SELECT c_custkey AS track_id, greatest(CASE WHEN c_custkey % 3 = 0 THEN 2500000 ELSE 0 END + greatest(CAST(floor(abs(c_acctbal) * 1e6) AS BIGINT),
   CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3000000 ELSE 0 END, coalesce(last, 0)) + CASE WHEN c_custkey % 5 = 0 THEN 2500000 ELSE 0 END, 1000000) AS timeline_us
FROM customer LEFT JOIN l ON l.track_id = c_custkey"""


@query("tim25_timeline_extent", EXTENT_SQL)
def tim25(spark, sf_dir):
    key = F.col("c_custkey")
    projects = A.table(spark, sf_dir, "customer").select(
        key.alias("track_id"),
        F.floor(F.abs("c_acctbal") * F.lit(1e6)).alias("audio_us"),
        (key % 2 == 0).alias("voice_enabled"),
        (key * 3_000_000).alias("voice_us"),
        F.when(key % 3 == 0, 2_500_000).otherwise(0).alias("intro_us"),
        F.when(key % 5 == 0, 2_500_000).otherwise(0).alias("outro_us"),
    )
    cues = A.spans(spark, sf_dir).select("track_id", (F.col("end_us") - F.lit(1_704_067_200_000_000)).alias("end_us"))
    return E.timeline_extent(projects, cues)
