"""Join operators over events, documents, conversations, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import ASSETS, DIALOGUE, DOC_LINES, SIGNAL, SPANS, sig
from cuestream.catalog.estimates import EST, lines_with_locks
from cuestream.catalog.timing import view_beats
from cuestream.operators import estimate as E
from cuestream.operators import matching as M
from cuestream.operators import mixing as MX
from cuestream.operators import playback as PB
from cuestream.operators import postprocess as P
from cuestream.plans.joins import nearest_join, nearest_on_grid

HOUR = A.HOUR_US
T0 = 1_704_067_200_000_000


def parsed_lines(spark, sf_dir):
    """Odd document lines read back as parsed cues, with other punctuation, some without an end."""
    n = F.col("seq")
    return A.doc_lines(spark, sf_dir).filter(n % 2 == 1).select(
        "track_id",
        n.alias("cue_seq"),
        F.concat(F.lit("... "), "text", F.lit("!")).alias("text"),
        (n * 3_000_000).alias("start_us"),
        F.when(n % 3 == 0, n * 3_000_000 + 1_500_000).alias("end_us"),
    )


PARSED = f"""parsed AS (SELECT track_id, seq AS cue_seq, {sig("'... ' || text || '!'")} AS sg, seq * 3000000 AS ps, coalesce(CASE WHEN seq % 3 = 0 THEN seq * 3000000 + 1500000 END, seq * 3000000 + 2000000) AS pe
   FROM doc_lines WHERE seq % 2 = 1),
firsts AS (SELECT * FROM parsed WHERE sg <> '' QUALIFY row_number() OVER (PARTITION BY track_id, sg ORDER BY cue_seq) = 1)"""
MERGED = f"""merged AS (SELECT e.track_id, e.seq, e.text, CASE WHEN hit THEN ps ELSE start_us END AS start_us, CASE WHEN hit THEN pe ELSE end_us END AS end_us, hit FROM
   (SELECT e.*, f.ps, f.pe, f.ps IS NOT NULL AND NOT keep AS hit FROM (SELECT *, {sig("text")} AS sg FROM est) e LEFT JOIN firsts f USING (track_id, sg)) e)"""


@query(
    "join01_signature_merge",
    f"WITH {EST}, {PARSED}, {MERGED} SELECT track_id, seq, start_us, end_us, CASE WHEN hit THEN 'align' WHEN seq % 7 = 3 THEN 'human' ELSE 'estimate' END AS source FROM merged",
)
def join01(spark, sf_dir):
    cues = E.estimate_line_timings(lines_with_locks(spark, sf_dir), hot=False)
    merged = M.merge_parsed_timings(cues, parsed_lines(spark, sf_dir))
    return merged.select("track_id", "seq", "start_us", "end_us", "source")


WORD_SQL = f"""WITH {DIALOGUE}, cues AS (SELECT track_id, seq AS cue_id, text, seq * 10000000 AS c0, seq * 10000000 + 8000000 AS c1 FROM dialogue),
tok AS (SELECT track_id, cue_id, c0, c1, i, tks[i + 1] AS text, {sig("tks[i + 1]")} AS k, sum(length_grapheme(tks[i + 1])) OVER w AS tw, length_grapheme(tks[i + 1]) AS gw, len(tks) AS n
   FROM (SELECT *, unnest(range(0, len(tks))) AS i FROM (SELECT *, regexp_extract_all(text, '\\S+') AS tks FROM cues)) WINDOW w AS (PARTITION BY track_id, cue_id)),
pw AS (SELECT track_id, cue_id, k, i, c0 + i * 200000 AS ps, c0 + i * 200000 + 150000 AS pe FROM tok WHERE i % 3 = 0 AND cue_id % 4 <> 3 AND k <> ''),
f AS (SELECT * FROM pw QUALIFY row_number() OVER (PARTITION BY track_id, cue_id, k ORDER BY i) = 1),
j AS (SELECT t.*, f.ps, f.pe FROM tok t LEFT JOIN f USING (track_id, cue_id, k)),
l AS (SELECT *, last_value(pe IGNORE NULLS) OVER (PARTITION BY track_id, cue_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le,
   bool_or(ps IS NOT NULL) OVER (PARTITION BY track_id, cue_id) AS hit, CAST(floor((c1 - c0) * gw / tw::DOUBLE + 0.5) AS BIGINT) AS share FROM j),
s AS (SELECT *, c0 + coalesce(sum(share) OVER (PARTITION BY track_id, cue_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM l)
SELECT track_id, cue_id, CAST(i AS BIGINT) AS word_idx, text,
  CAST(CASE WHEN NOT hit THEN ws WHEN ps IS NOT NULL THEN ps ELSE greatest(c0, coalesce(le, c0)) END AS BIGINT) AS start_us,
  CAST(CASE WHEN NOT hit THEN greatest(ws, CASE WHEN i = n - 1 THEN c1 ELSE ws + share END) WHEN ps IS NOT NULL THEN pe ELSE greatest(c0, coalesce(le, c0)) END AS BIGINT) AS end_us,
  CASE WHEN NOT hit THEN 0.8::DOUBLE WHEN ps IS NOT NULL THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS confidence,
  CASE WHEN NOT hit OR ps IS NOT NULL THEN 'align' ELSE 'estimate' END AS source FROM s"""


@query("join02_word_merge", WORD_SQL)
def join02(spark, sf_dir):
    n = F.col("seq")
    cues = A.dialogue(spark, sf_dir).select(
        "track_id",
        n.alias("cue_id"),
        "text",
        (n * 10_000_000).alias("start_us"),
        (n * 10_000_000 + 8_000_000).alias("end_us"),
        F.lit(0.8).alias("confidence"),
        F.lit("align").alias("source"),
    )
    words = cues.filter(F.col("cue_id") % 4 != 3).select(
        "track_id", "cue_id", "start_us", F.posexplode(F.split("text", r"\s+")).alias("word_idx", "text")
    )
    at = F.col("start_us") + F.col("word_idx") * 200_000
    parsed = words.filter(F.col("word_idx") % 3 == 0).select(
        "track_id", "cue_id", "word_idx", "text", at.alias("start_us"), (at + 150_000).alias("end_us")
    )
    return M.merge_word_timings(cues, parsed)


NEAR_CTE = f"""{SPANS}, t AS (SELECT track_id, cue_id, start_us AS t FROM spans WHERE event_type = 'click'),
beats AS (SELECT track_id, start_us AS beat_us FROM spans WHERE event_type = 'view'),
b AS (SELECT t.*, x.beat_us AS b FROM t ASOF LEFT JOIN beats x ON t.track_id = x.track_id AND t.t >= x.beat_us),
n AS (SELECT b.*, x.beat_us AS a FROM b ASOF LEFT JOIN beats x ON b.track_id = x.track_id AND b.t < x.beat_us)"""


@query(
    "join03_nearest",
    f"""WITH {NEAR_CTE}, d AS (SELECT track_id, cue_id, t, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN t - b <= a - t THEN b ELSE a END AS near FROM n)
    SELECT track_id, cue_id, CASE WHEN abs(near - t) <= {6 * HOUR} THEN near END AS beat_us FROM d""",
)
def join03(spark, sf_dir):
    clicks = A.spans(spark, sf_dir).filter(F.col("event_type") == "click").select("track_id", "cue_id", "start_us")
    near = nearest_join(clicks, view_beats(spark, sf_dir), ["track_id"], "start_us", "beat_us", "cue_id", "beat_us")
    beat = F.col("nearest.beat_us")
    return near.select("track_id", "cue_id", F.when(F.abs(beat - F.col("start_us")) <= 6 * HOUR, beat).alias("beat_us"))


GRID_SQL = f"""WITH {SPANS}, g AS (SELECT cue_id, start_us AS t, CAST(floor((start_us - {T0}) / {HOUR}::DOUBLE + 0.5) AS BIGINT) AS i FROM spans)
SELECT cue_id, CASE WHEN i BETWEEN 0 AND 499 AND abs({T0} + i * {HOUR} - t) <= 600000000 THEN {T0} + i * {HOUR}
  WHEN i - 1 BETWEEN 0 AND 499 AND abs({T0} + (i - 1) * {HOUR} - t) <= 600000000 THEN {T0} + (i - 1) * {HOUR}
  WHEN i + 1 BETWEEN 0 AND 499 AND abs({T0} + (i + 1) * {HOUR} - t) <= 600000000 THEN {T0} + (i + 1) * {HOUR} END AS beat_us FROM g"""


@query("join03_nearest_on_grid", GRID_SQL)
def join03_grid(spark, sf_dir):
    beat = nearest_on_grid(F.col("start_us"), F.lit(T0), F.lit(HOUR), F.lit(500), 600_000_000)
    return A.spans(spark, sf_dir).select("cue_id", beat.alias("beat_us"))


def hour_points(spans):
    """Every full hour inside each user's activity."""
    bounds = spans.groupBy("track_id").agg(
        F.floor(F.min("start_us") / HOUR).alias("lo"), F.floor(F.max("start_us") / HOUR).alias("hi")
    )
    hours = bounds.select("track_id", F.explode(F.sequence("lo", "hi")).alias("hour"))
    return hours.select("track_id", (F.col("hour") * F.lit(HOUR)).alias("t_us"))


POINTS = f"""{SPANS}, points AS (SELECT track_id, unnest(range(lo, hi + 1)) * {HOUR} AS t_us FROM
   (SELECT track_id, CAST(min(start_us) // {HOUR} AS BIGINT) AS lo, CAST(max(start_us) // {HOUR} AS BIGINT) AS hi FROM spans GROUP BY track_id))"""


@query(
    "join04_active_cue",
    f"""WITH {POINTS}, c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_us, cue_id) - 1 AS i FROM spans)
    SELECT p.track_id, p.t_us, coalesce(c.i, -1) AS cue_index, c.cue_id FROM points p ASOF LEFT JOIN c ON p.track_id = c.track_id AND p.t_us >= c.start_us""",
)
def join04(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    return PB.active_cue(hour_points(spans), spans, "t_us")


@query(
    "join05_visible_cues",
    f"""WITH {POINTS} SELECT p.track_id, p.t_us, s.cue_id FROM points p JOIN spans s ON p.track_id = s.track_id
      AND p.t_us BETWEEN s.start_us - 600000000 AND s.end_us + 1200000000""",
)
def join05(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    seen = PB.visible_cues(hour_points(spans), spans.drop("event_type"), 600_000_000, 1_200_000_000, 2 * HOUR)
    return seen.select("track_id", "t_us", "cue_id")


@query(
    "join06_word_progress",
    f"""WITH {POINTS}, w AS (SELECT track_id, start_us // 86400000000 AS cue_id, cue_id AS word_idx, start_us, end_us,
       min(start_us) OVER g AS c0, max(end_us) OVER g AS c1 FROM spans WINDOW g AS (PARTITION BY track_id, start_us // 86400000000)),
    j AS (SELECT p.track_id, p.t_us AS t, w.* EXCLUDE (track_id) FROM points p JOIN w ON p.track_id = w.track_id AND p.t_us BETWEEN c0 AND c1)
    SELECT track_id, t AS t_us, CAST(cue_id AS BIGINT) AS cue_id, word_idx, mode, round(CASE mode WHEN 'none' THEN 1.0 WHEN 'line' THEN greatest(0.0, least(1.0, (t - c0)::DOUBLE / greatest(1, c1 - c0)))
        WHEN 'word' THEN CASE WHEN t >= start_us THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, (t - start_us)::DOUBLE / greatest(120000, end_us - start_us))) END::DOUBLE, 9) AS fill,
      CASE mode WHEN 'none' THEN 'active' WHEN 'line' THEN CASE WHEN t >= c1 THEN 'done' WHEN t >= c0 THEN 'active' ELSE 'upcoming' END
        WHEN 'word' THEN CASE WHEN t >= end_us THEN 'done' WHEN t >= start_us THEN 'active' ELSE 'upcoming' END
        ELSE CASE WHEN t >= start_us + greatest(120000, end_us - start_us) THEN 'done' WHEN t > start_us THEN 'active' ELSE 'upcoming' END END AS state
    FROM j, (VALUES ('none'), ('line'), ('word'), ('progressive')) m(mode)""",
)
def join06(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    day = F.floor(F.col("start_us") / 86_400_000_000)
    words = spans.select("track_id", day.alias("cue_id"), F.col("cue_id").alias("word_idx"), "start_us", "end_us")
    # extent of a cue: partial aggregation, then an equi join that adaptive skew handling can split
    extent = words.groupBy("track_id", "cue_id").agg(F.min("start_us").alias("cue_start_us"), F.max("end_us").alias("cue_end_us"))
    out = PB.word_progress(
        hour_points(spans), words.join(extent, ["track_id", "cue_id"]), ("none", "line", "word", "progressive"), width_us=6 * HOUR
    )
    return out.withColumn("fill", F.round("fill", 9))


@query(
    "join07_containing_cue",
    f"""WITH {POINTS} SELECT p.track_id, p.t_us, arg_min(s.cue_id, (s.start_us, s.cue_id)) AS cue_id FROM points p LEFT JOIN spans s
      ON p.track_id = s.track_id AND p.t_us BETWEEN s.start_us AND s.end_us GROUP BY ALL""",
)
def join07(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    return PB.containing_cue(hour_points(spans), spans.drop("event_type"), 2 * HOUR).select("track_id", "t_us", "cue_id")


def reference_sites(spark, sf_dir):
    """Six reference columns: one per residue class of the labelled documents."""
    labels = A.table(spark, sf_dir, "labels")
    return [
        labels.filter((F.col("doc_id") % 6 == k) & ((F.col("quality") == 1) | (F.col("toxic") == k % 2))).select("doc_id")
        for k in range(6)
    ]


REFS = """refs AS (SELECT DISTINCT doc_id AS asset_id FROM labels WHERE quality = 1 OR toxic = (doc_id % 6) % 2)"""


@query(
    "join08_unreferenced_assets",
    f"WITH {ASSETS}, {REFS} SELECT * FROM assets ANTI JOIN refs USING (asset_id)",
)
def join08(spark, sf_dir):
    return M.unreferenced_assets(A.assets(spark, sf_dir), reference_sites(spark, sf_dir))


@query("set01_union_references", f"WITH {REFS} SELECT * FROM refs")
def set01(spark, sf_dir):
    return M.union_references(reference_sites(spark, sf_dir))


@query("set02_set_difference", f"WITH {REFS} SELECT doc_id AS asset_id FROM documents EXCEPT SELECT asset_id FROM refs")
def set02(spark, sf_dir):
    ids = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"))
    return ids.join(M.union_references(reference_sites(spark, sf_dir)), "asset_id", "left_anti")


@query(
    "join09_audio_missing",
    """SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS audio_id,
      o_orderkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = o_custkey) AS audio_missing FROM orders""",
)
def join09(spark, sf_dir):
    projects = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("audio_id")
    )
    assets = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    return M.flag_missing_audio(projects, assets)


@query(
    "join10_relink_by_hash",
    f"""WITH {ASSETS}, files AS (SELECT doc_id + doc_id % 2 AS asset_id, sha256(text) AS content_hash FROM documents)
    SELECT f.asset_id, f.content_hash, a.content_hash AS expected_hash, CASE WHEN a.content_hash IS NULL THEN 'unknown'
      WHEN a.content_hash = f.content_hash THEN 'accepted' ELSE 'mismatch' END AS verdict FROM files f LEFT JOIN assets a USING (asset_id)""",
)
def join10(spark, sf_dir):
    files = A.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + F.col("doc_id") % 2).alias("asset_id"), F.sha2("text", 256).alias("content_hash")
    )
    return M.relink_by_hash(files, A.assets(spark, sf_dir))


@query(
    "join17_relink_missing",
    f"""WITH {ASSETS}, present AS (SELECT asset_id FROM assets WHERE asset_id % 3 <> 1),
    opts AS (SELECT content_hash, min(asset_id) AS other FROM assets SEMI JOIN present USING (asset_id) GROUP BY content_hash)
    SELECT a.asset_id AS project_id, CASE WHEN p.asset_id IS NOT NULL THEN a.asset_id ELSE coalesce(o.other, a.asset_id) END AS linked_id,
      p.asset_id IS NULL AND o.other IS NULL AS audio_missing FROM assets a LEFT JOIN present p USING (asset_id) LEFT JOIN opts o USING (content_hash)""",
)
def join17(spark, sf_dir):
    assets = A.assets(spark, sf_dir)
    projects = assets.select(F.col("asset_id").alias("project_id"), F.col("asset_id").alias("audio_id"), "content_hash")
    manifest = assets.select("asset_id", "content_hash", F.col("asset_id").alias("position"))
    out = M.relink_missing(projects, manifest, assets.filter(F.col("asset_id") % 3 != 1))
    return out.select("project_id", "linked_id", "audio_missing")


# Delivery presets (id, aspect, width, height, fps, video and audio bitrate).
PRESETS = [
    ("youtube", "16:9", 1920, 1080, 30, 8_000_000, 192_000),
    ("youtube-4k", "16:9", 3840, 2160, 30, 35_000_000, 256_000),
    ("youtube-shorts", "9:16", 1080, 1920, 30, 10_000_000, 192_000),
    ("tiktok", "9:16", 1080, 1920, 30, 10_000_000, 192_000),
    ("instagram-reels", "9:16", 1080, 1920, 30, 10_000_000, 192_000),
    ("instagram-post", "4:5", 1080, 1350, 30, 8_000_000, 192_000),
    ("instagram-square", "1:1", 1080, 1080, 30, 8_000_000, 192_000),
    ("facebook", "16:9", 1280, 720, 30, 5_000_000, 128_000),
    ("karaoke-room", "16:9", 1920, 1080, 30, 10_000_000, 256_000),
    ("custom", "custom", 1280, 720, 30, 5_000_000, 160_000),
]
PRESET_COLUMNS = "preset_id string, aspect string, width int, height int, fps int, video_bitrate int, audio_bitrate int"
_VALUES = ", ".join(f"('{p[0]}', '{p[1]}', {', '.join(map(str, p[2:]))})" for p in PRESETS)
PRESETS_SQL = f"presets(preset_id, aspect, width, height, fps, video_bitrate, audio_bitrate) AS (VALUES {_VALUES})"
PRESET_OF = """CASE p_size % 6 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'youtube-4k' WHEN 2 THEN 'facebook' WHEN 3 THEN 'instagram-post' ELSE lower(p_type) END"""


def presets(spark):
    return spark.createDataFrame(PRESETS, PRESET_COLUMNS)


def preset_of(size):
    return (
        F.when(size % 6 == 0, "tiktok")
        .when(size % 6 == 1, "youtube-4k")
        .when(size % 6 == 2, "facebook")
        .when(size % 6 == 3, "instagram-post")
        .otherwise(F.lower("p_type"))
    )


@query(
    "join11_lookup_with_default",
    f"""WITH {PRESETS_SQL}, f AS (SELECT p_partkey, {PRESET_OF} AS wanted FROM part)
    SELECT f.p_partkey, f.wanted, coalesce(p.preset_id, d.preset_id) AS preset_id, coalesce(p.width, d.width) AS width, coalesce(p.height, d.height) AS height
    FROM f LEFT JOIN presets p ON p.preset_id = f.wanted, (SELECT * FROM presets WHERE preset_id = 'youtube') d""",
)
def join11(spark, sf_dir):
    facts = A.table(spark, sf_dir, "part").select("p_partkey", preset_of(F.col("p_size")).alias("wanted"))
    dim = presets(spark).select("preset_id", "width", "height")
    return M.lookup_with_default(facts, dim, "wanted", "preset_id", "youtube")


_LEVELS = ", ".join(f"({i}, '{v['level']:02x}', {v['rate']}, {v['frame']})" for i, v in enumerate(M.AVC_LEVELS))


@query(
    "join12_first_fit_level",
    f"""WITH lv(rk, id, rate, frame) AS (VALUES {_LEVELS}), d AS (SELECT l_orderkey, l_linenumber, l_partkey % 4000 + 128 AS w, l_suppkey * 20 + 128 AS h, CAST(l_quantity AS BIGINT) + 11 AS fps FROM lineitem),
    b AS (SELECT *, CAST(ceil(w / 16.0) * ceil(h / 16.0) AS BIGINT) AS blocks FROM d),
    k AS (SELECT blocks, fps, arg_min(id, rk) AS id FROM (SELECT DISTINCT blocks, fps FROM b) JOIN lv ON rate >= blocks * fps AND frame >= blocks GROUP BY ALL)
    SELECT b.l_orderkey, b.l_linenumber, 'avc1.6400' || coalesce(k.id, '34') AS codec FROM b LEFT JOIN k USING (blocks, fps)""",
)
def join12(spark, sf_dir):
    fps = F.col("l_quantity").cast("long") + 11
    codec = M.avc_codec_string(F.col("l_partkey") % 4000 + 128, F.col("l_suppkey") * 20 + 128, fps)
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codec.alias("codec"))


def by_band(spark, sf_dir, scale):
    """All bands, each a track of its own."""
    s = A.signal(spark, sf_dir)
    track = (F.ascii("band") * 256 + F.length("band")).cast("long")
    return s.select(track.alias("track_id"), "frame", (F.col("value") / scale).alias("value"))


BY_BAND = f"""{SIGNAL}, tr AS (SELECT CAST(ascii(band) * 256 + length(band) AS BIGINT) AS track_id, frame, value AS v FROM signal)"""

MIX_SQL = f"""WITH {BY_BAND}, m AS (SELECT track_id, frame, v / 500 AS v FROM tr), v AS (SELECT track_id, frame, v / 800 AS v FROM tr),
n AS (SELECT track_id, max(frame) + 1 AS n FROM v GROUP BY track_id), p AS (SELECT track_id, frame, v AS bg, (frame / 2.0::DOUBLE - 6.5) * 1.5 AS pos FROM m),
i AS (SELECT p.*, n, CAST(floor(pos) AS BIGINT) AS a FROM p JOIN n USING (track_id))
SELECT i.track_id, i.frame, round(greatest(-1.0, least(1.0, bg * 0.9 + CASE WHEN pos >= 0 AND pos < n THEN v0.v * (1 - (pos - a)) + v1.v * (pos - a) ELSE 0 END * 0.7)), 12) AS value
FROM i LEFT JOIN v v0 ON v0.track_id = i.track_id AND v0.frame = a LEFT JOIN v v1 ON v1.track_id = i.track_id AND v1.frame = least(n - 1, a + 1)"""


@query("join13_mix_series", MIX_SQL)
def join13(spark, sf_dir):
    out = MX.mix_voiceover(by_band(spark, sf_dir, 500), by_band(spark, sf_dir, 800), 2.0, 1.5, 6_500_000, 0.9, 0.7)
    return out.withColumn("value", F.round("value", 12))


@query(
    "join14_overlap_add",
    f"""WITH {SIGNAL}, c AS (SELECT frame + ascii(band) * 3 AS f, CAST(value AS DECIMAL(20,4)) AS v FROM signal)
    SELECT CAST(0 AS BIGINT) AS track_id, f AS frame, round(greatest(-1.0, least(1.0, CAST(sum(v) AS DOUBLE) / 2000)), 8) AS value FROM c GROUP BY f""",
)
def join14(spark, sf_dir):
    clips = A.signal(spark, sf_dir).select(
        "track_id", "frame", (F.ascii("band") * 3).cast("long").alias("start_frame"), (F.col("value") / 2000).alias("value")
    )
    return MX.overlap_add(clips).withColumn("value", F.round("value", 8))


RES_SQL = f"""WITH {BY_BAND}, n AS (SELECT track_id, max(frame) + 1 AS n, CAST(greatest(1, floor((max(frame) + 1) * 10 / 24.0::DOUBLE + 0.5)) AS BIGINT) AS m FROM tr GROUP BY track_id),
o AS (SELECT track_id, unnest(range(0, m)) AS o, n FROM n),
w AS (SELECT o.track_id, o, v, greatest(0, least(least(n, (o + 1) * 2.4::DOUBLE), frame + 1) - greatest(o * 2.4::DOUBLE, frame)) AS w
  FROM o JOIN tr ON tr.track_id = o.track_id AND frame >= floor(o * 2.4) - 1 AND frame <= (o + 1) * 2.4 + 1)
SELECT track_id, o AS frame, round(sum(v * w) / sum(w), 6) AS value FROM w GROUP BY ALL"""


@query("join15_resample_down", RES_SQL)
def join15_down(spark, sf_dir):
    s = by_band(spark, sf_dir, 1)
    lengths = s.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    return MX.resample(s, lengths, 24.0, 10.0).withColumn("value", F.round("value", 6))


@query(
    "join15_resample_up",
    f"""WITH {BY_BAND}, n AS (SELECT track_id, max(frame) + 1 AS n, CAST(floor((max(frame) + 1) * 25 / 10.0::DOUBLE + 0.5) AS BIGINT) AS m FROM tr GROUP BY track_id),
    o AS (SELECT track_id, o, n, o * 0.4::DOUBLE AS pos, least(n - 1, CAST(floor(o * 0.4::DOUBLE) AS BIGINT)) AS i FROM (SELECT track_id, unnest(range(0, m)) AS o, n FROM n))
    SELECT o.track_id, o AS frame, round(a.v * (1 - (pos - i)) + b.v * (pos - i), 6) AS value
    FROM o JOIN tr a ON a.track_id = o.track_id AND a.frame = i JOIN tr b ON b.track_id = o.track_id AND b.frame = least(n - 1, i + 1)""",
)
def join15_up(spark, sf_dir):
    s = by_band(spark, sf_dir, 1)
    lengths = s.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    return MX.resample(s, lengths, 10.0, 25.0).withColumn("value", F.round("value", 6))


IDENTITY_SQL = """WITH RECURSIVE l AS (SELECT o_custkey AS track_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders),
b AS (SELECT track_id, idx, 'ln' || idx AS line_id FROM l WHERE idx % 7 <> 6),
s AS (SELECT track_id, idx, CASE o_orderkey % 4 WHEN 0 THEN 'ln' || (o_orderkey % 9) WHEN 1 THEN 'own' || (o_orderkey % 3) END AS id FROM l),
j AS (SELECT s.*, b.line_id FROM s LEFT JOIN b USING (track_id, idx)),
r AS (SELECT track_id, CAST(-1 AS BIGINT) AS idx, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS scene_id, CAST(NULL AS VARCHAR) AS matched_by FROM (SELECT DISTINCT track_id FROM j)
  UNION ALL SELECT track_id, idx, list_append(used, c), c, how FROM (SELECT j.track_id, j.idx, r.used,
    CASE WHEN j.id IS NOT NULL AND NOT list_contains(r.used, j.id) THEN j.id WHEN j.line_id IS NOT NULL AND NOT list_contains(r.used, j.line_id) THEN j.line_id ELSE 'scn_' || j.idx END AS c,
    CASE WHEN j.id IS NOT NULL AND NOT list_contains(r.used, j.id) THEN 'explicit' WHEN j.line_id IS NOT NULL AND NOT list_contains(r.used, j.line_id) THEN 'index' ELSE 'new' END AS how
    FROM r JOIN j ON j.track_id = r.track_id AND j.idx = r.idx + 1))
SELECT track_id, idx, scene_id, matched_by FROM r WHERE idx >= 0"""


@query("join16_scene_identity", IDENTITY_SQL)
def join16(spark, sf_dir):
    from cuestream.plans.scan import OrderedScan, position

    orders = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), "o_orderkey")
    listed = OrderedScan.over(orders, ["track_id"], ["o_orderkey"]).add(_p=position()).done()
    listed = listed.withColumn("idx", F.col("_p") - 1)
    lines = listed.filter(F.col("idx") % 7 != 6).select(
        "track_id", "idx", F.concat(F.lit("ln"), F.col("idx").cast("string")).alias("line_id")
    )
    k = F.col("o_orderkey")
    explicit = F.when(k % 4 == 0, F.concat(F.lit("ln"), (k % 9).cast("string"))).when(
        k % 4 == 1, F.concat(F.lit("own"), (k % 3).cast("string"))
    )
    return M.match_scene_ids(listed.select("track_id", "idx", explicit.alias("id")), lines)


IMPORT_SQL_TAIL = f"""imp AS (SELECT m.*, seq AS cue_id, seq % 7 = 3 AS locked, 3600000000 AS duration_us FROM merged m)"""


def _import_sql() -> str:
    from cuestream.catalog import timing as T

    def us(sql: str) -> str:
        return sql.replace(str(T.MIN_LINE), "600000").replace(str(T.LEAD), "300000").replace(str(T.GAP), "400000")

    chain = ",".join(
        [
            "t0 AS (SELECT *, start_us AS s0 FROM imp)",
            T._clamp("t0", "c1"),
            us(T._minimum("c1", "m1")),
            T._overlap("m1", "o1"),
            us(T._lead("o1", "l1", "s0, cue_id")),
            us(T._fill("l1", "f1")),
            T._overlap("f1", "o2"),
        ]
    )
    return f"WITH {EST}, {PARSED}, {MERGED}, {IMPORT_SQL_TAIL}, {chain} SELECT track_id, cue_id, start_us, end_us FROM o2"


@query("tim26_timed_import", _import_sql())
def tim26(spark, sf_dir):
    """Estimate from text, merge parsed spans by signature, then clean up with lead-in."""
    cues = E.estimate_line_timings(lines_with_locks(spark, sf_dir), hot=False)
    merged = M.merge_parsed_timings(cues, parsed_lines(spark, sf_dir))
    options = P.PostProcessOptions(apply_lead_in=True)
    out = P.post_process(merged, options, F.lit(HOUR), hot=False)
    return out.select("track_id", "cue_id", "start_us", "end_us")
