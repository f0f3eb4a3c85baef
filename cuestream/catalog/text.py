"""Text functions over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import DIALOGUE, DOC_LINES, SPANS, rnd, sig
from cuestream.functions import text as X
from cuestream.functions import timecode as C

WORDS = "len(regexp_extract_all({0}, '[^\\s\\x{{A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+'))"
EDGE = "[\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+"


def n_words(expr: str) -> str:
    return WORDS.format(expr)


def syllables_sql(s: str) -> str:
    return (
        f"greatest(1, coalesce(list_sum(list_transform(list_filter(string_split({s}, ' '), lambda w: w <> ''), lambda w: "
        "greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '[^a-z]', '', 'g'), "
        "'(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '[aeiouy]{1,2}'))))), 0))"
    )


def weight_sql(s: str) -> str:
    return f"CASE WHEN {s} = '' THEN 10 ELSE greatest(10, 6 * length_grapheme({s}) + 60 * {syllables_sql(s)}) END"


DISPLAY_SQL = f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
   nfc_normalize(text), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '\\r\\n?', chr(10), 'g'), chr(9), '    '),
   ' {{2,}}', ' ', 'g'), '[ \\t\\r\\f\\v\\x{{A0}}]*\\n[ \\t\\r\\f\\v\\x{{A0}}]*', chr(10), 'g'), '^{EDGE}|{EDGE}$', '', 'g') AS display
FROM documents"""


@query("txt01_normalize_display", DISPLAY_SQL)
def txt01(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", X.norm_display("text").alias("display"))


@query("txt02_match_signature", f"WITH {DOC_LINES} SELECT track_id, seq, {sig('text')} AS signature FROM doc_lines")
def txt02(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).select("track_id", "seq", X.norm_match("text").alias("signature"))


TAGGED = """tagged AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '[' || p_type || ' ' || p_size || ']'
   WHEN 1 THEN '(' || p_name WHEN 2 THEN '## ' || p_brand ELSE p_name || ' (' || lower(p_type) || ')' END AS line FROM part)"""


def tagged_lines(spark, sf_dir):
    size = F.col("p_size") % 4
    line = (
        F.when(size == 0, F.concat(F.lit("["), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("]")))
        .when(size == 1, F.concat(F.lit("("), "p_name"))
        .when(size == 2, F.concat(F.lit("## "), "p_brand"))
        .otherwise(F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")")))
    )
    return A.table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query(
    "txt03_structural_tag",
    f"""WITH {TAGGED}, m AS (SELECT *, '^\\s*[\\[(#]+\\s*([A-Za-z][A-Za-z0-9 _''-]{{0,24}})\\s*[\\])]*\\s*$' AS p FROM tagged)
    SELECT p_partkey, line, CASE WHEN regexp_matches(line, p) THEN upper(trim(regexp_extract(line, p, 1))) END AS tag FROM m""",
)
def txt03(spark, sf_dir):
    return tagged_lines(spark, sf_dir).withColumn("tag", X.structural_tag("line"))


@query(
    "txt04_instrumental_marker",
    f"""WITH l AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '[Interlude]' WHEN 1 THEN '(Music ' || p_name || ')'
      WHEN 2 THEN 'Ad-lib' WHEN 3 THEN 'Solo!' ELSE p_name END AS line FROM part), s AS (SELECT *, {sig("line")} AS sg FROM l)
    SELECT p_partkey, line, regexp_matches(sg, '^({X.INSTRUMENTAL_WORDS})$') OR regexp_matches(sg, '^\\(?(music|instrumental)[^)]*\\)?$') AS marker FROM s""",
)
def txt04(spark, sf_dir):
    size = F.col("p_size") % 5
    line = (
        F.when(size == 0, "[Interlude]")
        .when(size == 1, F.concat(F.lit("(Music "), "p_name", F.lit(")")))
        .when(size == 2, "Ad-lib")
        .when(size == 3, "Solo!")
        .otherwise(F.col("p_name"))
    )
    lines = A.table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return lines.withColumn("marker", X.is_instrumental(X.norm_match("line")))


@query(
    "txt05_split_ad_lib",
    f"""WITH {TAGGED}, m AS (SELECT *, '^(.*?)\\s*(\\(([^()]{{1,60}})\\))\\s*$' AS p FROM tagged),
    h AS (SELECT *, regexp_matches(line, p) AND trim(regexp_extract(line, p, 1)) <> '' AS hit FROM m)
    SELECT p_partkey, CASE WHEN hit THEN trim(regexp_extract(line, p, 1)) ELSE line END AS main,
      CASE WHEN hit THEN trim(regexp_extract(line, p, 3)) END AS ad_lib FROM h""",
)
def txt05(spark, sf_dir):
    return tagged_lines(spark, sf_dir).select("p_partkey", X.split_ad_lib("line").alias("x")).select("p_partkey", "x.*")


RESIDUE_SQL = f"""WITH {DIALOGUE}, r AS (SELECT track_id, seq, 'WEBVTT kind' || chr(10) || '00:00:0' || (seq % 10) || '.5' || chr(10)
   || '  [00:1' || (seq % 10) || '.25] [01:00] ' || text || chr(10) || 'NOTE x' || chr(10) || '--> end' AS raw FROM dialogue)
SELECT track_id, seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
   '(?m)^\\s*(WEBVTT.*)$', '', 'g'), '(?m)^\\s*NOTE\\s.*$', '', 'g'), '(?m)^\\s*-->\\s*.*$', '', 'g'),
   '(?m)^\\s*\\d{{1,2}}:\\d{{2}}:\\d{{2}}[.,]\\d{{1,3}}\\s*$', '', 'g'), '(?m)^\\s*(\\[\\d{{1,2}}:\\d{{2}}(?:\\.\\d{{1,3}})?\\]\\s*)+', '', 'g') AS clean FROM r"""


@query("txt06_strip_timing_residue", RESIDUE_SQL)
def txt06(spark, sf_dir):
    digit = (F.col("seq") % 10).cast("string")
    raw = F.concat(
        F.lit("WEBVTT kind\n00:00:0"), digit, F.lit(".5\n  [00:1"), digit, F.lit(".25] [01:00] "), "text",
        F.lit("\nNOTE x\n--> end"),
    )
    return A.dialogue(spark, sf_dir).select("track_id", "seq", X.strip_timing_residue(raw).alias("clean"))


@query(
    "txt07_tokens",
    f"""WITH {DOC_LINES}, t AS (SELECT track_id, seq, regexp_extract_all(text, '[^\\s\\x{{A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+') AS w FROM doc_lines)
    SELECT track_id, seq, CAST(len(w) AS BIGINT) AS n_tokens, w[1] AS first_token, w[len(w)] AS last_token,
      CAST(list_max(list_transform(w, lambda x: length(x))) AS BIGINT) AS longest FROM t""",
)
def txt07(spark, sf_dir):
    t = F.col("tokens")
    return (
        A.doc_lines(spark, sf_dir)
        .withColumn("tokens", X.highlight_tokens("text"))
        .select(
            "track_id",
            "seq",
            F.size(t).cast("long").alias("n_tokens"),
            F.element_at(t, 1).alias("first_token"),
            F.element_at(t, -1).alias("last_token"),
            F.array_max(F.transform(t, F.length)).cast("long").alias("longest"),
        )
    )


@query(
    "txt08_grapheme_count",
    f"WITH {DOC_LINES} SELECT track_id, seq, CAST(length_grapheme(text) AS BIGINT) AS graphemes FROM doc_lines",
)
def txt08(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).select("track_id", "seq", X.grapheme_count("text").alias("graphemes"))


@query(
    "txt09_syllables",
    f"WITH {DOC_LINES}, s AS (SELECT track_id, seq, {sig('text')} AS sg FROM doc_lines) SELECT track_id, seq, CAST({syllables_sql('sg')} AS BIGINT) AS syllables FROM s",
)
def txt09(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir).withColumn("sg", X.norm_match("text"))
    return lines.select("track_id", "seq", X.syllables("sg").alias("syllables"))


@query(
    "txt10_speech_weight",
    f"WITH {DOC_LINES}, s AS (SELECT track_id, seq, {sig('text')} AS sg FROM doc_lines) SELECT track_id, seq, round(CAST({weight_sql('sg')} AS DOUBLE) / 10, 3) AS weight FROM s",
)
def txt10(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir).withColumn("sg", X.norm_match("text"))
    return lines.select("track_id", "seq", F.round(X.speech_weight("sg"), 3).alias("weight"))


_ABBR = "|".join(r"\.*".join(w) for w in X.ABBREVIATIONS)
_CLOSE = """[.!?''"”’)\\]]*"""


def sentences_sql(s: str) -> str:
    """Spaces are doubled first, so that neighbouring matches need not share one."""
    flat = f"replace(trim(regexp_replace({s}, '{EDGE}', ' ', 'g')), ' ', '  ')"
    kept = (
        f"regexp_replace({flat}, '(^|[^A-Za-z.])((?:\\.*(?i:{_ABBR})|\\.*[A-Z])\\.{_CLOSE})( )', '\\1\\2' || chr(2) || '\\3', 'g')"
    )
    cut = f"regexp_replace({kept}, '([.!?]{_CLOSE}) +', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split(replace(replace({cut}, chr(2), ''), '  ', ' '), chr(1)), lambda x: x <> '')"


SENTENCE_TEXT = "replace(replace(text, ' the ', ' Dr. '), ' le ', ' e.g. ')"


@query(
    "txt11_sentences",
    f"""WITH s AS (SELECT doc_id, {sentences_sql(SENTENCE_TEXT)} AS s FROM documents)
    SELECT doc_id, CAST(i AS BIGINT) AS idx, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)""",
)
def txt11(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" Dr. ")), F.lit(" le "), F.lit(" e.g. "))
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences(text)).alias("idx", "sentence")).withColumn(
        "idx", F.col("idx").cast("long")
    )


SPOKEN = """ex AS (SELECT track_id, seq, CAST(i AS BIGINT) AS line_no, ls[i + 1] AS raw FROM (SELECT track_id, seq, ls, unnest(range(0, len(ls))) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM dialogue))),
l AS (SELECT track_id, seq, line_no, trim(CASE (seq + line_no) % 5 WHEN 0 THEN 'Host: ' WHEN 1 THEN 'co-host : ' WHEN 2 THEN 'b:  ' WHEN 3 THEN 'Speaker 1: ' ELSE '' END || raw) AS line FROM ex)"""
_SPK = "(?i)^(?:(A|B)|(host|narrator|speaker\\s*1)|(guest|co-?host|speaker\\s*2))\\s*:\\s+(.+)$"


@query(
    "txt12_speaker_prefix",
    f"""WITH {DIALOGUE}, {SPOKEN}
    SELECT track_id, seq, line_no, CASE WHEN regexp_matches(line, '{_SPK}') THEN CASE WHEN upper(regexp_extract(line, '{_SPK}', 1)) = 'B'
        OR regexp_extract(line, '{_SPK}', 3) <> '' THEN 'B' ELSE 'A' END END AS speaker,
      CASE WHEN regexp_matches(line, '{_SPK}') THEN trim(regexp_extract(line, '{_SPK}', 4)) ELSE line END AS text FROM l""",
)
def txt12(spark, sf_dir):
    lines = A.dialogue(spark, sf_dir).select("track_id", "seq", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    n = (F.col("seq") + F.col("line_no")) % 5
    head = F.when(n == 0, "Host: ").when(n == 1, "co-host : ").when(n == 2, "b:  ").when(n == 3, "Speaker 1: ").otherwise("")
    out = lines.select("track_id", "seq", F.col("line_no").cast("long").alias("line_no"), X.speaker_prefix(F.concat(head, "raw")).alias("x"))
    return out.select("track_id", "seq", "line_no", "x.*")


def reading_sql(t: str, floor_ms: int = 1600) -> str:
    secs = (
        f"{n_words(t)} / 155.0 * 60 + len(regexp_extract_all({t}, '[,;:—–]')) * 0.14::DOUBLE"
        f" + greatest(0, len(regexp_extract_all({t}, '[.!?]')) - 1) * 0.24::DOUBLE + 0.35::DOUBLE"
    )
    return f"greatest({floor_ms * 1000}, {rnd(f'({secs.replace("155.0", "155.0::DOUBLE")}) * 1e6')})"


@query("txt15_reading_time", f"SELECT doc_id, {reading_sql('text')} AS reading_us FROM documents")
def txt15(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", X.reading_time_us("text").alias("reading_us"))


NARRATION_SQL = f"""WITH s AS (SELECT p_partkey, p_name AS text, CASE p_size % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'stat' WHEN 2 THEN 'bullets'
   WHEN 3 THEN 'quote' END AS layout, CAST(p_size AS VARCHAR) AS value, [p_type, ' ' || p_brand || '!'] AS items,
   CASE WHEN p_size % 4 = 0 THEN ' ' || p_brand || ' ' END AS subtext, CASE WHEN p_size % 7 = 0 THEN '  ' || p_type || ' ' END AS narration FROM part),
q AS (SELECT *, {sig("text")} AS sg FROM s)
SELECT p_partkey, CASE WHEN narration IS NOT NULL THEN trim(narration)
  WHEN regexp_matches(sg, '^({X.INSTRUMENTAL_WORDS})$') OR regexp_matches(sg, '^\\(?(music|instrumental)[^)]*\\)?$') THEN ''
  WHEN layout IS NULL THEN text WHEN layout = 'code' THEN trim(text || '. ' || trim(coalesce(subtext, '')))
  WHEN layout = 'stat' AND NOT contains(lower(text), value) THEN value || '. ' || text
  WHEN layout = 'bullets' THEN text || '. ' || items[1] || '. ' || trim(items[2]) ELSE text END AS spoken FROM q"""


@query("txt16_narration_text", NARRATION_SQL)
def txt16(spark, sf_dir):
    size = F.col("p_size")
    layout = (
        F.when(size % 6 == 0, "code").when(size % 6 == 1, "stat").when(size % 6 == 2, "bullets").when(size % 6 == 3, "quote")
    )
    scenes = A.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("text"),
        layout.alias("layout"),
        size.cast("string").alias("value"),
        F.array("p_type", F.concat(F.lit(" "), "p_brand", F.lit("!"))).alias("items"),
        F.when(size % 4 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("subtext"),
        F.when(size % 7 == 0, F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("narration"),
    )
    parts = ("text", "layout", "value", "items", "subtext", "narration")
    spoken = X.spoken_text(*[F.col(c) for c in parts], X.norm_match("text"))
    return scenes.select("p_partkey", spoken.alias("spoken"))


@query(
    "txt17_similarity",
    """WITH p AS (SELECT a.p_partkey, a.p_name || CASE WHEN a.p_size % 3 = 0 THEN ' ' || lower(a.p_type) || ' edition' ELSE '' END AS x,
      b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, round(CASE WHEN x = y THEN 1.0
       ELSE greatest(0.0, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) END::DOUBLE, 6) AS score FROM p""",
)
def txt17(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    x = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"), F.lit(" edition"))).otherwise(""))
    left = part.select("p_partkey", x.alias("x"))
    right = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    return left.join(right, "p_partkey").select("p_partkey", F.round(X.similarity("x", "y"), 6).alias("score"))


_T = "(us // 1000000)"
TIMECODE_SQL = """WITH t AS (SELECT event_id, epoch_us(ts) - 1704067200000000 - 3600000000 AS raw FROM events),
u AS (SELECT event_id, greatest(0, raw) AS us FROM t)
SELECT event_id,
  printf('%02d:%02d:%02d,%03d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us // 1000 % 1000) AS srt,
  printf('%02d:%02d:%02d.%03d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us // 1000 % 1000) AS vtt,
  printf('[%02d:%02d.%02d]', us // 60000000, us // 1000000 % 60, us // 10000 % 100) AS lrc,
  printf('%d:%02d:%02d.%02d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us // 10000 % 100) AS ass,
  printf('%02d:%02d', us // 60000000, us // 1000000 % 60) AS clock,
  printf('%02d:%02d.%02d', us // 60000000, us // 1000000 % 60, us % 1000000 // 10000) AS timecode,
  printf('%02d:%02d.%02d', us // 60000000, us // 1000000 % 60,
     CAST(floor(us / (1000000.0::DOUBLE / 30) + 1e-9) AS BIGINT) % 30) AS frames,
  us // 1000 * 1000 AS parsed FROM u"""


@query("txt18_timecodes", TIMECODE_SQL)
def txt18(spark, sf_dir):
    us = A.epoch_us("ts") - F.lit(1_704_067_200_000_000) - F.lit(A.HOUR_US)
    out = A.table(spark, sf_dir, "events").select(
        "event_id", *[C.render(us, fmt).alias(fmt) for fmt in C.FORMATS]
    )
    return out.withColumn("parsed", C.parse_clock(F.col("srt")))


@query(
    "txt19_frame_quantisation",
    f"""WITH u AS (SELECT event_id, epoch_us(ts) - 1704067200000000 AS us FROM events)
    SELECT event_id, {rnd("us / 33333.0::DOUBLE")} * 33333 AS snapped, CAST(floor(us / (1000000.0::DOUBLE / 30) + 1e-9) AS BIGINT) AS frame,
      {rnd("floor(us / (1000000.0::DOUBLE / 30) + 1e-9) * 1000000 / 30")} AS frame_us, least(86400000000, greatest(3600000000, us)) AS clamped FROM u""",
)
def txt19(spark, sf_dir):
    us = F.col("us")
    ev = A.table(spark, sf_dir, "events").select("event_id", (A.epoch_us("ts") - F.lit(1_704_067_200_000_000)).alias("us"))
    return ev.select(
        "event_id",
        C.snap_to_frame(us).alias("snapped"),
        C.frame_index(us).alias("frame"),
        C.frame_to_us(C.frame_index(us)).alias("frame_us"),
        C.clamp_us(us, 3_600_000_000, 86_400_000_000).alias("clamped"),
    )


@query(
    "txt20_confidence_tiers",
    f"""WITH {SPANS}, c AS (SELECT track_id, start_us // 86400000000 AS day, count(*) FILTER (event_type <> 'view') AS n,
       min(CASE WHEN event_type <> 'view' THEN (end_us - start_us) / 6e9 END) AS conf, CASE WHEN track_id % 2 = 0 THEN 'tap' ELSE 'asr' END AS source
       FROM spans GROUP BY ALL)
    SELECT track_id, CAST(day AS BIGINT) AS day, CASE WHEN n = 0 THEN CASE WHEN source = 'tap' THEN 'high' ELSE 'low' END
       WHEN conf > 0.7 THEN 'high' WHEN conf > 0.35 THEN 'mid' ELSE 'low' END AS tier FROM c""",
)
def txt20(spark, sf_dir):
    spans = A.spans(spark, sf_dir).withColumns(
        {"day": F.floor(F.col("start_us") / 86_400_000_000), "is_word": F.col("event_type") != "view"}
    )
    conf = (F.col("end_us") - F.col("start_us")) / F.lit(6e9)
    cues = spans.groupBy("track_id", "day").agg(
        F.count_if("is_word").alias("n"), F.min(F.when(F.col("is_word"), conf)).alias("conf")
    )
    source = F.when(F.col("track_id") % 2 == 0, "tap").otherwise("asr")
    return cues.select("track_id", "day", X.confidence_tier(F.col("n"), F.col("conf"), source).alias("tier"))


@query(
    "txt21_cue_search",
    f"WITH {DOC_LINES} SELECT track_id, seq, text FROM doc_lines WHERE contains(lower(text), 'ation')",
)
def txt21(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).filter(X.matches_search("text", "  ATION "))
