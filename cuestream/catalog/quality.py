"""Document checks over JSON built from orders, events, conversations and parts."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.assets import SETTINGS_SQL, export_settings
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import rnd
from cuestream.catalog.text import reading_sql
from cuestream.operators import quality as Q
from cuestream.operators import specs as SP
from cuestream.plans.session import spread

_LINE = {
    "id": "@LID", "text": "hello", "words": [{"id": "w", "text": "hello", "norm": "hello", "start": 0, "end": 1, "confidence": "@CONF",
     "source": "asr", "locked": False}], "start": 0, "end": 10, "sectionId": None, "locked": False, "style": {}, "speaker": None,
    "translation": None, "source": "asr",
}
_CARD = {"enabled": False, "title": "", "subtitle": "", "durationUs": 0}
_DOC = {
    "formatVersion": 3, "id": "@ID", "createdAt": 1, "updatedAt": 2,
    "meta": {"title": "@TITLE", "@ARTIST": "a", "album": "", "language": "en", "notes": ""},
    "audio": "@AUDIO", "voiceover": None,
    "lyrics": {"source": "@SOURCE", "originalText": "", "originalFileName": None, "lines": [_LINE]},
    "sections": [{"id": "s", "kind": "VERSE", "label": "Verse", "occurrence": 1}],
    "design": {
        "themeId": "t", "aspectId": "16:9", "customSize": None,
        "background": {"kind": "solid", "assetId": None, "colors": ["#000"], "motion": 0, "scrim": 0.5, "visualizerBand": 0, "visualizerGain": 1},
        "typography": {"fontStack": "x", "weight": 400, "sizeRatio": 0.05, "lineHeight": 1.2, "letterSpacing": 0, "align": "left",
            "anchor": "top", "uppercase": False, "color": "#fff", "activeColor": "#fff", "shadowBlur": 0, "shadowColor": "", "shadowOffsetY": 0,
            "outlineWidth": 0, "outlineColor": ""},
        "karaoke": {"mode": "line", "fillEase": "linear", "glow": 0, "scale": 1, "colorShift": False, "beatAware": False},
        "motion": {"enter": "fade", "exit": "fade", "enterUs": 0, "exitUs": 0, "overlapUs": 0, "intensity": 1},
        "brand": {"enabled": False, "text": "", "logoAssetId": None, "position": "top-left", "opacity": 1},
        "intro": _CARD, "outro": _CARD, "accent": None,
    },
    "export": {"presetId": "p", "width": "@W", "height": 1080, "fps": "@FPS", "videoBitrate": 8000000, "codec": "h264", "audioBitrate": 192000,
        "globalOffsetUs": 0, "rangeStartUs": 0, "rangeEndUs": 10, "includeAudio": True, "fileName": ""},
    "ui": {"mode": "simple", "zoomPxPerSecond": 60, "selection": None, "lastPlayheadUs": 0},
}
TEMPLATE = json.dumps(_DOC, separators=(",", ":"))
AUDIO = json.dumps(
    {"assetId": "a", "fileName": "f", "mimeType": "m", "bytes": 1.5, "durationUs": 1, "sampleRate": 44100, "channels": 40, "peaksAssetId": "p", "contentHash": "h"}
)


def project_docs(spark, sf_dir):
    """Project documents from orders; seven of eight carry a known defect or none."""
    k = F.col("o_orderkey") % 8
    fills = {
        '"@TITLE"': F.when(k == 1, "5").otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))),
        "@ARTIST": F.when(k == 4, "painter").otherwise("artist"),
        '"@AUDIO"': F.when(k == 6, AUDIO).otherwise("null"),
        "@SOURCE": F.when(k == 3, "web").otherwise("user"),
        "@LID": F.when(k == 5, "").otherwise("l1"),
        '"@CONF"': F.when(k == 5, "2").otherwise("0.5"),
        '"@W"': F.when(k == 2, "64").otherwise("1920"),
        '"@FPS"': F.when(k == 2, "90").otherwise("30"),
        "@ID": F.col("o_orderkey").cast("string"),
    }
    parts = re.split(f"({'|'.join(map(re.escape, fills))})", TEMPLATE)
    raw = F.concat(*[fills[p] if p in fills else F.lit(p) for p in parts])
    return spread(A.table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("project_id"), F.when(k == 7, F.lit("[1]")).otherwise(raw).alias("raw_json")
    )


@query(
    "dq01_validate_projects",
    """SELECT o_orderkey AS project_id, o_orderkey % 8 = 0 AS ok, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'meta.title' WHEN 2 THEN 'export.width,export.fps' WHEN 3 THEN 'lyrics.source'
      WHEN 4 THEN 'meta.artist' WHEN 5 THEN 'lyrics.lines.0.id,lyrics.lines.0.words.0.confidence' WHEN 6 THEN 'audio.bytes,audio.channels' ELSE '(root)' END AS paths,
      CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'invalid_type' WHEN 2 THEN 'too_small,too_big' WHEN 3 THEN 'invalid_enum_value' WHEN 4 THEN 'invalid_type' WHEN 5 THEN 'too_small,too_big'
      WHEN 6 THEN 'invalid_type,too_big' ELSE 'invalid_type' END AS codes FROM orders""",
)
def dq01(spark, sf_dir):
    out = Q.validate_documents(project_docs(spark, sf_dir))
    return out.select("project_id", "ok", F.array_join("issues.path", ",").alias("paths"), F.array_join("issues.code", ",").alias("codes"))


def prop_docs(spark, sf_dir):
    extra = F.replace("props", F.lit("}"), F.lit(', "x": 1, "a": 2}'))
    raw = F.when(F.col("event_id") % 3 == 0, extra).otherwise(F.col("props"))
    return A.table(spark, sf_dir, "events").select("event_id", raw.alias("raw_json"))


@query("dq02_reject_unknown_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,x' ELSE '' END AS unknown, event_id % 3 = 0 AS rejected FROM events")
def dq02(spark, sf_dir):
    return Q.unknown_keys(prop_docs(spark, sf_dir), ["k"], strict=True).drop("raw_json")


@query(
    "dq02_strip_unknown_keys",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,x' ELSE '' END AS unknown, '{"k":"' || (props::JSON->>'k') || '"}' AS stripped FROM events""",
)
def dq02_strip(spark, sf_dir):
    return Q.unknown_keys(prop_docs(spark, sf_dir), ["k"], strict=False).drop("raw_json")


#: Documents put together from order columns; one text for Spark and for the check.
VERSIONED = f"""CASE WHEN o_custkey % 41 = 7 THEN concat('[', o_custkey, ']')
WHEN o_custkey % 43 = 5 THEN concat('{{"id":"', o_orderkey)
ELSE concat(CASE WHEN o_orderstatus = 'P' THEN '{{"kind":"{Q.PROJECT_KIND}","project":' ELSE '' END,
  '{{"id":"', o_orderkey, '"',
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ',"formatVersion":1' WHEN '2' THEN ',"formatVersion":2' WHEN '3' THEN ',"formatVersion":3'
    WHEN '4' THEN '' ELSE concat(',"formatVersion":', o_custkey % 6) END,
  CASE WHEN o_totalprice > 120000 THEN concat(',"voiceover":{{"voiceId":"v', o_custkey, '"', CASE WHEN o_custkey % 3 = 0 THEN ',"mode":"sequential"' ELSE '' END, '}}') ELSE '' END,
  '}}', CASE WHEN o_orderstatus = 'P' THEN '}}' ELSE '' END) END"""


def versioned_docs(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.expr(VERSIONED).alias("raw_json"))


@query(
    "dq03_migrate_projects",
    f"""WITH j AS (SELECT o_orderkey AS project_id, try_cast({VERSIONED} AS JSON) AS r FROM orders),
    p AS (SELECT project_id, CASE WHEN r->>'$.kind' = '{Q.PROJECT_KIND}' THEN r->'$.project' ELSE r END AS p FROM j),
    v AS (SELECT project_id, p, coalesce(json_type(p) = 'OBJECT', false) AS obj,
      CASE WHEN json_type(p, '$.formatVersion') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (p->>'$.formatVersion')::DOUBLE ELSE 1.0::DOUBLE END AS v FROM p),
    st AS (SELECT *, CASE WHEN NOT obj THEN 'NOT_A_PROJECT' WHEN v > {Q.PROJECT_VERSION} THEN 'FUTURE_VERSION' WHEN v NOT IN (1, 2, 3) THEN 'CORRUPT' ELSE 'ok' END AS status FROM v)
    SELECT project_id, status, v AS from_version,
      CASE WHEN status = 'ok' THEN concat_ws('; ', CASE WHEN v <= 1 THEN '{Q.MIGRATIONS[1]}' END, CASE WHEN v <= 2 THEN '{Q.MIGRATIONS[2]}' END) END AS steps,
      CASE WHEN status = 'ok' AND json_type(p, '$.voiceover') = 'OBJECT' THEN coalesce(p->>'$.voiceover.mode', CASE WHEN v <= 2 THEN 'timed' END) END AS voice_mode FROM st""",
)
def dq03(spark, sf_dir):
    out = Q.migrate_documents(versioned_docs(spark, sf_dir))
    mode = F.try_element_at("voiceover", F.lit("mode"))
    return out.select("project_id", "status", "from_version", F.array_join("steps", "; ").alias("steps"), mode.alias("voice_mode"))


#: Sparse documents put together from order columns; one text for Spark and for the check.
_SPARSE_LINE = """concat('{{', concat_ws(',', CASE WHEN o_custkey % 4 = {k} THEN '"words":[]' END, CASE WHEN o_orderstatus = 'O' THEN '"speaker":null' END,
  CASE WHEN o_totalprice > {price} THEN concat('"locked":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END) END,
  CASE WHEN o_custkey % 6 < {k} + 2 THEN concat('"style":{{"n":', o_custkey, '}},"sectionId":null') END), '}}')"""
SPARSE = f"""CASE WHEN o_custkey % 37 = 3 THEN '[]' WHEN o_custkey % 41 = 7 THEN concat('{{"id":"', o_orderkey) ELSE concat('{{', concat_ws(',',
  CASE WHEN o_orderstatus <> 'P' THEN concat('"meta":{{', concat_ws(',', CASE WHEN o_custkey % 2 = 0 THEN concat('"title":"t', o_custkey, '"') END,
    CASE WHEN o_custkey % 3 = 0 THEN '"artist":null' END, CASE WHEN o_totalprice > 150000 THEN '"language":"de","notes":""' END), '}}') END,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN '"sections":[],"audio":null' END,
  CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN '"voiceover":{{"mode":"timed"}}' END,
  CASE WHEN o_custkey % 5 <> 0 THEN concat('"lyrics":{{', concat_ws(',', CASE WHEN o_custkey % 7 < 4 THEN '"source":"asr"' END,
    CASE WHEN o_totalprice < 100000 THEN '"originalText":"x"' END,
    CASE WHEN o_custkey % 11 < 9 THEN concat('"lines":[', concat_ws(',', {_SPARSE_LINE.format(k=1, price=90000)}, CASE WHEN o_custkey % 3 = 1 THEN '3' END,
      CASE WHEN o_custkey % 2 = 1 THEN {_SPARSE_LINE.format(k=2, price=160000)} END), ']') END), '}}') END,
  CASE WHEN o_custkey % 7 > 2 THEN concat('"ui":{{', CASE WHEN o_orderstatus = 'F' THEN '"mode":"full","selection":null' ELSE '' END, '}}') END,
  CASE WHEN o_custkey % 9 > 3 THEN concat('"design":{{', concat_ws(',', CASE WHEN o_custkey % 4 > 1 THEN '"brand":{{}}' END, CASE WHEN o_custkey % 8 = 2 THEN '"accent":"#fff"' END,
    CASE WHEN o_custkey % 4 = 1 THEN '"brand":7' END), '}}') END,
  CASE WHEN o_totalprice > 60000 THEN concat('"export":{{', CASE WHEN o_orderstatus = 'O' THEN '"codec":"vp9","includeAudio":false' ELSE '' END, '}}') END), '}}') END"""


def _filled_sql() -> str:
    """The report read from the JSON: which paths have no value, in order; lines one by one."""

    def path(p: str) -> str:
        gone = f"json_type(r, '$.{p}') IS NULL"
        parent = p.rsplit(".", 1)[0] if "." in p else ""
        if parent in ("design", "export", "design.brand"):
            gone += f" AND json_type(r, '$.{parent}') = 'OBJECT'"
        if parent in ("lyrics", "ui"):
            gone += f" AND json_type(r, '$.{parent}') IS NOT NULL"
        return f"CASE WHEN {gone} THEN '{p}' END"

    first = "meta meta.title meta.artist meta.album meta.language meta.notes sections audio voiceover lyrics lyrics.source lyrics.originalText lyrics.originalFileName lyrics.lines"
    late = "ui ui.mode ui.zoomPxPerSecond ui.selection ui.lastPlayheadUs design.customSize design.accent design.brand.logoAssetId export.codec export.globalOffsetUs export.includeAudio export.fileName"
    names = ", ".join(f"CASE WHEN json_type(x, '$.{n}') IS NULL THEN '{n}' END" for n in "words locked style sectionId speaker translation source".split())
    lines = f"""list_transform(CAST(r->'$.lyrics.lines' AS JSON[]), lambda x, i: CASE WHEN json_type(x) = 'OBJECT'
      THEN array_to_string(list_transform(list_filter([{names}], lambda n: n IS NOT NULL), lambda n: 'lyrics.lines[' || (i - 1) || '].' || n), ',') END)"""
    return f"""concat_ws(',', {", ".join(path(p) for p in first.split())}, nullif(array_to_string(list_filter({lines}, lambda x: x IS NOT NULL AND x <> ''), ','), ''), {", ".join(path(p) for p in late.split())})"""


@query(
    "dq04_fill_defaults",
    f"WITH j AS (SELECT o_orderkey AS project_id, try_cast({SPARSE} AS JSON) AS r FROM orders) SELECT project_id, {_filled_sql()} AS filled, coalesce(r->>'$.meta.title', '') AS title, "
    "coalesce(r->>'$.export.codec', 'h264') AS codec, coalesce(r->>'$.ui.mode', 'simple') AS mode FROM j",
)
def dq04(spark, sf_dir):
    raw = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.expr(SPARSE).alias("raw_json"))
    out = Q.fill_defaults(raw)
    fields = {name: F.col("fields")[p].alias(name) for name, p in (("title", "meta.title"), ("codec", "export.codec"), ("mode", "ui.mode"))}
    return out.select("project_id", F.array_join("filled", ",").alias("filled"), *fields.values())


#: Specs put together from conversation columns; one text for Spark and for the check.
SPEC_DOCS = """CASE WHEN conv_id % 23 = 4 AND turn = 0 THEN ' ' WHEN conv_id % 17 = 3 THEN concat('{oops', text)
ELSE concat('{', concat_ws(',', CASE WHEN turn % 3 = 1 THEN concat('"version":', conv_id % 3) END, CASE WHEN conv_id % 2 = 0 THEN concat('"fps":', length(text) % 80) END,
  CASE WHEN conv_id % 5 = 2 THEN concat('"voice":{"pauseMs":', length(text), ',"wpm":', length(text) % 500, '}') END,
  CASE WHEN conv_id % 13 <> 6 THEN concat('"scenes":[', concat_ws(',',
    concat('{"text":"', CASE WHEN length(text) % 7 = 1 THEN '' ELSE role END, '","start":', turn, ',"end":', length(text) % 6, '}'),
    CASE WHEN turn > 0 THEN concat('{"text":"', role, '"', CASE WHEN conv_id % 4 = 1 THEN ',"layout":"chart"' ELSE '' END,
      CASE WHEN conv_id % 8 < 3 THEN ',"chart":[{"label":"l","value":3}]' ELSE '' END,
      CASE length(text) % 4 WHEN 0 THEN ',"duration":"auto"' WHEN 1 THEN ',"duration":"soon"' WHEN 2 THEN concat(',"duration":', length(text)) ELSE '' END, '}') END), ']') END), '}') END"""


def spec_docs(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(SPEC_DOCS).alias("raw_json"))


_EACH = "list_transform(scenes, lambda x, i: {})"
_CROSSED = """array_to_string(list_filter([
  CASE WHEN json_type(x, '$.duration') IS NOT NULL AND NOT coalesce(x->>'$.duration' = 'auto' OR TRY_CAST(x->>'$.duration' AS DOUBLE) BETWEEN 0.000001 AND 600, false) THEN 'scenes[' || (i - 1) || '].duration' END,
  CASE WHEN TRY_CAST(x->>'$.end' AS DOUBLE) <= TRY_CAST(x->>'$.start' AS DOUBLE) THEN 'scenes[' || (i - 1) || '].end' END,
  CASE WHEN x->>'$.layout' = 'chart' AND coalesce(json_array_length(x, '$.chart'), 0) < 1 THEN 'scenes[' || (i - 1) || '].chart' END], lambda n: n IS NOT NULL), ',')"""


@query(
    "dq05_validate_specs",
    f"""WITH d AS (SELECT conv_id, turn, {SPEC_DOCS} AS raw FROM conversations), j AS (SELECT *, try_cast(raw AS JSON) AS r FROM d),
    s AS (SELECT *, CAST(r->'$.scenes' AS JSON[]) AS scenes, CAST(r->>'$.version' AS INTEGER) AS v, CAST(r->>'$.fps' AS INTEGER) AS fps, CAST(r->>'$.voice.wpm' AS INTEGER) AS wpm, CAST(r->>'$.voice.pauseMs' AS INTEGER) AS pause FROM j),
    p AS (SELECT conv_id, turn, CASE WHEN trim(raw) = '' THEN '(root)' WHEN r IS NULL THEN 'JSON' WHEN v > {Q.SPEC_VERSION} THEN 'version'
      ELSE concat_ws(',', CASE WHEN v < 1 THEN 'version' END, CASE WHEN fps NOT BETWEEN 12 AND 60 THEN 'fps' END, CASE WHEN pause > 5000 THEN 'voice.pauseMs' END, CASE WHEN wpm NOT BETWEEN 60 AND 360 THEN 'voice.wpm' END,
        CASE WHEN scenes IS NULL THEN 'scenes' END,
        nullif(array_to_string(list_filter({_EACH.format("CASE WHEN x->>'$.text' = '' THEN 'scenes[' || (i - 1) || '].text' END")}, lambda n: n IS NOT NULL), ','), ''),
        nullif(array_to_string(list_filter({_EACH.format(_CROSSED)}, lambda n: n <> ''), ','), '')) END AS paths FROM s)
    SELECT conv_id, turn, paths = '' AS ok, paths FROM p""",
)
def dq05(spark, sf_dir):
    out = Q.validate_specs(spec_docs(spark, sf_dir))
    return out.select("conv_id", "turn", "ok", F.array_join("issues.path", ",").alias("paths"))


#: Documents put together from event columns; one text for Spark and for the check.
ROUTED = f"""CASE WHEN value < 12 THEN substr(props, 1, length(props) - 1) WHEN value > 180 THEN concat('[', props, ']')
WHEN event_type = 'click' THEN concat('{{"kind":"{Q.SPEC_KIND}","user":', user_id, ',"props":', props, '}}')
WHEN event_type = 'view' THEN concat('{{"scenes":[', props, '],"kind":', CASE WHEN user_id % 2 = 0 THEN '"{Q.PROJECT_KIND}"' ELSE '"other"' END, '}}')
WHEN event_type = 'purchase' THEN concat('{{"scenes":[', props, ',', props, ']}}')
WHEN event_type = 'error' THEN concat('{{"scenes":', props, '}}') ELSE props END"""


@query(
    "dq06_route_documents",
    f"""WITH j AS (SELECT event_id, try_cast({ROUTED} AS JSON) AS r FROM events)
    SELECT event_id, CASE WHEN coalesce(json_type(r), '') <> 'OBJECT' THEN 'other' WHEN r->>'$.kind' = '{Q.SPEC_KIND}' THEN 'spec'
      WHEN r->>'$.kind' = '{Q.PROJECT_KIND}' THEN 'project' WHEN json_type(r, '$.scenes') = 'ARRAY' THEN 'spec' ELSE 'other' END AS route FROM j""",
)
def dq06(spark, sf_dir):
    raw = A.table(spark, sf_dir, "events").select("event_id", F.expr(ROUTED).alias("raw_json"))
    return Q.route_documents(raw).drop("raw_json")


def part_specs(spark, sf_dir):
    """A four-scene spec per part."""
    raw = F.format_string(
        '{"voice":{"pauseMs":500},"scenes":[{"id":"a","text":"%s","section":"Verse","start":1.5},{"text":"%s","duration":2},'
        '{"text":"%s","section":"pre chorus","end":%d,"pauseAfter":1,"layout":"stat"},{"text":"the end, of it all.","section":"Verse","duration":"auto","speaker":"B"}]}',
        "p_name", "p_brand", "p_type", "p_size",
    )
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), raw.alias("raw_json"))


COMPILED = f"""a AS (SELECT p_partkey AS track_id, p_name, p_brand, p_type, p_size, 1500000 AS s0, 1500000 + {reading_sql("p_name")} AS e0 FROM part),
b AS (SELECT *, e0 + 500000 AS s1, e0 + 2500000 AS e1 FROM a), c AS (SELECT *, e1 + 500000 AS s2, greatest(e1 + 700000, p_size * 1000000) AS e2 FROM b),
d AS (SELECT *, e2 + 1000000 AS s3, e2 + 1000000 + {reading_sql("'the end, of it all.'")} AS e3 FROM c),
cues AS (SELECT track_id, 0 AS seq, 'a' AS cue_id, p_name AS text, s0 AS start_us, e0 AS end_us, 'VERSE' AS section_kind, 1 AS section_no, 'human' AS source FROM d
  UNION ALL SELECT track_id, 1, 'scn_1', p_brand, s1, e1, NULL, NULL, 'human' FROM d UNION ALL SELECT track_id, 2, 'scn_2', p_type, s2, e2, 'PRE_CHORUS', 2, 'human' FROM d
  UNION ALL SELECT track_id, 3, 'scn_3', 'the end, of it all.', s3, e3, 'VERSE', 1, 'estimate' FROM d)"""


@query(
    "dq07_compile_specs",
    f"WITH {COMPILED} SELECT track_id, CAST(seq AS BIGINT) AS seq, cue_id, text, start_us, end_us, section_kind, CAST(section_no AS BIGINT) AS section_no, source FROM cues",
)
def dq07(spark, sf_dir):
    cues = SP.compile_specs(part_specs(spark, sf_dir))
    return cues.select("track_id", "seq", "cue_id", "text", "start_us", "end_us", "section_kind", "section_no", "source")


@query(
    "dq07_cues_to_specs",
    f"""WITH {COMPILED} SELECT track_id, CAST(seq AS BIGINT) AS seq, cue_id AS id, CASE WHEN seq = 2 THEN 'stat' END AS layout, {rnd("start_us / 1e4::DOUBLE")} / 100.0::DOUBLE AS start,
      {rnd("end_us / 1e4::DOUBLE")} / 100.0::DOUBLE AS "end", CASE WHEN seq = 3 THEN 'B' END AS speaker FROM cues""",
)
def dq07_back(spark, sf_dir):
    scenes = SP.cue_specs(SP.compile_specs(part_specs(spark, sf_dir)))
    parsed = F.from_json("scene_json", "id string, layout string, start double, `end` double, speaker string")
    return scenes.select("track_id", "seq", parsed.alias("s")).select("track_id", "seq", "s.*")


_AUDIT = """concat_ws(',', CASE WHEN w < 128 OR height < 128 THEN 'too_small' END, CASE WHEN w > 7680 OR height > 4320 THEN 'above_8k' END, CASE WHEN w % 2 <> 0 OR height % 2 <> 0 THEN 'odd_size' END,
   CASE WHEN f < 12 OR f > 60 THEN 'frame_rate' END, CASE WHEN vb < 500000 THEN 'low_video_bitrate' END, CASE WHEN vb > 60000000 THEN 'high_video_bitrate' END,
   CASE WHEN e <= s THEN 'empty_range' END, CASE WHEN ab < 48000 THEN 'low_audio_bitrate' END)"""


@query(
    "dq08_export_audit",
    f"""WITH {SETTINGS_SQL}, x AS (SELECT *, width + l_linenumber - 1 AS w, fps + l_orderkey % 40 AS f, video_bitrate * (l_orderkey % 3) AS vb, audio_bitrate - l_orderkey % 150000 AS ab FROM st)
    SELECT l_orderkey, l_linenumber, {_AUDIT} AS problems FROM x""",
)
def dq08(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = export_settings(spark, sf_dir).withColumns(
        {
            "width": F.col("width") + F.col("l_linenumber") - 1,
            "fps": F.col("fps") + k % 40,
            "video_bitrate": F.col("video_bitrate") * (k % 3),
            "audio_bitrate": F.col("audio_bitrate") - k % 150_000,
        }
    )
    return Q.audit_export(rows).select("l_orderkey", "l_linenumber", "problems")
