"""Readers and writers over files built from documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import DIALOGUE, SPANS
from cuestream.catalog.text import EDGE
from cuestream.functions import text as X
from cuestream.functions import timecode as C
from cuestream.operators import matching as M
from cuestream.sinks import subtitles as SK
from cuestream.sources import audio as AU
from cuestream.sources import recogniser as R
from cuestream.sources import timed_text as TT

STEP, LENGTH = 3_250_000, 2_500_000


def documents(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.split("text", "\n").alias("ls"))


def joined(lines, separator="\n"):
    return F.array_join(lines, separator)


def disp(expr: str) -> str:
    return f"regexp_replace(regexp_replace(replace(regexp_replace(nfc_normalize({expr}), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), chr(9), '    '), ' {{2,}}', ' ', 'g'), '^{EDGE}|{EDGE}$', '', 'g')"


LN = f"""ln AS (SELECT file, i, {disp("raw")} AS text, i * {STEP} AS s, i * {STEP} + {LENGTH} AS e FROM (SELECT doc_id AS file, ls[k] AS raw, k - 1 AS i FROM
   (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))),
cue AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS cue_seq FROM ln WHERE text <> '')"""


def at(i):
    return i.cast("long") * STEP


HEADS = ("WEBVTT\n\n", "[Script Info]\n", "[00:01.00]x\n", "1\n00:00:01,000 --> 00:00:02,000\nx\n", '[{"text": "a"}]\n', "")
EXTENSIONS = (".txt", ".lrc", ".srt", ".json", "", ".SSA", ".vtt")


@query(
    "src01_detect_format",
    """SELECT doc_id AS file, CASE doc_id % 7 WHEN 1 THEN 'lrc' WHEN 2 THEN 'srt' WHEN 3 THEN 'json' WHEN 5 THEN 'ass' WHEN 6 THEN 'vtt'
       ELSE CASE doc_id % 6 WHEN 0 THEN 'vtt' WHEN 1 THEN 'ass' WHEN 2 THEN 'lrc' WHEN 3 THEN 'srt' WHEN 4 THEN 'json' ELSE 'txt' END END AS format FROM documents""",
)
def src01(spark, sf_dir):
    heads, exts = F.array(*[F.lit(h) for h in HEADS]), F.array(*[F.lit(x) for x in EXTENSIONS])
    n = F.col("doc_id")
    name = F.concat(F.lit("file"), n.cast("string"), F.element_at(exts, (n % 7 + 1).cast("int")))
    body = F.concat(F.element_at(heads, (n % 6 + 1).cast("int")), F.lit("x "), "text")
    return A.table(spark, sf_dir, "documents").select(n.alias("file"), TT.detect_format(name, body).alias("format"))


def lrc_files(spark, sf_dir, enhanced=False):
    def line(raw, i):
        body = raw
        if enhanced:
            tokens = X.highlight_tokens(raw)
            body = F.array_join(
                F.transform(tokens, lambda w, k: F.concat(F.translate(C.lrc_stamp(at(i) + k.cast("long") * 20_000), "[]", "<>"), w)), " "
            )
        return F.concat(C.lrc_stamp(at(i)), body)

    body = joined(F.transform("ls", line))
    head = F.concat(F.lit("[ti:Doc "), F.col("file").cast("string"), F.lit("]\n[ar: Someone ]\n[offset:"), F.when(F.col("file") % 3 == 0, "x").otherwise("200"), F.lit("]\n"))
    return documents(spark, sf_dir).select("file", F.concat(head, body).alias("contents"))


@query("src02_lrc_cues", f"WITH {LN} SELECT file, cue_seq, text, s AS start_us FROM cue")
def src02(spark, sf_dir):
    return TT.parse_lrc(lrc_files(spark, sf_dir)).select("file", "cue_seq", "text", "start_us")


@query(
    "src02_lrc_meta",
    "SELECT doc_id AS file, 'Doc ' || doc_id AS title, 'Someone' AS artist, CASE WHEN doc_id % 3 <> 0 THEN CAST(-200000 AS BIGINT) END AS offset_us, CAST(doc_id % 3 = 0 AS BIGINT) AS n_warnings FROM documents",
)
def src02_meta(spark, sf_dir):
    return TT.lrc_meta(lrc_files(spark, sf_dir)).drop("album")


_NAMES = ("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN concat('Own ', doc_id) END AS title", "CASE WHEN lang = 'en' THEN source END AS artist")


@query(
    "tim26_title_artist",
    f"SELECT doc_id AS file, coalesce(nullif(trim(title), ''), 'Doc ' || doc_id) AS title, coalesce(artist, 'Someone') AS artist FROM (SELECT doc_id, {', '.join(_NAMES)} FROM documents)",
)
def tim26_names(spark, sf_dir):
    """Titles and artists of imported lyric files, for projects that have none."""
    own = A.table(spark, sf_dir, "documents").selectExpr("doc_id AS file", *_NAMES)
    return M.fill_blank_names(own, TT.lrc_meta(lrc_files(spark, sf_dir)))


ENH = f"""{LN}, tk AS (SELECT file, cue_seq, s, regexp_extract_all(text, '[^\\s\\x{{A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+') AS w FROM cue)"""


@query(
    "src03_enhanced_lrc_words",
    f"""WITH {ENH} SELECT file, cue_seq, CASE WHEN len(w) < 2 THEN 0 ELSE len(w) END AS n_words, CASE WHEN len(w) >= 2 THEN w[1] END AS first_word,
      CASE WHEN len(w) >= 2 THEN s + 20000 END AS first_end, CASE WHEN len(w) >= 2 THEN s + (len(w) - 1) * 20000 END AS last_end FROM tk""",
)
def src03(spark, sf_dir):
    cues = TT.parse_lrc(lrc_files(spark, sf_dir, enhanced=True))
    first, last = F.get("words", F.lit(0)), F.try_element_at("words", F.lit(-1))
    return cues.select(
        "file", "cue_seq", F.size("words").cast("long").alias("n_words"), first["text"].alias("first_word"),
        first["end_us"].alias("first_end"), last["end_us"].alias("last_end"),
    )


def block_files(spark, sf_dir, fmt):
    stamp = C.srt_stamp if fmt == "srt" else C.vtt_stamp

    def block(raw, i):
        body = raw
        if fmt == "vtt":
            tokens = X.highlight_tokens(raw)
            body = F.array_join(
                F.transform(tokens, lambda w, k: F.concat(F.lit("<"), C.vtt_stamp(at(i) + k.cast("long") * 1_000), F.lit(">"), w)), " "
            )
        span = F.concat(stamp(at(i)), F.lit(" --> "), stamp(at(i) + LENGTH))
        return F.concat_ws("\n", (i + 1).cast("string"), span, body)

    head = "WEBVTT\n\nNOTE nothing\n\nSTYLE x\n\n" if fmt == "vtt" else ""
    return documents(spark, sf_dir).select("file", F.concat(F.lit(head), joined(F.transform("ls", block), "\n\n")).alias("contents"))


@query("src04_srt_cues", f"WITH {LN} SELECT file, cue_seq, text, s AS start_us, e AS end_us FROM cue")
def src04(spark, sf_dir):
    return TT.parse_srt_vtt(block_files(spark, sf_dir, "srt"), "srt").drop("words")


@query("src04_skipped_blocks", f"WITH {LN} SELECT file, count(*) FILTER (text = '') AS n_skipped FROM ln GROUP BY file")
def src04_skipped(spark, sf_dir):
    return TT.skipped_blocks(block_files(spark, sf_dir, "srt"), "srt")


@query(
    "src05_vtt_words",
    f"""WITH {ENH} SELECT file, cue_seq, CASE WHEN len(w) < 2 THEN 0 ELSE len(w) END AS n_words, CASE WHEN len(w) >= 2 THEN w[len(w)] END AS last_word,
      CASE WHEN len(w) >= 2 THEN s + (len(w) - 1) * 1000 END AS last_start, CASE WHEN len(w) >= 2 THEN s + (len(w) - 1) * 1000 END AS last_end FROM tk""",
)
def src05(spark, sf_dir):
    cues = TT.parse_srt_vtt(block_files(spark, sf_dir, "vtt"), "vtt")
    last = F.try_element_at("words", F.lit(-1))
    return cues.select(
        "file", "cue_seq", F.size("words").cast("long").alias("n_words"), last["text"].alias("last_word"),
        last["start_us"].alias("last_start"), last["end_us"].alias("last_end"),
    )


def ass_files(spark, sf_dir):
    def line(raw, i):
        plain = raw
        for old, new in zip("{}\\", "()/", strict=True):
            plain = F.replace(plain, F.lit(old), F.lit(new))
        marks = F.array(*[F.lit(f"{{\\kf{n}}}") for n in range(1, 8)])
        sung = F.array_join(F.transform(X.highlight_tokens(plain), lambda w, k: F.concat(F.get(marks, k % 7), w)), " ")
        return F.concat(
            F.lit("Dialogue: 0,"), C.ass_stamp(at(i)), F.lit(","), C.ass_stamp(at(i) + LENGTH), F.lit(",Default,,0,0,0,,"), sung
        )

    head = F.concat(F.lit("[Script Info]\nTitle: Doc "), F.col("file").cast("string"), F.lit("\n\n[Events]\nFormat: x\nDialogue: broken\n"))
    return documents(spark, sf_dir).select("file", F.concat(head, joined(F.transform("ls", line))).alias("contents"))


ASS = f"""{LN}, tk AS (SELECT file, cue_seq, s, e, regexp_extract_all(translate(text, '{{}}\\', '()/'), '[^\\s\\x{{A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+') AS w FROM cue)"""


@query(
    "src06_ass_cues",
    f"WITH {ASS} SELECT file, cue_seq, array_to_string(w, ' ') AS text, s AS start_us, e AS end_us FROM tk",
)
def src06(spark, sf_dir):
    return TT.parse_ass(ass_files(spark, sf_dir)).drop("words")


@query("src06_ass_notes", "SELECT doc_id AS file, 'Doc ' || doc_id AS title, CAST(1 AS BIGINT) AS n_warnings FROM documents")
def src06_notes(spark, sf_dir):
    return TT.ass_notes(ass_files(spark, sf_dir))


@query(
    "src07_karaoke_words",
    f"""WITH {ASS}, k AS (SELECT *, list_sum(list_transform(range(0, len(w)), lambda i: (i % 7 + 1) * 10000)) AS total FROM tk)
    SELECT file, cue_seq, len(w) AS n_words, w[len(w)] AS last_word, CAST(s + total - ((len(w) - 1) % 7 + 1) * 10000 AS BIGINT) AS last_start, CAST(s + total AS BIGINT) AS last_end FROM k""",
)
def src07(spark, sf_dir):
    last = F.try_element_at("words", F.lit(-1))
    return TT.parse_ass(ass_files(spark, sf_dir)).select(
        "file", "cue_seq", F.size("words").cast("long").alias("n_words"), last["text"].alias("last_word"),
        last["start_us"].alias("last_start"), last["end_us"].alias("last_end"),
    )


def json_files(spark, sf_dir):
    n = F.col("file")
    scale = F.when(n % 3 == 0, 1e6).when(n % 3 == 1, 1e3).otherwise(1.0)

    def entry(raw, i):
        start = at(i)
        return F.struct(raw.alias("text"), (start / scale).alias("start"), C.clock(start + 61_000_000).alias("end"))

    kept = F.filter("ls", lambda x: x != "")
    body = F.to_json(F.transform(kept, entry))
    wrapped = F.concat(F.lit('{"timeUnit":'), F.when(n % 3 == 2, '"microseconds"').otherwise("null"), F.lit(',"cues":'), body, F.lit("}"))
    return documents(spark, sf_dir).select("file", wrapped.alias("contents"))


JSONC = f"""raw AS (SELECT doc_id AS file, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
jl AS (SELECT file, k - 1 AS i, {disp("ls[k]")} AS text, max(k - 1) OVER (PARTITION BY file) AS top FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM raw)),
un AS (SELECT *, CASE file % 3 WHEN 2 THEN 'microseconds' WHEN 0 THEN CASE WHEN top * {STEP} = 0 THEN 'microseconds' WHEN top * {STEP} / 1e6 < 10000 THEN 'seconds' ELSE 'milliseconds' END
   ELSE CASE WHEN top * {STEP} = 0 THEN 'microseconds' WHEN top * {STEP} / 1e3 < 10000 THEN 'seconds' WHEN top * {STEP} / 1e3 < 1e7 THEN 'milliseconds' ELSE 'microseconds' END END AS unit FROM jl),
js AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS cue_seq,
   CAST(floor(i * {STEP} / CASE file % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1 END * CASE unit WHEN 'seconds' THEN 1e6 WHEN 'milliseconds' THEN 1e3 ELSE 1 END + 0.5) AS BIGINT) AS start_us FROM un WHERE text <> '')"""


@query(
    "src08_json_cues",
    f"WITH {JSONC} SELECT file, cue_seq, text, start_us, CASE WHEN (i * {STEP} + 61000000) // 60000000 < 100 THEN CASE WHEN (i * {STEP} + 61000000) // 60000000 <= 59 THEN (i * {STEP} + 61000000) // 1000000 * 1000000 END END AS end_us FROM js",
)
def src08(spark, sf_dir):
    return TT.parse_json(json_files(spark, sf_dir)).drop("words")


@query(
    "src09_time_units",
    """WITH m AS (SELECT o_custkey, max(o_totalprice * CASE o_custkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 100000 END) AS top FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN 'milliseconds' WHEN top <= 0 THEN 'microseconds' WHEN top < 10000 THEN 'seconds' WHEN top < 10000000 THEN 'milliseconds' ELSE 'microseconds' END AS unit FROM m""",
)
def src09(spark, sf_dir):
    key = F.col("o_custkey")
    factor = F.when(key % 3 == 0, 0.001).when(key % 3 == 1, 1.0).otherwise(100_000.0)
    top = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.col("o_totalprice") * factor).alias("top"))
    declared = F.when(key % 10 == 0, "milliseconds")
    return top.select("o_custkey", TT.infer_unit(F.col("top"), declared).alias("unit"))


@query("src10_plain_text", f"WITH {LN} SELECT file, cue_seq, text FROM cue")
def src10(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("contents"))
    return TT.parse_txt(docs).select("file", "cue_seq", "text")


@query(
    "src11_import_report",
    f"WITH {LN} SELECT file, count(*) AS n_cues, bool_or(i % 4 <> 0) AS has_timings, avg(CAST(i % 4 <> 0 AS DOUBLE)) AS coverage FROM cue GROUP BY file",
)
def src11(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir).select(F.col("track_id").alias("file"), F.when(F.col("seq") % 4 != 0, F.col("seq")).alias("start_us"))
    return TT.import_report(lines)


@query(
    "src01_mixed_folder",
    f"""WITH {LN}, f AS (SELECT doc_id, ['lrc', 'srt', 'vtt', 'ass', 'txt', 'project'][doc_id % 6 + 1] AS format FROM documents), c AS (SELECT file, count(*) AS n FROM cue GROUP BY file)
    SELECT 'd' || doc_id || '.' || CASE format WHEN 'project' THEN 'json' ELSE format END AS file, format, CASE WHEN format = 'project' THEN 0 ELSE coalesce(n, 0) END AS n_cues,
      format NOT IN ('txt', 'project') AND n > 0 AS has_timings, CASE WHEN format NOT IN ('txt', 'project') AND n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage FROM f LEFT JOIN c ON c.file = f.doc_id""",
)
def src01_folder(spark, sf_dir):
    """A folder of files in all formats, project documents among them."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("contents"))
    project = F.concat(F.lit('{"kind":"'), F.lit(TT.PROJECT_KIND), F.lit('","project":{"id":"'), F.col("file").cast("string"), F.lit('"}}'))
    kinds = {
        "lrc": lrc_files(spark, sf_dir), "srt": block_files(spark, sf_dir, "srt"), "vtt": block_files(spark, sf_dir, "vtt"),
        "ass": ass_files(spark, sf_dir), "txt": docs, "json": docs.withColumn("contents", project),
    }
    files = None
    for k, (ext, df) in enumerate(kinds.items()):
        own = df.filter(F.col("file") % 6 == k).select(F.concat(F.lit("d"), F.col("file").cast("string"), F.lit(f".{ext}")).alias("file"), "contents")
        files = own if files is None else files.unionByName(own)
    return TT.import_files(files)


@query(
    "src12_recogniser_segments",
    f"""WITH {SPANS}, s AS (SELECT track_id, cue_id AS seg_idx, event_type AS text, (start_us - 1704067200000000) / 1e3 AS t0, (end_us - 1704067200000000) / 1e3 AS t1 FROM spans),
    d AS (SELECT track_id, 1900000000000 + track_id * 1000000000 AS dur FROM s GROUP BY track_id), c AS (SELECT s.*, dur, greatest(0, CAST(floor(t0 * 1000 + 0.5) AS BIGINT)) AS a FROM s JOIN d USING (track_id) WHERE text <> 'error')
    SELECT track_id, seg_idx, text, a AS start_us, least(greatest(a, CAST(floor(t1 * 1000 + 0.5) AS BIGINT)), dur) AS end_us FROM c WHERE a < dur""",
)
def src12(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    base = F.lit(1_704_067_200_000_000)
    segments = spans.select(
        "track_id", F.col("cue_id").alias("seg_idx"), F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"),
        ((F.col("start_us") - base) / F.lit(1e3)).alias("t0_ms"), ((F.col("end_us") - base) / F.lit(1e3)).alias("t1_ms"),
    )
    tracks = spans.groupBy("track_id").agg(F.lit(0).alias("z")).select("track_id", (F.lit(1_900_000_000_000) + F.col("track_id") * 1_000_000_000).alias("duration_us"))
    return R.segments_to_cues(segments, tracks)


_A, _I, _T = ("'" + "', '".join(x) + "'" for x in (AU.AUDIO_EXTENSIONS, AU.IMAGE_EXTENSIONS, AU.TEXT_EXTENSIONS))
NAME = "url || CASE page_id % 5 WHEN 0 THEN '/song.MP3' WHEN 1 THEN '/cover.png' WHEN 2 THEN '/words.lrc' WHEN 3 THEN '/data.bin' ELSE '' END"


@query(
    "src13_intake_audit",
    f"""WITH p AS (SELECT page_id, lower(string_split({NAME}, '.')[-1]) AS ext, CASE WHEN page_id % 7 = 0 THEN 'Video/mp4; codecs=x' ELSE '' END AS mime,
        CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) * (page_id % 9) * 20000 END AS size, page_id * 4000000 - 40000000 AS dur FROM pages),
    k AS (SELECT *, CASE WHEN ext IN ({_A}) OR mime <> '' THEN 'audio' WHEN ext IN ({_I}) THEN 'image' WHEN ext IN ({_T}) THEN 'lyrics' ELSE 'unknown' END AS kind FROM p)
    SELECT page_id, kind, CASE WHEN size = 0 THEN 'AUDIO_EMPTY' WHEN kind IN ('lyrics', 'image') THEN 'AUDIO_UNSUPPORTED_FORMAT' WHEN size > {AU.MAX_BYTES} THEN 'AUDIO_TOO_LARGE' WHEN size > {AU.SOFT_BYTES} THEN 'warn_large' ELSE 'ok' END AS verdict,
      CASE WHEN dur <= 0 THEN 'AUDIO_EMPTY' WHEN dur > {AU.MAX_DURATION_US} THEN 'AUDIO_TOO_LONG' WHEN dur > {AU.SOFT_DURATION_US} THEN 'warn_long' ELSE 'ok' END AS duration_verdict FROM k""",
)
def src13(spark, sf_dir):
    n = F.col("page_id")
    tail = F.when(n % 5 == 0, "/song.MP3").when(n % 5 == 1, "/cover.png").when(n % 5 == 2, "/words.lrc").when(n % 5 == 3, "/data.bin").otherwise("")
    mime = F.when(n % 7 == 0, "Video/mp4; codecs=x").otherwise("")
    size = F.when(n % 11 == 0, 0).otherwise(F.length("html") * (n % 9) * 20_000)
    pages = A.table(spark, sf_dir, "pages").select("page_id", AU.file_kind(F.concat("url", tail), mime).alias("kind"), size.alias("size"))
    return pages.select(
        "page_id", "kind", AU.intake_verdict(F.col("kind"), F.col("size")).alias("verdict"),
        AU.duration_verdict(n * 4_000_000 - 40_000_000).alias("duration_verdict"),
    )


OFFSET = -2_000_000


def sink_cues(spark, sf_dir, words=False):
    """Dialogue turns as cues: the text on one line, every seventh blank, optional words with confidence."""
    n = F.col("seq")
    text = F.when(n % 7 == 6, " ").otherwise(F.regexp_replace("text", r"\s+", " "))
    cues = A.dialogue(spark, sf_dir).select(
        "track_id", n.alias("cue_id"), F.trim(text).alias("text"), "speaker", (n * 4_000_000).alias("start_us"), (n * 4_000_000 + 3_500_000).alias("end_us"), F.lit("asr").alias("source")
    )
    if words:
        made = F.transform(
            X.highlight_tokens("text"),
            lambda w, i: F.struct(
                w.alias("text"), (F.col("start_us") + i * 90_000).alias("start_us"), (F.col("start_us") + i * 90_000 + 60_000).alias("end_us"),
                (F.lit(0.9) - (i % 5) / F.lit(10.0)).alias("confidence"),
            ),
        )
        cues = cues.withColumn("words", F.when(F.col("cue_id") % 3 == 1, F.array().cast("array<struct<text:string,start_us:bigint,end_us:bigint,confidence:double>>")).otherwise(made))
    return SK.select_cues(cues, OFFSET)


SINK = f"""{DIALOGUE}, sc AS (SELECT track_id, seq AS cue_id, trim(CASE WHEN seq % 7 = 6 THEN ' ' ELSE regexp_replace(text, '\\s+', ' ', 'g') END) AS text, speaker, seq * 4000000 AS s0, seq * 4000000 + 3500000 AS e0 FROM dialogue),
cs AS (SELECT *, greatest(0, s0 + {OFFSET}) AS s, greatest(s0, e0 + {OFFSET}) AS e, row_number() OVER (PARTITION BY track_id ORDER BY greatest(0, s0 + {OFFSET}), cue_id) AS n,
   CASE WHEN cue_id % 3 = 1 THEN [] ELSE regexp_extract_all(text, '\\S+') END AS w FROM sc WHERE text <> '')"""
_HMS = "printf('%02d:%02d:%02d{0}%03d', {1} // 3600000000, {1} // 60000000 % 60, {1} // 1000000 % 60, {1} // 1000 % 1000)"
_LRC = "printf('%02d:%02d.%02d', {0} // 60000000, {0} // 1000000 % 60, {0} // 10000 % 100)"
_ASSS = "printf('%d:%02d:%02d.%02d', {0} // 3600000000, {0} // 60000000 % 60, {0} // 1000000 % 60, {0} // 10000 % 100)"


def _wordlist(stamp: str, sep: str) -> str:
    tags = f"array_to_string(list_transform(range(0, len(w)), lambda i: '<' || {stamp} || '>' || w[i + 1]), '{sep}')"
    return f"CASE WHEN len(w) > 0 THEN {tags} ELSE text END"


@query("snk07_select_cues", f"WITH {SINK} SELECT track_id, cue_id, s AS start_us, e AS end_us FROM cs")
def snk07(spark, sf_dir):
    return sink_cues(spark, sf_dir).select("track_id", "cue_id", "start_us", "end_us")


@query("snk01_lrc", f"WITH {SINK} SELECT track_id, cue_id, '[' || {_LRC.format('s')} || ']' || text AS line FROM cs")
def snk01(spark, sf_dir):
    return SK.lrc_lines(sink_cues(spark, sf_dir)).select("track_id", "cue_id", "line")


@query(
    "snk02_enhanced_lrc",
    f"WITH {SINK} SELECT track_id, cue_id, '[' || {_LRC.format('s')} || ']' || {_wordlist(_LRC.format('(s0 + i * 90000)'), '')} AS line FROM cs",
)
def snk02(spark, sf_dir):
    return SK.enhanced_lrc_lines(sink_cues(spark, sf_dir, words=True)).select("track_id", "cue_id", "line")


@query(
    "snk03_srt",
    f"WITH {SINK} SELECT track_id, cue_id, n || chr(10) || {_HMS.format(',', 's')} || ' --> ' || {_HMS.format(',', 'e')} || chr(10) || text || chr(10) AS line FROM cs",
)
def snk03(spark, sf_dir):
    return SK.srt_lines(SK.number_cues(sink_cues(spark, sf_dir))).select("track_id", "cue_id", "line")


@query(
    "snk04_vtt",
    f"WITH {SINK} SELECT track_id, cue_id, 'cue-' || n || chr(10) || {_HMS.format('.', 's')} || ' --> ' || {_HMS.format('.', 'e')} || chr(10) || {_wordlist(_HMS.format('.', '(s0 + i * 90000)'), ' ')} || chr(10) AS line FROM cs",
)
def snk04(spark, sf_dir):
    return SK.vtt_lines(SK.number_cues(sink_cues(spark, sf_dir, words=True))).select("track_id", "cue_id", "line")


@query(
    "snk05_ass",
    f"""WITH {SINK} SELECT track_id, cue_id, 'Dialogue: 0,' || {_ASSS.format('s')} || ',' || {_ASSS.format('e')} || ',Default,,0,0,0,,' || CASE WHEN speaker = 'B' THEN '{{\\fad(120,120)}}' ELSE '' END
      || CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '{{\\kf6}}' || x), ' ') ELSE text END AS line FROM cs""",
)
def snk05(spark, sf_dir):
    return SK.ass_lines(sink_cues(spark, sf_dir, words=True)).select("track_id", "cue_id", "line")


@query("snk06_plain_text", f"WITH {SINK} SELECT track_id, cue_id, text AS line FROM cs")
def snk06(spark, sf_dir):
    return SK.plain_lines(sink_cues(spark, sf_dir)).select("track_id", "cue_id", "line")


@query(
    "snk06_timed_json",
    f"""WITH {SINK} SELECT track_id, cue_id, text, s AS start, e AS "end", round(CASE WHEN len(w) = 0 THEN 1.0 ELSE 0.9 - least(4, len(w) - 1) / 10.0 END::DOUBLE, 9) AS confidence, len(w) AS n_words FROM cs""",
)
def snk06_json(spark, sf_dir):
    lines = SK.timed_json_lines(sink_cues(spark, sf_dir, words=True))
    parsed = F.from_json("line", "text string, start bigint, `end` bigint, confidence double, words array<struct<text:string>>")
    out = lines.select("track_id", "cue_id", parsed.alias("p"))
    return out.select(
        "track_id", "cue_id", "p.text", "p.start", "p.end", F.round("p.confidence", 9).alias("confidence"), F.size("p.words").cast("long").alias("n_words")
    )


@query(
    "snk08_safe_names",
    f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS artist, CASE WHEN doc_id % 10 = 0 THEN '???' ELSE text END AS title FROM documents),
    b AS (SELECT doc_id, title, CASE WHEN artist = '' THEN title WHEN title = '' THEN artist ELSE artist || ' - ' || title END AS base FROM n),
    s AS (SELECT doc_id, title, regexp_replace(trim(regexp_replace(strip_accents(base), '[^\\w\\s-]', '', 'g')), '\\s+', '-', 'g') AS nm FROM b)
    SELECT doc_id, CASE WHEN nm = '' THEN 'lyric-video' ELSE nm END || '-' || doc_id || '.srt' AS name,
      CASE WHEN regexp_replace(title, '[\\\\/:*?"<>|]', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1f]', '', 'g'), '{EDGE}', ' ', 'g'), '^ | $', '', 'g') END AS shown FROM s""",
)
def snk08(spark, sf_dir):
    n = F.col("doc_id")
    artist = F.when(n % 3 == 0, "").otherwise(F.col("lang"))
    title = F.when(n % 10 == 0, "???").otherwise(F.col("text"))
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", X.safe_name(artist, title, n, ".srt").alias("name"), X.sanitize_file_name(title).alias("shown")
    )


@query(
    "snk09_project_bundles",
    """WITH a AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS project_id, 'demo.project' AS kind, c_name AS name, coalesce(n, 0) AS n_assets, first AS first_asset FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
)
def snk09(spark, sf_dir):
    projects = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("project_json"))
    assets = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("asset_id"), F.lit("audio").alias("kind"), F.lit(1).alias("bytes"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash")
    )
    out = SK.project_bundles(projects, assets, "demo.project")
    parsed = F.from_json("bundle_json", "kind string, project struct<name:string>, assets array<struct<id:bigint>>")
    rows = out.select("project_id", parsed.alias("b"))
    return rows.select(
        "project_id", "b.kind", F.col("b.project.name").alias("name"), F.size("b.assets").cast("long").alias("n_assets"), F.get("b.assets.id", F.lit(0)).alias("first_asset")
    )
