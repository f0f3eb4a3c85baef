"""Timed-text files to cue rows, one whole file per input row ``(file, contents)``.

A file is one cell, so everything derived from it is a bounded group and the
few ordered steps use plain windows. Words come as arrays of
``(text, start_us, end_us)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestream.functions import text as X
from cuestream.functions.timecode import parse_clock, us_from_ms, us_from_seconds
from cuestream.operators.quality import PROJECT_KIND
from cuestream.plans.scan import OrderedScan, last_upto, position

WORDS = "array<struct<text:string,start_us:bigint,end_us:bigint>>"
CUE_COLUMNS = ["file", "cue_seq", "text", "start_us", "end_us", "words"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files under a path as ``(file, contents)``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("contents"))


def detect_format(name: Column, contents: Column, project_kind: str = PROJECT_KIND) -> Column:
    """Format by extension, then by the contents; ``.txt`` is never trusted."""
    # What the formats begin with.
    ext = F.lower(F.substring_index(name, ".", -1))
    head = F.regexp_replace(contents, r"(?U)^[\s\x{FEFF}]+", "")
    kind = F.try_variant_get(F.try_parse_json(contents), "$.kind", "string")
    marked = contents.rlike(rf'"kind": ?"{project_kind}"')
    braced = head.rlike(r"^[\[{]")
    return (
        F.when(ext.isin("srt", "vtt", "lrc"), ext)
        .when(ext.isin("ass", "ssa"), "ass")
        .when(ext == "json", F.when(marked, "project").otherwise("json"))
        .when(F.startswith(head, F.lit("WEBVTT")), "vtt")
        .when(head.rlike(r"(?im)^\[Script Info\]"), "ass")
        .when(braced & F.coalesce(kind == project_kind, F.lit(False)), "project")
        .when(braced & head.rlike(r'^\s*\[?\{?\s*"') & head.rlike(r'"(text|line|start|words)"'), "json")
        .when(head.rlike(r"(?m)^\[\d{1,2}:\d{2}([.:]\d{1,3})?\]"), "lrc")
        .when(head.rlike(r"(?m)^\d+\s*\n\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}\s*-->"), "srt")
        .otherwise("txt")
    )


def _lines(contents: Column) -> Column:
    return F.split(F.regexp_replace(contents, "\r\n?", "\n"), "\n")


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


def _millis(fraction: Column) -> Column:
    return _number(F.rpad(F.coalesce(fraction, F.lit("")), 3, "0"))


def _words(pieces: Column, starts: Column, clean) -> Column:
    """Words from the text between marks; each ends at the next mark, the last at its own start.

    Text, start and next start are zipped first, so the lambda touches each
    element once. ``pieces`` and ``starts`` should be columns of their own: they are
    read several times, and an expression would be computed each time.
    """
    n = F.size(starts)
    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(2), n).alias("t"), starts.alias("s"), F.slice(starts, F.lit(2), n).alias("e")
    )

    def word(z: Column) -> Column:
        return F.struct(clean(z["t"]).alias("text"), z["s"].alias("start_us"), F.coalesce(z["e"], z["s"]).alias("end_us"))

    words = F.filter(F.transform(zipped, word), lambda w: w["text"] != "").cast(WORDS)
    return F.when(n >= 2, words).otherwise(F.array().cast(WORDS))


# LRC tags and times.
LRC_META = r"(?i)^\[(ti|ar|al|by|re|ve|offset|length|au|hash|sign|qq|total|language):(.*)\]$"
LRC_TIME = r"\[(\d{1,2}):(\d{1,2})(?:[.:](\d{1,3}))?\]"
LRC_WORD = r"<(\d{1,2}):(\d{1,2})(?:[.:](\d{1,3}))?>"


def _lrc_times(line: Column, pattern: str) -> Column:
    """Times of all marks; the line is searched once, the parts of a mark in the mark."""

    def us(mark: Column) -> Column:
        m, s, f = (F.regexp_extract(mark, pattern, k) for k in (1, 2, 3))
        return (_number(m) * 60 + _number(s)) * 1_000_000 + _millis(f) * 1_000

    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), us)


def _lrc_lines(files: DataFrame) -> DataFrame:
    df = files.select("file", F.posexplode(_lines(F.col("contents"))).alias("line_no", "raw"))
    return df.withColumn("line", X.trim_all(F.col("raw"))).filter(F.col("line") != "")


def _is_meta(line: Column) -> Column:
    return line.rlike(LRC_META) & ~line.rlike(r"^\[(\d{1,2}):")


def lrc_meta(files: DataFrame) -> DataFrame:
    """Title, artist, album and offset per file; the offset sign is turned as players expect."""
    meta = _lrc_lines(files).filter(_is_meta(F.col("line")))
    key = F.lower(F.regexp_extract("line", LRC_META, 1))
    value = F.trim(F.regexp_extract("line", LRC_META, 2))
    tags = meta.select("file", "line_no", key.alias("key"), value.alias("value"))

    def last(*names: str) -> Column:
        return F.max_by("value", F.when(F.col("key").isin(*names), F.col("line_no")))

    number = F.when(F.col("key") == "offset", F.col("value").try_cast("double"))
    bad = (F.col("key") == "offset") & F.col("value").try_cast("double").isNull()
    return tags.groupBy("file").agg(
        last("ti").alias("title"),
        last("ar", "au").alias("artist"),
        last("al").alias("album"),
        (-us_from_ms(F.max_by(number, F.when(number.isNotNull(), F.col("line_no"))))).alias("offset_us"),
        F.coalesce(F.count_if(bad), F.lit(0)).alias("n_warnings"),
    )


def _numbered(cues: DataFrame, *order: str, words: Column | None = None) -> DataFrame:
    """Cues in order with their number; ``words`` stands in for words that are made afterwards."""
    cues = cues if words is None else cues.withColumn("words", words)
    scan = OrderedScan.over(cues, ["file"], list(order), hot=False).add(cue_seq=position())
    return scan.done().withColumn("cue_seq", F.col("cue_seq") - 1).select(*CUE_COLUMNS)


def _lrc_stamped(lines: Column) -> Column:
    """Lines with stamps and text, read inside the cell: a filter over rows would compute what it reads again."""
    sung = F.filter(F.transform(lines, X.trim_line), lambda t: (t != "") & ~_is_meta(t))
    stamped = F.transform(
        sung,
        lambda t, i: F.struct(i.alias("line_no"), _lrc_times(t, LRC_TIME).alias("stamps"), F.regexp_replace(t, rf"^.*{LRC_TIME}", "").alias("rest")),
    )
    shown = F.transform(
        F.filter(stamped, lambda x: F.size(x["stamps"]) > 0),
        lambda x: F.struct(x["line_no"], x["stamps"], x["rest"], X.clean_display(F.regexp_replace(x["rest"], LRC_WORD, "")).alias("text")),
    )
    return F.filter(shown, lambda x: x["text"] != "")


def parse_lrc(files: DataFrame, apply_offset: bool = False) -> DataFrame:
    """LRC and enhanced LRC: one cue per stamp, text from behind the last stamp."""
    # no mark and no line end is part of a composed character, so files are composed as a whole
    df = files.select("file", X.compose("contents").alias("contents"))
    df = df.select("file", F.inline(_lrc_stamped(_lines(F.col("contents")))))
    df = df.withColumns({"pieces": F.split("rest", LRC_WORD), "starts": _lrc_times(F.col("rest"), LRC_WORD)})
    words = _words(F.col("pieces"), F.col("starts"), F.trim)
    cues = df.withColumn("words", words).select(
        "file", "line_no", "text", "words", F.posexplode("stamps").alias("stamp_no", "start_us")
    )
    cues = cues.withColumn("end_us", F.lit(None).cast("long"))
    if apply_offset:
        shift = lrc_meta(files).select("file", F.coalesce("offset_us", F.lit(0)).alias("_o"))
        moved = F.greatest(F.lit(0), F.col("start_us") + F.coalesce("_o", F.lit(0)))
        cues = cues.join(shift, "file", "left").withColumn("start_us", moved).drop("_o")
    return _numbered(cues, "start_us", "line_no", "stamp_no")


# Cue times of SRT and VTT.
CUE_RANGE = r"(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})"
VTT_TIME = r"<(\d{1,2}):(\d{2}):(\d{2})\.(\d{1,3})>"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


# Bytes of which a word is made that needs no cleaning.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[c for c in range(ord("!"), ord("~") + 1) if chr(c) not in "<>"]] = True
_MARKED = T.StructType(
    [
        T.StructField("text", T.ArrayType(T.StringType())),
        T.StructField("start_us", T.ArrayType(T.LongType())),
        T.StructField("end_us", T.ArrayType(T.LongType())),
        T.StructField("plain", T.BooleanType()),
    ]
)


@F.arrow_udf(_MARKED)
def _vtt_marked(raw: pa.Array) -> pa.Array:
    """Text behind each mark ``VTT_TIME``, less blanks at its end, its start and the next start, if there are two marks.

    All texts of a batch are searched at once, as bytes; ``plain`` says that no word needs cleaning.
    """
    rows = pc.fill_null(raw, "").cast(pa.large_string())
    off = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, dtype=np.int64)
    d = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    d = np.r_[d, np.zeros(16, dtype=np.uint8)]
    digit = (d >= ord("0")) & (d <= ord("9"))

    def number(at: np.ndarray) -> np.ndarray:
        return d[at].astype(np.int64) - ord("0")

    c = np.flatnonzero(d == ord("<"))
    one, two = digit[c + 1] & (d[c + 2] == ord(":")), digit[c + 1] & digit[c + 2] & (d[c + 3] == ord(":"))
    q = c + 1 + np.where(one, 1, 2)
    form = (one | two) & digit[q + 1] & digit[q + 2] & (d[q + 3] == ord(":"))
    c, q = c[form], q[form]
    form = digit[q + 4] & digit[q + 5] & (d[q + 6] == ord(".")) & digit[q + 7]
    c, q = c[form], q[form]
    size = np.where(d[q + 8] == ord(">"), 1, np.where(digit[q + 8] & (d[q + 9] == ord(">")), 2, np.where(digit[q + 8] & digit[q + 9] & (d[q + 10] == ord(">")), 3, 0)))
    row = np.searchsorted(off, c, side="right") - 1
    behind = q + 8 + size
    form = (size > 0) & (behind <= off[row + 1])
    c, q, size, row, behind = (x[form] for x in (c, q, size, row, behind))
    form = np.bincount(row, minlength=len(rows))[row] > 1
    c, q, size, row, behind = (x[form] for x in (c, q, size, row, behind))
    hours = np.where(q - c == 3, number(c + 1) * 10, 0) + number(q - 1)
    seconds = (hours * 60 + number(q + 1) * 10 + number(q + 2)) * 60 + number(q + 4) * 10 + number(q + 5)
    rest = number(q + 7)
    for k in (1, 2):
        rest = np.where(size > k, rest * 10 + number(q + 7 + k), rest)
    start = (seconds * 1000 + rest) * 1000
    last = np.r_[row[1:] != row[:-1], True][: len(row)]
    end = np.where(last, start, np.r_[start[1:], 0][: len(row)])
    until = np.where(last, off[row + 1], np.r_[c[1:], 0][: len(row)])
    solid = np.maximum.accumulate(np.where(d == ord(" "), -1, np.arange(len(d))))
    until = np.maximum(behind, solid[until - 1] + 1)
    odd = np.r_[0, np.cumsum(~_PLAIN[d])]
    plain = np.bincount(row, weights=odd[until] > odd[behind], minlength=len(rows)) == 0
    full = until > behind
    row, start, end, behind, until = (x[full] for x in (row, start, end, behind, until))
    edge = np.zeros(len(d) + 1, dtype=np.int8)
    edge[behind] = 1
    edge[until] -= 1  # a text may begin where none ends: a mark lies between two
    data = d[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(rows)))], pa.int32())
    text = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.r_[0, np.cumsum(until - behind)].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (text, pa.array(start), pa.array(end))]
    return pa.StructArray.from_arrays([*lists, pa.array(plain)], fields=[pa.field(f, x.type) for f, x in zip(("text", "start_us", "end_us", "plain"), [*lists, pa.array(plain)], strict=True)])


def _vtt_words(marked: Column) -> Column:
    """Words of a column made by ``_vtt_marked``; most need no cleaning."""
    words = F.arrays_zip(*[marked[c].alias(c) for c in ("text", "start_us", "end_us")])

    def clean(w: Column) -> Column:
        return F.struct(X.clean_display(strip_tags(w["text"])).alias("text"), w["start_us"], w["end_us"])

    cleaned = F.filter(F.transform(words, clean), lambda w: w["text"] != "")
    return F.when(marked["plain"], words.cast(WORDS)).otherwise(cleaned.cast(WORDS))


def _block_list(contents: Column, fmt: str) -> Column:
    """Blocks with their range and text, read inside the cell: a filter over rows would compute what it reads again."""

    def lines(block: Column, i: Column) -> Column:
        shown = F.filter(F.split(block, "\n"), lambda t: t.rlike(r"(?U)[^\s\x{FEFF}]"))
        return F.struct(i.alias("block_no"), shown.alias("body"))

    def headless(x: Column) -> Column:
        headed = F.startswith(F.get(x["body"], F.lit(0)), F.lit("WEBVTT"))
        return F.struct(x["block_no"], F.when(headed, F.slice(x["body"], F.lit(2), F.size(x["body"]))).otherwise(x["body"]).alias("body"))

    def ranged(x: Column) -> Column:
        at = F.array_position(F.transform(x["body"], lambda t: t.rlike(CUE_RANGE)), True).cast("int")
        return F.struct(x["block_no"], x["body"], at.alias("at"))

    def block(x: Column) -> Column:
        after = F.slice(x["body"], x["at"] + 1, F.size(x["body"]))

        def shown(t: Column) -> Column:
            plain = F.array_join(F.transform(t, strip_tags), " ")
            return F.struct(
                x["block_no"], x["at"], F.array_join(t, " ").alias("raw"), X.clean_display(plain).alias("text"), F.get(x["body"], x["at"] - 1).alias("range")
            )

        return X.once(after, shown)

    listed = F.filter(F.transform(F.split(contents, r"\n{2,}"), lines), lambda x: F.size(x["body"]) > 0)
    if fmt == "vtt":
        listed = F.filter(F.transform(listed, headless), lambda x: F.size(x["body"]) > 0)
    listed = F.filter(listed, lambda x: ~F.get(x["body"], F.lit(0)).rlike("^(NOTE|STYLE)"))
    return F.transform(F.transform(listed, ranged), block)


def _composed(files: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("contents", "\r\n?", "\n"), r"^\x{FEFF}", "")
    return files.select("file", body.alias("contents")).select("file", X.compose("contents").alias("contents"))


def parse_srt_vtt(files: DataFrame, fmt: str) -> DataFrame:
    """SubRip and WebVTT blocks with a usable range and text."""
    usable = F.filter(_block_list(F.col("contents"), fmt), lambda x: (x["at"] > 0) & (x["text"] != ""))
    df = _composed(files).select("file", F.inline(usable))

    def us(k: int) -> Column:
        g = [F.regexp_extract("range", CUE_RANGE, k + i) for i in range(4)]
        return (((_number(g[0]) * 60 + _number(g[1])) * 60 + _number(g[2])) * 1000 + _millis(g[3])) * 1000

    if fmt == "vtt":
        df = df.withColumn("marked", _vtt_marked("raw"))
        words = _vtt_words(F.col("marked"))
    else:
        words = F.array().cast(WORDS)
    cues = df.select("file", "block_no", "text", us(1).alias("start_us"), us(5).alias("end_us"), words.alias("words"))
    return _numbered(cues, "block_no")


def skipped_blocks(files: DataFrame, fmt: str) -> DataFrame:
    """Blocks per file that had no usable range or no text."""
    bad = (F.col("at") == 0) | (F.col("text") == "")
    blocks = _composed(files).select("file", F.inline(_block_list(F.col("contents"), fmt)))
    return blocks.groupBy("file").agg(F.coalesce(F.count_if(bad), F.lit(0)).alias("n_skipped"))


# Section headers and karaoke marks of ASS.
ASS_SECTION = r"^\[(.*)\]$"
ASS_KARAOKE = r"\{\\[kK](?:f|o)?(\d+)\}([^{}]*)"


def strip_overrides(text: Column) -> Column:
    s = F.regexp_replace(text, r"\{[^}]*\}", "")
    s = F.regexp_replace(s, r"(?i)\\N", "\n")
    return F.when(text.rlike(r"[{\\]"), F.regexp_replace(s, r"\\h", " ")).otherwise(text)


def karaoke_lengths(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASS_KARAOKE), F.lit(1)), lambda n: _number(n) * 10_000)


def karaoke_words(text: Column, start: Column, lengths: Column | None = None) -> Column:
    """Words of karaoke tags; a tag without text still moves the time on."""
    lengths = karaoke_lengths(text) if lengths is None else lengths
    shown = F.transform(F.regexp_extract_all(text, F.lit(ASS_KARAOKE), F.lit(2)), lambda t: X.clean_display(strip_overrides(t)))
    zipped = F.arrays_zip(shown.alias("t"), lengths.alias("n"), X.running_sums(lengths).alias("e"))
    zero = F.coalesce(start, F.lit(0)).cast("long")

    def word(z: Column) -> Column:
        return F.struct(z["t"].alias("text"), (zero + z["e"] - z["n"]).alias("start_us"), (zero + z["e"]).alias("end_us"))

    return F.transform(F.filter(zipped, lambda z: z["t"] != ""), word).cast(WORDS)


def _ass_rows(files: DataFrame) -> DataFrame:
    """Non-header lines with the section they stand in."""
    df = files.select("file", F.posexplode(_lines(X.compose("contents"))).alias("line_no", "raw"))
    df = df.withColumn("line", X.trim_all(F.col("raw"))).filter(F.col("line") != "")
    header = F.when(F.col("line").rlike(ASS_SECTION), F.lower(F.regexp_extract("line", ASS_SECTION, 1)))
    scan = OrderedScan.over(df.withColumn("_h", header), ["file"], ["line_no"], hot=False).add(section=last_upto("_h"))
    return scan.done().filter(F.col("_h").isNull()).drop("_h")


def _dialogue(files: DataFrame) -> DataFrame:
    rows = _ass_rows(files).filter((F.col("section") == "events") & F.col("line").rlike("(?i)^Dialogue:"))
    payload = F.regexp_replace("line", "^[^:]*:", "")
    return rows.withColumn("f", F.split(payload, ",", 10))


def _ass_cues(lines: Column, heads: Column) -> Column:
    """Dialogue lines with text that stand in an events section, read inside the cell.

    ``heads`` are the places of the section headers among the ``lines``.
    """
    spans = F.arrays_zip(heads.alias("at"), F.slice(heads, F.lit(2), F.size(heads)).alias("next"))

    def held(span: Column) -> Column:
        name = F.lower(F.regexp_extract(F.get(lines, span["at"]), ASS_SECTION, 1))
        inner = F.slice(lines, span["at"] + 2, F.coalesce(span["next"], F.size(lines)) - span["at"] - 1)
        return F.when(name == "events", inner).otherwise(F.array().cast("array<string>"))

    spoken = F.filter(F.flatten(F.transform(spans, held)), lambda t: t.rlike("(?i)^Dialogue:"))
    fields = F.transform(spoken, lambda t, i: F.struct(i.alias("line_no"), F.split(F.regexp_replace(t, "^[^:]*:", ""), ",", 10).alias("f")))

    def cue(x: Column) -> Column:
        sung = F.get(x["f"], F.lit(9))
        start, end = parse_clock(F.get(x["f"], F.lit(1))), parse_clock(F.get(x["f"], F.lit(2)))
        shown = X.clean_display(X.once(sung, strip_overrides))
        return F.struct(x["line_no"], shown.alias("text"), start.alias("start_us"), end.alias("end_us"), sung.alias("sung"))

    return F.filter(F.transform(F.filter(fields, lambda x: F.size(x["f"]) == 10), cue), lambda x: x["text"] != "")


def parse_ass(files: DataFrame) -> DataFrame:
    """Dialogue lines; the tenth field keeps its commas."""
    df = files.select("file", X.compose("contents").alias("contents"))
    lines = F.filter(F.transform(_lines(F.col("contents")), X.trim_line), lambda t: t != "")
    df = df.select("file", lines.alias("lines"))
    heads = F.array_compact(F.transform("lines", lambda t, i: F.when(t.rlike(ASS_SECTION), i)))
    df = df.select("file", "lines", heads.alias("heads"))
    cues = df.select("file", F.inline(_ass_cues(F.col("lines"), F.col("heads"))))
    numbered = _numbered(cues.withColumn("_at", F.coalesce("start_us", F.lit(0))), "_at", "line_no", words=F.col("sung"))
    timed = numbered.withColumn("_n", karaoke_lengths(F.col("words")))
    return timed.withColumn("words", karaoke_words(F.col("words"), F.col("start_us"), F.col("_n"))).drop("_n")


def ass_meta(files: DataFrame) -> DataFrame:
    rows = _ass_rows(files).filter((F.col("section") == "script info") & F.col("line").rlike("(?i)^title *:"))
    title = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    return rows.groupBy("file").agg(F.max_by(title, "line_no").alias("title"))


def malformed_dialogue(files: DataFrame) -> DataFrame:
    return _dialogue(files).groupBy("file").agg(F.coalesce(F.count_if(F.size("f") < 10), F.lit(0)).alias("n_warnings"))


def ass_notes(files: DataFrame) -> DataFrame:
    """Title of every file that has one, with its malformed dialogue lines, from one pass over the lines."""
    section, line = F.col("section"), F.col("line")
    titled = (section == "script info") & line.rlike("(?i)^title *:")
    spoken = (section == "events") & line.rlike("(?i)^Dialogue:")
    payload = F.regexp_replace("line", "^[^:]*:", "")
    notes = _ass_rows(files).filter(titled | spoken).groupBy("file").agg(
        F.max_by(F.trim(payload), F.when(titled, F.col("line_no"))).alias("title"),
        F.sum(F.when(spoken, (F.size(F.split(payload, ",", 10)) < 10).cast("long"))).alias("n_warnings"),
        F.count_if(titled).alias("_titles"),
    )
    return notes.filter(F.col("_titles") > 0).drop("_titles")


# Time units, and the names under which JSON keeps times and lists.
UNITS = ("microseconds", "milliseconds", "seconds")
TIME_NUMBER = r'"(?:start|end|time|timestamp)"\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'
LISTS = ("lines", "lyrics", "cues", "segments")


def infer_unit(largest: Column, declared: Column | None = None) -> Column:
    """Time unit from the largest time seen; a declared unit wins."""
    unit = (
        F.when(F.coalesce(largest, F.lit(0.0)) <= 0, "microseconds")
        .when(largest < 10_000, "seconds")
        .when(largest < 10_000_000, "milliseconds")
        .otherwise("microseconds")
    )
    return unit if declared is None else F.when(declared.isin(*UNITS), declared).otherwise(unit)


def scale_time(value: Column, unit: Column) -> Column:
    """Number in a unit to microseconds."""
    return (
        F.when(unit == "seconds", us_from_seconds(value)).when(unit == "milliseconds", us_from_ms(value)).otherwise(us_from_ms(value / 1000))
    )


def _time(variant: Column, path: str, unit: Column) -> Column:
    """A number, a clock string or a numeric string as microseconds."""

    def us(text: Column) -> Column:
        return F.coalesce(parse_clock(text), scale_time(text.try_cast("double"), unit))

    return X.once(F.try_variant_get(variant, path, "string"), us)


def parse_json(files: DataFrame) -> DataFrame:
    """Timed JSON: an array, or the arrays under the known list names, with the unit inferred per file."""
    v = F.try_parse_json("contents")
    df = files.withColumn("_v", v)
    listed = [F.try_variant_get("_v", f"$.{name}", "array<variant>") for name in LISTS]
    none = F.array().cast("array<variant>")
    entries = F.coalesce(
        F.try_variant_get("_v", "$", "array<variant>"), F.concat(*[F.coalesce(x, none) for x in listed])
    )
    numbers = F.transform(F.regexp_extract_all("contents", F.lit(TIME_NUMBER), F.lit(1)), lambda n: n.try_cast("double"))
    unit = infer_unit(F.array_max(numbers), F.try_variant_get("_v", "$.timeUnit", "string"))
    df = df.withColumn("unit", unit).select("file", "unit", F.posexplode(entries).alias("entry_no", "e"))
    raw = F.coalesce(F.try_variant_get("e", "$.text", "string"), F.try_variant_get("e", "$.line", "string"), F.lit(""))
    # text and times are made once for a list of one cue, which is emptied if it has no text
    df = df.withColumn("raw", raw).withColumn("raw", X.compose("raw"))
    start, end = (_time(F.col("e"), f"$.{name}", F.col("unit")) for name in ("start", "end"))
    cue = F.struct(X.clean_display(F.col("raw")).alias("text"), start.alias("start_us"), end.alias("end_us"))
    df = df.select("file", "unit", "entry_no", "e", F.inline(F.filter(F.array(cue), lambda x: x["text"] != "")))

    def step(acc: Column, w: Column) -> Column:
        shown = X.clean_display(F.coalesce(F.try_variant_get(w, "$.text", "string"), F.lit("")))
        start = F.coalesce(_time(w, "$.start", F.col("unit")), acc["at"])
        end = F.coalesce(_time(w, "$.end", F.col("unit")), start)
        word = F.struct(shown.alias("text"), start.alias("start_us"), F.greatest(end, start).alias("end_us"))
        return F.when(
            shown != "",
            F.struct(F.greatest(acc["at"], end).alias("at"), F.array_append(acc["out"], word).alias("out")),
        ).otherwise(acc)

    zero = F.struct(F.coalesce("start_us", F.lit(0)).cast("long").alias("at"), F.array().cast(WORDS).alias("out"))
    words = F.aggregate(F.coalesce(F.try_variant_get("e", "$.words", "array<variant>"), none), zero, step)["out"]
    return _numbered(df.withColumn("words", words), "entry_no")


def parse_txt(files: DataFrame) -> DataFrame:
    """Plain text: one untimed cue per non-blank line."""
    df = files.select("file", F.posexplode(F.split(X.norm_display("contents"), "\n")).alias("line_no", "text"))
    none = F.lit(None).cast("long")
    cues = df.filter(F.col("text") != "").withColumns({"start_us": none, "end_us": none, "words": F.array().cast(WORDS)})
    return _numbered(cues, "line_no")


def parse_timed_text(files: DataFrame) -> DataFrame:
    """All formats at once: every file goes to the parser its name and head ask for."""
    typed = files.withColumn("format", detect_format(F.col("file"), F.col("contents")))

    def of(*formats: str) -> DataFrame:
        return typed.filter(F.col("format").isin(*formats)).drop("format")

    parts = [
        parse_lrc(of("lrc")), parse_srt_vtt(of("srt"), "srt"), parse_srt_vtt(of("vtt"), "vtt"), parse_ass(of("ass")),
        parse_json(of("json")), parse_txt(of("txt")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def import_files(files: DataFrame) -> DataFrame:
    """A row for every file: format, number of cues, whether any is timed, and the share that is.

    Project documents, which hold no cues, and files without a line have a row as well.
    """
    typed = files.select("file", detect_format(F.col("file"), F.col("contents")).alias("format"))
    report = import_report(parse_timed_text(files))
    return typed.join(report, "file", "left").select(
        "file", "format", F.coalesce("n_cues", F.lit(0)).alias("n_cues"), F.coalesce("has_timings", F.lit(False)).alias("has_timings"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def import_report(cues: DataFrame) -> DataFrame:
    """Share of timed cues per file."""
    timed = F.col("start_us").isNotNull()
    return cues.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_cues"),
        F.bool_or(timed).alias("has_timings"),
        F.avg(timed.cast("double")).alias("coverage"),
    )
