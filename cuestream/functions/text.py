"""Normalisation, tokens, syllables, sentences and speech estimates.

Everything is a native column expression. Unicode normalisation has no Spark
function, so ``norm_display`` and ``norm_match`` send a row to an Arrow UDF, but
only when it holds a character outside the ranges whose normal form is known
by table; for other rows the UDF sees a null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestream.functions.timecode import col, round_half_up

# Characters of these ranges are their own canonical composition.
# The first range leaves out nearly all characters at once, the rest is looked at only behind it.
NFC_UNSAFE = r"[\x{300}-\x{10FFFF}](?<![\x{2010}-\x{2027}\x{20AC}])"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
# Scripts written without spaces.
NO_SPACE_SCRIPT = (
    r"[\x{0E00}-\x{0E7F}\x{1780}-\x{17FF}\x{1000}-\x{109F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
)
EDGE_SPACE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _ends(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))


def trim_line(text: Column) -> Column:
    """``trim_all`` for a column or lambda variable; most lines have nothing to trim."""
    return F.when(_ends(text).rlike(r"(?U)[\s\x{FEFF}]"), trim_all(text)).otherwise(text)


def fold_text(value: str) -> str:
    """Matching form of one string; the rule behind the table and the UDF."""
    s = unicodedata.normalize("NFKC", value).lower()
    s = unicodedata.normalize("NFD", s)
    s = re.sub("[̀-ͯ]", "", s)
    s = re.sub("[​-‍﻿'’`]", "", s)
    s = "".join(c if unicodedata.category(c)[0] in "LN" or c.isspace() else " " for c in s)
    return " ".join(s.split())


def _ranges(points: list[int]) -> str:
    """Regex class body for sorted code points, as few ranges as possible."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def _fold_table() -> tuple[str, str, str]:
    """Per-character folding for Latin text, and the class of characters it covers."""
    points = [*range(0x180), *range(0x2010, 0x2028), 0x20AC]
    source, target, dropped, covered = [], [], [], []
    for p in points:
        c = chr(p)
        folded = fold_text(f"x{c}x")[1:-1]
        if len(folded) <= 1:
            covered.append(p)
        if folded == c or len(folded) > 1:
            continue
        if folded == "":
            dropped.append(c)
        else:
            source.append(c)
            target.append(folded)
    return "".join(source + dropped), "".join(target), _ranges(covered)


FOLD_FROM, FOLD_TO, FOLD_COVERED = _fold_table()
FOLD_MAP = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])
BETWEEN = "\uE000"
PLAIN_LATIN = r"[^\x{0}-\x{BB}\x{BF}-\x{131}]"


def _needs_fold(text: Column) -> Column:
    # ASCII is settled by its length in bytes, most other rows by the first class
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(PLAIN_LATIN) & text.rlike(f"[^{FOLD_COVERED}]")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def running_sums(values: pd.Series) -> pd.Series:
    """Sums up to each place of an array."""
    return values.map(np.cumsum, na_action="ignore")


@F.arrow_udf(T.ArrayType(T.StringType()))
def fold_words(values: pa.Array) -> pa.Array:
    """``norm_match`` of each word of an array; a word is folded once a batch, ASCII words all at once."""
    coded = values.flatten().cast(pa.string()).dictionary_encode()
    words = coded.dictionary
    plain = pc.replace_substring_regex(pc.ascii_lower(words), "['`]", "")
    plain = pc.ascii_trim(pc.replace_substring_regex(plain, "[^a-z0-9]+", " "), " ")
    # characters of the table are replaced in all words at once, with a mark between them that it does not have
    hard = pc.match_substring_regex(words, f"[^{FOLD_COVERED}]")
    easy = pc.and_not(pc.invert(pc.string_is_ascii(words)), hard)
    joined = BETWEEN.join(pc.filter(words, easy).to_pylist()).translate(FOLD_MAP)
    table = [" ".join(w.split()) if " " in w else w for w in joined.split(BETWEEN)][: pc.sum(easy).as_py() or 0]
    folded = pc.replace_with_mask(plain, easy, pa.array(table, pa.string()))
    folded = pc.replace_with_mask(folded, hard, pa.array([fold_text(w) for w in pc.filter(words, hard).to_pylist()], pa.string()))
    n = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), folded.take(coded.indices))


def compose(text: Column | str) -> Column:
    """Canonical composition; rows already composed by table do not reach Python."""
    text = col(text)
    # ASCII is settled by its length in bytes; what Python was not asked for is null
    needs = (F.octet_length(text) > F.char_length(text)) & text.rlike(NFC_UNSAFE)
    return F.coalesce(_nfc(F.when(needs, text)), text)


def _unclean(text: Column) -> Column:
    """Whether ``clean_display`` changes anything; most words and lines are clean."""
    marks = [F.contains(text, F.lit(c)) for c in ("  ", "\n", "\r", "\t")]
    wide = F.octet_length(text) > F.char_length(text)
    return marks[0] | marks[1] | marks[2] | marks[3] | _ends(text).rlike(r"(?U)[\s\x{FEFF}]") | (wide & text.rlike(ZERO_WIDTH))


def clean_display(composed: Column) -> Column:
    """The native part of ``norm_display``; usable inside higher-order functions."""

    def clean(t: Column) -> Column:
        s = F.regexp_replace(t, ZERO_WIDTH, "")
        s = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        s = F.replace(s, F.lit("\t"), F.lit("    "))
        s = F.regexp_replace(s, " {2,}", " ")
        s = F.regexp_replace(s, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
        return F.when(_unclean(t), trim_all(s)).otherwise(t)

    return once(composed, clean)


def norm_display(text: Column | str) -> Column:
    """Composed form with clean line ends and spaces; safe to show."""
    return clean_display(compose(text))


def norm_match(text: Column | str) -> Column:
    """Case, accent and punctuation free form used as a join and grouping signature."""
    text = col(text)
    needs = _needs_fold(text)
    # the table maps every covered space and mark to one blank
    fast = F.trim(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), " {2,}", " "))
    return F.coalesce(_fold(F.when(needs, text)), fast)


# A line that names a section.
STRUCTURAL_TAG = r"^\s*[\[(#]+\s*([A-Za-z][A-Za-z0-9 _'-]{0,24})\s*[\])]*\s*$"


def structural_tag(line: Column | str) -> Column:
    """Upper-case tag of lines like ``[Chorus]`` or ``## Intro``; null otherwise."""
    line = col(line)
    return F.when(line.rlike(STRUCTURAL_TAG), F.upper(F.trim(F.regexp_extract(line, STRUCTURAL_TAG, 1))))


# Lines that stand for music without words.
INSTRUMENTAL_WORDS = (
    "instrumental|interlude|break|breakdown|solo|drop|ad lib|adlibs|ad libitum|music|repeat|hook"
)


def is_instrumental(signature: Column | str) -> Column:
    """Predicate on a ``norm_match`` value."""
    s = col(signature)
    return s.rlike(f"^({INSTRUMENTAL_WORDS})$") | s.rlike(r"^\(?(music|instrumental)[^)]*\)?$")


# An aside in brackets at the end.
AD_LIB = r"^(.*?)\s*(\(([^()]{1,60})\))\s*$"


def split_ad_lib(line: Column | str) -> Column:
    line = col(line)
    main = F.trim(F.regexp_extract(line, AD_LIB, 1))
    hit = line.rlike(AD_LIB) & (main != "")
    return F.struct(
        F.when(hit, main).otherwise(line).alias("main"),
        F.when(hit, F.trim(F.regexp_extract(line, AD_LIB, 3))).alias("ad_lib"),
    )


# What other formats leave of their times.
TIMING_RESIDUE = (
    r"(?m)^\s*(WEBVTT.*)$",
    r"(?m)^\s*NOTE\s.*$",
    r"(?m)^\s*-->\s*.*$",
    r"(?m)^\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}\s*$",
    r"(?m)^\s*(\[\d{1,2}:\d{2}(?:\.\d{1,3})?\]\s*)+",
)


def strip_timing_residue(text: Column | str) -> Column:
    s = col(text)
    for pattern in TIMING_RESIDUE:
        s = F.regexp_replace(s, pattern, "")
    return s


def highlight_tokens(line: Column | str) -> Column:
    """Words, or graphemes for scripts written without spaces; whitespace is dropped."""

    def tokens(t: Column) -> Column:
        graphemes = F.array_remove(F.regexp_extract_all(F.regexp_replace(t, r"(?U)\s+", ""), F.lit(r"\X"), F.lit(0)), "")
        # ASCII is settled by its length in bytes; there both kinds of blank are the same
        plain = F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))
        words = F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))
        return F.when(F.octet_length(t) == F.char_length(t), plain).when(t.rlike(NO_SPACE_SCRIPT), graphemes).otherwise(words)

    return once(col(line), tokens)


def token_offsets(line: Column | str) -> Column:
    """Tokens with their character offset: array<struct<text, offset>>."""
    line = col(line)
    spaced = F.regexp_extract_all(line, F.lit(r"(?U)\s+|\S+"), F.lit(0))
    clusters = F.regexp_extract_all(line, F.lit(r"\X"), F.lit(0))
    parts = F.when(line.rlike(NO_SPACE_SCRIPT), clusters).otherwise(spaced)
    run = F.aggregate(
        parts,
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<text:string,offset:bigint>>").alias("out"),
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(p.rlike(r"(?U)^\s+$"), acc["out"])
            .otherwise(F.array_append(acc["out"], F.struct(p.alias("text"), acc["at"].alias("offset"))))
            .alias("out"),
        ),
    )
    return run["out"]


def grapheme_count(text: Column | str) -> Column:
    text = col(text)
    single = ~text.rlike(r"[^\x{20}-\x{2FF}]")
    return F.when(single, F.length(text)).otherwise(F.regexp_count(text, F.lit(r"\X"))).cast("long")


def word_count(text: Column | str) -> Column:
    text = col(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.regexp_count(text, F.lit(r"\S+"))).otherwise(F.regexp_count(text, F.lit(r"(?U)\S+"))).cast("long")


# A vowel that is heard; an e before a closing d, or behind a consonant but l and
# before a closing s or the end of the word, is silent.
HEARD = r"(?:[aiouy]|e(?!d(?: |$))(?!(?<=[b-df-hj-km-np-tv-xz]e)s?(?: |$)))"


def syllables(signature: Column | str) -> Column:
    """Syllable estimate of a ``norm_match`` value: at least one per word and overall."""
    s = col(signature)
    words = F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    latin = F.when(s.rlike("[^a-z ]"), F.regexp_replace(s, "[^a-z ]", "")).otherwise(s)
    # the first group of a word is what the word counts for; bound in a lambda, so that it is made once
    more = F.transform(F.array(latin), lambda t: F.regexp_count(t, F.lit(HEARD + "{1,2}")) - F.regexp_count(t, F.lit(HEARD + "[a-z]*")))
    return F.greatest(F.lit(1), words + F.get(more, F.lit(0))).cast("long")


# Classes of the bytes of a signature: none, blank, vowel, e, consonant, d, s, l.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 4
for _letters, _class in ((" ", 1), ("aiouy", 2), ("e", 3), ("d", 5), ("s", 6), ("l", 7)):
    _CLASS[[ord(c) for c in _letters]] = _class


@F.arrow_udf(T.LongType())
def syllable_counts(signatures: pa.Array) -> pa.Array:
    """``syllables`` of a whole batch, over its bytes: what is heard is looked up, not searched for."""
    rows = pc.fill_null(signatures, "").cast(pa.large_string())
    size = pc.binary_length(rows).to_numpy()
    # rows stand behind one another with a blank between
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(rows)], pa.int64()), rows), pa.scalar(" ", pa.large_string()))
    kind = _CLASS[np.frombuffer(joined.buffers()[2] or b"", dtype=np.uint8)]
    ends = np.cumsum(size + 1) - 1
    keep = kind > 0
    at = np.r_[0, np.cumsum(keep)]
    x = np.r_[kind[keep], np.uint8(1), np.uint8(1), np.uint8(1)]
    begin, end = at[ends - size], at[ends]
    e = np.flatnonzero(x == 3)
    after, next_but_one, before = x[e + 1], x[e + 2], np.where(e > 0, x[e - 1], 1)
    edge = (after == 1) | ((after == 6) & (next_but_one == 1))
    silent = ((after == 5) & (next_but_one == 1)) | ((before >= 4) & (before <= 6) & edge)
    heard = (x == 2) | (x == 3)
    heard[e[silent]] = False
    p = np.flatnonzero(heard)
    blanks = np.r_[0, np.cumsum(x == 1)]
    place = np.arange(len(p))
    # vowels side by side count in pairs; the first group of a word is what the word counts for
    run = np.maximum.accumulate(np.where(np.r_[True, np.diff(p) != 1][: len(p)], place, 0))
    more = ((place - run) % 2 == 0).astype(np.int64) - np.r_[True, np.diff(blanks[p]) != 0][: len(p)]
    upto = np.r_[0, np.cumsum(more)]
    words = np.where(size > 0, blanks[end] - blanks[begin] + 1, 0)
    found = upto[np.searchsorted(p, end)] - upto[np.searchsorted(p, begin)]
    return pa.array(np.maximum(1, words + found))


def speech_weight(signature: Column | str) -> Column:
    s = col(signature)
    weight = F.greatest(F.lit(1.0), grapheme_count(s) * F.lit(0.6) + syllables(s) * F.lit(6))
    return F.when(s == "", F.lit(1.0)).otherwise(weight)


# Abbreviations that do not end a sentence.
# Abbreviations that end no sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "fig", "no", "vol", "inc", "ltd", "co",
)
CLOSERS = r"[.!?'\"”’)\]]*"
_DOTTED = "|".join(r"\.*".join(word) for word in ABBREVIATIONS)


def sentences(text: Column | str) -> Column:
    """Array of sentences; abbreviations and single capitals do not end one."""

    def split(t: Column) -> Column:
        ascii_only = F.octet_length(t) == F.char_length(t)
        s = F.trim(F.when(ascii_only, F.regexp_replace(t, r"\s+", " ")).otherwise(F.regexp_replace(t, r"(?U)\s+", " ")))
        keep = "\x02"
        # a dot must follow within the longest abbreviation, which leaves out most words at once
        near = rf"(?=[A-Za-z]{{0,{max(map(len, ABBREVIATIONS))}}}\.)"
        s = F.regexp_replace(s, rf"(?<![A-Za-z.]){near}(?:\.*(?i:{_DOTTED})|\.*[A-Z])\.{CLOSERS}(?=\s)", "$0" + keep)
        s = F.regexp_replace(s, rf"([.!?]{CLOSERS})\s+", "$1\x01")
        s = F.regexp_replace(s, keep, "")
        return F.array_remove(F.split(s, "\x01"), "")

    return once(col(text), split)


# Speakers before a colon.
SPEAKER = r"(?i)^(?:(A|B)|(host|narrator|speaker\s*1)|(guest|co-?host|speaker\s*2))\s*:\s+(.+)$"


def speaker_prefix(raw: Column | str) -> Column:
    """Struct of speaker (A, B or null) and the text without the prefix."""

    def split(s: Column) -> Column:
        hit = s.rlike(SPEAKER)
        is_b = (F.upper(F.regexp_extract(s, SPEAKER, 1)) == "B") | (F.regexp_extract(s, SPEAKER, 3) != "")
        return F.struct(
            F.when(hit, F.when(is_b, F.lit("B")).otherwise(F.lit("A"))).alias("speaker"),
            F.when(hit, trim_all(F.regexp_extract(s, SPEAKER, 4))).otherwise(s).alias("text"),
        )

    return once(once(col(raw), trim_line), split)


def reading_time_us(
    text: Column | str,
    wpm: float | Column = 155,
    min_scene_ms: float = 1600,
    layout: Column | None = None,
    items: Column | None = None,
    chart_size: Column | None = None,
    subtext: Column | None = None,
) -> Column:
    """Narration length from words and punctuation, with floors for some layouts."""
    text = col(text)
    rate = wpm if isinstance(wpm, Column) else F.lit(float(wpm))
    rate = F.greatest(F.lit(60.0), F.least(F.lit(360.0), rate.cast("double")))
    floor_us = int(max(500, min_scene_ms) * 1000)
    words = word_count(text)
    commas = F.regexp_count(text, F.lit("[,;:—–]"))
    stops = F.regexp_count(text, F.lit("[.!?]"))
    seconds = (
        words / rate * 60 + commas * F.lit(0.14) + F.greatest(F.lit(0), stops - 1) * F.lit(0.24) + F.lit(0.35)
    )
    if layout is not None:
        n_items = F.coalesce(F.size(items), F.lit(0)) if items is not None else F.lit(0)
        item_words = word_count(F.array_join(items, " ")) if items is not None else F.lit(0)
        bars = chart_size if chart_size is not None else F.lit(0)
        sub_words = word_count(F.coalesce(subtext, F.lit(""))) if subtext is not None else F.lit(0)
        need = (
            F.when(
                (layout == "bullets") & (n_items > 0),
                (words + item_words * F.lit(0.65)) / rate * 60 + n_items * F.lit(0.35),
            )
            .when((layout == "code") & (n_items > 0), F.lit(1.8) + n_items * F.lit(0.55))
            .when((layout == "chart") & (bars > 0), F.lit(2.0) + bars * F.lit(0.55))
            .when(layout == "stat", F.lit(2.4))
            .when(layout == "title", F.lit(2.2) + sub_words / rate * 45)
            .otherwise(F.lit(0.0))
        )
        seconds = F.greatest(seconds, need)
    return F.greatest(F.lit(floor_us), round_half_up(seconds * F.lit(1_000_000.0))).cast("long")


def spoken_text(
    text: Column,
    layout: Column,
    value: Column,
    items: Column,
    subtext: Column,
    narration: Column,
    signature: Column,
) -> Column:
    """What a narrator reads for a scene: explicit narration first, no raw code."""
    headline = trim_all(text)

    def closed(c: Column) -> Column:
        return F.when(c == "", "").when(c.rlike(r"[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))

    said = F.array_join(F.transform(F.array_remove(F.transform(items, lambda i: F.trim(i)), ""), closed), " ")
    stat = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(narration.isNotNull(), trim_all(narration))
        .when(is_instrumental(signature), F.lit(""))
        .when(layout.isNull(), headline)
        .when(
            layout == "code",
            F.trim(F.concat(closed(headline), F.lit(" "), F.trim(F.coalesce(subtext, F.lit(""))))),
        )
        .when(
            (layout == "stat") & (stat != "") & ~F.contains(F.lower(headline), F.lower(stat)),
            F.concat(stat, F.lit(". "), headline),
        )
        .when(
            (layout == "bullets") & (F.size(items) > 0),
            F.trim(F.concat(closed(headline), F.lit(" "), said)),
        )
        .otherwise(headline)
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """Edit-distance ratio, at every length."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longest))
    )


def confidence_tier(n_words: Column, min_confidence: Column, source: Column) -> Column:
    trusted = source.isin("human", "tap", "tts")
    return (
        F.when(F.coalesce(n_words, F.lit(0)) == 0, F.when(trusted, "high").otherwise("low"))
        .when(min_confidence > 0.7, "high")
        .when(min_confidence > 0.35, "mid")
        .otherwise("low")
    )


def matches_search(text: Column | str, query: str) -> Column:
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(col(text)), F.lit(q))


def safe_name(artist: Column, title: Column, key: Column, extension: str, fallback: str = "lyric-video") -> Column:
    """Portable file or partition name from two labels and the key that keeps equal labels apart."""
    base = F.array_join(F.array_remove(F.array_compact(F.array(artist, title)), ""), " - ")
    base = F.when(base == "", F.lit(fallback)).otherwise(base)
    plain = F.translate(base, NAME_FROM, NAME_TO)
    s = F.trim(F.regexp_replace(plain, r"[^\w\s-]", ""))
    s = F.regexp_replace(s, r"\s+", "-")
    return F.concat(F.when(s == "", F.lit(fallback)).otherwise(s), F.lit("-"), key.cast("string"), F.lit(extension))


def _name_table() -> tuple[str, str]:
    """Accented Latin letters whose compatibility form starts with one ASCII letter."""
    source, target = [], []
    for p in range(0xA0, 0x250):
        plain = [c for c in unicodedata.normalize("NFKD", chr(p)) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != chr(p):
            source.append(chr(p))
            target.append(plain[0])
    return "".join(source), "".join(target)


NAME_FROM, NAME_TO = _name_table()


def sanitize_file_name(name: Column | str, fallback: str = "untitled") -> Column:
    s = F.regexp_replace(col(name), r'[\\/:*?"<>|\x00-\x1f]', "")
    s = trim_all(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(s == "", F.lit(fallback)).otherwise(s)
