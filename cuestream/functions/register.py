"""The functions of this package for SQL callers, as temporary functions of a session.

All but the two normalisers are SQL functions, which Catalyst inlines; the
normalisers fall back to an Arrow function for characters outside their table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cuestream.functions import text as X
from cuestream.functions import timecode as C


def _lit(value: str) -> str:
    out = []
    for c in value:
        if c in "\\'":
            out.append("\\" + c)
        elif ord(c) < 32 or ord(c) == 127:
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return "'" + "".join(out) + "'"


def _define(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def register_functions(spark: SparkSession) -> list[str]:
    """Define the SQL functions in this session and return their names."""
    spark.udf.register("cue_fold_text", X._fold)
    spark.udf.register("cue_nfc", X._nfc)
    hard = f"(octet_length(t) > char_length(t) AND t RLIKE {_lit(X.PLAIN_LATIN)} AND t RLIKE {_lit(f'[^{X.FOLD_COVERED}]')})"
    odd = f"(octet_length(t) > char_length(t) AND t RLIKE {_lit(X.NFC_UNSAFE)})"
    fast = f"trim(regexp_replace(translate(t, {_lit(X.FOLD_FROM)}, {_lit(X.FOLD_TO)}), ' {{2,}}', ' '))"
    shown = f"CASE WHEN {odd} THEN cue_nfc(CASE WHEN {odd} THEN t END) ELSE t END"
    for pattern, repl in ((X.ZERO_WIDTH, ""), ("\r\n?", "\n"), ("\t", "    "), (" {2,}", " "), (r"(?U)[^\S\n]*\n[^\S\n]*", "\n"), (X.EDGE_SPACE, "")):
        shown = f"regexp_replace({shown}, {_lit(pattern)}, {_lit(repl)})"
    longest = "greatest(length(a), length(b))"
    similar = (
        f"CASE WHEN a = b THEN 1D WHEN a = '' OR b = '' THEN 0D "
        f"ELSE greatest(0D, 1D - levenshtein(a, b) / {longest}) END"
    )
    words = "CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END"
    latin = "CASE WHEN s RLIKE '[^a-z ]' THEN regexp_replace(s, '[^a-z ]', '') ELSE s END"
    more = f"get(transform(array({latin}), x -> regexp_count(x, {_lit(X.HEARD + '{1,2}')}) - regexp_count(x, {_lit(X.HEARD + '[a-z]*')})), 0)"
    syll = f"CAST(greatest(1, {words} + {more}) AS BIGINT)"
    reading = (
        "greatest(1600000L, CAST(floor((regexp_count(t, '(?U)\\\\S+') / greatest(60D, least(360D, wpm)) * 60 + regexp_count(t, '[,;:—–]') * 0.14D "
        "+ greatest(0, regexp_count(t, '[.!?]') - 1) * 0.24D + 0.35D) * 1000000D + 0.5D) AS BIGINT))"
    )
    g = [f"coalesce(try_cast(regexp_extract(trim(t), {_lit(C.CLOCK)}, {i}) AS BIGINT), 0L)" for i in (1, 2, 3)]
    frac = f"coalesce(try_cast(rpad(regexp_extract(trim(t), {_lit(C.CLOCK)}, 4), 3, '0') AS BIGINT), 0L)"
    clock = f"CASE WHEN trim(t) RLIKE {_lit(C.CLOCK)} AND {g[1]} <= 59 AND {g[2]} <= 59 THEN (({g[0]} * 3600 + {g[1]} * 60 + {g[2]}) * 1000 + {frac}) * 1000 END"
    us = "greatest(0L, us)"
    h, m, s = f"{us} div 3600000000", f"{us} div 60000000", f"{us} div 1000000"

    def pad(e: str, n: int = 2) -> str:
        return f"lpad(CAST({e} AS STRING), greatest({n}, length(CAST({e} AS STRING))), '0')"

    hms = f"concat({pad(h)}, ':', {pad(f'{m} % 60')}, ':', {pad(f'{s} % 60')}"
    code = (
        f"CASE fmt WHEN 'srt' THEN {hms}, ',', {pad(f'{us} div 1000 % 1000', 3)}) WHEN 'vtt' THEN {hms}, '.', {pad(f'{us} div 1000 % 1000', 3)}) "
        f"WHEN 'lrc' THEN concat('[', {pad(m)}, ':', {pad(f'{s} % 60')}, '.', {pad(f'{us} div 10000 % 100')}, ']') "
        f"WHEN 'ass' THEN concat({h}, ':', {pad(f'{m} % 60')}, ':', {pad(f'{s} % 60')}, '.', {pad(f'{us} div 10000 % 100')}) "
        f"WHEN 'clock' THEN concat({pad(m)}, ':', {pad(f'{s} % 60')}) "
        f"WHEN 'timecode' THEN concat({pad(m)}, ':', {pad(f'{s} % 60')}, '.', {pad(f'{us} % 1000000 div 10000')}) END"
    )
    token_array = (
        f"CASE WHEN t RLIKE {_lit(X.NO_SPACE_SCRIPT)} THEN array_remove(regexp_extract_all(regexp_replace(t, '(?U)\\\\s+', ''), '\\\\X', 0), '') "
        "ELSE regexp_extract_all(t, '(?U)\\\\S+', 0) END"
    )
    flat = "trim(regexp_replace(t, '(?U)\\\\s+', ' '))"
    kept = f"regexp_replace({flat}, {_lit(rf'(?<![A-Za-z.])(?:\.*(?i:{X._DOTTED})|\.*[A-Z])\.{X.CLOSERS}(?=\s)')}, '$0\\u0002')"
    cut = f"regexp_replace(regexp_replace({kept}, {_lit(rf'([.!?]{X.CLOSERS})\s+')}, '$1\\u0001'), '\\u0002', '')"
    _define(spark, "norm_match", "t STRING", "STRING", f"CASE WHEN {hard} THEN cue_fold_text(CASE WHEN {hard} THEN t END) ELSE {fast} END")
    _define(spark, "norm_display", "t STRING", "STRING", shown)
    _define(spark, "similarity", "a STRING, b STRING", "DOUBLE", similar)
    _define(spark, "syllables", "s STRING", "BIGINT", syll)
    _define(spark, "reading_time_us", "t STRING, wpm DOUBLE", "BIGINT", reading)
    _define(spark, "parse_clock", "t STRING", "BIGINT", clock)
    _define(spark, "timecode", "us BIGINT, fmt STRING", "STRING", code)
    _define(spark, "explode_tokens", "t STRING", "TABLE (idx INT, token STRING)", f"SELECT pos, col FROM posexplode({token_array})")
    _define(spark, "explode_sentences", "t STRING", "TABLE (idx INT, sentence STRING)", f"SELECT pos, col FROM posexplode(array_remove(split({cut}, '\\u0001'), ''))")
    return ["norm_match", "norm_display", "similarity", "syllables", "reading_time_us", "parse_clock", "timecode", "explode_tokens", "explode_sentences"]
