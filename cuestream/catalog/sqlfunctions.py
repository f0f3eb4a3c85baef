"""The registered SQL functions, called from SQL text over documents, parts and events."""

from __future__ import annotations

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import DOC_LINES, sig
from cuestream.catalog.text import DISPLAY_SQL, SENTENCE_TEXT, TIMECODE_SQL, reading_sql, sentences_sql, syllables_sql
from cuestream.functions.register import register_functions
from cuestream.operators import align as AL


def run(spark, sf_dir, sql, **tables):
    """SQL text with tables bound by name; nothing is left behind in the catalog."""
    register_functions(spark)
    return spark.sql(sql, **tables)


@query("udf01_norm_display", DISPLAY_SQL)
def udf01_display(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return run(spark, sf_dir, "SELECT doc_id, norm_display(text) AS display FROM {docs}", docs=docs)


@query("udf01_norm_match", f"WITH {DOC_LINES} SELECT track_id, seq, {sig('text')} AS signature FROM doc_lines")
def udf01_match(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir)
    return run(spark, sf_dir, "SELECT track_id, seq, norm_match(text) AS signature FROM {lines}", lines=lines)


@query(
    "udf02_column_functions",
    f"""WITH {DOC_LINES}, s AS (SELECT track_id, seq, text, {sig('text')} AS sg FROM doc_lines)
    SELECT track_id, seq, CAST({syllables_sql('sg')} AS BIGINT) AS syllables, {reading_sql('text')} AS reading_us,
      round(CASE WHEN 'chorus' = w6 THEN 1.0 WHEN w6 = '' THEN 0.0 ELSE greatest(0.0, 1 - levenshtein('chorus', w6)::DOUBLE / greatest(6, length(w6))) END::DOUBLE, 9) AS score FROM (SELECT *, regexp_replace(sg, '[^a-z]', '', 'g') AS w6 FROM s)""",
)
def udf02(spark, sf_dir):
    lines = A.doc_lines(spark, sf_dir)
    return run(
        spark,
        sf_dir,
        """SELECT track_id, seq, syllables(sg) AS syllables, reading_time_us(text, 155D) AS reading_us, round(similarity('chorus', regexp_replace(sg, '[^a-z]', '')), 9) AS score
           FROM (SELECT track_id, seq, text, norm_match(text) AS sg FROM {lines})""",
        lines=lines,
    )


@query("udf02_time_codes", "SELECT event_id, srt, vtt, lrc, ass, clock, timecode, parsed FROM (" + TIMECODE_SQL + ")")
def udf02_time(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("event_id", (A.epoch_us("ts") - 1_704_067_200_000_000 - A.HOUR_US).alias("us"))
    cols = ", ".join(f"timecode(us, '{f}') AS {f}" for f in ("srt", "vtt", "lrc", "ass", "clock", "timecode"))
    return run(spark, sf_dir, f"SELECT event_id, {cols}, parse_clock(timecode(us, 'srt')) AS parsed FROM {{events}}", events=events)


@query("udf03_align_tables")
def udf03(spark, sf_dir):
    """Lines of each document aligned with its sorted lines, through the two-table form."""
    from pyspark.sql import functions as F

    lines = A.doc_lines(spark, sf_dir).select("track_id", F.col("seq").alias("idx"), F.col("text").alias("token"))
    short = lines.withColumn("idx", F.xxhash64("token"))
    pairs = AL.align(lines, short, ["track_id"], "token", "token")
    return AL.alignment_score(pairs, ["track_id"]).withColumn("score", F.round("score", 9))


@query(
    "udf06_explode_tokens",
    """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, CAST(i AS INTEGER) AS idx, w[i + 1] AS token FROM (SELECT *, unnest(range(0, len(w))) AS i FROM p)""",
)
def udf06_tokens(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    return run(spark, sf_dir, "SELECT p_partkey, x.idx, x.token FROM {part}, LATERAL explode_tokens(p_name) x", part=part)


@query(
    "udf06_explode_sentences",
    f"""WITH s AS (SELECT doc_id, {sentences_sql(SENTENCE_TEXT)} AS s FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS idx, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)""",
)
def udf06_sentences(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    sql = "SELECT doc_id, x.idx, x.sentence FROM {docs}, LATERAL explode_sentences(replace(replace(text, ' the ', ' Dr. '), ' le ', ' e.g. ')) x"
    return run(spark, sf_dir, sql, docs=docs)
