"""CTC output to words: greedy decoding, word assembly, transcript stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import OrderedScan, sliding, sum_upto


def greedy_decode(logits: DataFrame, blank_id: int) -> DataFrame:
    """Best token per frame without blanks and without repeats of the frame right before."""
    scores = F.col("scores")
    best = logits.select(
        "track_id",
        "frame",
        (F.array_position(scores, F.array_max(scores)) - 1).alias("token"),
        F.array_max(scores).cast("double").alias("score"),
    )
    before = {"_prev": lambda w: F.lag("token", 1, blank_id).over(w)}
    df = sliding(best, ["track_id"], "frame", 1, before)
    return df.filter((F.col("token") != blank_id) & (F.col("token") != F.col("_prev"))).drop("_prev")


def assemble_words(
    tokens: DataFrame, char: Column, frame_us: int, confidence: float = 0.65, hot: bool | None = None
) -> DataFrame:
    """Words between delimiters (blank or ``|``); a word starts at the delimiter before it."""
    df = tokens.withColumn("_c", char)
    delim = F.col("_c").isin(" ", "|")
    scan = OrderedScan.over(df, ["track_id"], ["frame"], hot=hot).add(word_idx=sum_upto(delim.cast("int")))
    letters = F.array_sort(F.collect_list(F.when(~delim & (F.col("_c") != ""), F.struct("frame", "_c"))))
    words = scan.done().groupBy("track_id", "word_idx").agg(
        letters.alias("_l"), F.min("frame").alias("_f0"), F.max("frame").alias("_f1")
    )
    text = F.trim(F.array_join(F.transform("_l", lambda x: x["_c"]), ""))
    return words.withColumn("text", text).filter(F.col("text") != "").select(
        "track_id",
        F.col("word_idx").cast("long").alias("word_idx"),
        "text",
        (F.col("_f0") * frame_us).alias("start_us"),
        ((F.col("_f1") + 1) * frame_us).alias("end_us"),
        F.lit(confidence).alias("confidence"),
    )


def distinct_words(words: DataFrame, grain_us: int = 40_000) -> DataFrame:
    """First word per (lower-case text, start in steps of the grain)."""
    cell = ["track_id", "_text", "_cell"]
    row = F.struct(*words.columns)
    keyed = words.withColumns({"_text": F.lower("text"), "_cell": F.floor(F.col("start_us") / grain_us)})
    first = keyed.groupBy(*cell).agg(F.min_by(row, F.struct("start_us", "idx")).alias("r"))
    return first.select("r.*")


def stitch_windows(words: DataFrame, hop_us: int) -> DataFrame:
    """Join words recognised in overlapping windows; each window keeps its own hop, the last one its tail.

    ``words(track_id, window_start_us, idx, text, start_us, ...)``.
    """
    last = words.groupBy("track_id").agg(F.max("window_start_us").alias("_tail"))
    own = F.col("start_us") < F.col("window_start_us") + hop_us
    kept = words.join(last, "track_id").filter(own | (F.col("window_start_us") == F.col("_tail")))
    return kept.drop("_tail")
