"""Batch edits of cue tables: set, nudge, move, lock, delete, duplicate, insert, reorder, split, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.functions.text import highlight_tokens
from cuestream.functions.timecode import ms, round_half_up
from cuestream.plans.scan import OrderedScan, last_before, next_row, position, prev_row

KEYS = ["track_id"]
ADD_GAP = ms(200)
INSERT_LENGTH = ms(2000)


def apply_edits(cues: DataFrame, edits: DataFrame, hot: bool | None = None) -> DataFrame:
    """Apply at most one edit per cue and renumber ``seq``.

    ``edits(track_id, cue_id, op, amount, value)`` with op one of set_start,
    set_end, nudge_start, nudge_end, move, lock, unlock, delete, duplicate,
    insert_after and reorder. ``amount`` is a time, a delta or an index step;
    ``value`` is the text of an inserted cue. New cues get the id of the cue they
    follow plus a suffix. A reorder whose target lies outside the track is
    ignored; give one reorder per track and batch.
    """
    e = edits.select("track_id", "cue_id", "op", F.col("amount").alias("_a"), F.col("value").alias("_v"))
    df = cues.withColumn("cue_id", F.col("cue_id").cast("string")).join(
        e.withColumn("cue_id", F.col("cue_id").cast("string")), ["track_id", "cue_id"], "left"
    )
    op, a = F.coalesce(F.col("op"), F.lit("")), F.col("_a")
    df = df.filter(op != "delete")
    start = (
        F.when(op == "set_start", F.greatest(F.lit(0), a))
        .when(op.isin("nudge_start", "move"), F.greatest(F.lit(0), F.col("start_us") + a))
        .otherwise(F.col("start_us"))
    )
    end = (
        F.when(op == "set_end", F.greatest(start, a))
        .when(op == "nudge_end", F.greatest(start, F.col("end_us") + a))
        .when(op == "move", start + F.col("end_us") - F.col("start_us"))
        .otherwise(F.col("end_us"))
    )
    human = op.isin("set_start", "set_end", "move")
    scan = OrderedScan.over(df, KEYS, ["seq", "cue_id"], hot=hot).add(_p=position(), _next=next_row("cue_id"))
    base = scan.done().withColumns({"_s": start.cast("long"), "_e": end.cast("long")})
    ends = base.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    base = base.join(ends, "track_id")
    target = F.col("_p") + a
    legal = (op == "reorder") & (target >= 1) & (target <= F.col("_n"))
    slot = F.when(legal, target + F.when(a > 0, F.lit(0.5)).otherwise(F.lit(-0.5))).otherwise(F.col("_p"))
    kept = base.select(
        "track_id",
        "cue_id",
        slot.cast("double").alias("_slot"),
        "text",
        F.col("_s").alias("start_us"),
        F.col("_e").alias("end_us"),
        F.when(op == "lock", F.lit(True)).when(op == "unlock", F.lit(False)).otherwise(F.col("locked")).alias("locked"),
        F.when(human, F.lit("human")).otherwise(F.col("source")).alias("source"),
    )
    copies = base.filter(op == "duplicate").select(
        "track_id",
        F.concat("cue_id", F.lit("+copy")).alias("cue_id"),
        (F.col("_p") + 0.25).cast("double").alias("_slot"),
        "text",
        (F.col("end_us") + ADD_GAP).alias("start_us"),
        (F.col("end_us") + ADD_GAP + F.col("end_us") - F.col("start_us")).alias("end_us"),
        F.lit(False).alias("locked"),
        F.lit("estimate").alias("source"),
    )
    inserts = base.filter(op == "insert_after").select(
        "track_id",
        F.concat("cue_id", F.lit("+new")).alias("cue_id"),
        (F.col("_p") + 0.25).cast("double").alias("_slot"),
        F.col("_v").alias("text"),
        (F.col("end_us") + ADD_GAP).alias("start_us"),
        (F.col("end_us") + ADD_GAP + INSERT_LENGTH).alias("end_us"),
        F.lit(False).alias("locked"),
        F.lit("estimate").alias("source"),
    )
    rows = kept.unionByName(copies).unionByName(inserts)
    out = OrderedScan.over(rows, KEYS, ["_slot", "cue_id"], hot=hot).add(seq=position()).done()
    return out.withColumn("seq", F.col("seq") - 1).drop("_slot")


def split_cues(cues: DataFrame, splits: DataFrame) -> DataFrame:
    """Split cues at a word, dividing the span by text length; out-of-range splits are refused."""
    df = cues.join(splits.select("track_id", "cue_id", F.col("word_index").alias("_k")), ["track_id", "cue_id"], "left")
    df = df.withColumn("_t", highlight_tokens("text"))
    k, n = F.col("_k"), F.size("_t")
    ok = F.coalesce((k > 0) & (k < n), F.lit(False))
    left = F.array_join(F.slice("_t", F.lit(1), F.when(ok, k).otherwise(0)), " ")
    right = F.array_join(F.slice("_t", F.when(ok, k + 1).otherwise(1), F.when(ok, n - k).otherwise(0)), " ")
    df = df.withColumns({"_l": left, "_r": right})
    a, b = F.length("_l"), F.length("_r")
    at = round_half_up(F.col("start_us") + (F.col("end_us") - F.col("start_us")) * a / F.greatest(F.lit(1), a + b))

    def part(i: int, text, start, end):
        return F.struct(F.lit(i).alias("part"), text.alias("text"), start.alias("s"), end.alias("e"))

    pieces = F.when(
        ok, F.array(part(1, F.col("_l"), F.col("start_us"), at), part(2, F.col("_r"), at, F.col("end_us")))
    ).otherwise(F.array(part(0, F.col("text"), F.col("start_us"), F.col("end_us"))))
    keep = [c for c in cues.columns if c not in ("text", "start_us", "end_us")]
    return df.withColumn("_x", F.explode(pieces)).select(
        *keep,
        F.col("_x.part").alias("part"),
        F.col("_x.text").alias("text"),
        F.col("_x.s").alias("start_us"),
        F.col("_x.e").alias("end_us"),
    )


def merge_with_next(cues: DataFrame, flag: str, hot: bool | None = None) -> DataFrame:
    """Merge each flagged cue with its successor in time order.

    A cue that was merged away cannot merge again, so inside a run of flagged
    cues every second one is consumed.
    """
    row = F.struct("cue_id", "text", "start_us", "end_us", "locked", "source")
    scan = OrderedScan.over(cues, KEYS, ["start_us", "cue_id"], hot=hot).add(_p=position(), _next=next_row(row))
    scan = scan.add(_calm=last_before(F.when(~F.col(flag), F.col("_p"))))
    active = F.col(flag) & ((F.col("_p") - F.coalesce(F.col("_calm"), F.lit(0))) % 2 == 1) & F.col("_next").isNotNull()
    scan = scan.let(_active=active).add(_gone=prev_row("_active"))
    df = scan.done().filter(~F.coalesce(F.col("_gone"), F.lit(False)))
    act, nxt = F.col("_active"), F.col("_next")
    joined = F.trim(F.regexp_replace(F.concat(F.trim("text"), F.lit(" "), F.trim(nxt["text"])), r"\s+", " "))
    human = (F.col("source") == "human") | (nxt["source"] == "human")
    return df.select(
        "track_id",
        "cue_id",
        F.when(act, joined).otherwise(F.col("text")).alias("text"),
        F.when(act, F.least("start_us", nxt["start_us"])).otherwise(F.col("start_us")).alias("start_us"),
        F.when(act, F.greatest("end_us", nxt["end_us"])).otherwise(F.col("end_us")).alias("end_us"),
        F.when(act, F.col("locked") & nxt["locked"]).otherwise(F.col("locked")).alias("locked"),
        F.when(act & human, F.lit("human")).otherwise(F.col("source")).alias("source"),
    )
