"""Estimated timings: lines from speech weight, words inside lines, scene timelines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestream.functions import text as X
from cuestream.functions.timecode import ms, round_half_up
from cuestream.plans.scan import (
    OrderedScan,
    group_count,
    group_max,
    group_sum,
    max_before,
    next_row,
    sum_before,
    sum_upto,
)

KEYS = ["track_id"]
PROTECTED = ("human", "tap")


def weight_tenths(signature: Column | str) -> Column:
    """Ten times the speech weight as an integer, so that totals do not depend on summation order."""
    s = F.col(signature) if isinstance(signature, str) else signature
    w = X.grapheme_count(s) * 6 + X.syllable_counts(s) * 60
    return F.when(s == "", F.lit(10)).otherwise(F.greatest(F.lit(10), w)).cast("long")


def protected(df: DataFrame) -> Column:
    flag = F.coalesce(F.col("locked"), F.lit(False)) if "locked" in df.columns else F.lit(False)
    if "source" in df.columns:
        flag = flag | F.coalesce(F.col("source").isin(*PROTECTED), F.lit(False))
    return flag


def estimate_line_timings(
    cues: DataFrame,
    duration: Column | None = None,
    gap_us: int = ms(250),
    lead_in_us: int = ms(400),
    min_line_us: int = ms(900),
    hot: bool | None = None,
) -> DataFrame:
    """Share the track among its lines by speech weight.

    Protected lines keep their span and do not move the cursor, but they do
    count in the total weight. ``cues`` is ordered by ``seq``.
    """
    df = cues if "sig" in cues.columns else cues.withColumn("sig", X.norm_match("text"))
    df = df.withColumns({"_w": weight_tenths("sig"), "_keep": protected(df)})
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot).add(_tw=group_sum("_w"), _n=group_count())
    span_end = F.col("_n") * ms(3000)
    if duration is not None:
        span_end = F.coalesce(duration, span_end)
    usable = F.greatest(F.lit(min_line_us), span_end - lead_in_us - (F.col("_n") - 1) * gap_us)
    share = F.greatest(F.lit(min_line_us), round_half_up(usable * F.col("_w") / F.col("_tw")))
    scan = scan.let(_share=share).add(_at=sum_before(F.when(~F.col("_keep"), F.col("_share") + gap_us)))
    out = scan.done()
    start = F.col("_at") + lead_in_us
    has_span = "start_us" in cues.columns
    keep = F.col("_keep")
    new = {
        "start_us": F.when(keep, F.col("start_us")).otherwise(start) if has_span else start,
        "end_us": F.when(keep, F.col("end_us")).otherwise(start + F.col("_share")) if has_span else start + F.col("_share"),
        "source": F.when(keep, F.col("source")).otherwise("estimate") if "source" in cues.columns else F.lit("estimate"),
        "confidence": F.when(keep, F.col("confidence")).otherwise(0.3) if "confidence" in cues.columns else F.lit(0.3),
    }
    return out.withColumns({k: v.cast("long") if k.endswith("_us") else v for k, v in new.items()}).drop(
        "_w", "_keep", "_tw", "_n", "_share", "_at"
    )


TIMES = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("word_idx", "start_us", "end_us")])


@F.arrow_udf(TIMES)
def _word_times(weights: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Places and times of words that share their cue by weight; the last one ends with its cue."""
    n = pc.fill_null(pc.list_value_length(weights), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    w = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    heads = ends - n
    row = np.repeat(np.arange(len(n)), n)
    known = [~np.asarray(pc.is_null(x)) for x in (first, last)]
    c0, c1 = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, last))
    span = np.where(known[0] & known[1], np.maximum(0, c1 - c0), 0)
    upto = np.r_[0, np.cumsum(w)]
    share = np.floor((span[row] * w) / (upto[ends] - upto[heads])[row] + 0.5).astype(np.int64)
    before = np.r_[0, np.cumsum(share)]
    start = c0[row] + before[:-1] - before[heads][row]
    end = start + share
    lasts = ends[n > 0] - 1
    given = known[1][row[lasts]]
    end[lasts] = np.where(given, np.where(known[0][row[lasts]], np.maximum(c1[row[lasts]], start[lasts]), c1[row[lasts]]), start[lasts])
    no_start, no_end = ~known[0][row], ~known[0][row]
    no_end[lasts] &= ~given
    offsets = pa.array(np.r_[0, ends], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (
        pa.array(np.arange(len(w)) - heads[row]), pa.array(start, mask=no_start), pa.array(end, mask=no_end),
    )]
    return pa.StructArray.from_arrays(lists, ["word_idx", "start_us", "end_us"])


def _spread(tokens: DataFrame, by: str) -> DataFrame:
    """``_words``, an array of (word_idx, text, start_us, end_us), for the tokens ``_t`` of each cue.

    Tokens, weights and times are columns of their own: an expression named inside a lambda is
    computed for every word.
    """
    def size(t: Column) -> Column:
        if by != "graphemes":
            return F.length(t)
        # ASCII is settled by its length in bytes; a token holds no line end
        return F.when(F.octet_length(t) == F.char_length(t), F.length(t)).otherwise(X.grapheme_count(t))

    df = tokens.withColumn("_w", F.transform("_t", lambda t: F.greatest(F.lit(1), size(t)).cast("long")))
    df = df.withColumn("_at", _word_times("_w", F.col("start_us").cast("long"), F.col("end_us").cast("long")))
    at = F.col("_at")
    words = F.arrays_zip(at["word_idx"].alias("word_idx"), F.col("_t").alias("text"), at["start_us"].alias("start_us"), at["end_us"].alias("end_us"))
    return df.withColumn("_words", words).drop("_w", "_at")


def interpolate_words(cues: DataFrame, by: str = "graphemes", carry: list[str] | None = None) -> DataFrame:
    """One row per highlightable token, its share of the cue proportional to its length.

    The tokens of a cue come out of one cell and are timed there as arrays, before they
    become rows, so nothing is shuffled.
    """
    cue = ["track_id", "cue_id"]
    tokens = cues.select(*cue, "start_us", "end_us", *(carry or []), X.highlight_tokens("text").alias("_t"))
    return _spread(tokens, by).select(*cue, *(carry or []), F.inline("_words")).select(
        *cue, "word_idx", "text", "start_us", "end_us", *(carry or [])
    )


def nest_words(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Attach words as an ordered array per cue; a cue's words came out of one cell."""
    fields = [c for c in words.columns if c not in ("track_id", "cue_id")]
    ordered = ["word_idx", *[c for c in fields if c != "word_idx"]]
    packed = words.groupBy("track_id", "cue_id").agg(
        F.array_sort(F.collect_list(F.struct(*ordered))).alias("words")
    )
    out = cues.join(packed, ["track_id", "cue_id"], "left")
    empty = F.array().cast(packed.schema["words"].dataType)
    return out.withColumn("words", F.coalesce("words", empty))


def _stored_in(words: DataFrame) -> Column:
    """The words of one cue, which came out of one cell, in order."""
    return F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in words.select("word_idx", "text", "start_us", "end_us").dtypes])))


def _with_stored(cues: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """A row for each cue, with the stored words of its key and the number of cues that share it.

    ``how`` of "full" keeps keys without a cue. ``nth`` counts the cues of a key from 0.
    """
    cue = ["track_id", "cue_id"]
    spans = cues.groupBy(*cue).agg(F.collect_list(F.struct("text", "start_us", "end_us")).alias("_cues"))
    met = spans.join(packed, cue, how).withColumn("_n", F.size("_cues"))
    kept = [c for c in met.columns if c != "_cues"]
    return met.select(*kept, F.posexplode_outer("_cues").alias("nth", "_c")).select(*kept, "nth", "_c.*")


def refresh_words(cues: DataFrame, words: DataFrame, preserve_words: bool = True) -> DataFrame:
    """Re-derive words of cues unless they hold better evidence.

    ``preserve_words`` keeps a cue whose words are not all estimates; otherwise
    only a human word protects its cue. Cues and words are read once: the words of a
    cue meet it as an array, and become rows again or are replaced in its cell.
    """
    strong = (F.col("source") != "estimate") if preserve_words else (F.col("source") == "human")
    cue = ["track_id", "cue_id"]
    named = F.col("track_id").isNotNull() & F.col("cue_id").isNotNull()
    packed = words.filter(named).groupBy(*cue).agg(F.bool_or(F.coalesce(strong, F.lit(False))).alias("_keep"), _stored_in(words).alias("_stored"))
    met = _with_stored(cues, packed.filter("_keep").drop("_keep"), "full")
    tokens = F.when(F.col("_stored").isNull(), X.highlight_tokens("text")).otherwise(F.array().cast("array<string>"))
    fresh = _spread(met.withColumn("_t", tokens), "graphemes")
    shown = F.when(F.col("_stored").isNull(), F.col("_words")).when(F.coalesce("nth", F.lit(0)) == 0, F.col("_stored"))
    return fresh.select(*cue, F.inline(shown))


def _fits(stored: Column, start: Column, end: Column) -> Column:
    """Whether words lie in order inside their cue; the first may not be empty. Unknown times count as neither."""
    at = F.transform(stored, lambda w: F.struct(w["start_us"].alias("s"), w["end_us"].alias("e")))
    none = F.array(F.lit(None).cast("long"))

    def checks(x: Column) -> Column:
        before = F.concat(none, F.transform(x, lambda w: w["s"]))

        def fits(z: Column) -> Column:
            s, e, ps = z["at"]["s"], z["at"]["e"], z["ps"]
            inside = (s >= start - 1) & (e <= end + 1) & (e >= s)
            return inside & (ps.isNull() | (s >= ps - 1)) & (ps.isNotNull() | (e > s))

        return F.transform(F.arrays_zip(x.alias("at"), F.slice(before, F.lit(1), F.size(x)).alias("ps")), fits)

    def settled(x: Column) -> Column:
        return F.coalesce(F.array_contains(x, True), F.lit(False)) & ~F.coalesce(F.array_contains(x, False), F.lit(False))

    return X.once(X.once(at, checks), settled)


def usable_words(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Stored words where they fit their cue, otherwise words spread by character length.

    The words of a cue meet it as an array and are checked there; of a key with several
    cues no words are taken over.
    """
    cue = ["track_id", "cue_id"]
    shown = words.filter(F.col("text").rlike(r"(?U)[^\s\x{FEFF}]"))
    packed = shown.groupBy(*cue).agg(_stored_in(words).alias("_stored"))
    met = _with_stored(cues, packed, "left").withColumn("_t", X.highlight_tokens("text"))
    fits = (F.col("_n") == 1) & (F.size("_stored") == F.size("_t")) & _fits(F.col("_stored"), F.col("start_us"), F.col("end_us"))
    met = met.withColumn("stored", F.coalesce(fits, F.lit(False)))
    met = met.withColumn("_t", F.when(~F.col("stored"), F.col("_t")).otherwise(F.array().cast("array<string>")))
    return _spread(met, "characters").select(*cue, "stored", F.inline(F.when(F.col("stored"), F.col("_stored")).otherwise(F.col("_words")))).select(
        *cue, "word_idx", "text", "start_us", "end_us", "stored"
    )


def cursor_scan(
    scan: OrderedScan,
    advance: Column,
    floor: Column,
    reset: Column,
    initial: Column | int,
) -> OrderedScan:
    """Add ``cursor_us``, the running position before each row.

    Each row maps the cursor c to ``max(c + advance, floor)`` (a null floor
    never binds), and a reset row to ``floor`` whatever c was. Such maps compose
    associatively, so the recurrence is two prefix aggregates: a sum, and a
    maximum inside the current reset group. Groups are compared first in the
    struct, so the latest one always wins the maximum.
    """
    zero = F.lit(0).cast("long")
    scan = scan.let(_adv=F.when(reset, zero).otherwise(advance).cast("long"), _reset=reset.cast("int"))
    scan = scan.add(_sum=sum_before("_adv"), _grp=sum_upto("_reset"))
    bound = F.struct(
        F.col("_grp").alias("g"), (floor - F.col("_sum") - F.col("_adv")).cast("long").alias("v")
    )
    scan = scan.let(_floor=F.when(floor.isNotNull(), bound)).add(_best=max_before("_floor"))
    best = F.when(F.col("_best.g") == F.col("_grp"), F.col("_best.v"))
    start = initial if isinstance(initial, Column) else F.lit(initial)
    base = F.when(F.col("_grp") == 0, F.greatest(best, start)).otherwise(best)
    scan = scan.let(cursor_us=(F.col("_sum") + base).cast("long"))
    return OrderedScan(scan.df.drop("_adv", "_reset", "_sum", "_grp", "_floor", "_best"), scan.keys, scan.order, scan.chunked)


def time_scenes_sequentially(
    scenes: DataFrame,
    duration: Column,
    pause_ms: int = 300,
    lead_in_ms: int = 150,
    hot: bool | None = None,
) -> DataFrame:
    """Back-to-back scenes; locked rows keep their span and only push the cursor on."""
    pause = ms(max(0, min(5000, pause_ms)))
    lead = ms(max(0, min(5000, lead_in_ms)))
    fixed = (
        F.coalesce(F.col("locked") & (F.col("end_us") > F.col("start_us")), F.lit(False))
        if "locked" in scenes.columns
        else F.lit(False)
    )
    df = scenes.withColumns({"_fixed": fixed, "_dur": duration.cast("long")})
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot)
    floor = F.when(F.col("_fixed"), F.col("end_us") + pause) if "locked" in scenes.columns else F.lit(None).cast("long")
    advance = F.when(F.col("_fixed"), F.lit(0)).otherwise(F.col("_dur") + pause)
    scan = cursor_scan(scan, advance, floor, F.lit(False), lead)
    out = scan.done()
    cur = F.col("cursor_us")
    old = {c: F.col(c) if c in scenes.columns else F.lit(None).cast("long") for c in ("start_us", "end_us")}
    return out.withColumns(
        {
            "start_us": F.when(F.col("_fixed"), old["start_us"]).otherwise(cur),
            "end_us": F.when(F.col("_fixed"), old["end_us"]).otherwise(cur + F.col("_dur")),
        }
    ).drop("_fixed", "_dur", "cursor_us")


def sequential_total(scenes: DataFrame, timed: DataFrame, pause_ms: int = 300) -> DataFrame:
    """Length of each sequential timeline: the last end plus the tail after an unlocked last scene."""
    pause = ms(pause_ms)
    locked = F.coalesce(F.col("locked"), F.lit(False)) if "locked" in timed.columns else F.lit(False)
    last = timed.groupBy("track_id").agg(
        F.max_by(F.struct(F.col("end_us").alias("e"), locked.alias("l")), "seq").alias("last"),
        F.max(F.when(locked, F.col("end_us") + pause)).alias("held"),
    )
    tail = F.when(F.col("last.l"), F.col("held")).otherwise(F.col("last.e") + ms(250))
    return last.select("track_id", tail.cast("long").alias("total_us"))


def anchored_timeline(
    scenes: DataFrame,
    reading_us: Column,
    pause_us: int = ms(250),
    min_us: int = ms(200),
    hot: bool | None = None,
) -> DataFrame:
    """Scene starts and ends where explicit values win and the rest follows on.

    Optional inputs per scene, in microseconds: ``at_us`` (start), ``until_us``
    (end), ``length_us`` and ``pause_after_us``.
    """
    pause = F.coalesce(F.col("pause_after_us"), F.lit(pause_us))
    given = F.greatest(F.lit(min_us), F.coalesce(F.col("length_us"), reading_us))
    df = scenes.withColumns({"_len": given.cast("long"), "_pause": pause.cast("long")})
    at, until = F.col("at_us"), F.col("until_us")
    open_end = F.when(until.isNull(), F.col("_len")).otherwise(F.lit(min_us))
    anchored_end = F.greatest(at + min_us, F.coalesce(until, at + F.col("_len")))
    floor = (
        F.when(at.isNotNull(), anchored_end + F.col("_pause"))
        .when(until.isNotNull(), until + F.col("_pause"))
    )
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot)
    scan = cursor_scan(scan, open_end + F.col("_pause"), floor, at.isNotNull(), 0)
    out = scan.done().withColumn("start_us", F.coalesce(at, F.col("cursor_us")).cast("long"))
    end = F.greatest(F.col("start_us") + min_us, F.coalesce(until, F.col("start_us") + F.col("_len")))
    return out.withColumn("end_us", end.cast("long")).drop("_len", "_pause", "cursor_us")


def apply_measured_cues(
    lines: DataFrame, measured: DataFrame, pause_ms: int = 300, hot: bool | None = None
) -> DataFrame:
    """Lines with a measured cue take it; silent lines follow on from the line before."""
    pause = ms(max(0, pause_ms))
    cues = measured.select(
        "track_id", "cue_id", F.col("start_us").alias("_ms"), F.col("end_us").alias("_me")
    )
    df = lines.join(cues, ["track_id", "cue_id"], "left")
    has = F.col("_ms").isNotNull()
    df = df.withColumn("_ms", F.when(has, F.greatest(F.lit(0), F.col("_ms"))))
    df = df.withColumns(
        {
            "_me": F.when(has, F.greatest(F.col("_ms") + 100_000, F.col("_me"))),
            "_span": F.greatest(F.lit(ms(1200)), F.col("end_us") - F.col("start_us")),
        }
    )
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot)
    scan = cursor_scan(scan, F.col("_span") + pause, F.when(has, F.col("_me") + pause), has, 0)
    out = scan.done()
    return out.withColumns(
        {
            "start_us": F.coalesce("_ms", "cursor_us").cast("long"),
            "end_us": F.coalesce(F.col("_me"), F.col("cursor_us") + F.col("_span")).cast("long"),
            "source": F.when(has, "tts").otherwise(F.col("source")) if "source" in lines.columns else F.when(has, "tts"),
        }
    ).drop("_ms", "_me", "_span", "cursor_us")


def stitch_clips(
    clips: DataFrame,
    sample_rate: int,
    lead_in_us: int = 120_000,
    pause_us: int = 300_000,
    tail_us: int = 240_000,
    hot: bool | None = None,
) -> DataFrame:
    """Frame offsets and cue times of clips played one after another; empty clips drop out."""

    def frames(us: int) -> int:
        return max(0, int(us * sample_rate / 1_000_000 + 0.5))

    lead, pause, tail = frames(lead_in_us), frames(pause_us), frames(tail_us)
    df = clips.filter(F.col("n_frames") > 0)
    scan = OrderedScan.over(df, KEYS, ["seq"], hot=hot).add(
        _at=sum_before(F.col("n_frames") + pause), _sum=group_sum(F.col("n_frames") + pause)
    )
    first = F.col("_at") + lead
    last = first + F.col("n_frames")

    def to_us(frame: Column) -> Column:
        return round_half_up(frame / F.lit(sample_rate) * 1_000_000)

    return scan.done().withColumns(
        {
            "start_frame": first.cast("long"),
            "end_frame": last.cast("long"),
            "start_us": to_us(first),
            "end_us": to_us(last),
            "total_us": to_us(F.col("_sum") - pause + lead + tail),
        }
    ).drop("_at", "_sum")


def timeline_extent(projects: DataFrame, cues: DataFrame) -> DataFrame:
    """Composition length per project: the longest of audio, enabled voice and cues, plus cards."""
    last = cues.groupBy("track_id").agg(F.max("end_us").alias("_last"))
    body = F.greatest(
        F.coalesce(F.col("audio_us"), F.lit(0)),
        F.when(F.col("voice_enabled"), F.coalesce(F.col("voice_us"), F.lit(0))).otherwise(0),
        F.coalesce(F.col("_last"), F.lit(0)),
    )
    total = F.greatest(
        F.coalesce("intro_us", F.lit(0)) + body + F.coalesce("outro_us", F.lit(0)), F.lit(1_000_000)
    )
    return projects.join(last, "track_id", "left").select("track_id", total.cast("long").alias("timeline_us"))
