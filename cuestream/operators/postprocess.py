"""Clean-up passes over timed cues.

Cues carry ``track_id, cue_id, start_us, end_us`` and optionally ``locked`` and
``words`` (array of structs with ``start_us`` and ``end_us``), which follow
their cue without a join. Each pass is one ordered scan; passes share the track
key, so Spark shuffles once and only re-sorts between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions.timecode import ms, round_half_up
from cuestream.plans.joins import nearest_join
from cuestream.plans.scan import OrderedScan, group_max, has_hot_group, max_before, next_row, prev_row

KEYS = ["track_id"]
BY_START = ["start_us", "cue_id"]


@dataclass(frozen=True)
class PostProcessOptions:
    min_line_us: int = ms(600)
    apply_lead_in: bool = False
    lead_in_us: int = ms(300)
    gap_fill_us: int = ms(400)
    beat_tolerance_us: int = ms(90)
    idle_min_us: int = ms(2500)


def _locked(df: DataFrame) -> Column:
    return F.coalesce(F.col("locked"), F.lit(False)) if "locked" in df.columns else F.lit(False)


def _move_words(df: DataFrame, change: Column, edit) -> DataFrame:
    """Apply ``edit`` (word struct -> (start, end)) to nested words where ``change`` holds."""
    if "words" not in df.columns:
        return df

    def moved(w: Column) -> Column:
        start, end = edit(w)
        return w.withField("start_us", start.cast("long")).withField("end_us", end.cast("long"))

    return df.withColumn("words", F.when(change, F.transform("words", moved)).otherwise(F.col("words")))


def sort_cues(cues: DataFrame) -> DataFrame:
    """Global deterministic order by track, start and id (a range sort, no single-task stage)."""
    return cues.orderBy("track_id", "start_us", "cue_id")


def clamp_timings(cues: DataFrame, duration: Column | None = None) -> DataFrame:
    """Keep every span inside ``[0, duration]`` with start at most end."""
    start = F.greatest(F.lit(0), F.col("start_us"))
    bounded = F.col("end_us") if duration is None else F.least(F.col("end_us"), duration)
    df = cues.withColumns({"_s": start, "_e": F.greatest(start, bounded)})
    changed = (F.col("_s") != F.col("start_us")) | (F.col("_e") != F.col("end_us"))

    def inside(w: Column):
        s = F.least(F.greatest(w["start_us"], F.col("_s")), F.col("_e"))
        return s, F.least(F.greatest(w["end_us"], s), F.col("_e"))

    df = _move_words(df, changed, inside)
    return df.withColumns({"start_us": F.col("_s"), "end_us": F.col("_e")}).drop("_s", "_e")


def enforce_minimum_duration(cues: DataFrame, min_line_us: int = ms(600)) -> DataFrame:
    """Lengthen short cues; their words stretch in proportion."""
    short = F.col("end_us") - F.col("start_us") < min_line_us
    df = cues.withColumn("_e", F.when(short, F.col("start_us") + min_line_us).otherwise(F.col("end_us")))
    if "words" in df.columns:
        first = F.element_at("words", 1)["start_us"]
        old = F.greatest(F.lit(1), F.element_at("words", -1)["end_us"] - first)
        new = F.greatest(F.lit(1), F.col("_e") - F.col("start_us"))
        df = df.withColumns({"_first": F.when(F.size("words") > 0, first), "_scale": F.when(F.size("words") > 0, new / old)})

        def stretched(w: Column):
            def at(c):
                return round_half_up(F.col("start_us") + (c - F.col("_first")) * F.col("_scale"))

            return at(w["start_us"]), at(w["end_us"])

        df = _move_words(df, short & (F.size("words") > 0), stretched).drop("_first", "_scale")
    return df.withColumn("end_us", F.col("_e")).drop("_e")


def _shift_to(df: DataFrame, new_start: Column) -> DataFrame:
    df = df.withColumn("_s", new_start)
    delta = F.col("_s") - F.col("start_us")

    def shifted(w: Column):
        return F.greatest(F.lit(0), w["start_us"] + delta), F.greatest(F.lit(0), w["end_us"] + delta)

    return _move_words(df, delta != 0, shifted).withColumn("start_us", F.col("_s")).drop("_s")


def apply_lead_in(
    cues: DataFrame, lead_in_us: int = ms(300), order: list[str] | None = None, hot: bool | None = None
) -> DataFrame:
    """Start earlier by the lead-in, never before the previous row's end; locked rows stay."""
    scan = OrderedScan.over(cues, KEYS, order or BY_START, hot=hot).add(_pe=prev_row("end_us"))
    df = scan.done()
    start = F.greatest(F.coalesce(F.col("_pe"), F.lit(0)), F.col("start_us") - lead_in_us)
    return _shift_to(df, F.when(_locked(df), F.col("start_us")).otherwise(start)).drop("_pe")


def fill_gaps(cues: DataFrame, gap_fill_us: int = ms(400), hot: bool | None = None) -> DataFrame:
    """Extend an end to the next start across short silences; locked rows stay."""
    df = OrderedScan.over(cues, KEYS, BY_START, hot=hot).add(_ns=next_row("start_us")).done()
    gap = F.col("_ns") - F.col("end_us")
    fill = F.coalesce(~_locked(df) & (gap > 0) & (gap <= gap_fill_us), F.lit(False))
    return df.withColumn("end_us", F.when(fill, F.col("_ns")).otherwise(F.col("end_us"))).drop("_ns")


def resolve_overlaps(cues: DataFrame, duration: Column | None = None, hot: bool | None = None) -> DataFrame:
    """Move a start to the latest earlier end, at most to the cue's own end."""
    df = OrderedScan.over(cues, KEYS, BY_START, hot=hot).add(_pe=max_before("end_us")).done()
    earlier = F.greatest(F.lit(0), F.col("_pe"))
    start = F.when(F.col("start_us") < earlier, F.least(earlier, F.col("end_us"))).otherwise(F.col("start_us"))
    return clamp_timings(_shift_to(df, start).drop("_pe"), duration)


def idle_regions(
    cues: DataFrame, tracks: DataFrame, min_length_us: int = ms(2500), hot: bool | None = None
) -> DataFrame:
    """Stretches of a track no cue covers, including the tail up to its duration."""
    timed = cues.filter(F.col("end_us") > F.col("start_us"))
    lengths = tracks.select("track_id", "duration_us").filter(F.col("duration_us") > 0)
    df = OrderedScan.over(timed, KEYS, BY_START, hot=hot).add(_pe=max_before("end_us")).done()
    cursor = F.greatest(F.lit(0), F.col("_pe"))
    inner = (
        df.select("track_id", cursor.alias("start_us"), F.col("start_us").alias("end_us"))
        .filter(F.col("end_us") - F.col("start_us") >= min_length_us)
        .join(lengths.select("track_id"), "track_id", "left_semi")
    )
    last = timed.groupBy("track_id").agg(F.greatest(F.lit(0), F.max("end_us")).alias("last"))
    tail = (
        lengths.join(last, "track_id", "left")
        .select("track_id", F.coalesce("last", F.lit(0)).cast("long").alias("start_us"), F.col("duration_us").alias("end_us"))
        .filter(F.col("end_us") - F.col("start_us") >= min_length_us)
    )
    return inner.unionByName(tail)


def snap_words_to_beats(
    words: DataFrame, beats: DataFrame, tolerance_us: int = ms(90), hot: bool | None = None
) -> DataFrame:
    """Snap word starts to the nearest beat in tolerance, then repair the order inside each cue."""
    near = nearest_join(
        words, beats.select("track_id", "beat_us"), KEYS, "start_us", "beat_us", "word_idx", "beat_us", hot=hot
    )
    beat = F.col("nearest.beat_us")
    hit = ~_locked(words) & (F.abs(beat - F.col("start_us")) <= tolerance_us)
    df = near.withColumn("_s", F.when(hit, beat).otherwise(F.col("start_us"))).drop("nearest")
    df = df.withColumns(
        {"_moved": (F.col("_s") != F.col("start_us")).cast("int"), "_m": F.greatest(F.col("_s"), F.col("end_us"))}
    )
    cue = ["track_id", "cue_id"]
    scan = OrderedScan.over(df, cue, ["word_idx"], hot=hot).add(_pe=max_before("_m"), _any=group_max("_moved"))
    start = F.greatest(F.col("_s"), F.coalesce(F.col("_pe"), F.lit(-1)))
    out = scan.done().withColumn("_s", F.when(F.col("_any") == 1, start).otherwise(F.col("start_us")))
    end = F.when(F.col("_any") == 1, F.greatest(F.col("end_us"), F.col("_s"))).otherwise(F.col("end_us"))
    return out.withColumns({"end_us": end, "start_us": F.col("_s")}).drop("_s", "_m", "_pe", "_any", "_moved")


def post_process(
    cues: DataFrame,
    options: PostProcessOptions = PostProcessOptions(),
    duration: Column | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """All passes in the order they depend on each other; word refresh is a separate step."""
    if hot is None:
        hot = has_hot_group(cues, KEYS)
    first_order = ["_s0", "cue_id"]
    df = cues.withColumn("_s0", F.col("start_us"))
    df = clamp_timings(df, duration)
    df = enforce_minimum_duration(df, options.min_line_us)
    df = resolve_overlaps(df, duration, hot)
    if options.apply_lead_in:
        df = apply_lead_in(df, options.lead_in_us, first_order, hot)
    df = fill_gaps(df, options.gap_fill_us, hot)
    df = resolve_overlaps(df, duration, hot)
    return df.drop("_s0")


def timing_audit(
    cues: DataFrame, duration: Column, min_line_us: int = ms(600), hot: bool | None = None
) -> DataFrame:
    """Per track: how many cues break order, overlap, minimum length or the track bounds."""
    scan = OrderedScan.over(cues, KEYS, BY_START, hot=hot).add(_pe=max_before("end_us"))
    n = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    return scan.done().groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_cues"),
        n(F.col("end_us") < F.col("start_us")).alias("n_inverted"),
        n(F.col("start_us") < F.col("_pe")).alias("n_overlapping"),
        n(F.col("end_us") - F.col("start_us") < min_line_us).alias("n_short"),
        n((F.col("start_us") < 0) | (F.col("end_us") > duration)).alias("n_outside"),
    )
