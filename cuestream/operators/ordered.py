"""Ordered per-key logic: unmatched words, anchors, command logs, undo history."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.functions.timecode import ms, round_half_up
from cuestream.operators.estimate import estimate_line_timings, weight_tenths
from cuestream.operators.postprocess import PostProcessOptions, post_process
from cuestream.operators.tap_log import TapState, fold_tap_log  # noqa: F401
from cuestream.plans.scan import OrderedScan, first_after, prev_row, sum_upto

KEYS = ["track_id"]
MIN_ANCHOR_GAP = ms(380)


def fill_words_in_cell(words: Column, first: Column, last: Column) -> Column:
    """``fill_unmatched_words`` for the words of one cue between ``first`` and ``last``.

    ``words`` is an array of structs with ``start_us``, ``end_us``, ``confidence`` and ``source`` in
    word order, and should be a column of its own. Words of unknown source drop out.
    """
    timed = F.filter(words, lambda w: w["source"].isNotNull())

    def nearest(times: Column, at: Column, edge: Column) -> Column:
        """The time at a place; where it is null, of the nearest before that has one."""
        known = F.filter(F.slice(times, F.lit(1), at), lambda t: t.isNotNull())
        return F.coalesce(F.get(times, at - 1), F.try_element_at(known, F.lit(-1)), edge)

    def filled(run: Column, left: Column, right: Column) -> Column:
        n, span = F.size(run), F.greatest(F.lit(0), right - left)

        def word(w: Column, k: Column) -> Column:
            start, end = left + round_half_up(span * k / n), left + round_half_up(span * (k + 1) / n)
            return w.withField("start_us", start).withField("end_us", F.greatest(start, end)).withField("confidence", F.lit(0.3))

        return F.transform(run, word)

    def cue(t: Column) -> Column:
        sure = F.array_compact(F.transform(t, lambda w, i: F.when(w["source"] != "estimate", i)))
        return F.struct(t.alias("t"), sure.alias("at"))

    def runs(c: Column) -> Column:
        t, at = c["t"], c["at"]
        known = F.transform(at, lambda i: F.get(t, i))
        n = F.size(at)
        ends, starts = F.transform(known, lambda w: w["end_us"]), F.reverse(F.transform(known, lambda w: w["start_us"]))
        # a run lies before each matched word, and one behind the last
        borders = F.transform(F.concat(at, F.array(F.size(t))), lambda to, j: F.struct(to.alias("to"), j.alias("j")))
        before = F.concat(F.array(F.lit(-1)), at)

        def parts(lists: Column) -> Column:
            def run(x: Column) -> Column:
                begin = F.get(lists["before"], x["j"])
                left, right = nearest(lists["ends"], x["j"], first), nearest(lists["starts"], n - x["j"], last)
                return X.once(
                    F.struct(F.slice(t, begin + 2, x["to"] - begin - 1).alias("run"), left.alias("l"), right.alias("r")),
                    lambda y: filled(y["run"], y["l"], y["r"]),
                )

            return F.concat(known, F.flatten(F.transform(borders, run)))

        return X.once(F.struct(ends.alias("ends"), starts.alias("starts"), before.alias("before")), parts)

    return X.once(X.once(timed, cue), runs)


def fill_unmatched_words(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Spread runs of estimate words evenly between the matched words around them.

    The words of a cue came out of one cell; they meet there again, and are timed as an array.
    Matched words without a cue stay, others have nothing to lie between.
    """
    cue = ["track_id", "cue_id"]
    fields = [c for c in words.columns if c not in cue]
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", *[c for c in fields if c != "word_idx"])))
    packed = words.groupBy(*cue).agg(ordered.alias("_words"))
    spans = cues.select(*cue, F.col("start_us").alias("_c0"), F.col("end_us").alias("_c1"), F.lit(True).alias("_met"))
    df = packed.join(spans, cue, "left")
    alone = F.filter("_words", lambda w: w["source"] != "estimate")
    timed = F.when(F.col("_met"), fill_words_in_cell(F.col("_words"), F.col("_c0"), F.col("_c1"))).otherwise(alone)
    return df.select(*cue, F.inline(timed)).select(*words.columns)


def choose_anchors(times: np.ndarray, strengths: np.ndarray, expected: np.ndarray) -> list[int]:
    """One anchor per line, maximising strength minus the deviation from the expected gaps.

    A deviation costs 3 at most, which any gap of four times the expected one reaches. So a
    line looks at the anchors in that range one by one, and at all earlier ones by their
    running best. Every so many lines the scores are kept and the choices in between are
    computed again on the way back, so memory holds about 2 sqrt(lines) rows of anchors.
    """
    n, k = len(expected), len(times)
    if n == 0 or k < n:
        return []
    gain, at = strengths * 2.0, np.arange(k)
    last = np.searchsorted(times, times - MIN_ANCHOR_GAP, side="right") - 1

    def line(i: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores with line i on each anchor, and the anchor of the line before."""
        e = expected[i - 1]
        top = np.maximum.accumulate(score)
        record = np.isfinite(score) & (score > np.concatenate(([-np.inf], top[:-1])))
        before = np.maximum.accumulate(np.where(record, at, -1))
        parent = np.where(last >= 0, before[last], -1)
        total = np.where(parent >= 0, score[parent] + gain - 3.0, -np.inf)
        reach = int((at - np.searchsorted(times, times - 4 * max(1.0, e), side="right")).max())
        for far in range(min(reach, k - 1), 0, -32):  # the earliest of equals
            j = at[:, None] - np.arange(far, max(0, far - 32), -1)
            gap = (times[:, None] - times[j]).astype(float)
            cost = np.minimum(3.0, np.abs(gap - e) / max(1.0, e))
            new = np.where((j >= 0) & (gap >= MIN_ANCHOR_GAP), score[j] + gain[:, None] - cost, -np.inf)
            pick = new.argmax(axis=1)
            better = new[at, pick] > total
            total[better] = new[at, pick][better]
            parent[better] = j[at, pick][better]
        return total, parent

    step = max(1, math.isqrt(n))
    score, kept = gain, {}
    for i in range(1, n):
        if (i - 1) % step == 0:
            kept[i] = score
        score, _ = line(i, score)
    best = int(score.argmax())
    if n == 1 or not np.isfinite(score[best]):
        return []
    chosen = [best]
    for start in sorted(kept, reverse=True):
        score, parents = kept[start], []
        for i in range(start, min(start + step, n)):
            score, parent = line(i, score)
            parents.append(parent)
        for parent in reversed(parents):
            chosen.append(int(parent[chosen[-1]]))
    return chosen[::-1]


def align_lines_to_onsets(
    lines: DataFrame, anchors: DataFrame, tracks: DataFrame, lead_in_us: int = ms(300)
) -> DataFrame:
    """Place each line on an onset; tracks without a full set of onsets return no rows.

    All anchors and all lines of a track count. They meet in one task per track,
    as a few numbers each. Unplaced tracks are for ``estimate_line_timings``.
    """
    counted = lines.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight_tenths("sig")).alias("_tw"))
    short = counted.join(tracks.select("track_id", "duration_us"), "track_id")
    usable = F.greatest(F.lit(1_000_000), F.col("duration_us") - lead_in_us)
    share = usable * weight_tenths("sig") / F.col("_tw")
    placed = lines.join(short, "track_id").select("track_id", "seq", share.alias("share"), "duration_us")

    def place(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("seq"), right.sort_values("time_us")
        expected = np.maximum(400_000.0, left["share"].to_numpy(float))
        strengths = right["strength"].to_numpy(float)
        got = choose_anchors(right["time_us"].to_numpy(np.int64), strengths, expected)
        if not got:
            return pd.DataFrame({"track_id": [], "seq": [], "at_us": [], "strength": [], "share": [], "duration_us": []})
        return left.assign(at_us=right["time_us"].to_numpy()[got], strength=strengths[got])[
            ["track_id", "seq", "at_us", "strength", "share", "duration_us"]
        ]

    schema = "track_id bigint, seq bigint, at_us bigint, strength double, share double, duration_us bigint"
    hits = placed.groupBy("track_id").cogroup(anchors.groupBy("track_id")).applyInPandas(place, schema)
    scan = OrderedScan.over(hits, KEYS, ["seq"], hot=False).add(_next=first_after("at_us"))
    at = F.col("at_us")
    end = F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next") - 150_000, at + 600_000)).otherwise(
        F.least(F.col("duration_us"), at + round_half_up(F.col("share")))
    )
    end = F.when(end <= at, at + 600_000).otherwise(end)
    confidence = F.least(F.lit(0.92), F.greatest(F.lit(0.28), F.lit(0.28) + F.lit(0.62) * F.col("strength")))
    return scan.done().select(
        "track_id", "seq", at.alias("start_us"), end.cast("long").alias("end_us"), confidence.alias("confidence"), F.lit("align").alias("source")
    )


def sync_lines(lines: DataFrame, anchors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Onset placement where it works, a marked estimate elsewhere, then the clean-up passes.

    ``lines`` carry ``track_id, seq, cue_id, text, sig``.
    """
    length = tracks.select("track_id", "duration_us")
    placed = align_lines_to_onsets(lines, anchors, tracks)
    done = placed.select("track_id").distinct()
    rest = estimate_line_timings(lines.join(done, "track_id", "left_anti").join(length, "track_id"), F.col("duration_us"))
    rest = rest.withColumn("confidence", F.lit(0.25))
    cols = ["track_id", "seq", "start_us", "end_us", "confidence", "source"]
    timed = placed.select(*cols).unionByName(rest.select(*cols))
    full = lines.join(timed, ["track_id", "seq"]).join(length, "track_id")
    return post_process(full, PostProcessOptions(apply_lead_in=True), F.col("duration_us")).drop("duration_us")


def coalesce_edits(log: DataFrame, hot: bool | None = None) -> DataFrame:
    """One undo step per run of commands with the same key: first "before", last "after"."""
    scan = OrderedScan.over(log, KEYS, ["seq"], hot=hot).add(_prev=prev_row("coalesce_key"))
    same = F.coalesce(F.col("coalesce_key") == F.col("_prev"), F.lit(False))
    steps = scan.let(_new=(~same).cast("int")).add(step=sum_upto("_new")).done()
    return steps.groupBy("track_id", "step").agg(
        F.max("coalesce_key").alias("coalesce_key"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("before", "seq").alias("before"),
        F.max_by("after", "seq").alias("after"),
    )
