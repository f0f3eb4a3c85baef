"""Times of a transcript on known lines: the text supplies the words, the transcript their times.

A recording's lines and transcript are aligned as wholes; words without evidence are spread
between those that have some, and confidence says which is which. For many transcripts and
many texts, pairs are found first: a transcript must hold a share of a text's shingles.
Texts and transcripts with equal shingles are one each while pairs are looked for, and of a text
only its rarest shingles are looked up, so many that a transcript with the share has one of
them; a shingle that is everywhere is met only by texts that have nothing rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.operators.align import BATCH_ROWS, align_tokens, dealt, shingles, windows
from cuestream.operators.ordered import fill_unmatched_words
from cuestream.operators.postprocess import PostProcessOptions, post_process
from cuestream.plans.session import cut_lineage

SHINGLE = 5
SHARE = 0.5
ACCEPT = 0.4
#: Hashes that are sent to every task.
MOST_SENT = 1 << 20


# ---------------------------------------------------------------- which transcripts hold which texts


def _classes(df: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """(rep, s) of distinct lists of hashes, and (ident, rep)."""
    marked = df.select(ident, "s", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"))
    first = marked.groupBy("k1", "k2").agg(F.min(ident).alias("rep"))
    named = marked.join(first, ["k1", "k2"])
    return named.filter(F.col(ident) == F.col("rep")).select("rep", "s").dropDuplicates(["rep"]), named.select(ident, "rep")


def _hashes(shingle_list: Column) -> Column:
    return F.transform(shingle_list, lambda s: F.xxhash64(s))


def _known(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose ``h`` is known; the known are sent to all tasks while they are few, else both sides are dealt by ``h``."""
    return df.join(F.broadcast(known) if known.count() <= MOST_SENT else known, "h", "left_semi")


def containing_pairs(left: DataFrame, right: DataFrame, size: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """Pairs ``(left_id, right_id, shared)`` where the left tokens hold at least ``share`` of the right's shingles.

    ``left(left_id, tokens)``, ``right(right_id, tokens)``. A right side of fewer than ``size``
    words is one shingle, which may stand anywhere in the left side. The left tokens are read
    once: of a left side only the shingles that a right side has are kept.
    """
    full = F.size("tokens") > 0
    wanted = cut_lineage(
        right.filter(full).select("right_id", F.least(F.size("tokens"), F.lit(size)).alias("n"), F.array_sort(F.array_distinct(_hashes(shingles(F.col("tokens"), size)))).alias("s"))
    )
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # as many as ``size`` at most
    known = wanted.select(F.explode("s").alias("h")).distinct()
    # windows of every length that a short text has; those that no text has go at once
    held = F.flatten(F.array(F.array().cast("array<string>"), *[windows(F.col("tokens"), n) for n in lengths]))
    met = _known(left.filter(full).select("left_id", F.explode(_hashes(held)).alias("h")), cut_lineage(known))
    have = cut_lineage(met.groupBy("left_id").agg(F.array_sort(F.collect_set("h")).alias("s")))
    lc, lm = _classes(have, "left_id")
    rc, rm = _classes(wanted, "right_id")
    items = rc.select(F.col("rep").alias("r"), "s")
    posted = lc.select(F.col("rep").alias("l"), F.explode("s").alias("h"))
    often = posted.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = items.select("r", F.size("s").alias("k"), F.explode("s").alias("h")).join(often, "h", "left")
    # the shingles of one text, which came out of one cell
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.coalesce("n", F.lit(0)), "h"))
    need = F.ceil(F.lit(share) * F.col("k"))
    rare = ranked.withColumn("place", place).filter(F.col("place") <= F.col("k") - need + 1).select("r", "h")
    pairs = posted.join(rare, "h").select("l", "r").distinct()
    sets = lc.select(F.col("rep").alias("l"), F.col("s").alias("have"))
    counted = pairs.join(items, "r").join(sets, "l").select("l", "r", F.size(F.array_intersect("s", "have")).alias("shared"), F.size("s").alias("k"))
    good = counted.filter((F.col("shared") > 0) & (F.col("shared") >= F.lit(share) * F.col("k"))).select("l", "r", "shared")
    named = good.join(lm.withColumnRenamed("rep", "l"), "l").join(rm.withColumnRenamed("rep", "r"), "r")
    return named.select("left_id", "right_id", F.col("shared").cast("long").alias("shared"))


# ---------------------------------------------------------------- times


def line_words(lines: DataFrame) -> DataFrame:
    """(track_id, cue_id, word_idx, text, norm) of the words shown for each line."""
    words = lines.select("track_id", "cue_id", F.posexplode(X.highlight_tokens("text")).alias("word_idx", "text"))
    return words.withColumns({"word_idx": F.col("word_idx").cast("long"), "norm": X.norm_match("text")})


TIMES = "track_id string, cue_id bigint, word_idx bigint, start_us bigint, end_us bigint, confidence double, score double"


def transfer_times(pairs: DataFrame, accept: float = ACCEPT, unit: str = "characters") -> DataFrame:
    """Every word of ``said`` with the times of the word it is aligned with, or nulls, and the track's score.

    ``pairs``: track_id, ``said`` (cue_id, word_idx, norm in order) and ``heard`` (norm, start_us,
    end_us, confidence in order), both of one recording. The score is the mean similarity
    over all aligned places; ``unit`` is what edits of a word are counted in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in TIMES.split(", ")])
            return out.astype({"start_us": "Int64", "end_us": "Int64", "confidence": "Float64"})

        for pdf in batches:
            rows: list[tuple] = []
            for track, said, heard in zip(pdf.track_id, pdf.said, pdf.heard, strict=True):
                got = align_tokens([w["norm"] for w in said], [w["norm"] for w in heard], unit=unit)
                score = sum(s for _, _, s in got) / len(got) if got else 0.0
                for i, j, s in got:
                    if i >= 0:
                        w, t = said[i], heard[j] if j >= 0 and s >= accept else None
                        times = (t["start_us"], max(t["start_us"], t["end_us"]), min(0.95, s * t["confidence"])) if t is not None else (None,) * 3
                        rows.append((track, w["cue_id"], w["word_idx"], *times, score))
                if len(rows) >= BATCH_ROWS:
                    yield joined(rows)
                    rows = []
            if rows:
                yield joined(rows)

    return dealt(pairs.select(F.col("track_id").cast("string"), "said", "heard"), ["track_id"]).mapInPandas(run, TIMES)


def _packed(words: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
    """The words of one recording as a sorted list."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return words.groupBy("track_id").agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def reconcile(
    lines: DataFrame, transcript: DataFrame, accept: float = ACCEPT, options: PostProcessOptions | None = PostProcessOptions(), unit: str = "characters"
) -> tuple[DataFrame, DataFrame]:
    """Lines and words with the transcript's times.

    ``lines(track_id, cue_id, text, start_us, end_us)`` with cue ids in line order,
    ``transcript(track_id, idx, text, start_us, end_us, confidence)``. Returns lines (with
    confidence and source) and words (track_id, cue_id, word_idx, text, norm, start_us,
    end_us, confidence, source). A track without a transcript keeps its lines, at
    confidence 0.2. ``options`` of None leaves out the passes over the new line times.
    """
    lines = lines.select(F.col("track_id").cast("string").alias("track_id"), F.col("cue_id").cast("long").alias("cue_id"), "text", "start_us", "end_us")
    heard = transcript.select(F.col("track_id").cast("string").alias("track_id"), "idx", X.norm_match("text").alias("norm"), "start_us", "end_us", "confidence")
    words = line_words(lines)
    pairs = _packed(words, ["cue_id", "word_idx"], ["cue_id", "word_idx", "norm"], "said").join(
        _packed(heard, ["idx"], ["norm", "start_us", "end_us", "confidence"], "heard"), "track_id"
    )
    timed = transfer_times(pairs, accept, unit)
    score = timed.groupBy("track_id").agg(F.max("score").alias("score"))
    at = lines.select("track_id", "cue_id", F.col("start_us").alias("line_us"))
    sure = F.col("start_us").isNotNull()
    full = timed.join(at, ["track_id", "cue_id"]).select(
        "track_id", "cue_id", "word_idx", F.coalesce("start_us", "line_us").alias("start_us"), F.coalesce("end_us", "line_us").alias("end_us"),
        F.coalesce("confidence", F.lit(0.25)).alias("confidence"), F.when(sure, "asr").otherwise("estimate").alias("source"),
    )
    filled = fill_unmatched_words(full, lines.select("track_id", "cue_id", "start_us", "end_us"))
    new_words = filled.join(words, ["track_id", "cue_id", "word_idx"]).select(
        "track_id", "cue_id", "word_idx", "text", "norm", "start_us", "end_us", "confidence", "source"
    )
    ends = filled.groupBy("track_id", "cue_id").agg(F.min_by("start_us", "word_idx").alias("first"), F.max_by("end_us", "word_idx").alias("last"))
    met = lines.join(score, "track_id", "left").join(ends, ["track_id", "cue_id"], "left")
    start = F.coalesce("first", "start_us")
    found = F.col("score").isNotNull()
    new_lines = met.select(
        "track_id", "cue_id", "text",
        F.when(found, start).otherwise(F.col("start_us")).alias("start_us"),
        F.when(found, F.greatest(start, F.coalesce("last", "end_us"))).otherwise(F.col("end_us")).alias("end_us"),
        F.when(found, F.least(F.lit(0.92), 0.3 + 0.5 * F.col("score"))).otherwise(F.lit(0.2)).alias("confidence"),
        F.when(found, "align").otherwise("unchanged").alias("source"),
    )
    if options is not None:
        kept = new_lines.filter(F.col("source") == "unchanged")
        new_lines = post_process(new_lines.filter(F.col("source") == "align"), options, hot=False).unionByName(kept)
    return new_lines, new_words


def _folded(words: DataFrame, ident: str, order: list[str], text: str) -> DataFrame:
    """(ident, tokens) with the matching forms of the words of each id, in order."""
    listed = words.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("x"))
    return listed.select(ident, X.fold_words(F.transform("x", lambda x: x["t"])).alias("tokens"))


def reconcile_corpus(transcripts: DataFrame, items: DataFrame, share: float = SHARE, **how) -> tuple[DataFrame, DataFrame]:
    """``reconcile`` of every text with every transcript that holds it.

    ``transcripts(left_id, idx, text, start_us, end_us, confidence)``, one row per word, and
    ``items(right_id, cue_id, text, start_us, end_us)``, one row per line. Tracks of the
    result are named ``left_id:right_id``.
    """
    said = items.select("right_id", "cue_id", F.posexplode(X.highlight_tokens("text")).alias("word_idx", "word"))
    right = _folded(said, "right_id", ["cue_id", "word_idx"], "word")
    left = _folded(transcripts, "left_id", ["idx"], "text")
    # read for the transcripts and for the texts
    pairs = cut_lineage(containing_pairs(left, right, share=share).select("left_id", "right_id"))
    track = F.concat_ws(":", "left_id", "right_id").alias("track_id")
    heard = transcripts.join(pairs, "left_id").select(track, "idx", "text", "start_us", "end_us", "confidence")
    lines = items.join(pairs, "right_id").select(track, "cue_id", "text", "start_us", "end_us")
    return reconcile(lines, heard, **how)
