"""Line dedup by distinct-site spread.

Each line's sites go into a HyperLogLog sketch, keyed by a 128-bit hash of the line; the
sketches merge by aggregation, so a line that is everywhere costs a row per map task. The
estimate decides where it is clear of the threshold; lines near it get an exact count of
their distinct sites. A line of at least ``min_sites`` sites is boilerplate: it stays at its
first place (smallest document id, then smallest line number) and goes everywhere else.

Defined results: null text has no lines and stays null; lines without a word are never
removed; a null site is no site; a row without an id loses nothing. Rows that share a document id
are told apart by their texts: each loses its own lines only, and equal lines at the first
place of several of them all stay. A document may end up empty but stays a
row. Ties cannot arise, as a place is unique. Empty tables give empty results. All columns
pass through, whatever their names; a very long text is split inside its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.shared import keep

HAS_WORD = r"[^\x20\x09-\x0D]"
MIN_SITES = 10
#: Relative half-width of the band around the threshold that is counted exactly: over five
#: standard errors of a sketch with 2**LOG_REGISTERS registers.
LOG_REGISTERS = 10
BAND = 0.2


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str | None = "source") -> DataFrame:
    """Rows (doc_id, place, k1, k2) of every line with a word, with the site or else the hash of
    the text as ``row``; k1, k2 hash the line."""
    cols = [F.col(f"`{doc_id}`").cast("long").alias("doc_id")]
    cols.append(F.col(f"`{site}`").cast("string").alias("site") if site else F.xxhash64(f"`{text}`").alias("row"))
    split = docs.select(*cols, F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("place", "line"))
    keys = (F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))
    kept = split.filter(F.col("line").rlike(HAS_WORD) & F.col("doc_id").isNotNull())
    return kept.select("doc_id", "place", *keys, "site" if site else "row")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Keys of lines with at least ``min_sites`` sites, and their first place."""
    lines = lines_of(docs, doc_id, text, site)
    spread = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"),
        F.min(F.struct("doc_id", "place")).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    # a line on fewer places than the threshold has fewer sites
    some = spread.filter(F.col("n") >= min_sites)
    judged = some.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    clear = judged.filter(F.col("sites") > min_sites * (1 + BAND)).select("k1", "k2", "first")
    near = judged.filter(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND)))
    near = near.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "first")
    exact = (
        lines.filter("site is not null")
        .join(near, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")))
        .select("k1", "k2", "first", "site")
        .distinct()
        .groupBy("k1", "k2", "first")
        .count()
        .filter(F.col("count") >= min_sites)
        .select("k1", "k2", "first")
    )
    return clear.unionByName(exact)


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Per text that loses lines: doc_id, ``row`` (hash of the text) and the line numbers (from 0) to remove."""
    # written, so that the join below has plain exchanges, which adaptive execution splits for a hot line
    kept = keep(boilerplate(docs, min_sites, doc_id, text, site), "boilerplate")
    found = kept.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "first")
    lines = lines_of(docs, doc_id, text, None)
    hits = lines.join(found, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
    later = hits.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
    # the lines of one document came out of one cell
    return later.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))


def clean(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    with_counts: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines removed; ``with_counts`` returns a struct ``d`` and n_lines, n_removed."""
    gone = removed_lines(docs, min_sites, doc_id, text, site).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "places")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    mine = (F.col(f"d.`{doc_id}`").cast("long") == F.col("gone_id")) & (F.xxhash64(f"d.`{text}`") == F.col("gone_row"))
    joined = packed.join(gone, mine, "left")
    split = F.split(F.col(f"d.`{text}`"), "\n")
    marked = F.transform(split, lambda line, i: F.when(F.array_contains(F.col("places"), i), None).otherwise(line))
    new = F.when(F.col("places").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(F.array_compact(marked), "\n"))
    columns = [(new if c == text else F.col(f"d.`{c}`")).alias(c) for c in docs.columns]
    if not with_counts:
        return joined.select(*columns)
    counts = (
        F.coalesce(F.size(F.filter(split, lambda line: line.rlike(HAS_WORD))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return joined.select(F.struct(*columns).alias("d"), *counts)
