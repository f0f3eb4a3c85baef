"""Song structure from text alone: sections opened by tags, repeats and instrumental markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.operators.assets import repeated_signatures
from cuestream.plans.scan import OrderedScan, last_before, last_upto, position, sum_upto

KEYS = ["track_id"]

# Section kind per tag.
TAG_KINDS = {
    "INTRO": "INTRO", "INTRODUCTION": "INTRO", "VERSE": "VERSE", "VERSE 1": "VERSE", "VERSE 2": "VERSE",
    "VERSE 3": "VERSE", "V1": "VERSE", "V2": "VERSE", "CHORUS": "CHORUS", "REFRAIN": "REFRAIN", "HOOK": "HOOK",
    "PRE-CHORUS": "PRE_CHORUS", "PRECHORUS": "PRE_CHORUS", "PRE CHORUS": "PRE_CHORUS", "BRIDGE": "BRIDGE",
    "BREAKDOWN": "BREAKDOWN", "INSTRUMENTAL": "INSTRUMENTAL", "INTERLUDE": "INSTRUMENTAL", "OUTRO": "OUTRO",
    "END": "OUTRO",
}


def kind_of_tag(tag: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TAG_KINDS.items() for x in pair])
    base = F.trim(F.translate(F.regexp_replace(tag, r"\s*\d+$", ""), "_-", "  "))
    return F.coalesce(F.try_element_at(known, tag), F.try_element_at(known, base), F.lit("UNKNOWN"))


def label_of_kind(kind: Column, occurrence: Column) -> Column:
    pretty = F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))
    numbered = F.concat(pretty, F.lit(" "), occurrence.cast("string"))
    part = F.concat(F.lit("Part "), occurrence.cast("string"))
    return F.when(kind == "UNKNOWN", part).when(occurrence > 1, numbered).otherwise(pretty)


def infer_sections(lines: DataFrame, hot: bool | None = None) -> DataFrame:
    """Kind and section number per line, the tag lines included (``is_tag``).

    Only tags, instrumental markers and repeated lines set the current kind on
    their own. A plain line keeps the kind, except that it turns a chorus into a
    verse, so the state before any line is the last set kind, and a section
    opens where the kind changes or a tag stands. Both are prefix aggregates.
    """
    df = lines if "sig" in lines.columns else lines.withColumn("sig", X.norm_match("text"))
    repeated = repeated_signatures(df).select("track_id", "sig", F.lit(True).alias("_rep"))
    df = df.join(repeated, ["track_id", "sig"], "left").withColumn("_tag", X.structural_tag("text"))
    own = (
        F.when(F.col("_tag").isNotNull(), kind_of_tag(F.col("_tag")))
        .when(X.is_instrumental("sig"), "INSTRUMENTAL")
        .when(F.col("_rep"), "CHORUS")
    )
    after_plain = F.struct("seq", F.col("_own").alias("kind"))
    scan = OrderedScan.over(df.withColumn("_own", own), KEYS, ["seq"], hot=hot)
    scan = scan.let(_set=F.when(F.col("_own").isNotNull(), after_plain)).add(_p=position(), _last=last_before("_set"))
    settled = F.coalesce(F.col("_last.kind"), F.lit("INTRO"))
    kind = F.coalesce(F.col("_own"), F.when(settled == "CHORUS", "VERSE").otherwise(settled))
    scan = scan.let(kind=kind).add(_before=last_before("kind"))
    is_tag = F.col("_tag").isNotNull()
    first = F.col("_before").isNull()
    opens_intro = first & ~is_tag
    changes = ~is_tag & (F.col("kind") != F.coalesce(F.col("_before"), F.lit("INTRO")))
    opened = is_tag.cast("int") + opens_intro.cast("int") + changes.cast("int")
    scan = scan.let(is_tag=is_tag, _open=opened, _intro=opens_intro).add(section_no=sum_upto("_open"))
    return scan.done().drop("_rep", "_tag", "_own", "_set", "_p", "_last", "_before")


def list_sections(assigned: DataFrame, hot: bool | None = None) -> DataFrame:
    """Section rows of ``infer_sections`` output with occurrence per kind and label.

    A leading intro that a repeat or marker replaces at once is listed, although no line belongs to it.
    """
    opening = assigned.filter(F.col("_open") > 0)
    double = F.col("_intro") & (F.col("_open") == 2)
    rows = F.when(
        double,
        F.array(
            F.struct((F.col("section_no") - 1).alias("section_no"), F.lit("INTRO").alias("kind")),
            F.struct("section_no", "kind"),
        ),
    ).otherwise(F.array(F.struct("section_no", "kind")))
    sections = opening.select("track_id", F.explode(rows).alias("s")).select("track_id", "s.*")
    ranked = OrderedScan.over(sections, ["track_id", "kind"], ["section_no"], hot=hot).add(occurrence=position())
    return ranked.done().withColumn("label", label_of_kind(F.col("kind"), F.col("occurrence")))
