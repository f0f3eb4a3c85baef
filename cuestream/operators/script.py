"""Written scripts to scenes: blocks, block kinds, and the lines they are spoken as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.plans.scan import OrderedScan, sum_before

BULLET = r"^(?:[-*•]|\d+[.)])\s+(.+)$"
TITLE_TAG = r"(?i)^\[(title|hook|intro|outro)(?:\s*:\s*([^\]]+))?\]\s*(.*)$"
STAT_TAG = r"(?i)^\[stat\s*:\s*([^\]]+)\]\s*(.+)$"
HEADING = r"^#{1,2}\s+\S"
BYLINE = r"^(?:—|--|-)\s*\S"
FENCE = "```"


def script_blocks(scripts: DataFrame) -> DataFrame:
    """Blocks of each script ``(track_id, text)`` as ordered line arrays.

    A blank line ends a block and a closing fence does too; fenced code stays
    whole. The lines of one script came out of one cell, so groups are bounded.
    """
    lines = scripts.select("track_id", F.posexplode(F.split(X.norm_display("text"), "\n")).alias("seq", "line"))
    fence = F.startswith(F.trim("line"), F.lit(FENCE))
    scan = OrderedScan.over(lines.withColumn("_f", fence.cast("int")), ["track_id"], ["seq"], hot=False)
    scan = scan.add(_open=sum_before("_f"))
    inside = F.col("_open") % 2 == 1
    blank = (F.trim("line") == "") & ~inside
    closing = (F.col("_f") == 1) & inside
    scan = scan.let(_blank=blank, _end=(blank | closing).cast("int")).add(block=sum_before("_end"))
    kept = scan.done().filter(~F.col("_blank"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return kept.groupBy("track_id", "block").agg(F.transform(ordered, lambda x: F.rtrim(x["line"])).alias("lines"))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _join(items: Column) -> Column:
    return F.array_join(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), " ")


def _or(*options: Column) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options])


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Kind of each block (code, bullets, quote, title, stat or prose) and the fields of its scene."""
    raw = F.col("lines")
    full = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")
    df = blocks.withColumn("full", full).filter(F.size("full") > 0)
    n = F.size("full")
    head, second = F.get("full", F.lit(0)), F.get("full", F.lit(1))

    is_fence = F.transform(raw, lambda x: F.startswith(F.trim(x), F.lit(FENCE)))
    f0 = F.coalesce(F.array_position(is_fence, True), F.lit(0)).cast("int")
    df = df.withColumn("_f0", f0)
    rest = F.slice(raw, F.col("_f0") + 1, F.size(raw))
    f1 = F.array_position(F.transform(rest, lambda x: F.startswith(F.trim(x), F.lit(FENCE))), True).cast("int")
    df = df.withColumns({"_rest": F.when(F.col("_f0") > 0, rest), "_f1": F.when(F.col("_f0") > 0, f1)})
    closed = F.col("_f1") > 0
    code = F.when(closed, F.slice("_rest", F.lit(1), F.col("_f1") - 1)).otherwise(F.col("_rest"))
    caption = F.when(closed, _join(F.slice("_rest", F.col("_f1") + 1, F.size("_rest")))).otherwise("")
    heading = _join(F.slice(raw, F.lit(1), F.greatest(F.lit(0), F.col("_f0") - 1)))
    lang = F.trim(F.substring(F.trim(F.get(raw, F.col("_f0") - 1)), 4, 1_000_000))
    df = df.withColumns({"_code": code, "_caption": caption, "_heading": heading, "_lang": F.when(F.col("_f0") > 0, lang)})

    bullet = lambda x: x.rlike(BULLET)
    n_bullets = F.size(F.filter("full", bullet))
    led = F.coalesce(head.rlike(BULLET), F.lit(False))
    listed = (n_bullets >= 2) & (led | (F.coalesce(second.rlike(BULLET), F.lit(False)) & (n_bullets == n - 1)))
    points = F.slice("full", F.when(led, 1).otherwise(2), n)
    items = F.filter(F.transform(points, lambda x: F.when(bullet(x), F.trim(F.regexp_extract(x, BULLET, 1))).otherwise(x)), lambda x: x != "")
    title = F.when(led, "Key Points").otherwise(F.trim(F.regexp_replace(F.regexp_replace(head, r"^#+\s*", ""), ":$", "")))

    quoted = F.startswith(head, F.lit(">")) & F.forall(
        F.transform("full", lambda x, i: F.startswith(x, F.lit(">")) | ((i == n - 1) & x.rlike(BYLINE))), lambda ok: ok
    )
    bare = F.filter(F.transform("full", lambda x: F.trim(F.regexp_replace(x, r"^>\s?", ""))), lambda x: x != "")
    df = df.withColumn("_bare", bare)
    signed = (F.size("_bare") > 1) & F.element_at("_bare", -1).rlike(BYLINE)
    body = F.array_join(F.when(signed, F.slice("_bare", F.lit(1), F.size("_bare") - 1)).otherwise(F.col("_bare")), " ")
    body = F.trim(F.regexp_replace(body, '^[“"]+|[”"]+$', ""))
    author = F.when(signed, F.trim(F.regexp_replace(F.element_at("_bare", -1), r"^(?:—|--|-)\s*", "")))
    df = df.withColumns({"_body": body, "_author": author})

    short = n <= 2
    tag_text = F.trim(F.regexp_extract(head, TITLE_TAG, 3))
    tag_head = F.trim(F.coalesce(_or(tag_text, second), F.lit("")))
    is_title = short & head.rlike(TITLE_TAG) & (tag_head != "")
    is_stat = short & head.rlike(STAT_TAG)
    is_heading = short & head.rlike(HEADING)
    none = F.lit(None).cast("string")
    kind = (
        F.when(F.col("_f0") > 0, "code")
        .when(listed, "bullets")
        .when(quoted & (F.col("_body") != ""), "quote")
        .when(is_title, "title_tag")
        .when(is_stat, "stat")
        .when(is_heading, "title")
        .otherwise("prose")
    )
    df = df.withColumns({"_kind": kind, "_items": items, "_title": title})
    k = F.col("_kind")
    who = X.speaker_prefix(F.col("_title"))
    spoken = F.coalesce(_or(F.col("_heading"), F.col("_caption"), F.trim(F.coalesce(_first(F.col("_code")), F.lit("")))), F.lit("Code example"))
    text = (
        F.when(k == "code", spoken)
        .when(k == "bullets", who["text"])
        .when(k == "quote", F.col("_body"))
        .when(k == "title_tag", tag_head)
        .when(k == "stat", F.trim(F.regexp_extract(head, STAT_TAG, 2)))
        .when(k == "title", F.trim(F.regexp_replace(head, r"^#{1,2}\s+", "")))
    )
    kicker = F.when(k == "code", F.coalesce(_or(F.col("_lang")), F.lit("code"))).when(
        k == "title_tag", _or(F.trim(F.regexp_extract(head, TITLE_TAG, 2)))
    )
    subtext = (
        F.when((k == "code") & (F.col("_heading") != ""), _or(F.col("_caption")))
        .when(k == "quote", F.col("_author"))
        .when(k == "title_tag", F.when(tag_text != "", second))
        .when(k.isin("stat", "title"), second)
        .otherwise(none)
    )
    code_items = F.when(F.size("_code") > 0, F.col("_code")).otherwise(F.array(spoken))
    return df.select(
        "track_id",
        "block",
        "full",
        F.when(k == "title_tag", "title").otherwise(k).alias("layout"),
        text.alias("text"),
        F.when(k == "bullets", who["speaker"]).alias("speaker"),
        kicker.alias("kicker"),
        F.when(k == "stat", F.trim(F.regexp_extract(head, STAT_TAG, 1))).alias("value"),
        F.when(k == "code", code_items).when(k == "bullets", F.col("_items")).alias("items"),
        subtext.alias("subtext"),
    )


SCENES = "array<struct<part:int,sub:int,layout:string,text:string,speaker:string,value:string>>"


def _prose_scenes(full: Column, mode: str) -> Column:
    """Scenes of a prose block under one of the three split modes, inside its cell."""
    none = F.lit(None).cast("string")
    joined = F.array(F.array_join(full, " "))
    chunks = {"paragraphs": joined, "lines": full}.get(mode)
    if chunks is None:
        chunks = F.when(F.exists(full, lambda x: x.rlike(X.SPEAKER)), full).otherwise(joined)

    def line(c: Column, part: Column) -> Column:
        stat, heading = c.rlike(STAT_TAG), c.rlike(HEADING)
        who = X.speaker_prefix(c)
        text = (
            F.when(stat, F.trim(F.regexp_extract(c, STAT_TAG, 2)))
            .when(heading, F.trim(F.regexp_replace(c, r"^#{1,2}\s+", "")))
            .otherwise(who["text"])
        )
        layout = F.when(stat, "stat").when(heading, "title")
        value = F.when(stat, F.trim(F.regexp_extract(c, STAT_TAG, 1)))
        return F.array(F.struct(part, F.lit(0), layout, text, F.when(~stat & ~heading, who["speaker"]), value)).cast(SCENES)

    def spoken(c: Column, part: Column) -> Column:
        def pieces(who: Column) -> Column:
            texts = X.sentences(who["text"]) if mode == "sentences" else F.array(who["text"])
            return F.transform(texts, lambda t, sub: F.struct(part, sub, none, t, who["speaker"], none)).cast(SCENES)

        return X.once(X.speaker_prefix(c), pieces)

    scenes = F.flatten(F.transform(chunks, line if mode == "lines" else spoken))
    return F.filter(scenes, lambda x: x["text"] != "")


def script_scenes(scripts: DataFrame, mode: str = "sentences") -> DataFrame:
    """All scenes of each script in reading order, numbered by ``seq`` from zero."""
    from cuestream.plans.scan import position

    # blocks of all kinds in one pass: two filters over them would find and class the blocks twice
    blocks = classify_blocks(script_blocks(scripts))
    rich = F.array(F.struct(F.lit(0), F.lit(0), "layout", "text", "speaker", "value")).cast(SCENES)
    scenes = F.when(F.col("layout") == "prose", _prose_scenes(F.col("full"), mode)).otherwise(rich)
    rows = blocks.select("track_id", "block", "kicker", "items", "subtext", F.inline(scenes))
    cols = ["track_id", "block", "part", "sub", "layout", "text", "speaker", "kicker", "value", "items", "subtext"]
    out = OrderedScan.over(rows.select(*cols), ["track_id"], ["block", "part", "sub"], hot=False).add(seq=position()).done()
    return out.withColumn("seq", F.col("seq") - 1).drop("part", "sub")
