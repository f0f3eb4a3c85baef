"""Document checks: rule trees over JSON, versions, defaults, keys, kinds, export settings.

A document is parsed once into a VARIANT and opened once into a struct of its leaves; a rule
tree is compiled into column expressions that collect issues, so a row never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECT_KIND = "cuestream.project"
SPEC_KIND = "cuestream.spec"
PROJECT_VERSION = 3
SPEC_VERSION = 1
ISSUE = "array<struct<path:string,message:string,code:string>>"
DOCUMENT = "_v"


@dataclass(frozen=True)
class Rule:
    kind: str
    low: float | None = None
    high: float | None = None
    whole: bool = False
    above: bool = False
    values: tuple[str, ...] = ()
    item: Rule | None = None
    fields: dict[str, Rule] = field(default_factory=dict)
    strict: bool = False
    optional: bool = False
    nullable: bool = False

    def opt(self) -> Rule:
        return Rule(**{**self.__dict__, "optional": True})

    def null(self) -> Rule:
        return Rule(**{**self.__dict__, "nullable": True})


def num(low=None, high=None, whole=False, above=False):
    return Rule("number", low, high, whole, above)


def text(high=None, low=None):
    return Rule("string", low, high)


def flag():
    return Rule("boolean")


def enum(*values):
    return Rule("enum", values=values)


def obj(strict=False, **fields):
    return Rule("object", fields=fields, strict=strict)


def arr(item, high=None, low=None):
    return Rule("array", low, high, item=item)


def _names(values: tuple[str, ...]) -> str:
    return " | ".join(f"'{v}'" for v in values)


TYPE_NAME = """CASE WHEN {t} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' THEN 'number' WHEN {t} = 'STRING' THEN 'string'
 WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'VOID' THEN 'null' WHEN {t} LIKE 'ARRAY%' THEN 'array' WHEN {t} LIKE 'OBJECT%' THEN 'object' END"""


def _type_name(t: Column) -> Column:
    return (
        F.when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null")
        .when(F.startswith(t, F.lit("ARRAY")), "array")
        .when(F.startswith(t, F.lit("OBJECT")), "object")
    )


def _issue(path: Column, message: Column | str, code: str) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    return F.struct(path.alias("path"), message.alias("message"), F.lit(code).alias("code"))


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _issue_sql(path: str, message: str, code: str) -> str:
    return f"named_struct('path', {path}, 'message', {message}, 'code', '{code}')"


def _show(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def _value_checks(rule: Rule, value: str, path: str) -> list[tuple[str, str]]:
    """SQL of range and membership checks of a value whose type is already right, each with its issue."""
    out = []
    if rule.kind == "number":
        if rule.whole:
            out.append((f"{value} <> floor({value})", _issue_sql(path, "'Expected integer, received float'", "invalid_type")))
        if rule.low is not None:
            sign, words = ("<=", "greater than") if rule.above else ("<", "greater than or equal to")
            out.append((f"{value} {sign} {rule.low}", _issue_sql(path, f"'Number must be {words} {_show(rule.low)}'", "too_small")))
        if rule.high is not None:
            out.append((f"{value} > {rule.high}", _issue_sql(path, f"'Number must be less than or equal to {_show(rule.high)}'", "too_big")))
    elif rule.kind == "enum":
        said = f"concat({_quote(f'Invalid enum value. Expected {_names(rule.values)}, received ')}, {_quote(chr(39))}, {value}, {_quote(chr(39))})"
        out.append((f"{value} NOT IN ({', '.join(map(_quote, rule.values))})", _issue_sql(path, said, "invalid_enum_value")))
    elif rule.kind in ("string", "array"):
        head, unit, n = ("String", "character(s)", f"length({value})") if rule.kind == "string" else ("Array", "element(s)", f"size({value})")
        if rule.low:
            out.append((f"{n} < {rule.low}", _issue_sql(path, f"'{head} must contain at least {rule.low} {unit}'", "too_small")))
        if rule.high is not None:
            out.append((f"{n} > {rule.high}", _issue_sql(path, f"'{head} must contain at most {rule.high} {unit}'", "too_big")))
    return out


def _bound_type(rule: Rule) -> str:
    """Type that opens a document down to its leaves in one step; what is of another kind becomes null."""
    if rule.kind == "object" and rule.fields:
        return f"struct<{','.join(f'`{name}`:{_bound_type(child)}' for name, child in rule.fields.items())}>"
    return {"array": "array<variant>", "object": "map<string,variant>"}.get(rule.kind, "variant")


def _field(path: str, name: str) -> str:
    """SQL of the path of a field; paths outside arrays are literals."""
    if path == "''":
        return f"'{name}'"
    return f"{path[:-1]}.{name}'" if path.startswith("'") else f"concat({path}, '.{name}')"


class Scope:
    """A document or array element: its variant, and lists of what its leaves hold, each read once."""

    TYPES = {"number": "double", "string": "string", "enum": "string"}

    def __init__(self, root: str, of: str):
        self.root, self.of = root, of
        self.lists: dict[str, list[str]] = {"kind": [], "double": [], "string": []}

    def read(self, name: str, value: str) -> str:
        self.lists[name].append(value)
        return f"{self.of}{name}[{len(self.lists[name]) - 1}]"

    def leaf(self, rule: Rule, held: str) -> tuple[str, str | None]:
        """SQL of the kind of a leaf and of its value as the type its checks want."""
        want = self.TYPES.get(rule.kind)
        return self.read("kind", held), want and self.read(want, held)

    def columns(self) -> dict[str, str]:
        """SQL of the lists. One function over an array of leaves is short code, which the JVM compiles well."""
        each = {"kind": "schema_of_variant(y)", "double": "try_variant_get(y, '$', 'double')", "string": "try_variant_get(y, '$', 'string')"}
        return {name: f"transform(array({', '.join(held)}), y -> {each[name]})" for name, held in self.lists.items() if held}


def rule_sql(rule: Rule, scope: Scope, at: str, held: str, path: str, brackets: bool, depth: int = 0) -> str:
    """SQL for the array of issues of one value, children included, in rule order.

    ``held`` is the value as part of the opened document (or array element): an object is a
    struct, an array an array, a leaf a variant. A struct or array that is null is missing or
    of another kind; only then is the value read again, from the variant of the scope at ``at``,
    to name its kind. The type of a whole object, which lists all it holds, is never asked for.
    """
    leaf = rule.kind not in ("object", "array")
    read = f"try_variant_get({scope.root}, '${at}', '{{}}')"
    kind, value = scope.leaf(rule, held) if leaf else (f"schema_of_variant({read.format('variant')})", held)
    want = {"enum": "string"}.get(rule.kind, rule.kind)
    label = "'(root)'" if path == "''" else path
    none = f"cast(array() AS {ISSUE})"
    expected = _names(rule.values) if rule.kind == "enum" else rule.kind
    wrong = f"array({_issue_sql(label, f'concat({_quote(f"Expected {expected}, received ")}, {TYPE_NAME.format(t=kind)})', 'invalid_type')})"
    checks = _value_checks(rule, value, label) if value else []
    right = []
    if checks:
        found = ", ".join(f"CASE WHEN {condition} THEN {issue} END" for condition, issue in checks)
        right.append(f"CASE WHEN {' OR '.join(condition for condition, _ in checks)} THEN array_compact(array({found})) ELSE {none} END")
    if rule.kind == "object":
        for name, child in rule.fields.items():
            right.append(rule_sql(child, scope, f"{at}.{name}", f"{held}.`{name}`", _field(path, name), brackets, depth))
        if rule.strict:
            extra = f"array_except(map_keys({read.format('map<string,variant>')}), array({', '.join(map(_quote, rule.fields))}))"
            said = f"concat({_quote('Unrecognized key(s) in object: ' + chr(39))}, array_join({extra}, {_quote(chr(39) + ', ' + chr(39))}), {_quote(chr(39))})"
            right.append(f"if(size({extra}) > 0, array({_issue_sql(label, said, 'unrecognized_keys')}), {none})")
    if rule.kind == "array":
        x, i = f"x{depth}", f"i{depth}"
        index = f"'[', {i}, ']'" if brackets else f"'.', {i}"
        inside = Scope(f"{x}.v", f"{x}.")
        item = rule_sql(rule.item, inside, "", f"{x}.s", f"concat({path}, {index})", brackets, depth + 1)
        opened = f"transform({held}, {x} -> named_struct('v', {x}, 's', try_variant_get({x}, '$', '{_bound_type(rule.item)}')))"
        listed = "".join(f", '{name}', {reads}" for name, reads in inside.columns().items())
        opened = f"transform({opened}, {x} -> named_struct('v', {x}.v, 's', {x}.s{listed}))"
        right.append(f"flatten(transform({opened}, ({x}, {i}) -> {item}))")
    inner = right[0] if len(right) == 1 else f"concat({', '.join(right)})" if right else none
    missing = none if rule.optional else f"array({_issue_sql(label, chr(39) + 'Required' + chr(39), 'invalid_type')})"
    null = f"WHEN {kind} = 'VOID' THEN {none} " if rule.nullable else ""
    if not leaf:
        return f"CASE WHEN {held} IS NOT NULL THEN {inner} WHEN {kind} IS NULL THEN {missing} {null}ELSE {wrong} END"
    numeric = f"({kind} = 'BIGINT' OR {kind} = 'DOUBLE' OR {kind} = 'FLOAT' OR {kind} LIKE 'DECIMAL%')"
    has_type = numeric if want == "number" else f"{kind} = '{want.upper()}'"
    return f"CASE WHEN {kind} IS NULL THEN {missing} {null}WHEN {has_type} THEN {inner} ELSE {wrong} END"


def with_issues(parsed: DataFrame, rule: Rule, brackets: bool) -> DataFrame:
    """Add the issues of the parsed document as ``_issues``."""
    opened = parsed.withColumn("_s", F.expr(f"try_variant_get({DOCUMENT}, '$', '{_bound_type(rule)}')"))
    scope = Scope(DOCUMENT, "_s_")
    issues = rule_sql(rule, scope, "", "_s", "''", brackets)
    lists = {f"_s_{name}": F.expr(reads) for name, reads in scope.columns().items()}
    return opened.withColumns(lists).withColumn("_issues", F.expr(issues).cast(ISSUE)).drop("_s", *lists)


us = num(low=0)
SOURCE = enum("human", "align", "asr", "estimate", "tap", "tts")
ENTER = enum("fade", "rise", "clip", "blur", "wordCascade", "zoom", "spring", "none")
EXIT = enum("fade", "sink", "blur", "none")
TRANSITION = enum("fade", "wipe", "slide", "zoom", "none")
BACKDROP = enum("gradient", "image", "solid", "mesh", "visualizer")
ASPECT = enum("16:9", "9:16", "1:1", "4:5", "4:3", "custom")
ALIGN = enum("left", "center", "right")
ANCHOR = enum("top", "center", "bottom")
CORNER = enum("top-left", "top-right", "bottom-left", "bottom-right")
KARAOKE = enum("line", "word", "progressive", "none")
CODEC = enum("h264", "vp9", "av1")
LAYOUT = enum("caption", "title", "stat", "bullets", "quote", "code", "chart")
SIZE = obj(width=num(128, 7680, whole=True), height=num(128, 4320, whole=True))
WORD = obj(
    id=text(128, 1), text=text(4000), norm=text(4000), start=us, end=us, confidence=num(0, 1), source=SOURCE, locked=flag()
)
SCENE = obj(
    layout=LAYOUT.opt(),
    kicker=text(160).opt(),
    subtext=text(600).opt(),
    value=text(80).opt(),
    items=arr(text(400), 24).opt(),
    chart=arr(obj(label=text(120, 1), value=num(0, 1_000_000_000), color=text(64).opt()), 12).opt(),
    background=obj(
        kind=BACKDROP.opt(), assetId=text(128).null().opt(), colors=arr(text(64), 8, 1).opt(), motion=num(0, 2).opt(), scrim=num(0, 1).opt()
    ).opt(),
    enter=ENTER.opt(),
    exit=EXIT.opt(),
    transition=TRANSITION.opt(),
    narration=text(4000).opt(),
    language=text(48).opt(),
    accent=text(64).opt(),
)
LINE = obj(
    id=text(128, 1),
    text=text(4000),
    words=arr(WORD, 600),
    start=us,
    end=us,
    sectionId=text(128).null(),
    locked=flag(),
    style=obj(
        sizeRatio=num(0.01, 0.5).opt(), weight=num(100, 900).opt(), color=text(32).opt(), uppercase=flag().opt(), align=ALIGN.opt()
    ),
    scene=SCENE.opt(),
    speaker=enum("A", "B").null(),
    translation=text(4000).null(),
    source=SOURCE,
    confidence=num(0, 1).opt(),
)
SECTION = obj(
    id=text(128, 1),
    kind=enum(
        "INTRO", "VERSE", "PRE_CHORUS", "CHORUS", "HOOK", "REFRAIN", "BRIDGE", "BREAKDOWN", "INSTRUMENTAL", "OUTRO", "UNKNOWN"
    ),
    label=text(64),
    occurrence=num(0, 999, whole=True),
)
CARD = obj(enabled=flag(), title=text(200), subtitle=text(400), durationUs=us)
AUDIO = obj(
    assetId=text(128),
    fileName=text(512),
    mimeType=text(128),
    bytes=num(0, whole=True),
    durationUs=us,
    sampleRate=num(0, whole=True, above=True),
    channels=num(1, 32, whole=True),
    peaksAssetId=text(128),
    contentHash=text(128),
)
VOICE = obj(
    assetId=text(128, 1),
    fileName=text(512),
    mimeType=text(128),
    bytes=num(0, whole=True),
    contentHash=text(128),
    sampleRate=num(0, whole=True, above=True),
    durationUs=us,
    voiceId=text(128, 1),
    voiceIdB=text(128, 1).null().opt(),
    mode=enum("timed", "sequential").opt(),
    pauseMs=num(0, 10_000, whole=True).opt(),
    sourceSignature=text(128, 1),
    enabled=flag(),
    musicGain=num(0, 2),
    speechGain=num(0, 2),
    createdAt=num(),
)
DESIGN = obj(
    themeId=text(64),
    aspectId=ASPECT,
    customSize=SIZE.null(),
    background=obj(
        kind=BACKDROP, assetId=text(128).null(), colors=arr(text(64), 8, 1), motion=num(0, 2), scrim=num(0, 1),
        visualizerBand=num(0, 1), visualizerGain=num(0, 4),
    ),
    typography=obj(
        fontStack=text(512), weight=num(100, 900), sizeRatio=num(0.01, 0.5), lineHeight=num(0.8, 3), letterSpacing=num(-0.2, 0.5),
        align=ALIGN, anchor=ANCHOR, uppercase=flag(), color=text(64), activeColor=text(64), shadowBlur=num(0, 200),
        shadowColor=text(64), shadowOffsetY=num(-100, 100), outlineWidth=num(0, 40), outlineColor=text(64),
    ),
    karaoke=obj(mode=KARAOKE, fillEase=enum("linear", "smooth"), glow=num(0, 2), scale=num(0.8, 1.5), colorShift=flag(), beatAware=flag()),
    motion=obj(enter=ENTER, exit=EXIT, enterUs=us, exitUs=us, overlapUs=us, intensity=num(0, 2)),
    brand=obj(enabled=flag(), text=text(200), logoAssetId=text(128).null(), position=CORNER, opacity=num(0, 1)),
    intro=CARD,
    outro=CARD,
    accent=text(64).null(),
)
EXPORT = obj(
    presetId=text(64),
    width=num(128, 7680, whole=True),
    height=num(128, 4320, whole=True),
    fps=num(12, 60, whole=True),
    videoBitrate=num(100_000, 80_000_000, whole=True),
    codec=CODEC,
    audioBitrate=num(32_000, 512_000, whole=True),
    globalOffsetUs=num(),
    rangeStartUs=us,
    rangeEndUs=us,
    includeAudio=flag(),
    fileName=text(256),
)
PROJECT = obj(
    formatVersion=num(1, whole=True),
    id=text(128, 1),
    createdAt=num(),
    updatedAt=num(),
    meta=obj(title=text(300), artist=text(300), album=text(300), language=text(16), notes=text(8000)),
    audio=AUDIO.null(),
    voiceover=VOICE.null(),
    lyrics=obj(
        source=enum("user", "file", "asr", "script", "spec", "empty"),
        originalText=text(200_000),
        originalFileName=text(512).null(),
        lines=arr(LINE, 5000),
    ),
    sections=arr(SECTION, 500),
    design=DESIGN,
    export=EXPORT,
    ui=obj(mode=enum("simple", "advanced"), zoomPxPerSecond=num(2, 4000), selection=text(128).null(), lastPlayheadUs=num()),
)
ASSET = obj(
    id=text(128, 1),
    kind=enum("audio", "peaks", "image", "video", "json"),
    fileName=text(512),
    mimeType=text(128),
    bytes=num(0, whole=True),
    contentHash=text(128),
    createdAt=num(),
)

colour = text(64, 1)
SPEC_SCENE = obj(
    id=text(128, 1).opt(),
    layout=LAYOUT.opt(),
    kicker=text(160).opt(),
    text=text(4000, 1),
    subtext=text(600).opt(),
    value=text(80).opt(),
    narration=text(4000).opt(),
    language=text(48).opt(),
    items=arr(text(400), 24).opt(),
    chart=arr(obj(strict=True, label=text(120, 1), value=num(0, 1_000_000_000), color=colour.opt()), 12).opt(),
    start=num(0, 1200).opt(),
    end=num(0, 1200).opt(),
    pauseAfter=num(0, 30).opt(),
    speaker=enum("A", "B").null().opt(),
    section=text(64).opt(),
    locked=flag().opt(),
    background=obj(
        strict=True, kind=BACKDROP.opt(), assetId=text(128).null().opt(), colors=arr(colour, 8, 1).opt(), motion=num(0, 2).opt(), scrim=num(0, 1).opt()
    ).opt(),
    enter=ENTER.opt(),
    exit=EXIT.opt(),
    transition=TRANSITION.opt(),
    accent=colour.opt(),
    style=obj(
        strict=True, sizeRatio=num(0.015, 0.4).opt(), weight=num(100, 900).opt(), color=text(32, 1).opt(), uppercase=flag().opt(), align=ALIGN.opt()
    ).opt(),
)
SPEC = obj(
    version=num(1, SPEC_VERSION, whole=True).opt(),
    title=text(300).opt(),
    author=text(300).opt(),
    language=text(16).opt(),
    theme=text(64).opt(),
    aspect=ASPECT.opt(),
    customSize=SIZE.opt(),
    fps=num(12, 60, whole=True).opt(),
    codec=CODEC.opt(),
    accent=colour.null().opt(),
    background=obj(
        strict=True, kind=BACKDROP.opt(), assetId=text(128).null().opt(), colors=arr(colour, 8, 1).opt(), motion=num(0, 2).opt(), scrim=num(0, 1).opt()
    ).opt(),
    karaoke=KARAOKE.opt(),
    voice=obj(
        voiceId=text(128, 1).opt(), voiceIdB=text(128, 1).null().opt(), pauseMs=num(0, 5000, whole=True).opt(), wpm=num(60, 360, whole=True).opt()
    ).opt(),
    scenes=arr(SPEC_SCENE, 2000),
)


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_v", F.try_parse_json("raw_json"))


def validate_documents(docs: DataFrame, rule: Rule = PROJECT, brackets: bool = False) -> DataFrame:
    """Add ``issues`` (all of them, in rule order) and ``ok``; bad JSON is one issue at the root."""
    broken = F.array(_issue(F.lit("(root)"), "Invalid JSON", "invalid_json")).cast(ISSUE)
    df = with_issues(_parsed(docs), rule, brackets)
    df = df.withColumn("issues", F.when(F.col("_v").isNull(), broken).otherwise(F.col("_issues")))
    return df.withColumn("ok", F.size("issues") == 0).drop("_v", "_issues")


def unknown_keys(docs: DataFrame, known: list[str], strict: bool) -> DataFrame:
    """Strict: reject objects with other keys. Otherwise: drop those keys and keep the document."""
    keys = F.json_object_keys("raw_json")
    extra = F.coalesce(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known]))), F.array().cast("array<string>"))
    df = docs.withColumn("unknown", F.array_join(extra, ","))
    if strict:
        return df.withColumn("rejected", F.size(extra) > 0)
    fields = F.from_json("raw_json", ", ".join(f"`{k}` string" for k in known))
    return df.withColumn("stripped", F.to_json(fields))


MIGRATIONS = {1: "v1 -> v2: add generated voiceover metadata", 2: "v2 -> v3: add scene visuals and sequential voiceover options"}


def migrate_documents(docs: DataFrame, current: int = PROJECT_VERSION, kind: str = PROJECT_KIND) -> DataFrame:
    """Version verdict and the steps each document takes to the current format.

    Adds ``status`` (ok, NOT_A_PROJECT, FUTURE_VERSION or CORRUPT), ``from_version``,
    ``steps`` and, for accepted documents, the migrated ``voiceover`` JSON.
    """
    df = _parsed(docs)
    is_file = F.try_variant_get("_v", "$.kind", "string") == kind
    body = F.when(is_file, F.try_variant_get("_v", "$.project", "variant")).otherwise(F.col("_v"))
    df = df.withColumn("_p", body)
    is_object = F.coalesce(_type_name(F.schema_of_variant("_p")) == "object", F.lit(False))
    declared = F.try_variant_get("_p", "$.formatVersion", "variant")
    is_number = F.coalesce(_type_name(F.schema_of_variant(declared)) == "number", F.lit(False))
    version = F.when(is_number, F.try_variant_get("_p", "$.formatVersion", "double")).otherwise(F.lit(1.0))
    df = df.withColumns({"_obj": is_object, "_ver": version})
    v = F.col("_ver")
    known = v.isin(*[float(k) for k in range(1, current + 1)])
    status = F.when(~F.col("_obj"), "NOT_A_PROJECT").when(v > current, "FUTURE_VERSION").when(~known, "CORRUPT").otherwise("ok")
    steps = F.array_compact(F.array(*[F.when(v <= k, F.lit(name)) for k, name in MIGRATIONS.items() if k < current]))
    voice = F.try_variant_get("_p", "$.voiceover", "map<string,string>")
    to_v3 = v <= 2
    filled = F.when(
        to_v3 & voice.isNotNull(),
        F.map_concat(
            F.map_filter(voice, lambda k, x: ~(k.isin("mode", "voiceIdB"))),
            F.create_map(
                F.lit("mode"), F.coalesce(F.try_element_at(voice, F.lit("mode")), F.lit("timed")),
                F.lit("voiceIdB"), F.try_element_at(voice, F.lit("voiceIdB")),
            ),
        ),
    ).otherwise(voice)
    accepted = F.col("status") == "ok"
    out = df.withColumns({"status": status, "from_version": v})
    return out.withColumns(
        {
            "steps": F.when(accepted, steps),
            "voiceover": F.when(accepted, filled),
        }
    ).drop("_v", "_p", "_obj", "_ver")


# Defaults by path, in report order. A parent given as {} opens its children;
# a parent given as a whole value closes them.
DEFAULTS = (
    ("meta", "{}"), ("meta.title", ""), ("meta.artist", ""), ("meta.album", ""), ("meta.language", "en"), ("meta.notes", ""),
    ("sections", "[]"), ("audio", None), ("voiceover", None), ("lyrics", "whole"), ("lyrics.source", "empty"),
    ("lyrics.originalText", ""), ("lyrics.originalFileName", None), ("lyrics.lines", "[]"),
)
LINE_DEFAULTS = ("words", "locked", "style", "sectionId", "speaker", "translation", "source")
LATE_DEFAULTS = (
    ("ui", "whole"), ("ui.mode", "simple"), ("ui.zoomPxPerSecond", "60"), ("ui.selection", None), ("ui.lastPlayheadUs", "0"),
    ("design.customSize", None), ("design.accent", None), ("design.brand.logoAssetId", None), ("export.codec", "h264"),
    ("export.globalOffsetUs", "0"), ("export.includeAudio", "true"), ("export.fileName", ""),
)
NO_PARENT = {"design", "export", "design.brand"}


def fill_defaults(docs: DataFrame) -> DataFrame:
    """Report the paths a document lacks and give the filled scalar fields.

    Adds ``filled`` (paths in order) and ``fields`` (map from scalar path to value).
    """
    df = _parsed(docs)

    def node(path: str) -> Column:
        return F.try_variant_get("_v", f"$.{path}", "variant")

    def lacking(path: str, value: str | None) -> Column:
        gone = node(path).isNull()
        parent = path.rsplit(".", 1)[0] if "." in path else None
        if parent is None:
            return gone
        if parent in NO_PARENT:
            return gone & F.coalesce(_type_name(F.schema_of_variant(node(parent))) == "object", F.lit(False))
        whole = dict(DEFAULTS + LATE_DEFAULTS).get(parent) == "whole"
        return gone & node(parent).isNotNull() if whole else gone

    def listed(table) -> Column:
        return F.array_compact(F.array(*[F.when(lacking(p, v), F.lit(p)) for p, v in table]))

    lines = F.try_variant_get("_v", "$.lyrics.lines", "array<variant>")

    def line_paths(x: Column, i: Column) -> Column:
        is_object = _type_name(F.schema_of_variant(x)) == "object"
        at = F.concat(F.lit("lyrics.lines["), i.cast("string"), F.lit("]."))
        names = [F.when(is_object & F.try_variant_get(x, f"$.{n}", "variant").isNull(), F.concat(at, F.lit(n))) for n in LINE_DEFAULTS]
        return F.array_compact(F.array(*names))

    per_line = F.coalesce(F.flatten(F.transform(lines, line_paths)), F.array().cast("array<string>"))
    scalars = [(p, v) for p, v in DEFAULTS + LATE_DEFAULTS if v not in ("{}", "[]", "whole") and "." in p]
    pairs = [x for p, v in scalars for x in (F.lit(p), F.coalesce(F.try_variant_get("_v", f"$.{p}", "string"), F.lit(v)))]
    return df.withColumns(
        {"filled": F.concat(listed(DEFAULTS), per_line, listed(LATE_DEFAULTS)), "fields": F.create_map(*pairs)}
    ).drop("_v")


def validate_specs(docs: DataFrame, kind: str = SPEC_KIND) -> DataFrame:
    """Spec verdicts: empty, broken or too new text first, then rules and cross-field checks."""
    rule = Rule(**{**SPEC.__dict__, "fields": {"kind": enum(kind).opt(), **SPEC.fields}})
    df = with_issues(_parsed(docs), rule, True)
    v = F.col("_v")

    def one(path: str, message: Column | str, code: str) -> Column:
        return F.array(_issue(F.lit(path), message, code)).cast(ISSUE)

    version = F.try_variant_get(v, "$.version", "double")
    newer = F.concat(
        F.lit("Spec version "), F.try_variant_get(v, "$.version", "string"), F.lit(f" is newer than supported v{SPEC_VERSION}.")
    )

    def crossed(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("scenes["), i.cast("string"), F.lit("]."))
        start, end = F.try_variant_get(x, "$.start", "double"), F.try_variant_get(x, "$.end", "double")
        layout = F.try_variant_get(x, "$.layout", "string")
        bars = F.coalesce(F.size(F.try_variant_get(x, "$.chart", "array<variant>")), F.lit(0))
        length = F.try_variant_get(x, "$.duration", "variant")
        seconds, word = F.try_variant_get(x, "$.duration", "double"), F.try_variant_get(x, "$.duration", "string")
        bad_length = length.isNotNull() & ~F.coalesce((seconds > 0) & (seconds <= 600), word == "auto", F.lit(False))
        return F.array_compact(
            F.array(
                F.when(bad_length, _issue(F.concat(at, F.lit("duration")), "Invalid input", "invalid_union")),
                F.when(end <= start, _issue(F.concat(at, F.lit("end")), "`end` must be greater than `start`.", "custom")),
                F.when(
                    (layout == "chart") & (bars < 1),
                    _issue(F.concat(at, F.lit("chart")), "Chart scenes require at least one `{ label, value }` bar in `chart`.", "custom"),
                ),
            )
        ).cast(ISSUE)

    scenes = F.try_variant_get(v, "$.scenes", "array<variant>")
    cross = F.coalesce(F.flatten(F.transform(scenes, crossed)), F.array().cast(ISSUE))
    found = F.concat("_issues", cross)
    issues = (
        F.when(F.trim("raw_json") == "", one("(root)", "Spec is empty — paste JSON or choose a template.", "empty"))
        .when(v.isNull(), one("JSON", "Invalid JSON syntax.", "invalid_json"))
        .when(version > SPEC_VERSION, one("version", newer, "future_version"))
        .otherwise(found)
    )
    out = df.withColumn("issues", issues)
    return out.withColumn("ok", F.size("issues") == 0).drop("_v", "_issues")


def route_documents(docs: DataFrame, spec_kind: str = SPEC_KIND, project_kind: str = PROJECT_KIND) -> DataFrame:
    """Document kind: spec, project or other."""
    df = _parsed(docs)
    root = _type_name(F.schema_of_variant("_v"))
    kind = F.try_variant_get("_v", "$.kind", "string")
    scenes = _type_name(F.schema_of_variant(F.try_variant_get("_v", "$.scenes", "variant")))
    route = (
        F.when(F.coalesce(root != "object", F.lit(True)), "other")
        .when(kind == spec_kind, "spec")
        .when(kind == project_kind, "project")
        .when(scenes == "array", "spec")
        .otherwise("other")
    )
    return df.withColumn("route", route).drop("_v")


def audit_export(settings: DataFrame) -> DataFrame:
    """All export rules an export row breaks, comma-separated in rule order."""
    w, h = F.col("width"), F.col("height")
    checks = (
        ("too_small", (w < 128) | (h < 128)),
        ("above_8k", (w > 7680) | (h > 4320)),
        ("odd_size", (w % 2 != 0) | (h % 2 != 0)),
        ("frame_rate", (F.col("fps") < 12) | (F.col("fps") > 60)),
        ("low_video_bitrate", F.col("video_bitrate") < 500_000),
        ("high_video_bitrate", F.col("video_bitrate") > 60_000_000),
        ("empty_range", F.col("range_end_us") <= F.col("range_start_us")),
        ("low_audio_bitrate", F.col("audio_bitrate") < 48_000),
    )
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    return settings.withColumn("problems", F.array_join(found, ","))
