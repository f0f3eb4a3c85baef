"""Anonymous usage counters: admission, sanitising, roll-up, forwarding, de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import OrderedScan, position

# The accepted event names and limits.
EVENTS = (
    "project_created", "audio_imported", "lyrics_imported", "lyrics_pasted", "tap_sync_started", "tap_sync_completed",
    "auto_align_started", "auto_align_low_confidence", "export_started", "export_completed", "export_failed",
    "subtitle_exported", "project_exported", "project_imported", "theme_changed", "aspect_changed",
)
KEYS = ("event", "bucket", "outcome")
BUCKET = r"^[a-z0-9][a-z0-9:._-]{0,31}$"


def looks_like_content(value: Column) -> Column:
    """Text that could carry content: long, spaced, addresses, paths, ids or hashes."""
    return (
        (F.length(value) > 32)
        | value.rlike(r"(?U)\s")
        | value.rlike(r"@|\.\.|/|\\|://")
        | value.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}")
        | value.rlike(r"(?i)^[0-9a-f]{32,}$")
    )


def sanitise(entry: Column) -> Column:
    """Struct of event, bucket and outcome plus ``reason``, which is null for accepted entries."""

    def get(key: str) -> Column:
        return F.try_variant_get(entry, f"$.{key}", "variant")

    def is_text(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))

    event, bucket, outcome = (F.try_variant_get(entry, f"$.{k}", "string") for k in KEYS)
    keys = F.map_keys(F.try_variant_get(entry, "$", "map<string,variant>"))
    bad_bucket = get("bucket").isNotNull() & (~is_text(get("bucket")) | ~bucket.rlike(BUCKET) | looks_like_content(bucket))
    bad_outcome = get("outcome").isNotNull() & (~is_text(get("outcome")) | ~outcome.isin("success", "failure"))
    reason = (
        F.when(keys.isNull(), "not_an_object")
        .when(~is_text(get("event")) | ~F.coalesce(event.isin(*EVENTS), F.lit(False)), "unknown_event")
        .when(F.coalesce(bad_bucket, F.lit(True)), "bad_bucket")
        .when(F.coalesce(bad_outcome, F.lit(True)), "bad_outcome")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) > 0, "unknown_key")
    )
    return F.struct(event.alias("event"), bucket.alias("bucket"), outcome.alias("outcome"), reason.alias("reason"))


def sanitise_entries(entries: DataFrame) -> DataFrame:
    """Sanitise single JSON entries; a rejected row keeps its reason but none of its content."""
    df = entries.withColumn("_s", sanitise(F.try_parse_json("raw_json"))).drop("raw_json")
    ok = F.col("_s.reason").isNull()
    shown = {k: F.when(ok, F.col(f"_s.{k}")) for k in KEYS}
    return df.withColumns({**shown, "reason": F.col("_s.reason")}).drop("_s")


def admit_batches(batches: DataFrame) -> DataFrame:
    """Add ``invalid`` (why a whole batch is refused) and ``entries`` (its array, null when refused)."""
    v = F.try_parse_json("raw_json")
    df = batches.withColumn("_v", v).withColumn("_e", F.try_variant_get("_v", "$.events", "array<variant>"))
    root = F.schema_of_variant("_v")
    invalid = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~root.rlike("^(OBJECT|ARRAY)"), "expected an object")
        .when(F.col("_e").isNull(), "expected an events array")
    )
    return df.withColumns({"invalid": invalid, "entries": F.when(invalid.isNull(), F.col("_e")), "n_entries": F.coalesce(F.size("_e"), F.lit(0))}).drop("_v", "_e", "raw_json")


def explode_batches(batches: DataFrame) -> DataFrame:
    """Sanitised entries of admitted batches, one row each, numbered inside their batch."""
    admitted = admit_batches(batches).filter(F.col("invalid").isNull())
    keep = [c for c in admitted.columns if c not in ("entries", "invalid", "n_entries")]
    rows = admitted.select(*keep, F.posexplode("entries").alias("pos", "_e"))
    return rows.withColumn("_s", sanitise(F.col("_e"))).select(*keep, "pos", "_s.*")


def batch_report(batches: DataFrame) -> DataFrame:
    """Size of each batch, and how many of its entries are accepted and rejected; batches of any size are read."""
    df = admit_batches(batches)
    kept = F.filter(F.transform("entries", sanitise), lambda s: s["reason"].isNull())
    n = F.coalesce(F.size(kept), F.lit(0))
    return df.select(
        "batch_id",
        "invalid",
        F.when(F.col("invalid").isNull(), n).otherwise(0).cast("long").alias("accepted"),
        F.when(F.col("invalid").isNull(), F.col("n_entries") - n).otherwise(0).cast("long").alias("rejected"),
        F.when(F.col("invalid").isNull(), F.col("n_entries")).otherwise(0).cast("long").alias("n_entries"),
    )


def roll_up(events: DataFrame, length: str = "15 seconds", lateness: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Counts per window and counter; the watermark bounds the state of a stream."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = events.withWatermark("ts", lateness).groupBy(win, *KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *KEYS, "n")


def client_batches(events: DataFrame, client: str, order: str, length_us: int = 15_000_000, size: int = 20) -> DataFrame:
    """What a client sends: the events of each interval in order, ``size`` to a batch (``batch`` counts from 0)."""
    cells = events.withColumn("_cell", F.floor(F.col("at_us") / length_us))
    ranked = OrderedScan.over(cells, [client, "_cell"], ["at_us", order]).add(_p=position()).done()
    return ranked.withColumn("batch", F.floor((F.col("_p") - 1) / size)).drop("_cell", "_p")


def forward_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps accepted counters only, adds no fields, and may be retried.

    A retried batch overwrites its own folder, so forwarding twice changes
    nothing. A failed write raises, so that the stream stops before the batch is
    committed and sends it again when it is restarted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.filter(F.col("reason").isNull()).select(*[c for c in batch.columns if c != "reason"])
        kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drop_replays(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """First arrival per key; replays inside the lateness and rows past it are dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def debounce_saves(changes: DataFrame, key: str, quiet: str = "2500 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """Last state of each burst of changes, once the key was quiet for the gap."""
    win = F.session_window("ts", quiet)
    bursts = changes.withWatermark("ts", lateness).groupBy(win, key).agg(
        F.max_by("state", F.struct("ts", "seq")).alias("state"), F.count(F.lit(1)).alias("n_changes")
    )
    return bursts.select(key, F.col("session_window.start").alias("first_change"), "state", "n_changes")
