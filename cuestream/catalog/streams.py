"""Streaming operators over events: batch runs with oracles, and drained streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.registry import query
from cuestream.catalog.sequences import TAP_STATES, tap_log
from cuestream.catalog.sqlviews import SPANS
from cuestream.sources.audio import CHUNK, mel_frames, spectrum_rows
from cuestream.streaming import metrics as ME
from cuestream.streaming import presence as PR
from cuestream.streaming import runner as RU
from cuestream.streaming import sessions as SE

HOUR = A.HOUR_US
NAMES = ", ".join(f"'{e}'" for e in ME.EVENTS)
DEFECTS = (
    '{"event":"@E","bucket":"@B","outcome":"success"}', '{"event":"@E"}', '{"event":"opened_mail"}', '{"event":"@E","bucket":"a b"}',
    '{"event":"@E","bucket":"me@home.org"}', '{"event":"@E","outcome":"maybe"}', '{"event":"@E","title":"x"}', '[1]', '{"event":7}',
    '{"event":"@E","bucket":"0b0ccafe-beef-1"}', '{"event":"@E","bucket":"Upper"}',
)
REASONS = (None, None, "unknown_event", "bad_bucket", "bad_bucket", "bad_outcome", "unknown_key", "not_an_object", "unknown_event", "bad_bucket", "bad_bucket")


def entries(events):
    """Events as counter entries, nine of eleven kinds broken in a known way."""
    n = F.col("event_id")
    kinds, names = (F.array(*[F.lit(x) for x in xs]) for xs in (DEFECTS, ME.EVENTS))
    raw = F.element_at(kinds, (n % len(DEFECTS) + 1).cast("int"))
    raw = F.replace(raw, F.lit("@E"), F.element_at(names, (n % 16 + 1).cast("int")))
    raw = F.replace(raw, F.lit("@B"), F.col("event_type"))
    return events.withColumn("raw_json", raw)


def events_of(spark, sf_dir):
    return A.table(spark, sf_dir, "events")


_EV = f"([{NAMES}])[event_id % 16 + 1]"
_REASON = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS) if r)
CLEAN = f"""clean AS (SELECT event_id, user_id, ts, CASE event_id % 11 {_REASON} END AS reason, CASE WHEN event_id % 11 < 2 THEN {_EV} END AS event,
   CASE WHEN event_id % 11 = 0 THEN event_type END AS bucket, CASE WHEN event_id % 11 = 0 THEN 'success' END AS outcome FROM events)"""


@query("str01_sanitise_events", f"WITH {CLEAN} SELECT event_id, event, bucket, outcome, reason FROM clean")
def str01(spark, sf_dir):
    return ME.sanitise_entries(entries(events_of(spark, sf_dir))).select("event_id", "event", "bucket", "outcome", "reason")


def batches(spark, sf_dir):
    """One client batch per user and run of 4096 event ids (so a batch is bounded); some users send broken payloads."""
    rows = entries(events_of(spark, sf_dir)).withColumn("slot", F.floor(F.col("event_id") / 4096))
    user, slot = F.col("user_id"), F.col("slot")
    packed = rows.groupBy("user_id", "slot").agg(F.array_join(F.array_sort(F.collect_list("raw_json")), ",").alias("j"))
    body = F.concat(F.lit('{"events":['), "j", F.lit("]}"))
    raw = F.when(user % 10 == 0, "{oops").when(user % 10 == 1, "5").when(user % 10 == 2, '{"n":1}').otherwise(body)
    return packed.select((user * 100_000 + slot).alias("batch_id"), raw.alias("raw_json"))


@query(
    "str02_batch_admission",
    f"""WITH {CLEAN}, b AS (SELECT user_id, user_id * 100000 + event_id // 4096 AS batch_id, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok FROM clean GROUP BY ALL),
    v AS (SELECT *, CASE user_id % 10 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'expected an object' WHEN 2 THEN 'expected an events array' END AS invalid FROM b)
    SELECT batch_id, invalid, CASE WHEN invalid IS NULL THEN ok ELSE 0 END AS accepted, CASE WHEN invalid IS NULL THEN n - ok ELSE 0 END AS rejected,
      CASE WHEN invalid IS NULL THEN n ELSE 0 END AS n_entries FROM v""",
)
def str02(spark, sf_dir):
    return ME.batch_report(batches(spark, sf_dir))


@query(
    "str03_tap_stream",
    f"""WITH RECURSIVE {SPANS}, {TAP_STATES.replace("LINES", "CAST(1000000 AS BIGINT)")}
    SELECT track_id, as_of_seq, CAST(i - 1 AS BIGINT) AS line_index, ts[i] AS time_us, sq[i] AS tap_seq FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM e JOIN (SELECT track_id, max(seq) AS as_of_seq FROM l GROUP BY track_id) USING (track_id))""",
)
def str03(spark, sf_dir):
    """The tap log as a stream; rows are the sessions' taps after the last command."""
    like = events_of(spark, sf_dir)
    stream = RU.stream_files(spark, f"{sf_dir}/events*.parquet", like)
    kind, n = F.col("event_type"), F.col("event_id")
    op = (
        F.when(kind == "click", "TAP")
        .when(kind == "view", F.when(n % 2 == 0, "TAP").otherwise("NUDGE"))
        .when(kind == "error", "UNDO")
        .when(kind == "signup", F.when(n % 9 == 0, "RESET").otherwise("SET_COMPENSATION"))
        .otherwise("REDO_LAST_TAP")
    )
    log = stream.select(
        F.col("user_id").alias("track_id"), n.alias("seq"), op.alias("type"), (A.epoch_us("ts") - F.lit(1_704_067_200_000_000)).alias("time_us"),
        (n % 20).alias("line_index"), (n % 1000).alias("amount"), F.lit(1_000_000).alias("n_lines"),
    )
    out = RU.drain_to_table(SE.tap_stream(log), "taps")
    last = out.groupBy("track_id").agg(F.max("as_of_seq").alias("_m"))
    return out.join(last, "track_id").filter(F.col("as_of_seq") == F.col("_m")).drop("_m")


@query(
    "str04_counter_roll_up",
    f"""WITH {CLEAN} SELECT epoch_us(ts) // {6 * HOUR} * {6 * HOUR} AS window_us, event, bucket, outcome, count(*) AS n FROM clean WHERE reason IS NULL GROUP BY ALL""",
)
def str04(spark, sf_dir):
    clean = ME.sanitise_entries(entries(events_of(spark, sf_dir))).filter(F.col("reason").isNull())
    utc = clean.withColumn("ts", F.timestamp_micros(A.epoch_us("ts")))
    counts = ME.roll_up(utc, "6 hours")
    return counts.select(F.unix_micros("window_start").alias("window_us"), "event", "bucket", "outcome", "n")


@query(
    "str04_client_batches",
    f"""SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {24 * HOUR} ORDER BY ts, event_id) - 1) // 3 AS batch FROM events""",
)
def str04_client(spark, sf_dir):
    events = events_of(spark, sf_dir).withColumn("at_us", A.epoch_us("ts"))
    return ME.client_batches(events, "user_id", "event_id", 24 * HOUR, 3).select("event_id", "user_id", "batch")


@query(
    "str05_autosave_debounce",
    f"""WITH g AS (SELECT *, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(t) AS first_us, arg_max(event_type, (t, event_id)) AS state, count(*) AS n_changes FROM s GROUP BY user_id, k""",
)
def str05(spark, sf_dir):
    changes = events_of(spark, sf_dir).select(
        "user_id", F.timestamp_micros(A.epoch_us("ts")).alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")
    )
    out = ME.debounce_saves(changes, "user_id", "6 hours")
    return out.select("user_id", F.unix_micros("first_change").alias("first_us"), "state", "n_changes")


def heartbeats(spark, sf_dir):
    """Users grouped by ten into projects; each is a tab and errors close it."""
    user = F.col("track_id")
    return A.spans(spark, sf_dir).select(
        F.floor(user / 10).alias("project_id"), user.alias("tab_id"), F.col("cue_id").alias("seq"),
        F.when(F.col("event_type") == "error", "closed").otherwise("heartbeat").alias("type"), F.col("start_us").alias("at_us"),
    )


@query(
    "str06_presence",
    f"""WITH m AS (SELECT user_id // 10 AS project_id, user_id AS tab_id, epoch_us(ts) AS t, event_type = 'error' AS closed, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
    d AS (SELECT project_id, t, 1 AS d FROM m WHERE NOT closed UNION ALL SELECT project_id, least(t + {12 * HOUR}, coalesce(nx, t + {12 * HOUR})), -1 FROM m WHERE NOT closed),
    n AS (SELECT project_id, t, sum(d) AS d FROM d GROUP BY ALL HAVING sum(d) <> 0), r AS (SELECT project_id, t, sum(d) OVER (PARTITION BY project_id ORDER BY t) AS live FROM n)
    SELECT CAST(project_id AS BIGINT) AS project_id, t AS at_us, CAST(live AS BIGINT) AS live, live > 1 AS conflict FROM r""",
)
def str06(spark, sf_dir):
    return PR.presence_timeline(heartbeats(spark, sf_dir), 12 * HOUR)


TRACKS = 4


def value_chunks(spark, sf_dir):
    """Event values in id order as 512-sample chunks, dealt to four tracks in turn."""
    block = F.floor(F.col("event_id") / CHUNK)
    ev = events_of(spark, sf_dir).select(
        (block % TRACKS).alias("track_id"), F.floor(block / TRACKS).alias("chunk_idx"), (F.col("event_id") % CHUNK).alias("k"),
        ((F.col("value") - 50) / 60).cast("float").alias("v"),
    )
    packed = ev.groupBy("track_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x"))
    total = ev.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return packed.join(total, "track_id").select(
        "track_id", "chunk_idx", F.transform("x", lambda s: s["v"]).alias("samples"), F.lit(22_050).cast("long").alias("sample_rate"), "n_samples"
    )


#: Frames by Fourier sums: every bin of every windowed frame, the mean of each band's bins, and its logarithm in 255 steps.
FRAME_PARTS = f"""s AS (SELECT event_id // {CHUNK} % {TRACKS} AS track_id, event_id // {CHUNK * TRACKS} AS chunk_idx, event_id % {CHUNK} AS k, CAST((value - 50) / 60 AS FLOAT)::DOUBLE AS v FROM events),
size AS (SELECT track_id, count(*) AS n, max(chunk_idx) AS last FROM s GROUP BY track_id),
x AS MATERIALIZED (SELECT track_id, chunk_idx AS frame, k AS n, v FROM s UNION ALL SELECT track_id, chunk_idx - 1, k + {CHUNK}, v FROM s WHERE chunk_idx > 0)"""
FRAMES_SQL = """w AS (SELECT track_id, frame, n, v * 0.5 * (1 - cos(2 * pi() * n / 1023)) AS v FROM x SEMI JOIN wanted USING (track_id, frame)),
bins AS MATERIALIZED (SELECT track_id, frame, q, sqrt(pow(sum(v * cos(2 * pi() * (q * n % 1024) / 1024)), 2) + pow(sum(v * sin(2 * pi() * (q * n % 1024) / 1024)), 2)) / 1024 AS e
  FROM w, range(0, 513) t(q) GROUP BY track_id, frame, q),
edges AS (SELECT b, CAST(greatest(1, least(512, floor(700 * (pow(10, 2595 * log10(1 + 22050 / 2.0::DOUBLE / 700) * b / 32 / 2595) - 1) / (22050 / 1024.0::DOUBLE) + 0.5))) AS BIGINT) AS lo FROM range(0, 33) t(b)),
bands AS (SELECT l.b AS band, l.lo, greatest(l.lo + 1, h.lo) AS hi FROM edges l JOIN edges h ON h.b = l.b + 1),
mel AS (SELECT track_id, frame, band, floor(least(255, greatest(0, 255 * log10(1 + avg(e) * 400) / 3)) + 0.5)::DOUBLE AS value FROM bins JOIN bands ON q >= lo AND q < hi GROUP BY track_id, frame, band)
SELECT track_id, frame, band, value FROM mel"""


@query(
    "sig01_mel_frames",
    f"WITH {FRAME_PARTS}, wanted AS (SELECT track_id, frame FROM x JOIN size USING (track_id) WHERE frame < greatest(1, floor((size.n - 1024) / {CHUNK}.0) + 1) GROUP BY ALL), {FRAMES_SQL}",
)
def sig01(spark, sf_dir):
    """Mel band frames of the event-value signals, one row per frame and band."""
    return spectrum_rows(mel_frames(value_chunks(spark, sf_dir)))


@query(
    "str07_incremental_frames",
    f"WITH {FRAME_PARTS}, wanted AS (SELECT track_id, frame FROM x GROUP BY track_id, frame HAVING count(*) = 1024), {FRAMES_SQL}",
)
def str07(spark, sf_dir):
    """The frames of whole chunks from a stream of chunks in several micro-batches, with carried state."""
    base = RU.work_dir(spark, "chunks")
    value_chunks(spark, sf_dir).repartition(8, "track_id", "chunk_idx").write.parquet(f"{base}/in")
    stream = RU.stream_files(spark, f"{base}/in", spark.read.parquet(f"{base}/in"), max_files=2)
    return spectrum_rows(RU.drain_to_table(SE.frame_stream(stream), "frames"))


@query(
    "str08_sliding_windows",
    f"""WITH w AS (SELECT event_type, value, (k - i) * {HOUR} AS w FROM (SELECT event_type, value, epoch_us(ts) // {HOUR} AS k FROM events), range(0, 3) t(i))
    SELECT w AS window_us, event_type, count(*) AS n, round(max(value), 6) AS top FROM w GROUP BY ALL""",
)
def str08(spark, sf_dir):
    ev = events_of(spark, sf_dir).withColumn("ts", F.timestamp_micros(A.epoch_us("ts")))
    out = ev.groupBy(F.window("ts", "3 hours", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top"))
    return out.select(F.unix_micros("window.start").alias("window_us"), "event_type", "n", "top")


@query("str09_forward_sink", f"WITH {CLEAN} SELECT event_id, event, bucket, outcome FROM clean WHERE reason IS NULL")
def str09(spark, sf_dir):
    stream = RU.stream_files(spark, f"{sf_dir}/events*.parquet", events_of(spark, sf_dir))
    clean = ME.sanitise_entries(entries(stream)).select("event_id", "event", "bucket", "outcome", "reason")
    path = RU.work_dir(spark, "forward")
    RU.drain_batches(clean, "forward", ME.forward_sink(path))
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


@query("str10_drop_replays", "SELECT event_id, user_id FROM events")
def str10(spark, sf_dir):
    stream = RU.stream_files(spark, f"{sf_dir}/events*.parquet", events_of(spark, sf_dir))
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("ts", F.timestamp_micros(A.epoch_us("ts")))
    return RU.drain_to_table(ME.drop_replays(doubled, ["user_id", "event_id"]).select("event_id", "user_id"), "replays")
