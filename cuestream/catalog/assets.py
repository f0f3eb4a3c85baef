"""Assets, signatures and summaries over documents, orders, lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuestream import adapters as A
from cuestream.catalog.joins import PRESETS_SQL, presets
from cuestream.catalog.registry import query
from cuestream.catalog.sqlviews import ASSETS, DIALOGUE, DOC_LINES, sig
from cuestream.functions import text as X
from cuestream.operators import assets as AS
from cuestream.operators import matching as M

SIGS = f"{DOC_LINES}, s AS (SELECT track_id, seq, {sig('text')} AS sig FROM doc_lines)"


def signed_lines(spark, sf_dir):
    return A.doc_lines(spark, sf_dir).select("track_id", "seq", X.norm_match("text").alias("sig"))


@query("agg04_repeated_lines", f"WITH {SIGS} SELECT track_id, sig, count(*) AS n FROM s WHERE length(sig) >= 3 GROUP BY ALL HAVING count(*) >= 2")
def agg04(spark, sf_dir):
    return AS.repeated_signatures(signed_lines(spark, sf_dir))


@query(
    "agg05_repetition_groups",
    f"""WITH {SIGS} SELECT track_id, sig, seq, count(*) OVER w AS n, min(seq) OVER w AS first_seq FROM s WHERE length(sig) >= 3
    WINDOW w AS (PARTITION BY track_id, sig) QUALIFY n >= 2""",
)
def agg05(spark, sf_dir):
    return AS.repetition_groups(signed_lines(spark, sf_dir), hot=False)


@query(
    "agg07_alignment_score",
    """WITH p AS (SELECT a.p_size, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_size, round(avg(CASE WHEN x = y THEN 1.0 ELSE greatest(0.0, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) END::DOUBLE), 9) AS score FROM p GROUP BY p_size""",
)
def agg07(spark, sf_dir):
    from cuestream.operators.align import alignment_score

    part = A.table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    pairs = part.select("p_partkey", "p_size", "p_name").join(other, "p_partkey")
    pairs = pairs.withColumn("score", X.similarity("p_name", "y"))
    return alignment_score(pairs, ["p_size"]).withColumn("score", F.round("score", 9))


@query(
    "agg08_project_summaries",
    """WITH per AS (SELECT o_custkey, count(*) AS n, max(epoch_us(o_orderdate) - 694224000000000) AS last, max(epoch_us(o_orderdate)) AS up FROM orders GROUP BY 1)
    SELECT c_custkey AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'Untitled project' ELSE c_name END AS title, coalesce(up, 0) AS updated_us, coalesce(n, 0) AS line_count,
      c_custkey % 3 = 0 AS has_audio, c_custkey % 5 = 0 AS has_voiceover,
      greatest(CASE WHEN c_custkey % 3 = 0 THEN 300000000000000 ELSE 0 END, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 1000000 ELSE 0 END, coalesce(last, 0)) AS duration_us
    FROM customer LEFT JOIN per ON o_custkey = c_custkey""",
)
def agg08(spark, sf_dir):
    at = A.epoch_us("cast(o_orderdate as timestamp_ntz)")
    cues = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), at.alias("at"), (at - F.lit(694_224_000_000_000)).alias("end_us")
    )
    key = F.col("c_custkey")
    newest = cues.groupBy("project_id").agg(F.max("at").alias("_up"))
    projects = A.table(spark, sf_dir, "customer").select(
        key.alias("project_id"),
        F.when(key % 4 != 0, F.col("c_name")).otherwise("").alias("title"),
        F.when(key % 3 == 0, F.lit(300_000_000_000_000)).alias("audio_us"),
        F.when(key % 5 == 0, key * 1_000_000).alias("voice_us"),
    )
    projects = projects.join(newest, "project_id", "left").withColumn("updated_us", F.coalesce("_up", F.lit(0))).drop("_up")
    return AS.summarise_projects(projects, cues)


@query("agg09_dedupe_by_hash", f"WITH {ASSETS} SELECT * FROM assets QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY asset_id) = 1")
def agg09(spark, sf_dir):
    return AS.dedupe_by_hash(A.assets(spark, sf_dir), "asset_id")


@query(
    "agg10_content_signature",
    f"""WITH {DIALOGUE}, t AS (SELECT track_id, sha256(concat_ws(chr(31), 'vb:nova', CAST(seq AS VARCHAR), CAST(seq AS VARCHAR), text, CAST(seq * 5000000 AS VARCHAR),
      CASE WHEN speaker = 'B' THEN 'B' ELSE '' END)) AS h FROM dialogue WHERE trim(text) <> '')
    SELECT track_id, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR) AS signature FROM t GROUP BY track_id""",
)
def agg10(spark, sf_dir):
    lines = A.dialogue(spark, sf_dir).withColumns({"cue_id": F.col("seq"), "spoken": F.col("text"), "start_us": F.col("seq") * 5_000_000})
    return AS.content_signature(lines, "nova")


SETTINGS_SQL = f"""{PRESETS_SQL}, st AS (SELECT l_orderkey, l_linenumber, preset_id, width, height, fps, video_bitrate, audio_bitrate, l_suppkey * 1000000 AS s,
   l_suppkey * 1000000 + CAST(floor(l_extendedprice * 1e4 + 0.5) AS BIGINT) AS e, l_linenumber % 2 = 0 AS inc
   FROM lineitem JOIN (SELECT *, row_number() OVER () - 1 AS k FROM presets) ON k = l_partkey % 10)"""


def export_settings(spark, sf_dir):
    dim = presets(spark)
    ids = F.array(*[F.lit(p[0]) for p in __import__("cuestream.catalog.joins", fromlist=["PRESETS"]).PRESETS])
    start = F.col("l_suppkey") * 1_000_000
    rows = A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.element_at(ids, (F.col("l_partkey") % 10 + 1).cast("int")).alias("wanted"),
        start.alias("range_start_us"),
        (start + F.floor(F.col("l_extendedprice") * F.lit(1e4) + 0.5)).alias("range_end_us"),
        (F.col("l_linenumber") % 2 == 0).alias("include_audio"),
    )
    return M.lookup_with_default(rows, dim, "wanted", "preset_id", "youtube").drop("wanted")


_EST = """SELECT *, CAST(floor((greatest(0.0, (e - s) / 1e6::DOUBLE) * video_bitrate + CASE WHEN inc THEN greatest(0.0, (e - s) / 1e6::DOUBLE) * audio_bitrate ELSE 0 END) / 8 + 0.5) AS BIGINT) AS output_bytes,
   CAST(floor((e - s) / 1e6::DOUBLE * fps + 0.5) AS BIGINT) AS frames, CAST(floor((e - s) / 1e6::DOUBLE * 3 + 0.5) AS BIGINT) AS eta_seconds,
   concat_ws(',', CASE WHEN width * height >= 8294400 AND (e - s) / 1e6::DOUBLE > 60 THEN '4k_over_a_minute' END, CASE WHEN (e - s) / 1e6::DOUBLE > 600 THEN 'over_ten_minutes' END,
     CASE WHEN (e - s) / 1e6::DOUBLE * fps > 30000 THEN 'many_frames' END) AS warnings FROM st"""


@query(
    "agg12_export_estimates",
    f"WITH {SETTINGS_SQL}, x AS ({_EST}) SELECT l_orderkey, l_linenumber, preset_id, output_bytes, frames, eta_seconds, warnings FROM x",
)
def agg12(spark, sf_dir):
    return AS.export_estimates(export_settings(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "preset_id", "output_bytes", "frames", "eta_seconds", "warnings"
    )


@query(
    "agg12_export_totals",
    f"WITH {SETTINGS_SQL}, x AS ({_EST}) SELECT preset_id, count(*) AS n, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, CAST(sum(frames) AS BIGINT) AS frames, count(*) FILTER (warnings <> '') AS n_warned FROM x GROUP BY preset_id",
)
def agg12_totals(spark, sf_dir):
    return AS.export_estimates(export_settings(spark, sf_dir)).groupBy("preset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("output_bytes").alias("output_bytes"),
        F.sum("frames").alias("frames"),
        F.count_if(F.col("warnings") != "").alias("n_warned"),
    )


@query(
    "agg14_bundle_id",
    f"""WITH {ASSETS}, e AS (SELECT kind, asset_id || chr(31) || content_hash || chr(31) || bytes AS e FROM assets),
    b AS (SELECT kind, substr(sha256(e), 1, 3) AS b, count(*) AS k, sha256(string_agg(e, chr(30) ORDER BY encode(e))) AS h FROM e GROUP BY ALL)
    SELECT kind AS bundle, sum(k)::BIGINT AS n_entries, substr(sha256(string_agg(h, chr(30) ORDER BY b)), 1, 24) AS bundle_id FROM b GROUP BY kind""",
)
def agg14(spark, sf_dir):
    d = A.assets(spark, sf_dir).select(
        F.col("kind").alias("bundle"), F.col("asset_id").alias("id"), F.col("content_hash").alias("sha256"), "bytes"
    )
    return AS.bundle_id(d)


PIXELS = """px AS (SELECT vec_id, label AS image, CAST(abs(CAST(floor(embedding[i * 4 + 1] * 400) AS BIGINT)) % 256 AS INTEGER) AS r, CAST(abs(CAST(floor(embedding[i * 4 + 2] * 400) AS BIGINT)) % 256 AS INTEGER) AS g,
   CAST(abs(CAST(floor(embedding[i * 4 + 3] * 400) AS BIGINT)) % 256 AS INTEGER) AS b, CAST(abs(CAST(floor(embedding[i * 4 + 4] * 4000) AS BIGINT)) % 256 AS INTEGER) AS a FROM embeddings, range(0, 16) t(i))"""


@query(
    "agg15_palette",
    f"""WITH {PIXELS}, k AS (SELECT image, ((r >> 4) << 8) + ((g >> 4) << 4) + (b >> 4) AS bucket, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM px WHERE a >= 64 GROUP BY ALL),
    t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, bucket) <= 4)
    SELECT image, CAST(bucket AS INTEGER) AS bucket, n, printf('#%02X%02X%02X', CAST(sr // n AS BIGINT), CAST(sg // n AS BIGINT), CAST(sb // n AS BIGINT)) AS colour,
      round((sr * 0.2126::DOUBLE + sg * 0.7152::DOUBLE + sb * 0.0722::DOUBLE) / n, 6) AS luminance FROM t""",
)
def agg15(spark, sf_dir):
    vec = F.col("embedding")
    emb = A.table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))

    def channel(k: int, scale: int):
        raw = F.element_at(vec, F.col("i") * 4 + k) * F.lit(scale).cast("float")
        return (F.abs(F.floor(raw)) % 256).cast("int")

    px = emb.select(
        F.col("label").alias("image"), channel(1, 400).alias("r"), channel(2, 400).alias("g"), channel(3, 400).alias("b"), channel(4, 4000).alias("a")
    )
    return AS.palette(px)


CHUNK_BYTES = 512


def doc_files(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file"), F.col("text").cast("binary").alias("content")
    )


CHUNKS = f"""ch AS (SELECT doc_id AS file, CAST(i AS INTEGER) AS idx, c[i * {CHUNK_BYTES} + 1:(i + 1) * {CHUNK_BYTES}] AS piece FROM
   (SELECT doc_id, c, unnest(range(0, CAST(ceil(octet_length(c) / {CHUNK_BYTES}.0) AS BIGINT))) AS i FROM (SELECT doc_id, encode(text) AS c FROM documents)))"""


@query("src16_chunk_table", f"WITH {CHUNKS} SELECT file, idx, octet_length(piece) AS bytes, sha256(piece) AS sha256 FROM ch")
def src16(spark, sf_dir):
    return AS.split_into_chunks(doc_files(spark, sf_dir), CHUNK_BYTES).drop("piece")


@query(
    "src15_chunk_integrity",
    f"""WITH {CHUNKS}, n AS (SELECT file, count(*) AS n FROM ch GROUP BY file)
    SELECT file, CASE WHEN file % 11 = 1 THEN 'inconsistent size' WHEN file % 11 = 2 THEN 'missing part' WHEN file % 11 = 3 THEN 'unexpected part size'
      WHEN file % 11 = 4 THEN 'failed integrity check' ELSE 'ok' END AS verdict FROM n""",
)
def src15(spark, sf_dir):
    """Chunks damaged in four ways by document number, checked against the sound manifest."""
    files = doc_files(spark, sf_dir)
    sound = AS.split_into_chunks(files, CHUNK_BYTES)
    kind = F.col("file") % 11
    first = F.col("idx") == 0
    damaged = sound.filter(~((kind == 2) & first)).withColumns(
        {
            "bytes": F.when((kind == 3) & first, F.col("bytes") + 1).otherwise(F.col("bytes")),
            "sha256": F.when((kind == 4) & first, F.lit("0")).otherwise(F.col("sha256")),
        }
    )
    declared = files.select("file", (F.octet_length("content") + F.when(kind == 1, 1).otherwise(0)).cast("long").alias("total_bytes"))
    return AS.verify_chunks(damaged, sound, declared)
