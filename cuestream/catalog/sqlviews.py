"""The adapter views of ``cuestream.adapters`` as SQL, for the oracles."""

SPANS = """
spans AS (
  SELECT user_id AS track_id, event_id AS cue_id, event_type, epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(floor(value * 6e7 + 0.5) AS BIGINT) AS end_us
  FROM events)"""

TRACKS = SPANS + """,
tracks AS (SELECT track_id, max(start_us) + 3600000000 AS duration_us FROM spans GROUP BY track_id)"""

DOC_LINES = """
doc_lines AS (
  SELECT * FROM (
    SELECT doc_id AS track_id, CAST(i - 1 AS BIGINT) AS seq,
           regexp_replace(string_split(text, chr(10))[i], '^[\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g') AS text
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
  WHERE text <> '')"""

DIALOGUE = """
dialogue AS (
  SELECT conv_id AS track_id, turn AS seq,
         CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' END AS speaker, text
  FROM conversations)"""

SIGNAL = """
hours AS (SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, event_type AS band, CAST(value AS DECIMAL(20,4)) AS value FROM events),
bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM hours),
signal AS (
  SELECT CAST(0 AS BIGINT) AS track_id, f.hour - b.lo AS frame, t.band,
         CAST(coalesce(s.v, 0) AS DOUBLE) AS value
  FROM bounds b, (SELECT unnest(range(lo, hi + 1)) AS hour FROM bounds) f,
       (SELECT DISTINCT band FROM hours) t
  LEFT JOIN (SELECT hour, band, sum(value) AS v FROM hours GROUP BY ALL) s
    ON s.hour = f.hour AND s.band = t.band)"""

TAPS = """
taps AS (SELECT user_id AS track_id, event_id AS tap_id, epoch_us(ts) AS time_us FROM events WHERE event_type = 'click')"""

ASSETS = """
assets AS (SELECT doc_id AS asset_id, source AS kind, octet_length(encode(text)) AS bytes, sha256(text) AS content_hash FROM documents)"""


def sig(expr: str) -> str:
    """SQL for the match signature of Latin text."""
    folded = f"strip_accents(lower(strip_accents(regexp_replace({expr}, '[''’`]', '', 'g'))))"
    return f"trim(regexp_replace(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"


def rnd(expr: str) -> str:
    """Nearest integer, halves up."""
    return f"CAST(floor(({expr}) + 0.5) AS BIGINT)"


def nw(pairs: str) -> str:
    """Global alignments of the token lists a and b of ``pairs(p, a, b)``, for WITH RECURSIVE.

    ``nw_pairs(p, i, j, s)`` are the aligned tokens (from 1), ``nw_score(p, score)`` the mean
    over all aligned places. A row of scores is a list; the way back looks up, for each row,
    where a run of moves to the left ends.
    """
    return f"""
nw_sims AS MATERIALIZED (
  SELECT p, i, list(CASE WHEN x = y THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE greatest(0.0, 1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) END ORDER BY j) AS sims
  FROM (SELECT p, i, a[i] AS x, b, unnest(range(1, len(b) + 1)) AS j, b[j] AS y FROM (SELECT p, a, b, unnest(range(1, len(a) + 1)) AS i FROM {pairs} WHERE len(b) > 0))
  GROUP BY p, i),
nw_rows(p, i, score, land, moves) AS MATERIALIZED (
  SELECT p, CAST(0 AS BIGINT), list_transform(range(0, len(b) + 1), lambda j: CAST(-j AS DOUBLE)), CAST([] AS BIGINT[]), CAST([] AS INTEGER[]) FROM {pairs}
  UNION ALL
  SELECT p, i, list(new ORDER BY j), list(coalesce(lands, 0) ORDER BY j) FILTER (j > 0), list(move ORDER BY j) FILTER (j > 0)
  FROM (
    SELECT *, last_value(CASE WHEN move < 2 AND j > 0 THEN j END IGNORE NULLS) OVER (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING) AS lands
    FROM (
      SELECT *, CASE WHEN abs(new - diag) < 1e-9 THEN 0 WHEN abs(new - up) < 1e-9 THEN 1 ELSE 2 END AS move
      FROM (
        SELECT *, max(greatest(diag, up) + j) OVER (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING) - j AS new
        FROM (
          SELECT p, i, j, score[j + 1] - 1 AS up, CASE WHEN j > 0 THEN score[j] + CASE WHEN sims[j] >= 0.5 THEN 2 * sims[j] ELSE 4 * sims[j] - 2 END END AS diag
          FROM (SELECT r.p, s.i, r.score, s.sims, unnest(range(0, len(r.score))) AS j FROM nw_rows r JOIN nw_sims s ON s.p = r.p AND s.i = r.i + 1)))))
  GROUP BY p, i),
nw_back(p, i, j, s) AS (
  SELECT p, CAST(len(a) AS BIGINT) + 1, CAST(len(b) AS BIGINT), CAST(NULL AS DOUBLE) FROM {pairs}
  UNION ALL
  SELECT p, i, CASE WHEN hit THEN col - 1 ELSE col END, CASE WHEN hit THEN sim END
  FROM (SELECT b.p, r.i, CASE WHEN b.j > 0 THEN r.land[b.j] ELSE 0 END AS col, col > 0 AND r.moves[col] = 0 AS hit, s.sims[col] AS sim
        FROM nw_back b JOIN nw_rows r ON r.p = b.p AND r.i = b.i - 1 JOIN nw_sims s ON s.p = r.p AND s.i = r.i)),
nw_pairs AS (SELECT p, i, j + 1 AS j, s FROM nw_back WHERE s IS NOT NULL),
nw_score AS (
  SELECT p, coalesce(sum(s), 0) / (any_value(len(a)) + any_value(len(b)) - count(s)) AS score FROM {pairs} LEFT JOIN nw_pairs USING (p) GROUP BY p)"""
