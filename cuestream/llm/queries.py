"""One query per operator of this subpackage over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, language_model, lempel_ziv_dedup, line_dedup, merkle_manifest, prefix_trie, suffix_dedup, token_shards
from cuestream.llm import quality_rules as rules
from cuestream.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from cuestream.llm.shared import keep, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

OP1_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR 2 * n_upper > word_chars
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM judged
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.apply_policy(rules.apply_policy(rules.evaluate(docs), rules.BASE).withColumnRenamed("kept", "base_kept"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.count_hit_words("spans")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, with_ids=False)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(language_id.fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    predicted = language_id.predict(docs, language_id.train(learned))
    return predicted.select(
        "doc_id", (language_id.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>' || role || chr(10) || text || '</s>')
           + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))
           + length(regexp_replace(role, '[^\n]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    read = chat_format.run_chains(rows.unionByName(more))
    return chat_format.digests(chat_format.parse(read)).select(
        F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query("op2_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.filter(language_id.fold(F.col("doc_id"), 5) != 1)
    counts = keep(language_model.count_tokens(learned), "counts")
    words = language_model.vocabulary(counts)
    net = language_model.train(learned, words)
    scored = language_model.score(docs, counts, words, net)
    return scored.select(
        "doc_id", (language_id.fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i - 1 AS place, t[i] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents)),
words AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
boiler AS (SELECT line, min((doc_id, place)) AS first FROM words GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.*, regexp_matches(l.line, '[^\x20\x09-\x0D]') AS counted,
         b.line IS NOT NULL AND (l.doc_id, l.place) <> b.first AS gone
  FROM l LEFT JOIN boiler b ON l.line = b.line)
SELECT d.doc_id, count(m.place) FILTER (WHERE counted) AS n_lines, count(m.place) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_dedup.clean(docs, with_counts=True)
    kept = F.coalesce(F.col("d.text"), F.lit(""))
    return cleaned.select("d.doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') || ' ' || least(5, len(w)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b, c = x.n AND c = y.n AS same
  FROM common JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 9 * c >= 4 * (x.n + y.n)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
copies AS (SELECT a, min(b) AS m FROM link WHERE same GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT w.doc_id, least(w.doc_id, class.m) AS class_id, least(w.doc_id, copies.m) AS copy_of,
       coalesce(n.n, 0)::BIGINT AS n_links, coalesce(size.n, 0)::BIGINT AS n_shingles
FROM w LEFT JOIN class ON w.doc_id = class.a LEFT JOIN copies ON w.doc_id = copies.a LEFT JOIN n ON w.doc_id = n.a
LEFT JOIN size ON w.doc_id = size.doc_id
"""


@query("op4_jaccard_join", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_token_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.materialise(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, key=2024)
    rows = token_shards.read_slots(shards)
    return rows.select("slot", "shard", "doc_id", "part", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
late AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
starts AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS new FROM late),
numbered AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM starts),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs),
cut AS (
  SELECT d.doc_id, sum(e - s) AS n, count(*) AS k,
         string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""


@query("op5_suffix_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Unsigned CRC-32 of decimal numbers in SQL: its table by rule, then one step per character.
CRC_SQL = r"""
bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
steps(id, rest, r) AS (
  SELECT id, id::VARCHAR, 4294967295::BIGINT FROM ids
  UNION ALL SELECT id, substr(rest, 2), xor(v, r >> 8) FROM steps JOIN bits ON k = 8 AND b = xor(r, ascii(rest)) & 255 WHERE rest <> ''),
crc AS (SELECT id, xor(r, 4294967295) AS c FROM steps WHERE rest = '')
"""

OP13_SQL = (
    r"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents),
"""
    + CRC_SQL
    + r""",
own AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS other FROM own),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up(lang, lvl, pos, n, d) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, lvl, n, pos // 8),
subs AS (SELECT lang, d, lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, d) AS (
  SELECT 0, pos, n, d FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 8),
-- the siblings of every node below the root, the levels of a language's tree first
steps1 AS (
  SELECT a.lang, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.lang, a.lvl, a.pos),
steps2 AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
walk(doc_id, leaf, lang, lvl, pos, proof, folded) AS (
  SELECT doc_id, leaf, lang, 0, pos, '', CASE WHEN c % 3 = 0 THEN other ELSE leaf END FROM placed LEFT JOIN crc ON crc.id = doc_id
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.lvl + 1, w.pos // 8, proof || l || r, sha256(l || folded || r)
  FROM walk w JOIN steps1 s ON w.lang IS NOT DISTINCT FROM s.lang AND w.lvl = s.lvl AND w.pos = s.pos),
there AS (
  SELECT w.*, s.d AS subroot, s.pos AS top_pos FROM walk w JOIN subs s ON w.lang IS NOT DISTINCT FROM s.lang AND w.lvl = s.lvl),
climb(doc_id, leaf, subroot, lvl, pos, proof, folded) AS (
  SELECT doc_id, leaf, subroot, 0, top_pos, proof, folded FROM there
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.pos // 8, proof || l || r, sha256(l || folded || r)
  FROM climb c JOIN steps2 s ON c.lvl = s.lvl AND c.pos = s.pos)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified
FROM climb c JOIN top t ON t.n = 1 AND t.lvl = c.lvl
"""
)


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered(fields):
        hit = F.pmod(F.crc32(fields["doc_id"].cast("string").cast("binary")), F.lit(3)) == 0
        small = {**fields, "text": merkle_manifest.lower_ascii(fields["text"])}
        return F.when(hit, merkle_manifest.leaf(list(small.values())))

    return merkle_manifest.verify(merkle_manifest.manifest(table(spark, sf_dir, "documents"), changed=tampered))


OP11_SQL = (
    r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),
"""
    + CRC_SQL
    + r""",
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT id, c % 6 AS h, id - id % 100 AS b FROM crc),
convs AS (SELECT id, h, b, count(t.i) AS m FROM heads LEFT JOIN t ON t.c = b AND t.i <= h GROUP BY id, h, b),
rebuilt AS (
  SELECT id AS c, i AS d, role, text FROM convs JOIN t ON t.c = b AND i <= h
  UNION ALL SELECT id, m + i - h, role, text FROM convs JOIN t ON t.c = id AND i > h),
p AS (
  SELECT c, d, text, string_agg(sha256(role || chr(31) || text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM rebuilt
  UNION ALL SELECT id, 0, '', '' FROM convs),
member AS (SELECT *, min(c) OVER (PARTITION BY d, key) AS node, max(d) OVER (PARTITION BY c) AS len FROM p),
nodes AS (
  SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(length(text)) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends FROM member GROUP BY node, d),
up AS (SELECT n.node, n.d, n.saved, a.node AS over_node, a.d AS over_d FROM nodes n JOIN member a ON a.c = n.node AND a.d <= n.d),
kids AS (SELECT over_node, over_d, count(*) AS n FROM up WHERE over_d = d - 1 GROUP BY over_node, over_d),
sums AS (
  SELECT u.over_node, u.over_d, sum(u.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM up u LEFT JOIN kids k ON u.node = k.over_node AND u.d = k.over_d GROUP BY u.over_node, u.over_d)
SELECT n.node AS conv_id, n.d AS depth, u.over_node AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON n.node = s.over_node AND n.d = s.over_d
LEFT JOIN kids k ON n.node = k.over_node AND n.d = k.over_d
LEFT JOIN up u ON n.node = u.node AND n.d = u.d AND u.over_d = n.d - 1
"""
)


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    head = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(6))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns, F.col("c") - F.col("c") % 100, head, 5))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM late),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
stays AS (SELECT a.doc_id, a.i, a.word FROM words a LEFT JOIN gone b ON a.doc_id = b.doc_id AND a.i = b.i WHERE b.i IS NULL),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM stays GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op12_lempel_ziv_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lempel_ziv_dedup.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
