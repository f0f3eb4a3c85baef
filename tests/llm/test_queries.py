"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from cuestream.llm import byte_bpe, jaccard_join, quality_rules
from cuestream.llm.queries import ORACLES, QUERIES

TABLES = "documents benchmark labels conversations".split()


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, df.collect()) == table(list(want.columns), want.fetchall())


def test_language_id_and_model_on_the_test_tables(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["op9_language_id"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


def brute_pipeline(docs, bench):
    """Plain Python over a small corpus, stage by stage."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def kept(text):
        t = text or ""
        w = word.findall(t)
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeat = len({p + j for at in seen.values() if len(at) > 1 for p in at for j in range(3)})
        lines = [x for x in t.split("\n") if word.search(x)]
        chars, symbols, upper = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-Z]", t))
        return not (
            len(w) < 50 or 100 * repeat > 50 * len(w) or 10 * symbols > len(w) or 2 * upper > chars
            or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or chars < 2 * len(w) or chars > 20 * len(w)
        )

    docs = [d for d in docs if kept(d[1])]
    sites, first = {}, {}
    for d, t, s in docs:
        for i, line in enumerate(t.split("\n")):
            if word.search(line):
                sites.setdefault(line, set()).add(s)
                first[line] = min(first.get(line, (d, i)), (d, i))
    gone = lambda d, i, x: len(sites.get(x, ())) >= 10 and first[x] != (d, i)
    docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if not gone(d, i, x))) for d, t, _ in docs]

    def grams(text):
        w = text.encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    sets = {d: grams(t) for d, t in docs}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    docs = [(d, t) for d, t in docs if label[d] == d]

    clean = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: clean.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for t in bench:
        w = words(t or "")
        k = min(10, len(w))
        if k:
            windows.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    def leaked(t):
        w = words(t)
        return any(tuple(w[i : i + k]) in g for k, g in windows.items() for i in range(len(w) - k + 1))

    return [(d, t) for d, t in docs if not leaked(t)]


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.read_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = set()
    for d, t in brute_pipeline(docs, bench):
        ids = plain.encode_ordinary(t)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert 0 < len(got) < len(docs) and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, d int"
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text, None, None, None, "x", 1), (2, text, "en", "s", 5, None, None), (3, None, "en", "s", 0, "y", 2), (None, text + " z", "en", "s", 1, "z", 3)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        kept = sorted((r.h or "") for r in out.collect())
        assert kept == {"quality_rules": ["", "x", "z"], "ngram_jaccard_join": ["x", "y", "z"]}.get(name, ["", "x", "y", "z"]), name
    assert quality_rules.STANDARD.version and jaccard_join.THRESHOLD == 0.8
