"""Language model: gradients by differences, counts and base scores by plain Python, windows that carry state."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cuestream.llm import language_model as L

SMALL = L.Shape(hidden=5, words=12, classes=3, window=6, lanes=3)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = L.GatedNet(11, SMALL)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, fresh, target, real, _ = L.lay_out([rng.integers(0, 11, n) for n in (6, 4, 3, 5)], 3, len(net.w["embed"]) - 1)
    start = np.zeros((len(words), 5))
    grads, _, _ = net.step(words, fresh, target, real, start)

    def loss():
        out, _ = net.run(words, fresh, start)
        flat = real.reshape(-1)
        return -net.log_probs(out.reshape(-1, 5)[flat].astype(np.float64), target.reshape(-1)[flat])[0].sum()

    for name, x in net.w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), x.shape)
        was = x[at]
        x[at] = was + 1e-4
        up = loss()
        x[at] = was - 1e-4
        down = loss()
        x[at] = was
        assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3, name


def test_probabilities_sum_to_one_and_state_is_carried():
    net = L.GatedNet(11, SMALL)
    hidden = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    p = [math.exp(net.log_probs(hidden, np.array([w]))[0][0]) for w in range(11)]
    assert abs(sum(p) - 1) < 1e-5
    text = np.random.default_rng(2).integers(0, 11, 300)
    alone = L.score_texts(net, [text])[0]
    among = L.score_texts(net, [text[:40], text, text[:7]], lanes=2)
    assert abs(alone - among[1]) < 1e-2
    cut = L.score_texts(net, [text[:64], text[64:]]).sum()  # without the state between the two
    assert abs(alone - cut) > 1e-4


def test_training_beats_the_unigram_start():
    rng = np.random.default_rng(3)
    texts = [np.array([(i + k) % 9 + 1 for i in range(40)] + [0]) for k in rng.integers(0, 9, 200)]
    counts = np.bincount(np.concatenate(texts), minlength=11).tolist()
    net = L.GatedNet(11, L.Shape(hidden=8, classes=3, window=10, lanes=8)).start_from(counts)
    before = L.score_texts(net, texts[:20]).sum()
    trainer = L.Trainer(net)
    for at in range(0, 200, 20):
        trainer.texts(texts[at : at + 20])
    assert L.score_texts(net, texts[:20]).sum() > 0.5 * before


ROWS = [(i, " ".join(f"W{(i * j) % 23}" for j in range(i % 17))) for i in range(120)]
ROWS += [(500, None), (501, ""), (502, "rare1 rare2 rare2\tthe"), (503, "é " * 9000), (500, None), (None, "no id")]


@pytest.mark.parametrize("head", [L.HEAD, 3])
def test_counts_and_base_score(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, n long, token string")
    learned = docs.filter("doc_id is null or doc_id % 3 <> 1")
    counts = L.keep(L.count_tokens(learned), "counts")
    v = L.vocabulary(counts, L.Shape(words=10, classes=2), head)
    assert len(v.counts) <= head + 1
    net = L.train(learned, v, L.Shape(words=10, classes=2, hidden=4), share=1, replicas=2)
    got = L.score(docs, counts, v, net).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter()
    for d, t in ROWS:
        if d is None or d % 3 != 1:
            c.update(tokens(t))
    total, distinct = sum(c.values()), len(c)
    assert (v.total, v.distinct) == (total, distinct) and len(got) == len(ROWS)
    for r in got:
        t = tokens(next(x for d, x in ROWS if d == r.doc_id))
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


@pytest.mark.parametrize("replica_tokens", [L.REPLICA_TOKENS, 300])
def test_every_training_document_reaches_the_network(spark, monkeypatch, replica_tokens):
    monkeypatch.setattr(L, "REPLICA_TOKENS", replica_tokens)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    shape = L.Shape(words=10, classes=2, hidden=4)
    v = L.vocabulary(L.keep(L.count_tokens(docs), "counts"), shape)
    net = L.train(docs, v, shape)
    assert net.trained == v.total == sum(len((t or "").split()) + 1 for _, t in ROWS)
    start = L.GatedNet(len(v.ids) + 1, shape).start_from(L.model_counts(v))
    assert all(np.isfinite(x).all() and x.shape == start.w[k].shape for k, x in net.w.items())
    texts = [L.text_ids(v, L.tokens_of((t or "").encode())) for _, t in ROWS]
    assert L.score_texts(net, texts).sum() > L.score_texts(start, texts).sum()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    counts = L.keep(L.count_tokens(docs.limit(0)), "counts")
    v = L.vocabulary(counts)
    net = L.train(docs.limit(0), v)
    r = L.score(docs, counts, v, net).collect()[0]
    assert r.n_known == 0 and math.isclose(r.base_score, 3 * math.log10(0.5 / 0.5))
    assert L.score(docs.limit(0), counts, v, net).count() == 0


def test_fold_is_crc32_of_the_id(spark):
    from pyspark.sql import functions as F

    from cuestream.llm.language_id import fold

    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def plain_score(net, text):
    """Natural log-likelihood of a text, step by step: a gated unit, its class and its word within the class."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    h = net.shape.hidden
    squash = lambda x: 1 / (1 + np.exp(-x))
    state, last, total = np.zeros(h), len(w["embed"]) - 1, 0.0
    for word in text:
        x, r = w["embed"][last] @ w["x"] + w["b"], state @ w["h"]
        z, g = squash(x[:h] + r[:h]), squash(x[h : 2 * h] + r[h : 2 * h])
        c = np.tanh(x[2 * h :] + g * r[2 * h :])
        state = z * state + (1 - z) * c
        cls, k = divmod(int(word), net.per)
        for logits, at in (
            (state @ w["class"] + w["class_b"], cls),
            (state @ w["word"][cls] + w["word_b"][cls] + net.mask[cls], k),
        ):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        last = int(word)
    return total


def test_scores_match_a_plain_network(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    shape = L.Shape(words=10, classes=2, hidden=4)
    counts = L.keep(L.count_tokens(docs), "counts")
    v = L.vocabulary(counts, shape)
    net = L.train(docs, v, shape)
    for r in L.score(docs, counts, v, net).filter("doc_id < 60 or doc_id = 502").collect():
        t = L.tokens_of((dict(ROWS[:-1])[r.doc_id] or "").encode())
        outside = sum(v.outside(v.counts.get(w, 0)) for w in t if w not in v.ids)
        assert math.isclose(r.score, plain_score(net, L.text_ids(v, t)) / L.LOG10 + outside, rel_tol=1e-4, abs_tol=1e-3)


def test_training_is_the_same_in_another_layout(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    shape = L.Shape(words=10, classes=2, hidden=4)
    v = L.vocabulary(L.keep(L.count_tokens(docs), "counts"), shape)
    a, b = (L.train(d, v, shape, replicas=5) for d in (docs.repartition(7, "text"), docs.orderBy(docs.doc_id.desc())))
    assert all((a.w[k] == b.w[k]).all() for k in a.w)


def test_long_texts_wait_for_others_and_keep_their_state():
    rng = np.random.default_rng(4)
    shape = L.Shape(hidden=5, words=12, classes=3, window=6, lanes=8, rate=0.0)
    net = L.GatedNet(11, shape)
    parts = [[rng.integers(0, 11, n) for n in (300, *rng.integers(1, 30, 40))] for _ in range(10)]
    trainer, step, sums = L.Trainer(net), net.step, []

    def noted(*args):
        grads, logp, last = step(*args)
        sums.append((len(logp), float(logp.sum())))
        return grads, logp, last

    net.step = noted
    seen = [trainer.read(*L.joined(p)) for p in parts]
    seen.append(trainer.finish())
    flat = [t for p in parts for t in p]
    words = sum(map(len, flat))
    assert sum(seen) == sum(n for n, _ in sums) == words
    # at a rate of 0 the windows give what the texts have from first word to end
    assert math.isclose(sum(s for _, s in sums), L.score_texts(net, flat).sum(), rel_tol=1e-4)
    # long texts of several parts are read beside each other
    assert len(sums) < 2 * words / (shape.lanes * shape.window)
    assert len(sums) < sum(-(-max(map(len, p)) // shape.window) for p in parts)


def test_words_are_those_of_plain_splitting():
    import pyarrow as pa

    texts = ["  A  b\x0bc\x0cD\r\n", None, "", " ", "a\x1cb \x85x y z ÉİA", "\x00 a\x00", "x" * 70000, "a b\tc"]
    for kind in (pa.string(), pa.large_string()):
        found, sizes = L.words_of(pa.array([*texts, "cut"], kind).slice(1))
        want = [L.tokens_of((t or "").encode()) for t in [*texts[1:], "cut"]]
        assert found.to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
        v = L.Vocabulary({}, {b"": 2, b"a": 0, b"c": 3}, 1, 0, 0, 0, 0)
        flat, sizes = L.piece_ids(v, L.model_words(v), pa.array(texts, kind))
        ids = [L.text_ids(v, L.tokens_of((t or "").encode())) for t in texts]
        assert flat.tolist() == np.concatenate(ids).tolist() and sizes.tolist() == list(map(len, ids))


def test_scores_with_large_weights():
    rng = np.random.default_rng(6)
    net = L.GatedNet(11, SMALL)
    net.w = {k: v * 12 for k, v in net.w.items()}  # exponents could pass the clip, so it is applied
    texts = [rng.integers(0, 11, n) for n in (50, 1, 9)]
    for text, got in zip(texts, L.score_texts(net, texts, lanes=2), strict=True):
        assert math.isclose(got, plain_score(net, text), rel_tol=1e-3)


def test_each_replica_starts_from_the_network_of_its_round(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    shape = L.Shape(words=10, classes=2, hidden=4)
    v = L.vocabulary(L.keep(L.count_tokens(docs), "counts"), shape)
    got = L.train(docs, v, shape, replicas=40)  # more than there are workers: some train for several
    net = L.GatedNet(len(v.ids) + 1, shape).start_from(L.model_counts(v))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.xxhash64("doc_id", "text")
    for k in range(shape.rounds):
        mine = slim.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(shape.rounds)) == k)
        tasks = {}
        for r in mine.repartition(40, mark).sortWithinPartitions(mark, "doc_id").select("text", F.spark_partition_id().alias("p")).collect():
            tasks.setdefault(r.p, []).append(L.text_ids(v, L.tokens_of(r.text.encode())))
        copies = []
        for texts in tasks.values():
            one = net.copy()
            copies.append((L.Trainer(one).texts(texts), one.w))
        net.w = {x: sum(n * w[x].astype(float) for n, w in copies) / sum(n for n, _ in copies) for x in net.w}
        net.w = {x: a.astype(np.float32) for x, a in net.w.items()}
    assert all(np.allclose(net.w[x], got.w[x], rtol=1e-4, atol=1e-5) for x in net.w)
