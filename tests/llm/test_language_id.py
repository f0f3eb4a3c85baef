"""Language identification: gradients, held-out accuracy, edge cases."""

import random

import numpy as np

from cuestream.llm import language_id as I

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "öß"], "cc": ["qué", "ñor", "ción", "el"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_pair_tables_give_what_the_filters_give():
    net = I.ByteConvNet(["x", "y", "z"], I.Shape(widths=(2, 3, 4, 5)))
    windows = np.random.default_rng(0).integers(0, 256, (20, I.WINDOW)).astype(np.uint8)
    assert np.abs(net.predict(windows) - net._forward(windows)[3]).max() < 1e-5


def test_gradients_match_differences():
    net = I.ByteConvNet(["x", "y"], I.Shape(embedding=3, filters=2))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(1, 256, (6, I.WINDOW)).astype(np.uint8), rng.integers(0, 2, 6)
    grads = net._gradients(windows, labels)
    loss = lambda: -np.log(net._forward(windows)[3][np.arange(6), labels]).mean()
    for name, x in net.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), x.shape)
        was = x[at]
        x[at] = was + 1e-6
        up = loss()
        x[at] = was - 1e-6
        down = loss()
        x[at] = was
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-4, name


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, k, rng.randint(5, 120)), k) for i, k in enumerate(rng.choices(list(SYLLABLES), k=240))]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    net = I.train(docs.filter("doc_id % 4 <> 2"), shape=I.Shape(steps=250))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "k"), (1004, text(rng, "bb", 40000)), (1000, None), (None, "lomi")]
    held = docs.filter("doc_id % 4 = 2").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = I.predict(held, net).collect()
    want = {i: k for i, _, k in rows}
    known = [r for r in got if r.doc_id in want]
    assert sum(r.lang_pred == want[r.doc_id] for r in known) / len(known) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(got) == held.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1004].lang_pred == "bb" and by[1003].lang_pred in SYLLABLES


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert I.train(docs) is None
    assert I.predict(docs, None).collect()[0].lang_pred == "und"
    assert I.predict(docs.limit(0), None).count() == 0
