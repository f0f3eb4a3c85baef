"""Shards: the permutation, and every sequence once at its slot."""

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from cuestream.llm import token_shards as S

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 4, 5, 17, 255, 256, 257, 5000):
        order = S.Permutation(n, 9)
        slots = order.forward(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.backward(slots) == np.arange(n)).all()
    a, b = S.Permutation(5000, 1).forward(np.arange(5000)), S.Permutation(5000, 2).forward(np.arange(5000))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05


def test_every_sequence_is_at_its_slot(spark):
    texts = [None, "", "short", "some words " * 400, "日本語 " * 90, "some words " * 400, "z" * 3000]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x"), (None, "no id", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, part string")
    shards = S.materialise(docs, PATH, PATTERN, key=4, length=32, per_shard=10)
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, *_ in rows:
        ids = plain.encode_ordinary(t or "")
        want += [(str(d), k // 32, tuple(ids[k : k + 32])) for k in range(0, len(ids), 32)]
    got = S.read_slots(shards).collect()
    assert sorted((str(r.doc_id), r.part, tuple(np.frombuffer(bytes(r.ids), "<u2").tolist())) for r in got) == sorted(want)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    blocks = shards.collect()
    assert all(len(r.block) == r.stride * r.n_sequences and r.stride == 64 for r in blocks)
    assert sorted(r.n_sequences for r in blocks)[1:] == [10] * (len(blocks) - 1)
    some = S.read_slots(shards, 13, 9).collect()
    assert {(r.slot, bytes(r.ids)) for r in some} == {(r.slot, bytes(r.ids)) for r in got if 13 <= r.slot < 22}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.materialise(docs, PATH, PATTERN).count() == 0


def test_long_blanks_and_a_job_that_starts_again(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "two words")], "doc_id long, text string")
    where = f"file://{tmp_path}/tokens"
    once = S.read_slots(S.materialise(docs, PATH, PATTERN, key=4, length=32, tokenised=where)).collect()
    assert {r.doc_id for r in once} == {1, 2}

    def no_second_pass(*args):
        raise AssertionError

    monkeypatch.setattr(S, "sequences", no_second_pass)
    again = S.read_slots(S.materialise(docs, PATH, PATTERN, key=4, length=32, tokenised=where)).collect()
    assert sorted(map(str, again)) == sorted(map(str, once))


def test_wide_ids_are_read_as_written(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * 30 * i) for i in range(5)], "doc_id long, text string")
    narrow = {(r.doc_id, r.part): np.frombuffer(bytes(r.ids), "<u2").tolist() for r in S.read_slots(S.materialise(docs, PATH, PATTERN, length=32)).collect()}
    ids = S.sequences(docs, PATH, PATTERN, 32).collect()
    assert narrow == {(r.doc_id, r.part): np.frombuffer(bytes(r.ids), "<u2").tolist() for r in ids}
    data = np.arange(20, dtype="<u4")
    batch = pa.RecordBatch.from_arrays(
        [*[pa.array([7, 7], pa.int64())] * 2, pa.array([16, 4], pa.int64()), S.binary_array(data.view(np.uint8), np.array([0, 64, 80]))],
        ["doc_id", "part", "n_tokens", "ids"],
    )
    wide = spark.createDataFrame(S._shard(0, [batch], 1024, 128, 4).to_pylist(), S.SHARDS)
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in S.read_slots(wide).collect()] == [list(range(16)), list(range(16, 20))]
