"""Two-tier BPE against the tiktoken library, and exact round trips."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cuestream.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "hello world", "  \n\t x", "</s>[INST] <|endoftext|>", "日本語 😀 é́", "\x1c\x85​", "ab" * 30000, "x" * 5000, "hello world"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    bpe = B.tokenizer(PATH, PATTERN)
    assert sorted(bpe.hash.value) == list(range(len(bpe.tokens)))
    assert all(bpe.lookup(t) == i for i, t in enumerate(bpe.tokens))
    assert bpe.lookup(b"no such token, surely") == -1


def test_random_texts_match_the_library(reference):
    bpe, rng = B.tokenizer(PATH, PATTERN), random.Random(3)
    alphabet = ["a", "th", "ing", " ", "  ", "\n", "1", "²", "'s", "é", "ß", "日", "😀", "_", "\x1c", " ", "!!", "Z"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_merge_alone_matches_the_library(reference):
    bpe = B.tokenizer(PATH, PATTERN)
    for piece in (b"antidisestablishmentarianisms", b"qqqqqqqqqqq", bytes(range(200, 256)), b"zxzxzxzxzxz"):
        assert bpe.merge(piece) == reference._encode_single_piece(piece)


def test_query_shape_round_trip_and_edge_cases(spark, reference):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    got = B.decode(B.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert bytes(r.decoded).decode() == text
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) // 4
    assert B.encode(docs.limit(0), PATH, PATTERN).count() == 0
