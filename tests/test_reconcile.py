"""Times of a transcript on known lines: the reference case, blocking against all pairs, and memory of long alignments."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from cuestream.functions import text as X
from cuestream.operators import align as AL
from cuestream.operators import reconcile as R

LINES = "track_id string, cue_id long, text string, start_us long, end_us long"
HEARD = "track_id string, idx long, text string, start_us long, end_us long, confidence double"


def test_words_take_the_times_they_were_heard_at(spark):
    lines = spark.createDataFrame(
        [("a", 0, "Hello world", 0, 4_000_000), ("a", 1, "unheard words here", 5_000_000, 9_000_000), ("b", 0, "no transcript", 7, 9), ("a", 2, "", 9_500_000, 9_900_000)],
        LINES,
    )
    heard = spark.createDataFrame(
        [("a", 0, "hello", 1_000_000, 1_400_000, 0.9), ("a", 1, "World,", 1_500_000, 2_100_000, 0.8), ("c", 0, "hello", 1, 2, 0.9)], HEARD
    )
    out, words = R.reconcile(lines, heard, options=None)
    assert rows(words.filter("cue_id = 0"), "track_id", "word_idx", "start_us", "end_us", "source") == [
        ("a", 0, 1_000_000, 1_400_000, "asr"), ("a", 1, 1_500_000, 2_100_000, "asr")
    ]
    got = {(r.cue_id, r.word_idx): r for r in words.collect()}
    assert all(r.confidence < 1 for r in got.values()) and abs(got[0, 0].confidence - 0.9) < 1e-9
    assert {r.source for k, r in got.items() if k[0] == 1} == {"estimate"} and got[1, 0].start_us == 5_000_000
    by = {(r.track_id, r.cue_id): r for r in out.collect()}
    assert (by["a", 0].start_us, by["a", 0].end_us, by["a", 0].source) == (1_000_000, 2_100_000, "align")
    assert abs(by["a", 0].confidence - (0.3 + 0.5 * 2 / 5)) < 1e-9
    assert (by["b", 0].start_us, by["b", 0].end_us, by["b", 0].confidence, by["b", 0].source) == (7, 9, 0.2, "unchanged")
    assert (by["a", 2].start_us, by["a", 2].end_us) == (9_500_000, 9_900_000)
    passed, _ = R.reconcile(lines, heard)
    spans = [(r.start_us, r.end_us) for r in passed.filter("track_id = 'a'").orderBy("start_us", "cue_id").collect()]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def brute_pairs(left, right, size=5, share=0.5):
    out = []
    for l, a in left:
        for r, b in right:
            if a and b:
                n = min(size, len(b))
                s = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
                c = len(s & {tuple(a[i : i + n]) for i in range(len(a) - n + 1)})
                if c and c >= share * len(s):
                    out.append((l, r, c))
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("share", [0.3, 0.5, 1.0])
def test_rarest_shingles_find_every_pair(spark, share):
    rng = random.Random(4)
    hot = [f"h{i}" for i in range(9)]
    left = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 30))] + (hot if i % 3 == 0 else [])) for i in range(60)]
    right = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 9))] + (hot[: rng.randint(0, 9)] if i % 2 else [])) for i in range(40)]
    left += [(100, ["just", "three", "words"]), (101, ["just", "three", "words"])]
    right += [(100, ["just", "three", "words"]), (101, hot), (102, hot)]
    df = [spark.createDataFrame(x, f"{name} long, tokens array<string>") for x, name in ((left, "left_id"), (right, "right_id"))]
    assert rows(R.containing_pairs(*df, share=share), "left_id", "right_id", "shared") == brute_pairs(left, right, share=share)


def test_equal_short_texts_are_aligned(spark):
    left = spark.createDataFrame([(1, "only three words"), (2, "other")], "left_id long, text string")
    right = spark.createDataFrame([(7, "Only three words!")], "right_id long, text string")
    assert rows(AL.align_corpus(left, right), "left_id", "right_id", "left_idx", "right_idx") == [(1, 7, k, k) for k in range(3)]


def test_corpus_of_transcripts(spark):
    said = "the quick brown fox jumps over a lazy dog"
    heard = [(t, i, w, i * 1_000_000, i * 1_000_000 + 900_000, 0.8) for t, text in ((1, "well now " + said), (2, "nothing of it"), (3, said)) for i, w in enumerate(text.split())]
    transcripts = spark.createDataFrame(heard, HEARD.replace("track_id string", "left_id long"))
    items = spark.createDataFrame([(5, 0, said, 0, 1), (6, 0, "of it", 0, 1)], LINES.replace("track_id string", "right_id long"))
    _, words = R.reconcile_corpus(transcripts, items)
    first = words.filter(F.col("word_idx") == 0)
    assert rows(first, "track_id", "start_us", "source") == [("1:5", 2_000_000, "asr"), ("2:6", 1_000_000, "asr"), ("3:5", 0, "asr")]


def test_long_alignment_takes_little_memory():
    rng = random.Random(9)
    a = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000)]
    b = [w for w in a if rng.random() < 0.9]
    tracemalloc.start()
    got = AL.align_tokens(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, _, _ in got if i >= 0] == list(range(3000)) and [j for _, j, _ in got if j >= 0] == list(range(len(b)))
    assert sum(s for _, _, s in got) > 0.85 * len(a) and peak < 60 << 20


def test_folded_words_match_the_rule(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aZ09'`’-_ .é\tßÉ日ﬁ\x00\x1fΣς\xad\xa0‐") for _ in range(rng.randint(0, 6))) for _ in range(5000)] + [None, ""]
    lists = [words[i : i + 7] for i in range(0, len(words), 7)] + [None, [], [None], ["é"]]
    for begin, end in ((0, None), (3, 50), (5, 5)):
        got = X.fold_words.func(pa.array(lists, pa.list_(pa.string()))[begin:end]).to_pylist()
        assert got == [[None if t is None else X.fold_text(t) for t in r or []] for r in lists[begin:end]]
    df = spark.createDataFrame([(t,) for t in words], "t string")
    same = df.select(X.norm_match("t").alias("a"), F.get(X.fold_words(F.array("t")), F.lit(0)).alias("b"))
    assert all(r.a == r.b for r in same.collect())


def test_transcripts_are_read_once_while_pairs_are_looked_for(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def seen(tokens):
        read.add(1)
        return tokens

    left = spark.createDataFrame([(k, f"a b c d e f g {k}".split()) for k in range(20)], "left_id long, tokens array<string>")
    left = left.select("left_id", seen("tokens").alias("tokens"))
    right = spark.createDataFrame([(1, "b c d e f".split()), (2, "x y".split())], "right_id long, tokens array<string>")
    for most in (R.MOST_SENT, 0):
        monkeypatch.setattr(R, "MOST_SENT", most)
        before = read.value
        assert sorted(map(tuple, R.containing_pairs(left, right).collect())) == [(k, 1, 1) for k in range(20)]
        assert read.value - before <= 40  # a filter and the list itself
