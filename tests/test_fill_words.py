"""Words spread between matched ones, inside the cell of their cue."""

from cuestream import catalog
from cuestream.operators import ordered as O

WORDS = "track_id int, cue_id int, word_idx long, start_us long, end_us long, source string, confidence double"


def test_words_of_a_cell_are_not_shuffled(spark, sf_dir):
    catalog.load()
    plan = catalog.QUERIES["seq05_fill_unmatched_words"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Sort " not in plan


def test_runs_between_matched_words(spark):
    rows = [
        (1, 1, 0, 0, 0, "estimate", 0.1), (1, 1, 1, 20, 30, "asr", 0.9), (1, 1, 2, 0, 0, "estimate", 0.1), (1, 1, 3, 0, 0, "estimate", 0.1),
        (1, 1, 4, None, None, "human", 1.0), (1, 1, 5, 0, 0, "estimate", 0.1), (1, 1, 6, 70, 60, "asr", 0.8), (1, 1, 7, 0, 0, "estimate", 0.1),
        (1, 2, 0, 0, 0, "estimate", 0.1), (1, 2, 1, 0, 0, None, 0.1), (1, 2, 2, 0, 0, "estimate", 0.1),
        (1, 3, 0, 5, 6, "asr", 0.5), (1, 3, 1, 0, 0, "estimate", 0.1),
    ]
    words = spark.createDataFrame(rows[::-1], WORDS)
    cues = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 10, 21), (2, 1, 0, 9)], "track_id int, cue_id int, start_us long, end_us long")
    got = sorted((r.cue_id, r.word_idx, r.start_us, r.end_us, r.confidence) for r in O.fill_unmatched_words(words, cues).collect())
    assert got == [
        (1, 0, 0, 20, 0.3), (1, 1, 20, 30, 0.9), (1, 2, 30, 50, 0.3), (1, 3, 50, 70, 0.3), (1, 4, None, None, 1.0), (1, 5, 30, 70, 0.3),
        (1, 6, 70, 60, 0.8), (1, 7, 60, 100, 0.3), (2, 0, 10, 16, 0.3), (2, 2, 16, 21, 0.3), (3, 0, 5, 6, 0.5),
    ]
