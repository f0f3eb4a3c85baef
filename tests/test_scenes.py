"""Scenes of scripts in one pass, and sentences with a look ahead for the dot."""

from pyspark.sql import functions as F

from cuestream.functions import text as X
from cuestream.operators import script as S


def test_blocks_are_classed_once(spark):
    scripts = spark.createDataFrame([(1, "# T\n\nA: hi. Yes!\nB: no")], "track_id int, text string")
    scenes = S.script_scenes(scripts)
    plan = scenes._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("posexplode") == 1 and plan.count("ArrowEvalPython") == 1
    got = [(r.seq, r.layout, r.speaker, r.text) for r in scenes.orderBy("seq").collect()]
    assert got == [(0, "title", None, "T"), (1, None, "A", "hi."), (2, None, "A", "Yes!"), (3, None, "B", "no")]


def test_sentences_around_abbreviations(spark):
    texts = ["Prof. X. went to st. Ives. Ok? e..g. this p.r.o.f. that etc.) end. Jr.. b", "nofig. Fig. 3 is..no. 4 (vs. J.) done! x", "a. b é. c"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.sentences(F.col("t")).alias("s")).collect()]
    assert got == [
        ["Prof. X. went to st. Ives.", "Ok?", "e..g. this p.r.o.f. that etc.) end.", "Jr.. b"],
        ["nofig.", "Fig. 3 is..no.", "4 (vs. J.) done!", "x"],
        ["a.", "b é.", "c"],
    ]
