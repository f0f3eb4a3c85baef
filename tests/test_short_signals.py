"""Rhythm of short tracks: one formula at every length, and files of all kinds in one folder."""

from conftest import rows
from cuestream.operators import rhythm as RH
from cuestream.sources import timed_text as TT


def onsets(spark, lengths):
    data = [(t, f, 1.0 if f % 5 == 0 else 0.0) for t, n in lengths.items() for f in range(n)]
    return spark.createDataFrame(data, "track_id long, frame long, onset double")


def test_short_tracks_are_scaled_like_long_ones(spark):
    out = RH.prepare_onsets(onsets(spark, {1: 5, 2: 7, 3: 9, 4: 300}))
    top = {r.track_id: r.m for r in out.groupBy("track_id").agg({"x": "max"}).toDF("track_id", "m").collect()}
    assert all(abs(v - 1) < 1e-9 for v in top.values()) and len(top) == 4
    assert out.filter("x <> 0 and smooth = 0").count() == 0


def test_tempo_of_short_tracks_is_the_same_and_less_sure(spark):
    frame_us = 100_000
    got = {r.track_id: r for r in RH.estimate_tempo(RH.prepare_onsets(onsets(spark, {1: 4, 2: 30, 3: 60, 4: 640})), frame_us).collect()}
    assert got[1].bpm == 0 and got[1].confidence == 0
    assert got[2].bpm == got[3].bpm == got[4].bpm == 120.0
    assert 0 < got[2].confidence < got[3].confidence < got[4].confidence


def test_every_file_of_a_folder_has_a_row(spark):
    project = '{"kind":"' + TT.PROJECT_KIND + '","project":{}}'
    files = [("a.lrc", "[00:01.00]x\n[00:02.00]y"), ("b.txt", "one\ntwo"), ("c.json", project), ("d.txt", project), ("e.txt", ""), ("f.vtt", "WEBVTT\n")]
    out = TT.import_files(spark.createDataFrame(files, "file string, contents string"))
    assert rows(out, "file", "format", "n_cues", "has_timings", "coverage") == [
        ("a.lrc", "lrc", 2, True, 1.0), ("b.txt", "txt", 2, False, 0.0), ("c.json", "project", 0, False, 0.0),
        ("d.txt", "project", 0, False, 0.0), ("e.txt", "txt", 0, False, 0.0), ("f.vtt", "vtt", 0, False, 0.0),
    ]
