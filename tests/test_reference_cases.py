"""Small cases with known results, and properties every timing output must have."""

import hashlib
import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from cuestream.functions import text as X
from cuestream.functions import timecode as C
from cuestream.operators import align as AL
from cuestream.operators import assets as AS
from cuestream.operators import estimate as E
from cuestream.operators import history as H
from cuestream.operators import matching as M
from cuestream.operators import mixing as MX
from cuestream.operators import ordered as O
from cuestream.operators import peaks as PK
from cuestream.operators import postprocess as P
from cuestream.operators import rhythm as RH
from cuestream.operators import script as S
from cuestream.operators import sections as SE
from cuestream.operators import taps as TP
from cuestream.sinks import subtitles as SK
from cuestream.sources import audio as AU
from cuestream.sources import recogniser as R
from cuestream.sources import timed_text as TT
from cuestream.streaming import metrics as ME


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, contents string")


def test_lrc(spark):
    body = "[ti:Song]\n[ar:Artist]\n[offset:200]\n[00:01.00]First line\n[00:05.50][00:20.00]Chorus line"
    cues = TT.parse_lrc(files(spark, body))
    assert [r.start_us for r in cues.orderBy("cue_seq").collect()] == [1_000_000, 5_500_000, 20_000_000]
    meta = TT.lrc_meta(files(spark, body)).first()
    assert (meta.title, meta.artist, meta.offset_us) == ("Song", "Artist", -200_000)
    shifted = TT.parse_lrc(files(spark, body), apply_offset=True)
    assert [r.start_us for r in shifted.orderBy("cue_seq").collect()] == [800_000, 5_300_000, 19_800_000]


def test_enhanced_lrc(spark):
    words = TT.parse_lrc(files(spark, "[00:02.00]<00:02.00>Hello <00:02.40>world <00:02.90>again")).first().words
    assert [w.text for w in words] == ["Hello", "world", "again"]
    assert words[1].start_us == 2_400_000 and words[0].end_us == 2_400_000 and words[2].end_us == 2_900_000


def test_srt_and_vtt(spark):
    srt = "1\n00:00:01,000 --> 00:00:04,000\nOne\n\n2\n00:00:05,000 --> 00:00:07,500\nTwo <i>x</i>\n\nnothing here"
    cues = TT.parse_srt_vtt(files(spark, srt), "srt").orderBy("cue_seq").collect()
    assert cues[0].start_us == 1_000_000 and cues[1].end_us == 7_500_000 and cues[1].text == "Two x"
    assert TT.skipped_blocks(files(spark, srt), "srt").first().n_skipped == 1
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<00:00:01.000>Hello <00:00:01.500>world"
    cue = TT.parse_srt_vtt(files(spark, vtt), "vtt").first()
    assert cue.text == "Hello world" and len(cue.words) == 2 and cue.words[1].end_us == cue.words[1].start_us


def test_ass_keeps_commas(spark):
    body = "[Script Info]\nTitle: T\n[Events]\nDialogue: 0,0:00:01.00,0:00:05.00,Default,,0,0,0,,{\\kf50}Hel{\\kf50}lo {\\kf100}world, all\nDialogue: bad"
    cue = TT.parse_ass(files(spark, body)).first()
    assert cue.text == "Hello world, all" and cue.words[0].end_us == 1_500_000
    assert TT.malformed_dialogue(files(spark, body)).first().n_warnings == 1
    assert TT.ass_meta(files(spark, body)).first().title == "T"


def test_unit_inference_and_lying_extension(spark):
    bodies = [f'[{{"text":"a","start":{t}}}]' for t in (1, 65_000, 65_000_000)]
    got = [r.start_us for r in TT.parse_json(files(spark, *bodies)).orderBy("file").collect()]
    assert got == [1_000_000, 65_000_000, 65_000_000]
    heads = ["WEBVTT\n", "[00:01.00]x", "[Script Info]\n", "plain words"]
    df = spark.createDataFrame([("notes.txt", h) for h in heads], "n string, c string")
    assert [r.f for r in df.select(TT.detect_format(F.col("n"), F.col("c")).alias("f")).collect()] == ["vtt", "lrc", "ass", "txt"]
    junk = files(spark, "\x00\x01", "{broken", "][")
    assert TT.parse_json(junk).count() == 0 and TT.parse_lrc(junk).count() == 0


def test_all_formats_in_one_job(spark):
    df = spark.createDataFrame(
        [("a.lrc", "[00:01.00]x"), ("b.srt", "1\n00:00:01,000 --> 00:00:02,000\ny"), ("c.txt", "z\n\nq"), ("d.json", '{"lines":[{"text":"j"}]}')],
        "file string, contents string",
    )
    cues = TT.parse_timed_text(df)
    assert rows(cues, "file", "text") == [("a.lrc", "x"), ("b.srt", "y"), ("c.txt", "q"), ("c.txt", "z"), ("d.json", "j")]
    report = {r.file: r.coverage for r in TT.import_report(cues).collect()}
    assert report == {"a.lrc": 1.0, "b.srt": 1.0, "c.txt": 0.0, "d.json": 0.0}


def test_recogniser_segments(spark):
    seg = spark.createDataFrame([(1, 0, "  one  two ", 1250.0, 2340.0), (1, 1, "three", 3000.0, 4500.0), (1, 2, "late", 4000.0, 5000.0), (1, 3, " ", 0.0, 1.0)],
        "track_id long, seg_idx long, text string, t0_ms double, t1_ms double")
    cues = R.segments_to_cues(seg, spark.createDataFrame([(1, 4_000_000)], "track_id long, duration_us long"))
    assert rows(cues, "text", "start_us", "end_us") == [("one two", 1_250_000, 2_340_000), ("three", 3_000_000, 4_000_000)]
    both = R.with_untimed_fallback(cues, spark.createDataFrame([(1, "x", 5), (2, " all ", 9)], "track_id long, text string, duration_us long"))
    assert rows(both.filter("track_id = 2"), "text", "start_us", "end_us") == [("all", 0, 9)]


def small_cues(spark):
    data = [(1, f"c{i}", s * 1000, e * 1000) for i, (s, e) in enumerate([(0, 200), (1000, 1200), (2000, 2300), (9000, 9400)])]
    return spark.createDataFrame(data, "track_id long, cue_id string, start_us long, end_us long")


def test_post_process_is_ordered_and_idempotent(spark):
    once = P.post_process(small_cues(spark), duration=F.lit(12_000_000))
    got = rows(once, "start_us", "end_us")
    assert all(a[1] <= b[0] for a, b in zip(sorted(got), sorted(got)[1:], strict=False)) and all(e - s >= 600_000 for s, e in got)
    assert rows(P.post_process(once, duration=F.lit(12_000_000)), "start_us", "end_us") == got
    tracks = spark.createDataFrame([(1, 12_000_000), (2, 3_000_000)], "track_id long, duration_us long")
    idle = rows(P.idle_regions(small_cues(spark), tracks, 2_000_000), "track_id", "start_us", "end_us")
    assert (1, 2_300_000, 9_000_000) in idle and (2, 0, 3_000_000) in idle


def test_nested_words_follow_their_cue(spark):
    words = "array<struct<text:string,start_us:bigint,end_us:bigint>>"
    cue = spark.createDataFrame([(1, "a", 1000, 1400, [("x", 1000, 1200), ("y", 1200, 1400)])], f"track_id long, cue_id string, start_us long, end_us long, words {words}")
    got = P.enforce_minimum_duration(cue, 800).first()
    assert got.end_us == 1800 and [(w.start_us, w.end_us) for w in got.words] == [(1000, 1400), (1400, 1800)]
    got = P.clamp_timings(cue, F.lit(1300)).first()
    assert [(w.start_us, w.end_us) for w in got.words] == [(1000, 1200), (1200, 1300)]
    got = P.apply_lead_in(cue, 100, hot=False).first()
    assert got.start_us == 900 and got.words[0].start_us == 900


def test_beat_snap(spark):
    beats = spark.createDataFrame([(1, b * 1000) for b in (0, 500, 1000, 1500)], "track_id long, beat_us long")
    def snapped(at, tol):
        words = spark.createDataFrame([(1, 1, 0, at * 1000, at * 1000 + 50_000)], "track_id long, cue_id long, word_idx long, start_us long, end_us long")
        return P.snap_words_to_beats(words, beats, tol * 1000).first().start_us
    assert snapped(90, 100) == 0 and snapped(300, 50) == 300_000 and snapped(250, 300) == 0


def test_taps(spark):
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(3)], "track_id long, seq long, text string")
    taps = spark.createDataFrame([(1, 0, 1_000_000), (1, 1, 3_000_000), (1, 2, 6_000_000)], "track_id long, line_index long, time_us long")
    got = TP.apply_taps(lines, taps).orderBy("seq").collect()
    assert [r.start_us for r in got] == [1_000_000, 3_000_000, 6_000_000] and got[0].end_us == 2_850_000
    assert {r.source for r in got} == {"tap"} and {r.confidence for r in got} == {1.0}
    assert TP.tap_progress(lines, taps).first().progress == 1.0
    late = spark.createDataFrame([(1, i, i * 1_000_000 + 80_000) for i in range(8)], "track_id long, tap_id long, time_us long")
    grid = spark.createDataFrame([(1, i * 500_000) for i in range(20)], "track_id long, beat_us long")
    assert abs(TP.suggest_compensation(late, grid).first().compensation_us - 80_000) <= 50_000


def test_tap_log_fold_against_all_commands(spark):
    log = [("TAP", 1_000_000), ("TAP", 1_010_000), ("TAP", 3_000_000), ("UNDO", 0), ("TAP", 5_000_000), ("REDO_LAST_TAP", 6_000_000)]
    df = spark.createDataFrame([(1, i, k, t, 0, 0) for i, (k, t) in enumerate(log)], "track_id long, seq long, type string, time_us long, line_index long, amount long")
    counts = spark.createDataFrame([(1, 9)], "track_id long, n_lines long")
    assert rows(O.fold_tap_log(df, counts), "line_index", "time_us") == [(0, 1_000_000), (1, 6_000_000)]
    rng = np.random.default_rng(5)
    kinds = ["TAP", "TAP", "TAP", "UNDO", "NUDGE", "SET_COMPENSATION", "SET_GAP", "REDO_LAST_TAP", "RESET"]
    data = [(int(t), i, kinds[rng.integers(9)], int(i * 60_000 + rng.integers(90_000)), int(rng.integers(5)), int(rng.integers(9_000))) for t in (1, 2) for i in range(300)]
    df = spark.createDataFrame(data, df.schema)
    counts = spark.createDataFrame([(1, 12), (2, 500)], counts.schema)
    want = []
    for track, n in ((1, 12), (2, 500)):
        state = O.TapState(n)
        for row in data:
            if row[0] == track:
                state.apply(*row[2:])
        want += [(track, line, at, state.compensation, state.gap) for line, at, _ in state.taps]
    assert rows(O.fold_tap_log(df, counts), "track_id", "line_index", "time_us", "compensation_us", "gap_us") == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))


def test_undo_replay(spark):
    ops = ["do", "do", "undo", "redo", "undo", "do", "do", "undo", "undo", "redo"]
    df = spark.createDataFrame([(1, i, op) for i, op in enumerate(ops)], "track_id long, seq long, op string")
    assert rows(H.replay_history(df), "seq", "undoable") == [(0, True), (5, True)]
    many = spark.createDataFrame([(1, i, "do") for i in range(25)], df.schema)
    assert sum(1 for r in H.replay_history(many, limit=10).collect() if r.undoable) == 10 and H.replay_history(many, limit=10).count() == 25


def brute_alignment(a, b):
    def sim(x, y):
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        longest = max(len(x), len(y))
        d = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            prev, d[0] = d[0], i
            for j, cy in enumerate(y, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (cx != cy))
        return max(0.0, 1 - d[-1] / longest)

    n, m = len(a), len(b)
    f = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                s = sim(a[i - 1], b[j - 1])
                f[i][j] = max(f[i - 1][j - 1] + (2 * s if s >= 0.5 else 2 * s - 2 * (1 - s)), f[i - 1][j] - 1, f[i][j - 1] - 1)
            else:
                f[i][j] = -float(i + j)
    return f[n][m], sim


def test_debounce_treats_null_keys_alike_in_both_plans(spark):
    from cuestream.operators.debounce import debounce

    data = [(k, t, i) for i, (k, t) in enumerate([(None, 0), (None, 5), (None, 40), (1, 0), (1, 9), (1, 25), (None, 44)])]
    df = spark.createDataFrame(data, "k long, t long, i long")
    plans = [sorted(r.i for r in debounce(df, ["k"], "t", "i", 10, hot=hot).collect()) for hot in (False, True)]
    assert plans[0] == plans[1] == [0, 2, 3, 5]


def test_alignment(spark):
    got = AL.align_tokens("hello world again".split(), "helo wrold again".split())
    assert [(i, j) for i, j, _ in got] == [(0, 0), (1, 1), (2, 2)] and sum(s for *_, s in got) / 3 > 0.7
    assert AL.align_tokens([], ["a"]) == [(-1, 0, 0.0)]
    rng = np.random.default_rng(1)
    vocab = ["la", "lala", "love", "glove", "moon", "spoon", "x" * 26, "x" * 20 + "night" * 2, "", "night"]
    for _ in range(60):
        a, b = ([vocab[k] for k in rng.integers(10, size=rng.integers(1, 9))] for _ in range(2))
        best, sim = brute_alignment(a, b)
        pairs = AL.align_tokens(a, b)
        cost = 0.0
        for i, j, s in pairs:
            if i >= 0 and j >= 0:
                assert math.isclose(s, sim(a[i], b[j]), abs_tol=1e-9)
                cost += 2 * s if s >= 0.5 else 2 * s - 2 * (1 - s)
            else:
                cost -= 1
        assert math.isclose(cost, best, abs_tol=1e-9)
        assert [i for i, *_ in pairs if i >= 0] == list(range(len(a))) and [j for _, j, _ in pairs if j >= 0] == list(range(len(b)))


def test_anchor_choice_against_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(30):
        times = np.sort(rng.integers(0, 6_000_000, size=7))
        power = rng.random(7)
        expected = rng.integers(400_000, 2_000_000, size=3).astype(float)
        def score(pick):
            total = 2 * power[pick[0]]
            for i in range(1, 3):
                gap = times[pick[i]] - times[pick[i - 1]]
                if gap < 380_000:
                    return -math.inf
                total += 2 * power[pick[i]] - min(3.0, abs(gap - expected[i - 1]) / expected[i - 1])
            return total
        best = max(combinations(range(7), 3), key=score)
        got = O.choose_anchors(times, power, expected)
        assert (got == [] and score(best) == -math.inf) or math.isclose(score(got), score(best))


def test_anchor_choice_of_a_long_track(spark):
    rng = np.random.default_rng(4)
    n, k = 300, 700
    times = np.cumsum(rng.integers(350_000, 900_000, size=k))
    power = rng.random(k).round(6)
    power[:300] /= 8  # the strongest are all at the end
    expected = rng.integers(400_000, 2_000_000, size=n).astype(float)
    score = power * 2
    for e in expected[:-1]:  # every pair of anchors
        gap = (times[None, :] - times[:, None]).astype(float)
        cost = np.minimum(3.0, np.abs(gap - e) / e)
        score = np.where(gap >= 380_000, score[:, None] + 2 * power[None, :] - cost, -np.inf).max(axis=0)
    got = O.choose_anchors(times, power, expected)
    gaps = np.diff(times[got])
    assert len(got) == n and (gaps >= 380_000).all()
    assert math.isclose(2 * power[got].sum() - np.minimum(3.0, np.abs(gaps - expected[:-1]) / expected[:-1]).sum(), score.max())
    anchors = spark.createDataFrame([(1, i, int(t), float(p)) for i, (t, p) in enumerate(zip(times, power))], "track_id long, frame long, time_us long, strength double")
    lines = spark.createDataFrame([(1, i, "word " * int(1 + i % 5)) for i in range(n)], "track_id long, seq long, sig string")
    tracks = spark.createDataFrame([(1, int(times[-1]) + 1_000_000)], "track_id long, duration_us long")
    placed = O.align_lines_to_onsets(lines, anchors, tracks).collect()
    assert len(placed) == n and {r.start_us for r in placed} & set(times[:300].tolist())


def pcm(spark, x, size=512, track=1):
    data = [(track, i, len(x), 22_050, [float(v) for v in x[i * size : (i + 1) * size]]) for i in range(-(-len(x) // size))]
    return spark.createDataFrame(data, "track_id long, chunk_idx long, n_samples long, sample_rate long, samples array<float>")


@pytest.mark.parametrize(("bpm", "seconds"), [(120, 8), (90, 10)])
def test_click_track_tempo(spark, bpm, seconds):
    rate, x = 22_050, np.zeros(22_050 * seconds)
    for beat in np.arange(0, seconds, 60 / bpm):
        at = int(beat * rate)
        n = min(400, len(x) - at)
        x[at : at + n] += np.sin(2 * np.pi * 1000 * np.arange(n) / rate) * np.exp(-np.arange(n) / 80)
    spectrum = AU.spectrum_rows(AU.mel_frames(pcm(spark, x)))
    frame_us = round(512 / rate * 1e6)
    onsets = RH.onset_envelope(spectrum)
    tempo = RH.estimate_tempo(RH.prepare_onsets(onsets), frame_us)
    assert abs(tempo.first().bpm - bpm) <= 4
    grid = RH.beat_grid(onsets, tempo, frame_us)
    beats = [r.beat_us for r in RH.beats(grid).orderBy("beat_idx").collect()]
    assert len(beats) >= seconds * bpm / 60 - 2 and len(set(np.diff(beats))) == 1


def test_silence_has_no_tempo(spark):
    spectrum = AU.spectrum_rows(AU.mel_frames(pcm(spark, np.zeros(22_050 * 4))))
    tempo = RH.estimate_tempo(RH.prepare_onsets(RH.onset_envelope(spectrum)), 23_220)
    assert tempo.first().bpm == 0 and RH.beat_grid(RH.onset_envelope(spectrum), tempo, 23_220).count() == 0


def test_pure_tone_lands_in_its_band():
    rate = 22_050
    frame = np.sin(2 * np.pi * 1000 * np.arange(1024) / rate)[None, :]
    edges = AU.mel_edges(rate)
    loudest = int(AU.frame_bands(frame, rate)[0].argmax())
    assert edges[loudest] <= 1000 / (rate / 1024) + 1 and 1000 / (rate / 1024) - 1 <= edges[loudest + 1]


def test_peaks_of_a_sine(spark):
    x = 0.5 * np.sin(2 * np.pi * 100 * np.arange(8000) / 8000)
    chunks = pcm(spark, x)
    got = PK.peaks_from_chunks(chunks, 400, 512)
    assert got.count() == 20 and got.agg(F.max("max")).first()[0] > 0.45 and got.agg(F.min("min")).first()[0] < -0.45
    long = chunks.select("track_id", (F.col("chunk_idx") * 512).alias("b"), F.posexplode("samples").alias("i", "value"))
    flat = PK.compute_peaks(long.select("track_id", (F.col("b") + F.col("i")).alias("frame"), F.col("value").cast("double").alias("value")), 400)
    key = [F.round(c, 6).alias(c) for c in ("min", "max", "rms")]
    assert rows(got.select("bucket", *key), "bucket", "min", "max", "rms") == rows(flat.select("bucket", *key), "bucket", "min", "max", "rms")


def wav_bytes(x, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scale = 2 ** (8 * width - 1) - 1
        whole = np.round(np.asarray(x) * scale).astype(np.int64)
        raw = b"".join(int(v + 128 if width == 1 else v).to_bytes(width, "little", signed=width > 1) for v in whole.ravel())
        w.writeframes(raw)
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_depths(spark, width):
    x = np.stack([np.linspace(-0.9, 0.9, 1200), np.linspace(0.9, -0.9, 1200) * 0.5], axis=1)
    df = spark.createDataFrame([("a", bytearray(wav_bytes(x, width=width, channels=2))), ("b", bytearray(b"RIFFnope"))], "track_id string, content binary")
    got = AU.wav_chunks(df)
    chunks = got.filter("track_id = 'a'").orderBy("chunk_idx").collect()
    mono = np.concatenate([c.samples for c in chunks])
    assert len(mono) == 1200 and [len(c.samples) for c in chunks] == [512, 512, 176]
    assert np.abs(mono - x.mean(axis=1)).max() < (0.02 if width == 1 else 0.001)
    assert got.filter("track_id = 'b'").first().error


def test_wav_reader_and_audit(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes(np.full(600, 0.25)))
    (tmp_path / "b.txt").write_text("words")
    (tmp_path / "c.mp3").write_bytes(b"")
    assert AU.read_wav(spark, str(tmp_path)).count() == 2
    verdicts = {r.path.rsplit("/", 1)[1]: r.verdict for r in AU.audit_files(spark, str(tmp_path)).collect()}
    # Spark's file scan leaves files of zero bytes out, so c.mp3 is not listed
    assert verdicts == {"a.wav": "ok", "b.txt": "AUDIO_UNSUPPORTED_FORMAT"}
    got = spark.createDataFrame([("c.mp3", 0)], "n string, s long").select(AU.intake_verdict(AU.file_kind(F.col("n"), F.lit("")), F.col("s")).alias("v"))
    assert got.first().v == "AUDIO_EMPTY"


def series(spark, values, track=1):
    return spark.createDataFrame([(track, i, float(v)) for i, v in enumerate(values)], "track_id long, frame long, value double")


def test_resample_constant(spark):
    n = spark.createDataFrame([(1, 4410)], "track_id long, n long")
    out = MX.resample(series(spark, [0.25] * 4410), n, 44_100.0, 16_000.0)
    assert out.count() == 1600 and out.filter(F.abs(F.col("value") - 0.25) > 1e-9).count() == 0


def test_mix(spark):
    got = MX.mix_voiceover(series(spark, [0.2] * 4), series(spark, [0.5] * 4), 4.0, 4.0, 500_000, 0.5, 0.5)
    assert [round(r.value, 6) for r in got.orderBy("frame").collect()] == [0.1, 0.1, 0.35, 0.35]
    longer = MX.mix_voiceover(series(spark, [0.2] * 4), series(spark, [0.5] * 8), 4.0, 4.0, 0, 1.0, 1.0, extend_to_us=2_000_000)
    assert [round(r.value, 6) for r in longer.orderBy("frame").collect()] == [0.7] * 4 + [0.5] * 4
    alone = MX.render_standalone(series(spark, [0.5] * 8000), 8000.0, 8000.0, 0, 1.0, 500_000, 1_500_000)
    assert alone.count() == 8000 and alone.filter("value = 0.5").count() == 4000


def test_sentences(spark):
    text = "Dr. Rivera launched v3.5 in 1.5 seconds. It renders Mr. Chen’s charts locally! Ready to ship?"
    got = one(spark, text, X.sentences)
    assert len(got) == 3 and "1.5 seconds." in got[0] and "Mr. Chen" in got[1] and got[2] == "Ready to ship?"
    assert one(spark, 'He said "Stop!" Then J. Doe left. e.g. this', X.sentences) == ['He said "Stop!"', "Then J. Doe left.", "e.g. this"]


def test_signature_parity_of_table_and_rule(spark):
    samples = ["Élan d’Été — Straße № 5", "ﬁne ½ cup", "ΑΒΓ Ünïcödé", "naïve café", "ｗｉｄｅ", "İstanbul", "a​b", "Ça va?! (oui)"]
    df = spark.createDataFrame([(s,) for s in samples], "x string").select("x", X.norm_match("x").alias("y"))
    assert all(r.y == X.fold_text(r.x) for r in df.collect())


def test_tokens_and_markers(spark):
    assert one(spark, "你好 world", X.highlight_tokens) == list("你好world")
    assert [(t.text, t.offset) for t in one(spark, "go  now", X.token_offsets)] == [("go", 0), ("now", 4)]
    assert one(spark, "[Chorus]", X.structural_tag) == "CHORUS" and one(spark, "plain", X.structural_tag) is None
    assert one(spark, "(Music)", lambda c: X.is_instrumental(X.norm_match(c))) and not one(spark, "love", lambda c: X.is_instrumental(X.norm_match(c)))
    got = one(spark, "Hello (hello!)", X.split_ad_lib)
    assert (got.main, got.ad_lib) == ("Hello", "hello!")


def test_sections(spark):
    text = ["[Verse]", "one line", "sing it", "[Chorus]", "sing it", "other words", "(instrumental)", "instrumental", "end words"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "track_id long, seq long, text string")
    got = {r.seq: (r.kind, r.section_no) for r in SE.infer_sections(df).collect()}
    assert got[1] == ("VERSE", 1) and got[2] == ("CHORUS", 2) and got[4] == ("CHORUS", 3)
    assert got[5] == ("VERSE", 4) and got[6] == ("INSTRUMENTAL", 5) and got[8][0] == "INSTRUMENTAL"
    labels = [r.label for r in SE.list_sections(SE.infer_sections(df)).orderBy("section_no").collect()]
    assert labels == ["Verse", "Chorus", "Chorus 2", "Verse 2", "Instrumental"]


def test_script_blocks(spark):
    script = (
        "# Title here\nsub\n\n[stat: 42%] of people\n\nKey things:\n- a\n- b\n\n> Quote me\n— Someone\n\n"
        "Look:\n```py\nx = 1\n\ny = 2\n```\n\nA: Hello there. How are you?\nB: Fine."
    )
    df = spark.createDataFrame([(1, script)], "track_id long, text string")
    scenes = S.script_scenes(df).orderBy("seq").collect()
    assert [s.layout for s in scenes] == ["title", "stat", "bullets", "quote", "code", None, None, None]
    assert scenes[0].text == "Title here" and scenes[0].subtext == "sub" and scenes[1].value == "42%"
    assert scenes[2].items == ["a", "b"] and scenes[3].subtext == "Someone" and scenes[4].items == ["x = 1", "", "y = 2"] and scenes[4].kicker == "py"
    assert [(s.speaker, s.text) for s in scenes[5:]] == [("A", "Hello there."), ("A", "How are you?"), ("B", "Fine.")]
    modes = {m: S.script_scenes(df, m).filter("layout is null").count() for m in ("sentences", "lines", "paragraphs")}
    assert modes == {"sentences": 3, "lines": 2, "paragraphs": 1}


def test_measured_cues(spark):
    lines = spark.createDataFrame([(1, 0, "a", 0, 0), (1, 1, "b", 0, 0), (1, 2, "c", 0, 0)], "track_id long, seq long, cue_id string, start_us long, end_us long")
    cues = spark.createDataFrame([(1, "a", 0, 1_420_000), (1, "b", 3_220_000, 4_600_000)], "track_id long, cue_id string, start_us long, end_us long")
    got = rows(E.apply_measured_cues(lines, cues), "seq", "start_us", "end_us")
    assert got == [(0, 0, 1_420_000), (1, 3_220_000, 4_600_000), (2, 4_900_000, 6_100_000)]


def test_signature_sensitivity(spark):
    def sign(*rows_):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows_)], "track_id long, seq long, cue_id string, spoken string, start_us long, end_us long")
        return AS.content_signature(df).first().signature
    base = sign(("a", "x", 0, 5), ("b", "y", 9, 12))
    assert base == sign(("a", "x", 0, 7), ("b", "y", 9, 99))
    assert base != sign(("a", "x", 1, 5), ("b", "y", 9, 12)) and base != sign(("b", "y", 9, 12), ("a", "x", 0, 5))


def test_bundle_id_has_one_rule_for_all_sizes(spark):
    def expected(n):
        buckets = {}
        for i in range(n):
            e = f"{i}\x1f{hashlib.sha256(str(i).encode()).hexdigest()}\x1f{i * 2}"
            buckets.setdefault(hashlib.sha256(e.encode()).hexdigest()[:3], []).append(e)
        hashes = [hashlib.sha256("\x1e".join(sorted(buckets[b])).encode()).hexdigest() for b in sorted(buckets)]
        return hashlib.sha256("\x1e".join(hashes).encode()).hexdigest()[:24]

    for n in (1, 40, 20_000):
        df = spark.range(n).select(F.lit("b").alias("bundle"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") * 2).alias("bytes"))
        for parts in (df.coalesce(1), df.repartition(7)):
            assert tuple(AS.bundle_id(parts).first()) == ("b", n, expected(n))


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([("f", bytearray(range(250)))], "file string, content binary")
    assert bytes(AS.reassemble(AS.split_into_chunks(df, 64)).first().content) == bytes(range(250))


def test_metric_batches(spark):
    good, bad = '{"event":"project_created"}', '{"event":"unknown"}'
    big = ",".join([good] * 21)
    df = spark.createDataFrame([(1, f'{{"events":[{good},{good},{bad}]}}'), (2, f'{{"events":[{big}]}}')], "batch_id long, raw_json string")
    assert rows(ME.batch_report(df), "batch_id", "accepted", "rejected", "n_entries", "invalid") == [(1, 2, 1, 3, None), (2, 21, 0, 21, None)]
    buckets = ["a@b.c", "a/b", "x://y", "0b0ccafe-beef", "a b", "a" * 33, "ok-1"]
    entries = spark.createDataFrame([(i, f'{{"event":"project_created","bucket":"{b}"}}') for i, b in enumerate(buckets)], "i long, raw_json string")
    assert [r.reason for r in ME.sanitise_entries(entries).orderBy("i").collect()] == ["bad_bucket"] * 6 + [None]


def test_sinks_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, i, f"line {i}", i * 2_000_000, i * 2_000_000 + 1_500_000) for i in range(5)], "track_id long, cue_id long, text string, start_us long, end_us long")
    for fmt, lines in (("srt", SK.srt_lines(SK.number_cues(cues))), ("lrc", SK.lrc_lines(cues)), ("vtt", SK.vtt_lines(SK.number_cues(cues)))):
        body = "\n".join(r.line for r in lines.orderBy("start_us").collect())
        body = "WEBVTT\n\n" + body if fmt == "vtt" else body
        df = files(spark, body)
        back = TT.parse_lrc(df) if fmt == "lrc" else TT.parse_srt_vtt(df, fmt)
        assert rows(back, "text", "start_us") == [(f"line {i}", i * 2_000_000) for i in range(5)]
    out = str(tmp_path / "out")
    SK.write_lines(SK.lrc_lines(cues), out)
    assert spark.read.text(out).count() == 5
    assert SK.ass_colour("#1af") == "&H00FFAA11" and SK.ass_colour("#12") == "&H00FFFFFF"


def test_merge_keeps_protected_lines(spark):
    cues = spark.createDataFrame([(1, 0, "Hello", 5, 6, "human", 1.0), (1, 1, "hello!", 7, 8, "estimate", 0.3), (1, 2, "bye", 9, 10, "estimate", 0.3)],
        "track_id long, seq long, text string, start_us long, end_us long, source string, confidence double")
    parsed = spark.createDataFrame([(1, 0, "HELLO", 100, None), (1, 1, "hello", 900, 950)], "track_id long, cue_seq long, text string, start_us long, end_us long")
    got = rows(M.merge_parsed_timings(cues, parsed), "seq", "start_us", "end_us", "source")
    assert got == [(0, 5, 6, "human"), (1, 100, 2_000_100, "align"), (2, 9, 10, "estimate")]
    nth = rows(M.merge_parsed_timings(cues, parsed, match="nth"), "seq", "start_us")
    assert nth == [(0, 5), (1, 900), (2, 9)]


def test_clock_and_frames(spark):
    got = spark.createDataFrame([("1:02:03.5",), ("02:61",), ("65:00",), ("00:01,25",)], "x string").select(C.parse_clock(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [3_723_500_000, None, None, 1_250_000]
    df = spark.createDataFrame([(1_000_000,)], "u long").select(C.frame_index(F.col("u")).alias("f"), C.snap_to_frame(F.col("u")).alias("s"))
    assert tuple(df.first()) == (30, 999_990)
