"""Speech in tracks of probabilities, the second embedding, word times, joins and state of streams."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoq.sources import audio
from convoq.streaming import sessions


def plain_speech(p, on, off, quiet, short, long):
    """The same by a walk over frames."""
    out, start, below = [], None, 0
    for i, x in enumerate([*p, *[-1.0] * (quiet + 1)]):
        if start is None:
            if i < len(p) and x >= on:
                start, below = i, 0
        elif x >= off:
            below = 0
        else:
            below += 1
            if below >= quiet:
                out.append((start, i - below + 1))
                start = None
    done = []
    for s, e in out:
        while e - s > long:
            cut = min(range(s + short, s + long + 1), key=lambda i: (p[i], -i))
            done.append((s, cut))
            s = cut
        done.append((s, e))
    return [(s * 10, e * 10) for s, e in done if e - s >= short]


def test_speech_of_tracks_is_that_of_a_walk(spark):
    rng = random.Random(1)
    tracks = []
    for _ in range(150):
        x, p = 0.2, []
        for _ in range(rng.choice([0, 1, 30, 400])):
            x = min(1, max(0, x + rng.uniform(-0.15, 0.15)))
            p.append(round(float(x), 2))
        tracks.append(p)
    for on, off, silence, speech, most in ((0.5, 0.35, 50, 100, 300), (0.1, None, 30, 40, 3000), (0.4, 0.4, 10, 10, 60)):
        low = max(on - 0.15, 0.01) if off is None else off
        for p in tracks:
            got = audio.speech_of_track(np.array(p), 10, on, off, speech, silence, most)
            assert got == plain_speech(p, on, low, silence // 10, speech // 10, most // 10), p
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(tracks)] + [("none", None)], "meeting_id string, track array<double>")
    got = audio.speech_of_tracks(df, on=0.5, most=300).collect()
    assert {(r.meeting_id, r.start_ms, r.end_ms) for r in got} == {(str(i), *x) for i, p in enumerate(tracks) for x in audio.speech_of_track(np.array(p), on=0.5, most=300)}


def test_loudness_is_a_track():
    x = np.random.default_rng(0).normal(0, 0.001, 32_000)
    x[8_000:16_000] += np.sin(np.arange(8_000) * 0.3)
    p = audio.loudness_track(x)
    assert len(p) == 200 and (p[50:100] > 0.9).all() and (p[:50] < 0.5).all() and len(audio.loudness_track(x[:10])) == 0
    (s, e), = audio.speech_of_track(p, on=0.5)
    assert abs(s - 500) <= 10 and abs(e - 1000) <= 10


def test_second_embedding():
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000).astype(np.float32)
    v = audio.embed_frames(x)
    assert v.shape == (32,) or v.ndim == 1
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-5) and np.array_equal(v, audio.embed_frames(x))
    assert np.allclose(v, audio.embed_frames(7 * x), atol=1e-4)  # loudness does not matter
    short = x[:6_000]
    mirrored = np.pad(short, (1_000, 1_000), mode="reflect")
    assert np.allclose(audio.embed_frames(short, crops=1), audio.embed_frames(mirrored, crops=1), atol=1e-6)
    for n in (0, 1, 5, 3_000):  # too short to be mirrored: silence
        assert np.isfinite(audio.embed_frames(x[:n])).all() and len(audio.embed_frames(x[:n])) == len(v)
    low, high = (np.sin(np.arange(16_000) * w) for w in (0.05, 2.0))
    assert audio.embed_frames(low) @ audio.embed_frames(high) < 0.9 < audio.embed_frames(low) @ audio.embed_frames(low[500:])


def spelled(path, blank=0):
    return [s for k, s in enumerate(path) if s != blank and (k == 0 or s != path[k - 1])]


def test_alignment_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    for frames, symbols in itertools.product((1, 2, 4, 6), ([], [1], [1, 1], [1, 2], [2, 1, 2], [1, 1, 2, 2])):
        p = np.log(rng.dirichlet(np.ones(3), frames))
        best = max((sum(p[t, s] for t, s in enumerate(path)) for path in itertools.product(range(3), repeat=frames) if spelled(path) == symbols), default=None)
        spans = audio.forced_alignment(p, symbols)
        if best is None:
            assert spans is None
            continue
        path = [0] * frames
        for s, (a, b) in zip(symbols, spans, strict=True):
            path[a : b + 1] = [s] * (b - a + 1)
        assert spelled(path) == symbols and sum(p[t, s] for t, s in enumerate(path)) == pytest.approx(best)


def test_words_get_times(spark):
    alphabet = ["_", " ", "a", "b", "c"]
    path = "__aab__ __cc_c_"
    p = [[math.log(0.9 if alphabet.index(x) == i else 0.025) for i in range(5)] for x in path]
    rows = [(1, 0, 1000, "ab cc", p), (1, 1, 0, "ab?! ?? c", p[:5]), (1, 2, 0, None, p), (1, 3, 0, "", p), (2, 0, 0, "abcabcabc", p[:3]), (2, 1, 0, "ab", [])]
    df = spark.createDataFrame(rows, "meeting_id long, chunk_idx long, start_ms long, text string, log_probs array<array<double>>")
    got = sorted(map(tuple, audio.word_times(df, alphabet, 20).collect()))
    assert got[:2] == [(1, 0, 0, "ab", 1040, 1100), (1, 0, 1, "cc", 1200, 1280)]
    assert [(r[1], r[3]) for r in got[2:]] == [(1, "ab?!"), (1, "c")] and all(r[0] == 1 for r in got)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def written(spark, rows, schema, path, name):
    import os

    df = spark.createDataFrame(rows, schema)
    folder = f"{path}-{name}"
    df.coalesce(1).write.parquet(folder)
    (file,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    os.makedirs(path, exist_ok=True)
    os.rename(f"{folder}/{file}", f"{path}/{name}.parquet")


def test_join_of_two_streams_and_late_rows(spark, tmp_path):
    ts = lambda s: F.timestamp_seconds(F.col(s) + 1_000)
    words, segments = "meeting_id long, word_idx long, t long", "meeting_id long, seq long, speaker string, s long, e long"
    written(spark, [(1, 0, 5), (1, 1, 15), (2, 2, 5)], words, tmp_path / "w", "a")
    written(spark, [(1, 0, "x", 0, 10), (1, 1, "y", 8, 20)], segments, tmp_path / "s", "a")
    w = stream_of(spark, tmp_path / "w", words).select("meeting_id", "word_idx", ts("t").alias("at"))
    s = stream_of(spark, tmp_path / "s", segments).select("meeting_id", "seq", "speaker", ts("s").alias("start"), ts("e").alias("end"))
    found = sessions.words_in_segments(w, s, longest="1 minute", late="1 minute")

    def run():
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.meeting_id, r.word_idx, r.seq) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}

    assert run() == {(1, 0, 0), (1, 1, 1)}
    written(spark, [(1, 3, 19), (1, 4, 100_000)], words, tmp_path / "w", "b")  # goes on from the checkpoint; then time moves far on
    written(spark, [(1, 2, "z", 99_990, 100_010)], segments, tmp_path / "s", "b")
    assert run() == {(1, 0, 0), (1, 1, 1), (1, 3, 1), (1, 4, 2)}
    written(spark, [(1, 5, 6)], words, tmp_path / "w", "c")  # too late: its segment is forgotten
    written(spark, [(1, 3, "z", 100_000, 100_001)], segments, tmp_path / "s", "c")
    assert run() == {(1, 0, 0), (1, 1, 1), (1, 3, 1), (1, 4, 2), (1, 4, 3)}


def test_chat_history_goes_on_and_expires(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "chat_id long, n long, question string, answer string, t long"
        (tmp_path / "t").mkdir()
        turns = stream_of(spark, tmp_path / "t", schema).withColumn("at", F.timestamp_seconds(F.col("t") + 1_000))
        found = sessions.chat_history(turns, keep=2, idle="10 minutes", late="0 seconds")

        def run(rows, name):
            written(spark, rows, schema, tmp_path / "t", name)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
            return {(r.chat_id, r.n): r.context for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}

        got = run([(1, 0, "q0", "a0", 0), (1, 1, "q1", "a1", 10), (2, 0, "p0", "b0", 20)], "a")
        assert got[1, 0] == "" and "q0" in got[1, 1] and got[2, 0] == ""
        got = run([(1, 2, "q2", "a2", 30), (1, 3, "q3", "a3", 40)], "b")  # a new query goes on from the checkpoint
        assert "q0" in got[1, 2] and "q1" in got[1, 2] and "q0" not in got[1, 3] and "q2" in got[1, 3]
        run([(2, 1, "p1", "b1", 5000)], "c")  # time moves on: the chats were idle
        got = run([(1, 4, "q4", "a4", 5010), (2, 2, "p2", "b2", 5020)], "d")
        assert got[1, 4] == "" and "p1" in got[2, 2]  # the timer of chat 1 fired; that of chat 2 was moved by its new turn
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
