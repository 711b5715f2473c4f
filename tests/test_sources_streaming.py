"""Files in and out, streams, and the library without its optional parts."""

import json
import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from convoq.sources import store, xml
from convoq.streaming import sessions

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_xml_files(spark, tmp_path):
    (tmp_path / "m1.A.words.xml").write_text('<r><w id="x.words0" starttime="0.5" endtime="0.9">Hi</w><w id="x.words1" starttime="0.9" endtime="1.0" punc="true">,</w><sil starttime="1" endtime="2"/><w id="x.words2">untimed</w><w id="x.words3" starttime="2" endtime="3">all</w></r>')
    (tmp_path / "m1.B.words.xml").write_text('<r><w id="y.words0" starttime="0.7" endtime="0.8">Yes</w></r>')
    f = xml.files(spark, str(tmp_path / "*.words.xml"))
    assert [(r.speaker, r.start, r.end, r.word) for r in xml.meeting_words(f).orderBy("place").collect()] == [("A", 0.5, 1.0, "Hi,"), ("B", 0.7, 0.8, "Yes"), ("A", 2.0, 3.0, "all")]
    assert xml.transcript(f).first().text == "Hi, untimed all Yes"
    (tmp_path / "m1.A.summ.xml").write_text("<s><sent>One.</sent><sent> </sent><sent>12</sent><sent>Two.</sent></s>")
    s = xml.files(spark, str(tmp_path / "*.summ.xml"))
    assert [r.text for r in xml.participant_summaries(s).orderBy("sent_idx").collect()] == ["One.", "Two."]
    assert xml.abstractive_summaries(s).first().text == "One. 12 Two."
    t = spark.createDataFrame([("m1", '<root><topic other_description="a"><child href="f.A.words.xml#id(f.A.words1)..id(f.A.words4)"/><topic other_description="b"/></topic><topic/><topic other_description="c"/></root>')], "meeting_id string, xml string")
    got = xml.topics(t).orderBy("topic_id").collect()
    assert [(r.description, r.speaker, r.first_id, r.last_id) for r in got] == [("a", "A", "f.A.words1", "f.A.words4"), ("b", None, None, None), ("c", None, None, None)]


def test_json_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('note: [{"start": "00:00:01", "end": "00:00:02", "speaker": "A", "text": "x"}, {"start": "00:00:03", "end": "00:00:04", "speaker": "B", "text": "y"}]')
    assert [(r.speaker, r.text) for r in store.transcripts(spark, str(tmp_path / "t.json")).collect()] == [("A", "x"), ("B", "y")]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "A", "info": [{"text": "t", "start": 1, "end": 2.5}], "summary": "s"}, {"id": "B", "info": ["plain"], "summary": "u"}, {"id": "C", "info": [], "summary": "v"}]))
    got = {r.id: (r.text, r.start, r.end) for r in store.speaker_summaries(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"A": ("t", 1.0, 2.5), "B": ("plain", None, None), "C": (None, None, None)}
    (tmp_path / "o.json").write_text(json.dumps([{"topic_id": 0, "summary": "s", "evidence": [{"speaker": "A", "text": str(i), "start": i, "end": i} for i in range(8)]}]))
    assert len(store.topic_summaries(spark, str(tmp_path / "o.json")).first().evidence) == 5
    df = spark.createDataFrame([(1, "a"), (2, "b")], "meeting_id long, text string")
    store.write_json(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("meeting_id", "text").collect())) == [(1, "a"), (2, "b")]


def test_vector_store_keeps_what_is_there(spark, tmp_path):
    p = spark.createDataFrame([("a b.json", 1, [1.0]), ("a b.json", 2, [2.0])], "file string, id long, vector array<double>")
    path = str(tmp_path / "vectors")
    assert store.upsert_vectors(p, path).count() == 2
    more = store.upsert_vectors(p.union(spark.createDataFrame([("c", 3, [3.0])], p.schema)), path)
    assert sorted((r.collection, r.id) for r in more.collect()) == [("db_a_b_json", 1), ("db_a_b_json", 2), ("db_c", 3)]


def test_config_and_dataset_rows(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# top\npaths:\n  audio: in/x.wav\n  deep:\n    k: '3'\nname: y\n")
    c = store.Config.from_yaml(spark, str(tmp_path / "c.yaml"))
    assert c.get("paths", "audio") == "in/x.wav" and c.get("paths", "deep", "k") == "3" and c.get("name") == "y" and c.get("none", "x", default=1) == 1
    d = spark.createDataFrame([("m", [0.0, 1.5], [1.0, 2.0], ["A", "B"], b"x")], "meeting_id string, timestamps_start array<double>, timestamps_end array<double>, speakers array<string>, audio binary")
    assert [(r.seq, r.speaker, r.start_ms, r.end_ms) for r in store.diarization_rows(d).collect()] == [(0, "A", 0, 1000), (1, "B", 1500, 2000)]
    assert "audio" not in store.dataset_metadata(d).columns


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_sessions_split_at_the_gap(spark, tmp_path):
    rows = [(1, 0.0, 1.0), (1, 3.0, 4.0), (1, 5.999999, 7.0), (1, 30.0, 31.0), (1, 500.0, 501.0)]
    df = spark.createDataFrame(rows, "meeting_id long, s double, e double").select("meeting_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("start"), F.timestamp_micros((F.col("e") * 1e6).cast("long")).alias("end"))
    expect = [(0.0, 1.0, 1), (3.0, 7.0, 2), (30.0, 31.0, 1), (500.0, 501.0, 1)]
    secs = lambda rs: sorted((r.start.timestamp(), r.end.timestamp(), r.n) for r in rs)
    assert secs(sessions.silence_sessions(df).collect()) == expect
    live = _run(spark, sessions.silence_sessions(_stream(spark, df, str(tmp_path / "s"))), "sessions_out")
    assert secs(live) == expect[:3]  # the last one is still open


def test_sliding_and_dedup_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, "k", float(i)) for i in range(100)], "t long, id long, key string, value double").withColumn("ts", F.timestamp_seconds("t"))
    batch = {(r.start, r.n) for r in sessions.sliding_counts(df).collect()}
    live = {(r.start, r.n) for r in _run(spark, sessions.sliding_counts(_stream(spark, df, str(tmp_path / "w"))), "sliding_out", "update")}
    assert live == batch and sum(n for _, n in batch) > 100
    assert len(_run(spark, sessions.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), ["id"]), "dedup_out")) == 3


def test_chat_state(spark, tmp_path):
    df = spark.createDataFrame([(c, n, f"q{n}", f"a{n}") for c in (1, 2) for n in range(5)], "chat_id long, n long, question string, answer string")
    got = {(r.chat_id, r.n): r.context for r in _run(spark, sessions.chat_context(_stream(spark, df, str(tmp_path / "c"))), "chat_out")}
    assert got[1, 0] == "" and got[2, 4] == "\n".join(f"[{i}] q{i}: a{i}" for i in (1, 2, 3))


def _wav(path, x, rate, channels=1):
    import wave

    import numpy as np

    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.repeat(x, channels) * 32767).astype("<i2").tobytes())


def test_audio_segments_and_vectors(spark, tmp_path):
    import numpy as np

    from convoq.sources import audio

    rate = 8_000
    t = np.arange(rate * 4) / rate
    tone = lambda f, a, b: np.where((t >= a) & (t < b), 0.5 * np.sin(2 * np.pi * f * t), 0)
    _wav(tmp_path / "m1.mix.wav", tone(300, 0.5, 1.2) + tone(2000, 2.0, 3.5) + 1e-4, rate, 2)
    files = audio.wav_files(spark, str(tmp_path / "*.wav"))
    seg = audio.speech_segments(files)
    got = [(r.meeting_id, r.start_ms, r.end_ms) for r in seg.orderBy("seq").collect()]
    assert len(got) == 2 and all(abs(a - b) <= 20 for g, e in zip(got, [(500, 1200), (2000, 3500)], strict=True) for a, b in zip(g[1:], e, strict=True))
    v = [np.array(r.embedding) for r in audio.segment_embeddings(files, seg).orderBy("seq").collect()]
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v) and v[0] @ v[1] < 0.95
    assert abs(len(audio.decode((tmp_path / "m1.mix.wav").read_bytes())) - 4 * audio.RATE) <= 1 and audio.detect(np.zeros(0, np.float32)) == []


def test_ctc_decoders(spark):
    import itertools

    import numpy as np

    from convoq.sources import audio

    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.dirichlet(np.ones(3), 5)
        mass = {}
        for path in itertools.product(range(3), repeat=5):
            text = "".join("-ab"[i] for k, i in enumerate(path) if i and (k == 0 or i != path[k - 1]))
            mass[text] = mass.get(text, 0) + np.prod([p[k, i] for k, i in enumerate(path)])
        assert audio.ctc_beam(np.log(p), list("-ab"), beam=200) == max(mass, key=mass.get)
    rows = spark.createDataFrame([(1, [[-9.0, 0.0, -9.0], [0.0, -9.0, -9.0], [-9.0, 0.0, -9.0], [-9.0, -9.0, 0.0]]), (2, [])], "id long, log_probs array<array<double>>")
    assert {m: [r.text for r in audio.decoded(rows, list("-ab"), m).orderBy("id").collect()] for m in ("beam", "greedy")} == {"beam": ["aab", ""], "greedy": ["aab", ""]}


def test_entry_without_optional_parts(tmp_path):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, env={**os.environ, "PYTHONPATH": str(repo)})


def test_library_does_not_import_optional_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "convoq")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "convoq.llm" not in open(os.path.join(folder, n)).read(), n


def test_words_meet_segments_by_bin_of_time(spark):
    at = lambda c: F.timestamp_seconds(c)
    times = [0, 59, 60, 61, 119, 120, 300, 301, 3600, None]
    spans = [(0, 60), (60, 60), (59, 121), (10, 5), (0, 5000), (300, 3600), (None, 70), (5, None)]
    w = spark.createDataFrame([(m, i, t) for m in (1, 2) for i, t in enumerate(times)], "meeting_id long, word_idx long, t long").select("meeting_id", "word_idx", at("t").alias("at"))
    s = spark.createDataFrame([(1, i, "a", *x) for i, x in enumerate(spans)], "meeting_id long, seq long, speaker string, s long, e long").select("meeting_id", "seq", "speaker", at("s").alias("start"), at("e").alias("end"))
    for longest, most in (("5 minutes", 300), ("2 hours", 7200)):
        found = sessions.words_in_segments(w, s, longest=longest)
        join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
        assert "__bin" in join
        near = [(1, i, k) for i, t in enumerate(times) for k, (a, b) in enumerate(spans) if None not in (t, a, b) and a <= t <= min(b, a + most)]
        assert sorted((r.meeting_id, r.word_idx, r.seq) for r in found.collect()) == near


def test_named_files_need_no_folders_and_no_driver(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"in/final_transcriptions_m{i % 40}.json", i, f"te\nxt {i}") for i in range(200)], "file string, o long, text string")
    renamed = []
    monkeypatch.setattr(store, "_arrow_writes", lambda uri, f=store._arrow_writes: renamed.append(f(uri)) or renamed[-1])
    for _ in range(2):  # files that are there already are replaced
        store.write_named(df, f"file://{tmp_path}/new", "topic", order="o")
    assert renamed == [True, True]
    monkeypatch.setattr(store, "_arrow_writes", lambda uri: False)
    store.write_named(df, str(tmp_path / "plain"), "topic", order="o")
    store.write_named(df, str(tmp_path / "mixed"), "topic", order="o")
    monkeypatch.undo()
    store.write_named(df.withColumn("text", F.upper("text")), str(tmp_path / "mixed"), "topic", order="o")
    files = {p.name: p.read_text() for p in (tmp_path / "plain").iterdir() if not p.name.startswith(".")}
    assert {p.name: p.read_text() for p in (tmp_path / "new").iterdir()} == files and len(files) == 40
    assert {r.value.strip() for r in spark.read.text(str(tmp_path / "mixed"), wholetext=True).collect()} == {v.strip().replace("te\\nxt", "TE\\nXT") for v in files.values()}
