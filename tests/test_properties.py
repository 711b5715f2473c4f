"""Closed forms against plain loops on random rows, and edge cases written by hand."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoq.functions import text as T
from convoq.functions import vectors as FV
from convoq.operators import coverage as C
from convoq.operators import diarization as D
from convoq.operators import intervals as I
from convoq.operators import sequence as S
from convoq.operators import vectors as V
from convoq.plans.texts import salvage

SEG = "meeting_id long, seq long, speaker string, start_ms long, end_ms long"


def segments(rng, meetings=30, n=12, top=4000, step=1):
    rows = []
    for m in range(meetings):
        starts = sorted(rng.randrange(0, top, step) for _ in range(n))
        rows += [(m, i, rng.choice("abc"), s, s + rng.choice([0, step, 3 * step, 200, 500, 900])) for i, s in enumerate(starts)]
    return rows


def by_meeting(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_interval_union(spark):
    rows = segments(random.Random(1), step=50)
    expect = []
    for m, rs in by_meeting(rows).items():
        merged = []
        for _, _, s, e in sorted(rs, key=lambda r: (r[2], r[3])):
            if e <= s or e - s < 200:
                continue
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expect += [(m, s, e) for s, e in merged]
    got = S.interval_union(spark.createDataFrame(rows, SEG), "meeting_id", least=200).select("meeting_id", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, got)) == sorted(expect)


def test_capped_groups(spark):
    rows = segments(random.Random(2), top=60_000, n=40)
    expect = []
    for m, rs in by_meeting(rows).items():
        groups = []
        for seq, sp, s, e in sorted(rs, key=lambda r: (r[2], r[0])):
            g = groups[-1] if groups else None
            if g and g[0] == sp and s - g[2] <= 800 and e - g[1] <= 3_000:
                g[2], g[3] = e, g[3] + 1
            else:
                groups.append([sp, s, e, 1])
        expect += [(m, i, *g) for i, g in enumerate(groups)]
    got = S.capped_groups(spark.createDataFrame(rows, SEG), "meeting_id", "seq", max_length=3_000).collect()
    assert sorted(map(tuple, got)) == sorted(expect)


def test_time_windows_cover_and_clip(spark):
    df = spark.createDataFrame([(i, 7, 7 + n) for i, n in enumerate([0, 1, 59_999, 60_000, 60_001, 118_000, 118_001, 500_000])], "id long, start_ms long, end_ms long")
    got = {}
    for r in S.time_windows(df).collect():
        got.setdefault(r.id, []).append((r.win_start, r.win_end))
    for i, n in enumerate([0, 1, 59_999, 60_000, 60_001, 118_000, 118_001, 500_000]):
        expect, s = [], 0
        while True:
            expect.append((7 + s, 7 + min(s + 60_000, n)))
            if s + 60_000 >= n:
                break
            s += 58_000
        assert sorted(got[i]) == expect


@pytest.mark.parametrize("n", [0, 1, 18, 19, 30, 31, 50])
def test_word_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, words)], "id long, words array<string>")
    got = [r.window for r in S.word_windows(df, F.col("words")).orderBy("win_idx").collect()]
    assert got == ([words] if n <= 18 else [words[i : i + 18] for i in range(0, n, 12)])


def test_merge_overlapping(spark):
    rng = random.Random(3)
    rows = [(i, [[rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(0, 4))]) for i in range(60)]
    got = {r.id: r.m for r in spark.createDataFrame(rows, "id long, s array<array<string>>").select("id", S.merge_overlapping(F.col("s"), 3).alias("m")).collect()}
    for i, spans in rows:
        acc = list(spans[0]) if spans else []
        for cur in spans[1:]:
            tail, k = acc[-3:] if len(acc) >= 3 else acc, 0
            while k < min(len(tail), len(cur)) and tail[k] == cur[k]:
                k += 1
            acc = acc + cur[k:]
        assert got[i] == acc, spans


def test_topic_groups(spark):
    rng = random.Random(4)
    rows = segments(rng, top=400_000, n=10)
    got = {(r.meeting_id, r.seq): r.topic_idx for r in S.topic_groups(spark.createDataFrame(rows, SEG), "meeting_id", "seq").collect()}
    for m, rs in by_meeting(rows).items():
        topic, before = 0, None
        for seq, _, s, e in sorted(rs, key=lambda r: (r[2], r[0])):
            if before is not None and s - before > 22_500 and topic < 3:
                topic += 1
            assert got[m, seq] == topic
            before = e


def paint(rs):
    frames = {}
    for _, sp, s, e in sorted(rs):
        if e - s >= 200:
            for f in range(s // 10, -(-e // 10)):
                frames[f] = sp
    return frames


def test_sweep_equals_painted_frames(spark):
    rng = random.Random(5)
    g, s = segments(rng), segments(rng)
    sw = D.aligned(spark.createDataFrame(g, SEG), spark.createDataFrame(s, SEG)).collect()
    got = {}
    for r in sw:
        for f in range(r.start, r.end):
            assert (r.meeting_id, f) not in got
            got[r.meeting_id, f] = (r.gt, r.sys)
    gm, sm = by_meeting(g), by_meeting(s)
    expect = {}
    for m in gm:
        a, b = paint(gm[m]), paint(sm[m])
        expect |= {(m, f): (a.get(f), b.get(f)) for f in a.keys() | b.keys()}
    assert got == expect


def test_best_matching_is_optimal_and_first():
    rng = random.Random(6)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        size = max(n, m)
        best = None
        for p in permutations(range(size)):
            total = sum(w[i][p[i]] for i in range(n) if p[i] < m)
            key = (-total, [min(x, m) for x in p[:n]])
            best = min(best, key) if best else key
        assert [x if x >= 0 else m for x in D.best_matching(w)] == best[1]


def test_error_rates_of_published_counts(spark):
    """Frame counts and rates that a public evaluation prints for its meetings."""
    rows = [(1, 5035, 5859, 75770, 147708, 0.5867), (2, 14367, 4816, 15046, 97834, 0.3499), (5, 11793, 12482, 20294, 173967, 0.2562), (16, 6556, 8202, 96578, 189523, 0.5875)]
    df = spark.createDataFrame([r[:5] for r in rows], "meeting_id long, missed long, false_alarm long, confusion long, total long")
    assert {r.meeting_id: round(r.der, 4) for r in D.rates(df).collect()} == {r[0]: r[5] for r in rows}
    assert D.rates(spark.createDataFrame([(1, 0, 3, 0, 0)], "meeting_id long, missed long, false_alarm long, confusion long, total long")).first().der == 0.0


def test_error_invariants(spark):
    rng = random.Random(7)
    g, s = spark.createDataFrame(segments(rng), SEG), spark.createDataFrame(segments(rng), SEG)
    assert all(r.der == 0 for r in D.der(g, g).collect())
    renamed = s.withColumn("speaker", F.concat(F.lit("x"), F.translate("speaker", "abc", "cab")))
    key = lambda df: sorted(r.missed + r.false_alarm + r.confusion for r in df.collect())
    assert key(D.der(g, s, "confusion")) == key(D.der(g, renamed, "confusion"))
    a, b = D.aligned(g, s), D.aligned(s, g)
    silent = lambda sw, x, y: sum(r.end - r.start for r in sw.collect() if r[x] is not None and r[y] is None)
    assert silent(a, "gt", "sys") == silent(b, "sys", "gt")


def test_asof_takes_the_last_that_started(spark):
    seg = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, "b", 50, 60), (1, 2, "c", 50, 70), (1, 3, "d", 200, 300)], SEG)
    ev = spark.createDataFrame([(1, i, t) for i, t in enumerate([-1, 0, 49, 50, 70, 71, 90, 300, 301])], "meeting_id long, word_idx long, t long")
    got = {r.t: r.seg_speaker for r in I.active_segment(ev, "t", seg).collect()}
    assert got == {-1: None, 0: "a", 49: "a", 50: "c", 70: "c", 71: None, 90: None, 300: "d", 301: None}


def test_sentences_snap_or_stay_unknown(spark):
    seg = spark.createDataFrame([(1, 0, "a", 0, 1000), (1, 1, "b", 5000, 6000)], SEG)
    sent = spark.createDataFrame([(1, 0, 500, 900), (1, 1, 1000, 2000), (1, 2, 2000, 3900), (1, 3, 4100, 4900), (1, 4, 500, 5600)], "meeting_id long, sent_idx long, start_ms long, end_ms long")
    got = {r.sent_idx: (r.speaker, r.how) for r in I.attribute_sentences(sent, seg).collect()}
    assert got == {0: ("a", "overlap"), 1: ("a", "snap"), 2: ("Unknown", "none"), 3: ("b", "snap"), 4: ("b", "overlap")}


def test_text_functions(spark):
    df = spark.createDataFrame([("1:02:03",), ("02:03",), ("7.5",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(T.parse_hms(F.col("t"))).collect()] == [3723.0, 123.0, 7.5, None, None]
    with pytest.raises(Exception, match="not a time"):
        df.select(T.parse_hms(F.col("t"), strict=True)).collect()
    words = ["a", "uh", "don't", "word.", "é", "été", "Word"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.is_meaningful(F.col("w"))).collect()
    assert [r[0] for r in got] == [False, False, False, False, False, True, True]
    assert spark.range(1).select(T.normalize(F.lit(" Ça va?\tB2 ")), T.clean_fences(F.lit("```json\n[1]\n```"))).first()[:] == ("a va  b2", "[1]")


def test_salvage_rejects(spark):
    raw = '```json\n[{"start": 5, "end": 6, "speaker": "a", "text": "x"}, {"start": 0, "end": 6, "speaker": "a", "text": "y"}]\n``` and [{"start": 7, "end": 8, "speaker": "b", "text": "z ] w"}] [{"start": 9, "end": 9, "speaker": "c", "text": "q"}]'
    got = salvage(spark.createDataFrame([(1, raw), (2, None), (3, "none")], "id long, raw string")).collect()
    assert [(r.id, r.start, r.text) for r in got] == [(1, 5, "x"), (1, 9, "q")]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(FV.cosine(F.col("a"), F.col("b")), FV.norm(F.col("a")), FV.euclidean(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == pytest.approx(1) and r[0][1] == 5 and r[0][2] == 5 and r[1][0] == 0


def test_clustering_finds_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.03, (15, 8)) + np.eye(8)[i] for i in range(4)])
    for f in (V.spectral, V.agglomerative):
        label = f(x)
        assert len(set(label.tolist())) == 4 and all(len(set(label[i * 15 : i * 15 + 15].tolist())) == 1 for i in range(4)), f


def test_lcs_and_stems():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert C.lcs(a, b) == t[-1][-1]
    assert [C.stem(w) for w in ("meetings", "planned", "running", "miss", "is")] == ["meet", "plan", "run", "miss", "is"]


def test_claims_without_text(spark):
    claims = spark.createDataFrame([(1, 0, "alpha beta gamma")], "meeting_id long, chunk_idx long, chunk string")
    none = claims.limit(0)
    got = C.claim_support(claims, none, ["meeting_id"]).collect()
    assert [r.unsupported for r in got] == [True] and C.claim_support(none, claims, ["meeting_id"]).count() == 0
    assert C.layer_ics(claims, none, ["meeting_id"]).first().ics == 0.0


def test_stage_merge_trims(spark):
    rows = [(1, 0, "a", 2, 0, 1000), (1, 1, "b", 1, 500, 1500), (1, 2, "c", 0, 600, 900), (1, 3, "d", 2, 1500, 1500)]
    got = V.merge_stages(spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, priority int, start_ms long, end_ms long")).collect()
    assert sorted((r.seq, r.start_ms, r.end_ms) for r in got) == [(0, 0, 1000), (1, 1000, 1500)]
