"""Rounding, stems, files by name, indexes, refinement and generators' defaults against plain forms."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoq import plugins
from convoq import registry
from convoq.functions import text as T
from convoq.operators import coverage as C
from convoq.operators import diarization as D
from convoq.operators import index as I
from convoq.operators import sequence as S
from convoq.operators import vectors as V
from convoq.sources import store, xml

SF = "/root/testdata/sf0.01"


def test_rounding_is_pythons(spark):
    rng = random.Random(0)
    xs = [2.675, 0.5, 1.5, 2.5, -0.5, -1.5, 0.125, 0.375, 1.005, 0.285, 1e-9, 123456.785, 0.045, 0.0, -2.675] + [rng.uniform(-1000, 1000) for _ in range(300)] + [round(rng.uniform(0, 10), 3) for _ in range(1000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 4):
        for r in df.select("x", T.python_round(F.col("x"), digits).alias("y")).collect():
            assert r.y == round(r.x, digits), (r.x, digits)


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
        "happy": "happi", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "vileli": "vile",
        "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
        "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
        "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
        "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "are": "are",
    }
    assert {w: C.stem(w) for w in known} == known


def test_one_pass_over_layers_gives_the_single_scores(spark):
    from convoq import adapters as A

    keys = ["meeting_id", "layer"]
    g, p = A.gt_units(spark, "/root/testdata/sf0.001"), A.pred_texts(spark, "/root/testdata/sf0.001").withColumnRenamed("text_idx", "unit_idx")
    got = {(r.meeting_id, r.layer): r for r in C.layer_scores(g, p, keys).collect()}
    main, chunks, pred = C.text_chunks(g, keys, "unit_idx", least_tokens=4), C.text_chunks(g, keys, "unit_idx"), C.text_chunks(p, keys, "unit_idx")
    for r in C.layer_ics(main, pred, keys).collect():
        assert got[r.meeting_id, r.layer].ics == pytest.approx(r.ics)
    for r in C.claim_support(pred, chunks, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("unsupported").alias("bad")).collect():
        assert (got[r.meeting_id, r.layer].n_claims, got[r.meeting_id, r.layer].n_unsupported) == (r.n, r.bad)
    for r in C.compression(g, p, keys).collect():
        assert (got[r.meeting_id, r.layer].n_in, got[r.meeting_id, r.layer].n_out) == (r.n_in, r.n_out)


def plain_issues(rows):
    out = set()
    for m in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == m)
        runs = lambda k: [x for i, x in enumerate(v) if i == 0 or v[i - 1] != x] if (v := [r[k] for r in mine if r[k] is not None]) else []
        if len(runs(4)) > len(runs(2)):
            out.add((m, "OSCILLATION", "", len(runs(4))))
        for kind, a, b in (("MERGE", 3, 2), ("SPLIT", 2, 4)):
            for x in {r[a] for r in mine if r[a] is not None}:
                if (n := len({r[b] for r in mine if r[a] == x and r[b] is not None})) > 1:
                    out.add((m, kind, x, n))
        if all(r[2] is None for r in mine) or all(r[3] is None for r in mine):
            out.add((m, "EMPTY", "", 0))
    return out


def test_issues_equal_plain_counts(spark):
    rng = random.Random(5)
    rows = []
    for m in range(25):
        for i in range(rng.randint(1, 14)):
            sys = rng.choice([None, "x", "y"]) if m % 5 else None
            rows.append((m, i * 10, i * 10 + 10, rng.choice([None, "a", "b", "c"]), sys, None if sys is None else {"x": "a", "y": rng.choice(["b", None])}[sys]))
    df = spark.createDataFrame(rows, "meeting_id long, start long, end long, gt string, sys string, sys_gt string")
    assert {tuple(r) for r in D.issues(df).collect()} == plain_issues(rows)


def test_diar_issues_solves_the_assignment_once(spark):
    plan = registry.QUERIES["diar_issues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_error_counters(spark):
    counts, seen = D.observed(spark.createDataFrame([(1, 2, 3, 10), (4, 5, 6, 20)], "missed long, false_alarm long, confusion long, total long"))
    assert counts.count() == 2 and seen.get == {"missed": 5, "false_alarm": 7, "confusion": 9, "total": 30}


def test_capped_groups_equal_a_plain_fold(spark):
    rng = random.Random(6)
    rows = []
    for m in range(12):
        at = 0
        for i in range(rng.randint(1, 40)):
            at += rng.choice([0, 100, 700, 900])
            n = rng.randint(100, 9000)
            rows.append((m, i, rng.choice("aab"), at, at + n))
            at += n
    expect = set()
    for m in range(12):
        groups = []
        for _, _, who, s, e in sorted((r for r in rows if r[0] == m), key=lambda r: (r[3], r[1])):
            if groups and groups[-1][0] == who and s - groups[-1][2] <= 800 and e - groups[-1][1] <= 30_000:
                groups[-1][2:] = [e, groups[-1][3] + 1]
            else:
                groups.append([who, s, e, 1])
        expect |= {(m, k, *g) for k, g in enumerate(groups)}
    got = S.capped_groups(spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, start_ms long, end_ms long"), "meeting_id", "seq")
    assert {tuple(r) for r in got.collect()} == expect


def test_stages_are_merged_as_said(spark):
    rng = random.Random(7)
    rows = [(m, i, "s", rng.randrange(3), s := rng.randrange(0, 400), s + rng.randrange(1, 90)) for m in range(15) for i in range(40)]
    expect = set()
    for m in range(15):
        done = []
        for _, seq, who, p, s, e in sorted((r for r in rows if r[0] == m), key=lambda r: (r[4], -r[3], r[1])):
            if any(s >= a and e <= b for a, b in done):
                continue
            begin, end = s, e
            for a, b in done:
                if s < a < e:
                    end = a
                elif s < b < e:
                    begin = b
            if end > begin:
                done.append((begin, end))
                expect.add((m, seq, who, p, begin, end))
    got = V.merge_stages(spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, priority int, start_ms long, end_ms long"))
    assert {tuple(r) for r in got.collect()} == expect


# Vectors ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_nearest_centroid_in_each_metric(spark, vectors):
    c = V.centroids(vectors, ["label"])
    at = {r.label: np.array(r.centroid) for r in c.collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    of = {"cosine": lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "dot": lambda a, b: a @ b, "euclidean": lambda a, b: 1 / (1 + np.linalg.norm(a - b))}
    for metric, f in of.items():
        df = V.nearest_centroid(vectors, c, metric=metric)
        for r in df.collect():
            scores = {k: f(x[r.vec_id], v) for k, v in at.items()}
            assert r.score == pytest.approx(max(scores.values()), abs=1e-6) and scores[r.cluster] == pytest.approx(r.score, abs=1e-6)
    assert V.nearest_centroid(vectors, c.limit(0)).where("cluster is null").count() == len(x)


def test_candidates_without_centroids_are_clusters_of_their_own(spark, vectors):
    out, skipped = vectors.where("vec_id in (7, 3)"), vectors.where("vec_id = 5")
    got = V.reassign(out, skipped, V.centroids(vectors.limit(0), ["label"])).collect()
    assert [(r.vec_id, r.origin, r.cluster, r.score, r.tentative) for r in sorted(got, key=lambda r: r.cluster)] == [(3, "outlier", 0, 0.0, True), (7, "outlier", 1, 0.0, True), (5, "skipped", 2, 0.0, True)]


def test_davies_bouldin_and_the_fallback():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (10, 4)) + 3 * np.eye(4)[i] for i in range(3)])
    label = np.repeat([0, 1, 2], 10)
    c = np.array([x[label == i].mean(0) for i in range(3)])
    s = [np.linalg.norm(x[label == i] - c[i], axis=1).mean() for i in range(3)]
    expect = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert V._davies_bouldin(x, label) == pytest.approx(expect)
    assert V._score(x[:2], np.ones((2, 2)) - np.eye(2), np.array([0, 1])) == -V._davies_bouldin(x[:2], np.array([0, 1]))


def test_index_finds_nine_of_ten(spark, vectors, tmp_path):
    r = registry.QUERIES["index_recall"](spark, SF).first()
    assert r.n_queries == 10 and r.recall >= 0.9
    big = registry.QUERIES["index_recall"](spark, SF.replace("0.01", "0.1")).first()
    assert big.n_queries == 40 and big.recall >= 0.9, big
    centres = I.fit_cells(vectors, 8)
    assert I.fit_cells(vectors).probes <= len(I.fit_cells(vectors).centres)
    every = I.search(vectors.where("vec_id % 50 = 0"), I.build(vectors, centres), centres, probes=8)
    assert I.recall(every, V.knn(vectors.where("vec_id % 50 = 0"), vectors)).first().recall == 1.0
    I.write(I.build(vectors, centres), str(tmp_path / "i"))
    again = I.search(vectors.where("vec_id % 50 = 0"), spark.read.parquet(str(tmp_path / "i")), centres, probes=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, every.collect()))


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(I, "SHARE_ROWS", 50)
    v = spark.createDataFrame([(i, [100.0, 0.0] if i % 3 else [0.0, float(i + 100)]) for i in range(600)], "vec_id long, embedding array<double>")
    centres = I.fit_cells(v, 2)
    index = I.build(v, centres)
    assert index.groupBy("cell", "share").count().agg(F.max("count")).first()[0] < 100 and index.count() == 600
    got = I.search(v.where("vec_id in (1, 3)"), index, centres, k=5)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == {(1, i) for i in (1, 2, 4, 5, 7)} | {(3, i) for i in (0, 3, 6, 9, 12)}


def test_refinement_is_its_steps(spark):
    rng = np.random.default_rng(2)
    rows = [(1, f"s{c}", 100 * c + i, (3 * np.eye(6)[c * 3 + i % 3] + rng.normal(0, 0.05 + (i == 7), 6)).tolist()) for c in range(2) for i in range(24)]
    df = spark.createDataFrame(rows, "meeting_id long, speaker string, seq long, embedding array<double>")
    refined, compared = V.refine_clusters(df)
    got = {r.seq: r for r in refined.collect()}
    assert len(got) == len(rows)
    for c in range(2):
        mine = [r for r in rows if r[1] == f"s{c}"]
        x = np.array([r[3] for r in mine])
        label = V.spectral(x)
        for k in set(label.tolist()):
            part = x[label == k]
            d = np.linalg.norm(part - part.mean(0), axis=1)
            for (_, _, seq, _), dist in zip([r for r, z in zip(mine, label, strict=True) if z == k], d, strict=True):
                assert got[seq].distance == pytest.approx(dist) and got[seq].is_outlier == (dist > d.mean() + 1.5 * d.std())
    assert {r.sub_cluster for r in got.values()} >= {0, 1, 2} and any(r.is_outlier for r in got.values())
    (r,) = compared.collect()
    assert r.n_true == 2 and r.n == 48 and 0 < r.accuracy <= 1 and r.matched == round(r.accuracy * 48)


def test_a_group_too_large_is_an_error(spark, monkeypatch):
    from pyspark.errors import PythonException

    monkeypatch.setattr(V, "MOST_MERGED", 5)
    df = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(9)], "meeting_id long, vec_id long, embedding array<double>")
    fit = V.cluster_groups(df, "meeting_id", method="agglomerative")
    try:
        fit.collect()
    except PythonException as e:
        assert "at most" in str(e)


# Files ------------------------------------------------------------------------------------------------------------------


def test_word_ids_of_any_prefix(spark):
    x = '<nite:root xmlns:nite="n"><w nite:id="m.A.words1" starttime="1" endtime="2" cid="no">a</w><w starttime="2" endtime="3" id="m.A.words2">b</w></nite:root>'
    got = xml.word_index(spark.createDataFrame([("m", "A", x)], "meeting_id string, speaker string, xml string")).orderBy("pos").collect()
    assert [r.word_id for r in got] == ["m.A.words1", "m.A.words2"]


def test_files_by_name_and_their_listing(spark, tmp_path):
    df = spark.createDataFrame([("in/final_transcriptions_m 1.json", 1, "b"), ("in/final_transcriptions_m 1.json", 0, "é"), ("m2.json", 0, "c")], "file string, n long, summary string")
    path = str(tmp_path / "out")
    store.write_named(df, path, "topic", order="n")
    store.write_named(df, path, "topic", order="n")
    found = store.listing(spark, path)
    assert sorted(r.name for r in found.select("name").collect()) == ["topic_summarization_m 1.json", "topic_summarization_m2.json"]
    assert json.loads((tmp_path / "out" / "topic_summarization_m 1.json").read_text()) == [{"summary": "é"}, {"summary": "b"}]
    assert store.listing(spark, path, ".txt").count() == 0


# Generators -----------------------------------------------------------------------------------------------------------------


def test_default_generators(spark):
    df = spark.createDataFrame([(1, 0, "A", "We agreed. the plan is"), (1, 1, "B", "good for all"), (1, 2, "A", "Yes and no"), (1, 3, "A", "more")], "meeting_id long, seq long, speaker string, text string")
    assert [r.text for r in plugins.repair_boundaries(df, "meeting_id", "seq").orderBy("seq").collect()] == ["We agreed.", "the plan is good for all", "Yes and no", "more"]
    q = spark.createDataFrame([("what is it?", "a\nthe budget"), ("what is the plan?", "x"), ("is that so", None)], "q string, h string")
    assert [r[0] for r in q.select(plugins.standalone_question(F.col("q"), F.col("h"))).collect()] == ["the budget what is it?", "what is the plan?", "is that so"]
    assert [r[0] for r in q.select(plugins.sufficient(F.col("q"), F.lit("what is the plan"))).collect()] == [True, True, False]
    none = plugins.summaries(spark.createDataFrame([(1, 0, "!!"), (2, 0, "a b"), (2, 1, "b c"), (2, 2, "b")], "g long, i long, text string"), ["g"], "i").collect()
    assert {r.g: (r.n, r.summary) for r in none} == {1: (0, ""), 2: (2, "a b b")}
