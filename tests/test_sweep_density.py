"""Diarization where many segments overlap: work grows with the segments, not with pairs of them."""

from __future__ import annotations

import pytest

from convoq import registry
from convoq.operators import diarization as D

SEG = "meeting_id long, seq long, speaker string, start_ms long, end_ms long"


def test_sweep_meets_no_pairs(spark):
    rows = [(1, i, "a", 10 * i, 50_000 + 10 * i) for i in range(400)] + [(1, 400, None, 53_990, 54_500)]
    system = [(1, i, f"S{i // 200}", 10 * i, 50_000) for i in range(400)]
    sw = D.aligned(spark.createDataFrame(rows, SEG), spark.createDataFrame(system, SEG))
    assert "Join" not in sw._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.start, r.end, r.gt, r.sys) for r in sw.collect())
    assert got == [(0, 200, "a", "S0"), (200, 5000, "a", "S1"), (5000, 5399, "a", None), (5399, 5450, None, None)]


def test_error_intervals_reach_over_borders_without_a_join(spark):
    rows = [(1, 0, 100, "a", "a"), (1, 100, 110, "a", "b"), (1, 110, 114, "a", "a"), (1, 114, 120, "c", "c"), (1, 120, 300, "c", "c"), (1, 300, 310, None, "b"), (1, 310, 320, "a", None)]
    sw = spark.createDataFrame(rows, "meeting_id long, start long, end long, gt string, sys_gt string")
    found = D.error_intervals(sw)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.err_idx, r.start, r.end, r.gt, r.sys) for r in found.collect())
    assert got == [(0, 95, 99, "a", "a"), (1, 100, 109, "a", "b"), (2, 110, 113, "a", "a"), (3, 114, 114, "c", "c"), (4, 310, 319, "a", None)]


@pytest.mark.parametrize("name", ["der_report", "error_counts_confusion", "diar_issues", "frame_error_intervals", "label_quality", "speaker_assignment"])
def test_a_sweep_is_painted_once(spark, name, monkeypatch):
    painted, sweep = [], D.sweep
    monkeypatch.setattr(D, "sweep", lambda *a, **k: painted.append(1) or sweep(*a, **k))
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(painted) == 1 and "FlatMapGroupsInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_dealt_once_for_both_sides(spark):
    from convoq import adapters as A
    from convoq.plans import diarization as P

    d = "/root/testdata/sf0.001"
    sw = P._sweep(spark, d)
    plan = sw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    numbered = D.aligned(A.segments_gt(spark, d), A.segments_sys(spark, d))
    assert sorted(map(str, sw.collect())) == sorted(map(str, numbered.collect()))


def test_events_are_packed_without_loss(spark):
    from convoq import adapters as A

    last = A.BUCKET_US - 1
    rows = [(i, t, us, dur) for i, (t, us, dur) in enumerate(
        (t, us, dur) for t in (*A.TYPES, "other", None) for us in (0, last, last + 1, 10**16 + 7, -1, -last - 2, None) for dur in (0, 199, (1 << 25) - 1, 1 << 25, -1, None)
    )]
    e = spark.createDataFrame([*rows, (None, "view", 5, 6)], "event_id long, event_type string, us long, dur long").selectExpr(f"us div {A.BUCKET_US} AS meeting_id", "*")
    p = A.packed(e)
    assert p.where("packed is not null").count() == 5 * 4 * 3 + 1 and p.where("packed is not null and rest is not null").count() == 0
    assert sorted(map(str, A.unpacked(p).collect())) == sorted(map(str, e.collect()))
