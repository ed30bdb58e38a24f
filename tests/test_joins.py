import random
import re

import pytest
from pyspark.sql import functions as F

from sightline.operators.context import lookback_pairs, ran_nearby
from sightline.operators.joins import (
    anchor_windows,
    asof_join,
    compare_tables,
    pair_start_end,
    step_lookup,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(3), rng.randrange(100)) for i in range(120)]
    right = [(1000 + i, rng.randrange(3), rng.randrange(100)) for i in range(60)]
    return (
        left,
        right,
        spark.createDataFrame(left, "id long, k long, t long"),
        spark.createDataFrame(right, "rid long, k long, t long"),
    )


@pytest.mark.parametrize("width", [5, 1 << 16])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_matches_brute_force(sides, direction, exact, width):
    left, right, l, r = sides
    got = asof_join(
        l, r, on="t", by=["k"], take=["rid"], tie=["rid"], direction=direction,
        allow_exact=exact, width=width,
    )
    found = {x.id: x.rid for x in got.collect()}
    assert len(found) == len(left)
    for i, k, t in left:
        if direction == "backward":
            ok = [(rt, rid) for rid, rk, rt in right if rk == k and (rt <= t if exact else rt < t)]
            want = max(ok)[1] if ok else None
        else:
            ok = [(rt, rid) for rid, rk, rt in right if rk == k and (rt >= t if exact else rt > t)]
            want = min(ok)[1] if ok else None
        assert found[i] == want


def test_asof_tolerance_and_inner(sides):
    left, right, l, r = sides
    near = asof_join(l, r, on="t", by=["k"], take=["rid"], within=2, how="inner")
    times = {rid: rt for rid, _, rt in right}
    assert 0 < near.count() < len(left)
    assert all(0 <= x.t - times[x.rid] <= 2 for x in near.collect())


def ticks(spark, entities=(1, 2), n=40, skip=()):
    data = [(0, e, t, float(t)) for e in entities for t in range(n) if (e, t) not in skip]
    return spark.createDataFrame(data, "session_id long, entity_id long, tick long, yaw double")


def kills(spark, *triples):
    return spark.createDataFrame(
        [(0, a, v, t) for a, v, t in triples], "session_id long, entity_id long, target_id long, tick long"
    )


def test_window_length_and_offsets(spark):
    windows, wt = anchor_windows(ticks(spark), kills(spark, (1, 2, 20)), pre=8, post=2)
    got = rows(wt, "tick_offset", "tick")
    assert got == [(o, 20 + o) for o in range(-8, 3)]
    assert windows.count() == 1
    assert wt.filter("tick_offset = 2").first().t_ms == 31.25


def test_incomplete_and_self_inflicted_give_none(spark):
    anchors = kills(spark, (1, 2, 3), (1, 1, 20), (2, 1, 39), (1, None, 20))
    windows, wt = anchor_windows(ticks(spark), anchors, pre=8, post=2)
    assert rows(windows, "entity_id", "tick") == [(1, 20)]
    _, all_ticks = anchor_windows(ticks(spark), anchors, pre=8, post=2, drop_incomplete=False)
    assert all_ticks.select("window_uid").distinct().count() == 3


def test_a_gap_breaks_a_window(spark):
    windows, _ = anchor_windows(
        ticks(spark, skip={(1, 17)}), kills(spark, (1, 2, 20)), pre=8, post=2
    )
    assert windows.count() == 0


@pytest.mark.parametrize("start", [0, 65536 - 30, -20])
def test_windows_are_known_whole_before_they_are_written_out(spark, start):
    """Gaps, doubled ticks and chunk borders; the ticks need no grouping by window."""
    rng = random.Random(start)
    have = [start + t for t in range(60) for _ in range(rng.choice([1] * 30 + [0, 2]))]
    samples = spark.createDataFrame([(0, 1, t, 1.0) for t in have], "session_id long, entity_id long, tick int, yaw double")
    at = [start + t for t in range(60)]
    anchors = kills(spark, *[(1, 2, t) for t in at]).unionByName(
        spark.createDataFrame([(0, 1, 2, None), (None, 1, 2, start + 20)], "session_id long, entity_id long, target_id long, tick long")
    )
    windows, wt = anchor_windows(samples, anchors, pre=5, post=3)
    want = [t for t in at if sum(have.count(x) for x in range(t - 5, t + 4)) == 9]
    assert rows(windows, "tick") == [(t,) for t in want] and 0 < len(want) < 60
    assert wt.count() == 9 * len(want) and wt.filter("session_id is null").isEmpty()
    assert "Window" not in wt._jdf.queryExecution().optimizedPlan().toString()


def test_ticks_written_out_of_windows_are_not_broadcast(spark):
    """A planner that takes a window's ticks to be as small as the window sends them through the driver."""
    samples = ticks(spark).withColumns({c: F.col("tick").cast("double") for c in "xyz"}).withColumn("seq", F.col("tick"))
    windows, wt = anchor_windows(samples, kills(spark, (1, 2, 20)), pre=8, post=2)
    assert wt.count() == 11
    pairs = lookback_pairs(windows, samples, first=-8, last=-2, stride=2)
    assert pairs.count() == 4
    heard = ran_nearby(windows, samples, span=4, speed=0.0, reach=1e9)
    assert rows(heard, "victim_was_running") == [(True,)]
    for df in (wt, pairs, heard):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin .*, Inner", plan), plan


def test_reused_ids_pair_forward(spark):
    starts = spark.createDataFrame([(7, 100), (7, 300), (8, 50)], "id long, tick long")
    ends = spark.createDataFrame([(7, 90), (7, 150)], "id long, tick long")
    got = pair_start_end(
        starts, ends, by=["id"], limit=F.col("tick") + 20, bound=F.lit(310)
    )
    assert rows(got, "id", "tick", "until") == [(7, 100, 150), (7, 300, 310), (8, 50, 70)]


def test_step_lookup(spark):
    cuts = spark.createDataFrame([(0.1, 1.0), (0.5, 2.0), (0.9, 3.0)], "level double, cut double")
    scores = spark.createDataFrame([(0.5,), (2.0,), (2.5,), (9.0,), (None,)], "score double")
    got = rows(step_lookup(scores, cuts, value="score"), "score", "percentile")
    assert got == [(0.5, 0.0), (2.0, 0.5), (2.5, 0.5), (9.0, 0.9), (None, None)]


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (4, 0.0)], "k int, v double")
    assert rows(compare_tables(a, b, ["k"], ["v"]), "k", "status") == [
        (1, "equal"), (2, "differs"), (3, "equal"), (4, "only_fresh"),
    ]
