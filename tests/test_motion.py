import pytest
from pyspark.sql import functions as F

from sightline.functions.angles import target_angles, wrap_degrees
from sightline.operators.joins import clamped_interval
from sightline.operators.motion import entity_deltas, play_intervals
from tests.conftest import rows

AIM = (
    "session_id long, entity_id long, tick long, seq long, yaw double, pitch double,"
    " is_alive boolean, is_freeze boolean"
)


def aim(spark, *series, dead=(), entity=1):
    data = [
        (0, entity, t, t, float(y), 0.0, t not in dead, False)
        for t, y in enumerate(series, start=1)
    ]
    return spark.createDataFrame(data, AIM)


def test_wrap(spark):
    df = spark.createDataFrame([(d,) for d in (-358.0, 90.0, -90.0, 180.0)], "d double")
    got = [r.w for r in df.select(wrap_degrees(F.col("d")).alias("w")).collect()]
    assert got == [2.0, 90.0, -90.0, -180.0]


def test_short_way_round_is_a_small_turn(spark):
    got = rows(entity_deltas(aim(spark, 179, -179)), "tick", "d_yaw", "yaw_speed")
    assert got == [(1, None, None), (2, 2.0, 128.0)]


def test_no_delta_between_entities(spark):
    both = aim(spark, 0, 10).unionByName(aim(spark, 100, 110, entity=2))
    got = entity_deltas(both).filter("tick = 1").collect()
    assert [r.d_yaw for r in got] == [None, None]


def test_dead_tick_has_no_speed(spark):
    got = {r.tick: r.yaw_speed for r in entity_deltas(aim(spark, 0, 1, 2, 3, dead=(3,))).collect()}
    assert got[2] == 64.0 and got[3] is None and got[4] is None
    loose = entity_deltas(aim(spark, 0, 1, 2, dead=(2,)), require_alive=False)
    assert {r.tick: r.yaw_speed for r in loose.collect()}[2] == 64.0


def round_ticks(spark, tail=None, session=0):
    """450 ticks, the counter moves at 200 and 400, the first 32 of each are freeze."""
    data = []
    for t in range(450):
        number = 0 if t < 200 else 1 if t < 400 else 2
        start = {0: 0, 1: 200, 2: 400}[number]
        freeze = t - start < 32 if number < 2 else {"freeze": True, "none": False}.get(tail, t - start < 32)
        data.append((session, t, number, freeze))
    return spark.createDataFrame(data, "session_id long, tick long, round int, is_freeze boolean")


def test_time_after_the_last_round_joins_it(spark):
    got = rows(play_intervals(round_ticks(spark, "none")), "number", "start", "end")
    assert got == [(1, 32, 201), (2, 232, 450)]


def test_an_all_freeze_tail_is_dropped(spark):
    got = rows(play_intervals(round_ticks(spark, "freeze")), "number", "start", "end")
    assert got == [(1, 32, 201), (2, 232, 401)]


def test_intervals_do_not_mix_sessions(spark):
    both = round_ticks(spark, "none").unionByName(round_ticks(spark, "freeze", session=7))
    got = rows(play_intervals(both), "session_id", "number", "end")
    assert got == [(0, 1, 201), (0, 2, 450), (7, 1, 201), (7, 2, 401)]


def test_clamped_lookup(spark):
    intervals = play_intervals(round_ticks(spark, "none"))
    events = spark.createDataFrame([(0, 210), (0, 5), (0, 300), (9, 1)], "session_id long, tick long")
    got = rows(clamped_interval(events, intervals), "tick", "number")
    assert got == [(1, None), (5, 1), (210, 1), (300, 2)]


def test_angles_to_a_target(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0), (0.0, 0.0, 0.0, 90.0, 0.0, 100.0, 0.0, 0.0),
         (0.0, 0.0, 0.0, 0.0, -45.0, 100.0, 0.0, 100.0), (1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)],
        "x double, y double, z double, yaw double, pitch double, target_x double, target_y double, target_z double",
    )
    got = df.withColumns(target_angles()).collect()
    assert got[0].target_angle == pytest.approx(0, abs=1e-6)
    assert got[1].target_yaw_error == pytest.approx(-90)
    assert got[2].target_angle == pytest.approx(0, abs=1e-5)  # negative pitch looks up
    assert got[3].target_angle is None and got[3].target_distance == 0
