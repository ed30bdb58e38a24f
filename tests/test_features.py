import pytest
from pyspark.sql import functions as F

from sightline.operators.context import alive_counts, fired_recently, ran_nearby
from sightline.operators.features import (
    entity_features,
    mark_shots,
    window_features,
)
from tests.conftest import rows


def window(spark, turns, first=-6, uid="m#0"):
    data = [
        (uid, 0, 1, "clean", o, o / 64 * 1000, float(t), abs(t) * 64.0, 0.0)
        for o, t in enumerate(turns, start=first)
    ]
    return spark.createDataFrame(
        data,
        "window_uid string, session_id long, entity_id long, label string, tick_offset int,"
        " t_ms double, d_yaw double, yaw_speed double, pitch_speed double",
    )


def test_straight_flick(spark):
    got = window_features(window(spark, [0, 5, 10, 20, 5, 0, 0])).first()
    assert (got.straightness, got.corrections, got.turn_total_engage) == (1.0, 0, 40.0)


def test_overshoot_is_corrected(spark):
    got = window_features(window(spark, [0, 10, 20, -6, 2, 0, 0])).first()
    assert (got.corrections, got.turn_total_engage, got.turn_net_engage) == (2, 38.0, 26.0)


def test_jitter_is_no_correction(spark):
    assert window_features(window(spark, [0, 10, -0.01, 10, 0, 0, 0])).first().corrections == 0


def test_peak_and_settle(spark):
    got = window_features(window(spark, [0, 1, 10, 2, 1, 0, 1])).first()
    assert got.peak_speed_engage == 640.0
    assert got.t_peak_ms == -62.5
    assert got.settle_ratio == pytest.approx(0.1)


def arrivals(spark, angles, shots, d_yaw=5.0):
    data = [
        ("m#0", o, o / 64 * 1000, float(a), 400.0, o in shots, d_yaw, 0.0, 0.0, 100.0, 0.0)
        for o, a in angles.items()
    ]
    return spark.createDataFrame(
        data,
        "window_uid string, tick_offset int, t_ms double, target_angle double,"
        " target_distance double, shot boolean, d_yaw double, d_pitch double, pitch double,"
        " yaw_speed double, pitch_speed double",
    )


OFF, ON = 30.0, 0.2


def test_shot_on_the_arrival_tick(spark):
    angles = {o: (ON if o >= -5 else OFF) for o in range(-20, 1)}
    got = window_features(arrivals(spark, angles, {-5, 0})).first()
    assert got.arrival_shot is True and got.arrival_delay_ms == 0.0


def test_only_the_last_burst_opens(spark):
    angles = {o: (ON if o >= -40 else OFF) for o in range(-60, 1)}
    got = window_features(arrivals(spark, angles, {-40, -30, -5, 0})).first()
    assert got.arrival_shot is False and got.arrival_delay_ms == 35 / 64 * 1000


def test_a_held_angle_is_no_arrival(spark):
    angles = {o: (ON if o >= -5 else OFF) for o in range(-20, 1)}
    got = window_features(arrivals(spark, angles, {-5, 0}, d_yaw=0.1)).first()
    assert got.arrival_shot is None
    always = {o: ON for o in range(-20, 1)}
    assert window_features(arrivals(spark, always, {-5})).first().arrival_shot is None


def test_knives_are_no_shots(spark):
    wt = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 1, 7)], "session_id long, entity_id long, tick long")
    shots = spark.createDataFrame(
        [(0, 1, 5, "knife_t"), (0, 1, 6, "ak47"), (0, 1, 6, "ak47"), (0, 1, 7, None)],
        "session_id long, entity_id long, tick long, weapon string",
    )
    assert rows(mark_shots(wt, shots), "tick", "shot") == [(5, False), (6, True), (7, True)]
    assert rows(mark_shots(wt, None), "tick", "shot") == [(5, False), (6, False), (7, False)]


def features(spark, straight, speeds, weapons=None):
    data = [
        (0, 1, "clean", float(s), float(v), 2, 10.0, 0.5, -50.0, 3.0, 1.0, w, 10, 2)
        for s, v, w in zip(straight, speeds, weapons or ["ak47"] * len(speeds), strict=True)
    ]
    return spark.createDataFrame(
        data,
        "session_id long, entity_id long, label string, straightness double, speed_at_kill double,"
        " corrections int, peak_speed_engage double, settle_ratio double, t_peak_ms double,"
        " peak_pitch_speed_engage double, mean_speed_idle double, weapon string,"
        " speed_ticks long, still_ticks long",
    )


def test_entity_shares(spark):
    got = entity_features(features(spark, [1, 1, 0.4, 0.4, 0.4], [900, 5, 5, 5, 5.0])).first()
    assert got.straight_share == pytest.approx(0.4)
    assert (got.snap_max, got.snap_share, got.snap_kills) == (900.0, pytest.approx(0.2), 1)
    assert got.zero_motion_share == pytest.approx(0.2)


def test_a_snipers_snap_does_not_count(spark):
    got = entity_features(
        features(spark, [1.0] * 5, [900.0] * 5, ["awp", "awp", "ak47", None, "ak47"])
    ).first()
    assert got.snap_kills == 3 and got.sniper_share == pytest.approx(0.5)


def test_too_few_kills(spark):
    assert entity_features(features(spark, [1.0] * 4, [5.0] * 4)).count() == 0


def alive(spark):
    data = [(0, e, t, team, e != 5 or t < 10, 0.0 + e, 0.0, 0.0) for e, team in ((1, 2), (2, 2), (4, 3), (5, 3)) for t in range(20)]
    return spark.createDataFrame(
        data, "session_id long, entity_id long, tick long, team int, is_alive boolean, x double, y double, z double"
    )


def test_alive_counts(spark):
    windows = spark.createDataFrame([("a", 0, 1, 12)], "window_uid string, session_id long, entity_id long, tick long")
    assert rows(alive_counts(windows, alive(spark)), "allies_alive", "enemies_alive") == [(2, 1)]
    none = alive(spark).withColumn("is_alive", F.col("team") == 2)
    assert alive_counts(windows, none).count() == 0


def test_sounds_before_an_anchor(spark):
    windows = spark.createDataFrame(
        [("a", 0, 1, 4, 15), ("b", 0, 2, 5, 15)],
        "window_uid string, session_id long, entity_id long, target_id long, tick long",
    )
    shots = spark.createDataFrame([(0, 4, 3), (0, 4, 11), (0, 4, 16)], "session_id long, entity_id long, tick long")
    fired = fired_recently(windows, shots, span=8)
    assert rows(fired, "window_uid", "victim_fired_ms_ago") == [("a", 62.5), ("b", None)]
    moving = alive(spark).withColumn("seq", F.col("tick") + 1).withColumn(
        "x", F.when((F.col("entity_id") == 4) & (F.col("tick") >= 14), 50.0).otherwise(F.col("x"))
    )
    got = ran_nearby(windows, moving, span=8)
    assert rows(got, "window_uid", "victim_was_running") == [("a", True), ("b", False)]
    far = ran_nearby(windows, moving, span=8, reach=10.0)
    assert rows(far, "victim_was_running") == [(False,), (False,)]
