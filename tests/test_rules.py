import pytest

from sightline.operators import rules as R
from sightline.operators.motion import entity_deltas
from tests.conftest import rows
from tests.test_motion import AIM


def series(spark, yaws, pitch=None):
    data = [
        (0, 1, t, t, (y + 180) % 360 - 180.0, pitch(t) if pitch else 0.0, True, False)
        for t, y in enumerate(yaws, start=1)
    ]
    return entity_deltas(spark.createDataFrame(data, AIM))


def anchors(spark, *ticks):
    return spark.createDataFrame(
        [(0, 1, 2, t) for t in ticks],
        "session_id long, entity_id long, target_id long, tick long",
    )


LINES = R.Lines()


def test_sustained_spin(spark):
    spin = series(spark, [50.0 * t for t in range(64)])
    got = R.spinbot(spin, None, LINES).collect()
    assert len(got) == 1
    assert got[0].severity == "impossible" and got[0].value == 3200.0
    assert got[0].note.startswith("view spun at a sustained 3200 deg/s for 0.7")


def test_one_flick_is_no_spin(spark):
    flick = series(spark, [0.0] * 30 + [120.0] * 30)
    assert R.spinbot(flick, None, LINES).count() == 0


def test_alternating_turns(spark):
    shake = series(spark, [0.0 if t % 2 else 170.0 for t in range(12)])
    got = R.aliased_spin(shake, None, LINES).collect()
    assert len(got) == 1 and got[0].value >= 10
    steady = series(spark, [100.0 * t for t in range(12)])
    assert R.aliased_spin(steady, None, LINES).count() == 0


def test_speed_on_the_anchor_tick(spark):
    yaws = [0.0] * 9 + [50.0] + [50.0] * 10
    moved = series(spark, yaws)
    assert rows(R.kill_tick_snap(moved, anchors(spark, 10), LINES), "tick", "value") == [(10, 3200.0)]
    assert R.kill_tick_snap(moved, anchors(spark, 11, 99), LINES).count() == 0


def test_pitch_beyond_the_clamp(spark):
    tilted = series(spark, [0.0] * 20, pitch=lambda t: 89.5 if 5 <= t <= 7 else 89.0)
    assert rows(R.impossible_pitch(tilted, None, LINES), "tick_start", "tick_end", "value") == [(5, 7, 89.5)]


def test_worst_hits_per_rule(spark):
    names = "session_id long, entity_id long, name string, severity string, value double, tick long, unit string, threshold double, note string"
    data = [(0, 1, "a", "strong", v, t, "u", 0.0, f"n{v:g}") for t, v in enumerate((5.0, 9.0, 7.0))]
    data += [(0, 1, "b", "impossible", 1.0, 3, "u", 0.0, "b"), (0, 1, "c", "notable", 99.0, 4, "u", 0.0, "c")]
    data += [(0, 1, "d", "info", 99.0, 4, "u", 0.0, "d")]
    got = R.worst_hits(spark.createDataFrame(data, names))
    assert rows(got, "place", "name", "episodes") == [(1, "b", 1), (2, "a", 3), (3, "c", 1)]
    note = got.filter("name = 'a'").first().note
    assert note == "n9 — 3 such episodes this match"


def test_calibration_counts(spark):
    moved = series(spark, [3.0 * t for t in range(40)])
    got = R.calibrate(R.entity_extremes(moved, anchors(spark, 12))).first()
    assert got.entities == 1 and got.above_spin == 0 and got.alias_min_ticks == 6
    assert got.spin_speed_dps == pytest.approx(380.0)
