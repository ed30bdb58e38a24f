"""Column expressions for angles, speeds and view geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K


def wrap_degrees(angle: Column) -> Column:
    """The shortest way round the circle: [-180, 180)."""
    return F.pmod(angle + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def rate(delta: Column, steps: Column, valid: Column) -> Column:
    """Absolute change per second; NULL where the pair of rows is not comparable."""
    return F.when(valid & (steps > 0), F.abs(delta) / steps * F.lit(float(K.TICK_RATE)))


def ticks_to_ms(ticks: Column) -> Column:
    return ticks / F.lit(float(K.TICK_RATE)) * F.lit(1000.0)


def view_direction(yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a view; negative pitch looks up."""
    flat = F.cos(F.radians(pitch))
    return (
        F.cos(F.radians(yaw)) * flat,
        F.sin(F.radians(yaw)) * flat,
        -F.sin(F.radians(pitch)),
    )


def _clip_unit(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def target_angles(
    viewer: tuple[str, str, str] = ("x", "y", "z"),
    target: tuple[str, str, str] = ("target_x", "target_y", "target_z"),
    yaw: str = "yaw",
    pitch: str = "pitch",
    eye_height: float = K.EYE_HEIGHT,
    head_height: float = K.HEAD_HEIGHT,
    prefix: str = "target",
) -> dict[str, Column]:
    """Distance, signed yaw and pitch error, and total angle from view to target.

    A target at distance 0 has no direction: the angles are NULL.
    """
    dx, dy = (
        F.col(t).cast("double") - F.col(v).cast("double")
        for v, t in zip(viewer[:2], target[:2], strict=True)
    )
    dz = (F.col(target[2]).cast("double") + head_height) - (
        F.col(viewer[2]).cast("double") + eye_height
    )
    facing, tilt = F.col(yaw).cast("double"), F.col(pitch).cast("double")
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    lx, ly, lz = view_direction(facing, tilt)
    cosine = F.try_divide(lx * dx + ly * dy + lz * dz, distance)
    rise = F.degrees(F.asin(_clip_unit(F.try_divide(dz, distance))))
    return {
        f"{prefix}_distance": distance,
        f"{prefix}_yaw_error": wrap_degrees(F.degrees(F.atan2(dy, dx)) - facing),
        f"{prefix}_pitch_error": tilt + rise,
        f"{prefix}_angle": F.when(
            cosine.isNotNull(), F.degrees(F.acos(_clip_unit(cosine)))
        ),
    }


def in_field_of_view(
    angle: Column | str = "target_angle", degrees: float = K.FIELD_OF_VIEW_DEG
) -> Column:
    a = F.col(angle) if isinstance(angle, str) else angle
    return a <= F.lit(degrees / 2)


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def on_head(angle: Column, distance: Column, radius: float = K.HEAD_RADIUS) -> Column:
    """The view ray passes within ``radius`` of the head's centre."""
    return angle < F.degrees(F.lit(1.0)) * radius / F.greatest(
        distance, F.lit(K.MIN_DISTANCE)
    )


def sweep_speed(d_yaw: Column, d_pitch: Column, pitch: Column) -> Column:
    """The view's own angular step per second, yaw scaled by pitch."""
    flat = d_yaw * F.cos(F.radians(pitch))
    return F.sqrt(flat * flat + d_pitch * d_pitch) * F.lit(float(K.TICK_RATE))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def planar_speed(dx: Column, dy: Column) -> Column:
    """Speed in the plane between two rows, taken as one tick apart."""
    return F.sqrt(dx * dx + dy * dy) * F.lit(float(K.TICK_RATE))


def grid_cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def pixel(v: Column, low: Column, side: Column, n: int, *, flip: bool = False) -> Column:
    """World coordinate -> cell 0..n-1 of a square grid, clipped."""
    share = F.try_divide((low - v) if flip else (v - low), side)
    # truncation towards zero, then clipping
    cell = (share * n).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), cell))
