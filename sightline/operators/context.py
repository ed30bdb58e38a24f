"""What an entity could have known about its target before an anchor event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.angles import target_angles, ticks_to_ms
from sightline.functions.labels import listed_in
from sightline.operators.joins import asof_join, state_of
from sightline.operators.motion import movement
from sightline.operators.ordered import CHUNK_TICKS


def add_target_geometry(
    window_ticks: DataFrame, samples: DataFrame, **angles: float
) -> DataFrame:
    """The target's position on the same tick, and the view's angles to it.

    ``flag_visible`` is the source's own spotting flag, false when unknown.
    """
    columns = {"x": "target_x", "y": "target_y", "z": "target_z"}
    if "spotted_by" in samples.columns:
        columns["spotted_by"] = "target_spotted_by"
    joined = state_of(window_ticks, samples, "target_id", columns)
    out = joined.withColumns(target_angles(**angles))
    if "spotted_by" in samples.columns:
        seen = listed_in(F.col("target_spotted_by"), F.col("entity_id"))
        out = out.withColumn("flag_visible", seen).drop("target_spotted_by")
    return out


def alive_counts(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Allies and enemies alive on the anchor's tick.

    An anchor whose tick has no living enemy does not appear (its count is unknown
    to the caller, not zero).
    """
    alive = (
        samples.filter("is_alive")
        .groupBy("session_id", "tick", "team")
        .agg(F.count(F.lit(1)).alias("alive"))
    )
    mine = state_of(
        windows.select("window_uid", "session_id", "entity_id", "tick"),
        samples,
        "entity_id",
        {"team": "team"},
        how="inner",
    )
    sides = mine.join(alive.withColumnRenamed("team", "side"), ["session_id", "tick"])
    same = F.col("side") == F.col("team")
    # all sides of one tick are read once and split, instead of two joins
    return (
        sides.groupBy("window_uid")
        .agg(
            F.max(F.when(same, F.col("alive"))).alias("allies_alive"),
            F.max(F.when(~same, F.col("alive"))).alias("enemies_alive"),
        )
        .filter(F.col("enemies_alive").isNotNull())
    )


def fired_recently(
    windows: DataFrame, shots: DataFrame, *, span: int = 2 * K.TICK_RATE
) -> DataFrame:
    """``victim_fired_ms_ago``: the target's last shot within ``span`` ticks.

    Only the latest shot matters, so this is an as-of join with a limit: no pair of
    anchor and shot is built that is not the answer.
    """
    fired = shots.select(
        "session_id", F.col("entity_id").alias("target_id"), F.col("tick").alias("shot_tick")
    )
    near = asof_join(
        windows.select("window_uid", "session_id", "target_id", "tick").filter(
            F.col("target_id").isNotNull()
        ),
        fired,
        on="tick",
        right_on="shot_tick",
        by=("session_id", "target_id"),
        take=("shot_tick",),
        within=span,
        width=CHUNK_TICKS,
    )
    return near.select(
        "window_uid",
        ticks_to_ms(F.col("tick") - F.col("shot_tick")).alias("victim_fired_ms_ago"),
    )


def ran_nearby(
    windows: DataFrame,
    samples: DataFrame,
    *,
    span: int = 2 * K.TICK_RATE,
    speed: float = K.AUDIBLE_SPEED,
    reach: float = K.FOOTSTEP_RANGE,
) -> DataFrame:
    """``victim_was_running``: the target moved fast and close within the look-back.

    The look-back is expanded into exact (session, entity, tick) keys, which keeps
    a busy entity's rows spread over the cluster.
    """
    moves = movement(samples).select(
        "session_id", "entity_id", "tick", "speed", "x", "y", "z"
    )
    wanted = windows.select(
        "window_uid",
        "session_id",
        "entity_id",
        "target_id",
        F.explode(F.sequence(F.col("tick") - span, F.col("tick"))).alias("tick"),
    )
    fast = state_of(
        wanted,
        moves.filter(F.col("speed") > speed),
        "target_id",
        {"x": "vx", "y": "vy", "z": "vz"},
        how="inner",
    )
    both = state_of(
        fast, samples, "entity_id", {"x": "ax", "y": "ay", "z": "az"}, how="inner"
    )
    gap = F.sqrt(
        sum(
            (
                (F.col(f"v{a}") - F.col(f"a{a}")) * (F.col(f"v{a}") - F.col(f"a{a}"))
                for a in "xyz"
            ),
            F.lit(0.0),
        )
    )
    heard = (
        both.filter(gap < reach)
        .select("window_uid")
        .distinct()
        .withColumn("victim_was_running", F.lit(True))
    )
    return (
        windows.select("window_uid")
        .join(heard, "window_uid", "left")
        .withColumn(
            "victim_was_running", F.coalesce("victim_was_running", F.lit(False))
        )
    )


def lookback_pairs(
    windows: DataFrame,
    samples: DataFrame,
    *,
    first: int = -K.LOOKBACK_SECONDS * K.TICK_RATE,
    last: int = -K.ENGAGEMENT_SECONDS * K.TICK_RATE,
    stride: int = K.LOOKBACK_STRIDE,
) -> DataFrame:
    """Positions of both entities at sampled ticks before each anchor."""
    wanted = windows.select(
        "window_uid",
        "session_id",
        "entity_id",
        "target_id",
        F.col("tick").alias("anchor_tick"),
        F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(stride))).alias(
            "tick_offset"
        ),
    ).withColumn("tick", F.col("anchor_tick") + F.col("tick_offset"))
    here = state_of(
        wanted, samples, "entity_id", {c: c for c in "xyz"}, how="inner"
    )
    there = {c: f"target_{c}" for c in "xyz"}
    return state_of(here, samples, "target_id", there, how="inner")


def last_seen(windows: DataFrame, pairs: DataFrame, visible: Column) -> DataFrame:
    """``last_seen_ms`` from look-back pairs with a visibility column; NULL: never."""
    seen = (
        pairs.filter(visible)
        .groupBy("window_uid")
        .agg(ticks_to_ms(-F.max("tick_offset")).alias("last_seen_ms"))
    )
    return windows.select("window_uid").join(seen, "window_uid", "left")


def add_context(
    windows: DataFrame, *parts: DataFrame
) -> DataFrame:
    """Attach context tables keyed by ``window_uid``; every window is kept."""
    out = windows
    for part in parts:
        out = out.join(part, "window_uid", "left")
    return out
