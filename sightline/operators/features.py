"""Windows -> one row per anchor -> one row per entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.angles import on_head, sweep_speed, ticks_to_ms
from sightline.functions.labels import aimed_weapon, is_sniper
from sightline.operators.joins import at_tick
from sightline.operators.quantiles import feature_quantiles

AIM_COLUMNS = (
    "peak_speed_engage",
    "t_peak_ms",
    "speed_at_kill",
    "settle_ratio",
    "mean_speed_after",
    "mean_speed_idle",
    "turn_total_engage",
    "turn_net_engage",
    "straightness",
    "corrections",
    "speed_change_std",
    "peak_pitch_speed_engage",
)
PERCEPTION_COLUMNS = (
    "visible_share_engage",
    "aim_through_wall_share",
    "reaction_ms",
    "angle_at_first_visible",
    "angle_at_kill",
    "visible_before_kill",
)
SHOT_COLUMNS = ("arrival_shot", "arrival_delay_ms")
#: Ticks with a known speed, and those without any motion.
TICK_COUNTS = ("speed_ticks", "still_ticks")


@dataclass(frozen=True)
class Segments:
    """Parts of a window, as inclusive offsets."""

    idle: tuple[int, int] = K.IDLE
    engage: tuple[int, int] = K.ENGAGE
    after: tuple[int, int] = K.AFTER


def within(bounds: tuple[int, int]) -> Column:
    return F.col("tick_offset").between(*bounds)


def on_approach(stride: int, span_ms: tuple[float, float] = K.TRAJECTORY_MS) -> Column:
    """The ticks of a window that its approach is sampled on."""
    return F.col("t_ms").between(*span_ms) & (F.col("tick_offset") % stride == 0)


def approach_point() -> Column:
    return F.struct(
        F.col("t_ms").cast("int").alias("ms"),
        F.coalesce("target_angle", F.lit(180.0)).alias("angle"),
        F.coalesce("target_visible", F.lit(False)).alias("visible"),
        F.col("yaw_speed").alias("speed"),
    )


def mark_shots(window_ticks: DataFrame, shots: DataFrame | None) -> DataFrame:
    """``shot``: the window's own entity fired an aimed weapon on this tick."""
    if shots is None:
        return window_ticks.withColumn("shot", F.lit(False))
    fired = (
        shots.filter(aimed_weapon(F.col("weapon")))
        .select("session_id", "entity_id", "tick")
        .distinct()
        .withColumn("shot", F.lit(True))
    )
    return (
        at_tick(window_ticks.drop("shot"), fired, how="left")
        .withColumn("shot", F.coalesce("shot", F.lit(False)))
    )


def _aim(seg: Segments) -> list[Column]:
    engage = within(seg.engage)
    speed, turn = F.col("yaw_speed"), F.col("d_yaw")
    peak = F.when(engage & speed.isNotNull(), F.struct(speed, -F.col("tick_offset")))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(engage, c)), F.lit(0.0))

    return [
        F.max(F.when(engage, speed)).alias("peak_speed_engage"),
        # every speed unknown: the first row's time, as for an unsorted tie
        F.coalesce(
            F.max_by("t_ms", peak), F.min(F.when(engage, F.col("t_ms")))
        ).alias("t_peak_ms"),
        F.max(F.when(F.col("tick_offset") == 0, speed)).alias("speed_at_kill"),
        F.avg(F.when(within(seg.after), speed)).alias("mean_speed_after"),
        F.avg(F.when(within(seg.idle), speed)).alias("mean_speed_idle"),
        total(F.abs(turn)).alias("turn_total_engage"),
        F.abs(total(turn)).alias("turn_net_engage"),
        F.count_if("_reversed").cast("int").alias("corrections"),
        F.stddev_samp("_speed_change").alias("speed_change_std"),
        F.max(F.when(engage, F.col("pitch_speed"))).alias("peak_pitch_speed_engage"),
    ]


def _perception(seg: Segments) -> list[Column]:
    engage, seen = within(seg.engage), F.col("target_visible")
    first = F.when(seen & (F.col("tick_offset") <= 0), F.col("tick_offset"))
    hidden_on = ~seen & (F.col("target_angle") < K.ON_TARGET_DEG)
    return [
        F.avg(F.when(engage, seen.cast("int"))).alias("visible_share_engage"),
        F.avg(F.when(engage, hidden_on.cast("int"))).alias("aim_through_wall_share"),
        ticks_to_ms(-F.min(first)).alias("reaction_ms"),
        F.min_by("target_angle", first).alias("angle_at_first_visible"),
        F.max(F.when(F.col("tick_offset") == 0, F.col("target_angle"))).alias(
            "angle_at_kill"
        ),
        F.min(first).isNotNull().alias("visible_before_kill"),
    ]


def _with_reversals(df: DataFrame, seg: Segments) -> DataFrame:
    """Per row: change of speed inside the engage part, and a turn that reversed."""
    w = W.partitionBy("window_uid").orderBy("tick_offset")
    inside = within((seg.engage[0] + 1, seg.engage[1]))
    change = F.when(inside, F.col("yaw_speed") - F.lag("yaw_speed").over(w))
    move = F.when(
        within(seg.engage) & (F.abs("d_yaw") >= K.CORRECTION_MIN_DEG),
        F.signum("d_yaw"),
    )
    moved = df.withColumn("_move", move)
    before = F.last("_move", ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, -1)
    )
    return moved.withColumns(
        {"_speed_change": change, "_reversed": F.col("_move") != before}
    )


def with_arrivals(
    window_ticks: DataFrame,
    burst_gap: int = K.BURST_GAP,
    radius: float = K.HEAD_RADIUS,
) -> DataFrame:
    """Per row: ``arrives`` (the view came onto the head by its own motion), the
    window's ``opening`` shot, ``sweep`` and ``closure`` of the angle."""
    w = W.partitionBy("window_uid").orderBy("tick_offset")
    head = on_head(F.col("target_angle"), F.col("target_distance"), radius)
    sweep = sweep_speed(F.col("d_yaw"), F.col("d_pitch"), F.col("pitch"))
    shot_at = F.when(F.col("shot") & (F.col("tick_offset") <= 0), F.col("tick_offset"))
    rows = window_ticks.withColumns(
        {"_on": head, "sweep": sweep, "_shot_at": shot_at}
    )
    entered = F.coalesce("_on", F.lit(False)) & ~F.coalesce(
        F.lag("_on").over(w), F.lit(True)
    )
    last_shot = F.last("_shot_at", ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, -1)
    )
    opens = F.when(
        last_shot.isNull() | (F.col("_shot_at") - last_shot > burst_gap),
        F.col("_shot_at"),
    )
    return (
        rows.withColumns(
            {
                "enters": entered,
                "closure": F.lag("target_angle").over(w) - F.col("target_angle"),
                "_opens": opens,
            }
        )
        # the last burst's first shot is the latest of all burst openings
        .withColumn("opening", F.max("_opens").over(W.partitionBy("window_uid")))
        .withColumn(
            "arrives",
            F.col("enters")
            & F.coalesce(F.col("sweep") >= K.ARRIVAL_SWEEP_DPS, F.lit(False)),
        )
        .drop("_on", "_shot_at", "_opens")
    )


def arrival_table(
    window_ticks: DataFrame,
    burst_gap: int = K.BURST_GAP,
    radius: float = K.HEAD_RADIUS,
) -> DataFrame:
    """Every arrival at or before the opening shot, one row each, with its sweep.

    Sweep thresholds can then be tried without returning to the ticks; windows
    without an arrival keep one row with NULLs.
    """
    rows = with_arrivals(window_ticks, burst_gap, radius)
    hit = F.col("enters") & (F.col("tick_offset") <= F.col("opening"))
    keys = [c for c in ("session_id", "entity_id", "label", "weapon") if c in rows.columns]
    arrivals = rows.filter(hit).select(
        "window_uid",
        F.col("tick_offset").alias("arrived"),
        "opening",
        F.col("sweep").alias("dps"),
        "closure",
    )
    windows = rows.filter(F.col("tick_offset") == 0).select(
        "window_uid", *keys, F.col("yaw_speed").alias("speed_at_kill")
    )
    return windows.join(arrivals, "window_uid", "left")


def window_features(
    window_ticks: DataFrame,
    seg: Segments = Segments(),
    *,
    burst_gap: int = K.BURST_GAP,
    radius: float = K.HEAD_RADIUS,
    stride: int | None = None,
) -> DataFrame:
    """One row per window. Groups of features appear when their inputs are present.

    Everything is one shuffle on ``window_uid``: the ordered helpers and the
    conditional aggregates share its partitioning. With a ``stride`` the sampled approach
    (``trajectory``) comes too, so that ticks need not be stored to be read for it again.
    """
    have = set(window_ticks.columns)
    keys = [c for c in ("session_id", "entity_id", "label", "weapon") if c in have]
    rows = _with_reversals(window_ticks, seg)
    aggs = _aim(seg)
    if "target_visible" in have:
        aggs += _perception(seg)
    if {"shot", "target_angle", "target_distance"} <= have:
        rows = with_arrivals(rows, burst_gap, radius)
        arrived = F.max(
            F.when(
                F.col("arrives") & (F.col("tick_offset") <= F.col("opening")),
                F.col("tick_offset"),
            )
        )
        opening = F.max("opening")
        aggs += [
            (opening == arrived).alias("arrival_shot"),
            ticks_to_ms(opening - arrived).alias("arrival_delay_ms"),
        ]
    aggs += [
        F.count("yaw_speed").alias("speed_ticks"),
        F.count_if(F.col("yaw_speed") == 0).alias("still_ticks"),
    ]
    if stride is not None:
        points = F.collect_list(F.when(on_approach(stride), approach_point()))
        aggs.append(F.when(F.size(points) > 0, F.sort_array(points)).alias("trajectory"))
    out = rows.groupBy("window_uid").agg(*[F.first(k).alias(k) for k in keys], *aggs)
    out = out.withColumns(
        {
            "straightness": F.when(
                F.col("turn_total_engage") > 0,
                F.col("turn_net_engage") / F.col("turn_total_engage"),
            ),
            "settle_ratio": F.when(
                F.col("peak_speed_engage") > 0,
                F.col("speed_at_kill") / F.col("peak_speed_engage"),
            ),
        }
    )
    present = [
        c
        for c in (*AIM_COLUMNS, *PERCEPTION_COLUMNS, *SHOT_COLUMNS, *TICK_COUNTS, "trajectory")
        if c in out.columns
    ]
    return out.select("window_uid", *keys, *present)


def entity_features(
    features: DataFrame,
    *,
    min_kills: int = K.MIN_KILLS,
    min_arrivals: int = K.MIN_ARRIVAL_KILLS,
    quantile_method: str = "linear",
) -> DataFrame:
    """Shares, extremes and typical values per (session, entity, label).

    ``features`` is read for the aggregates and for the quantiles: stage it when it
    is expensive. The share of motionless ticks comes from the windows' own counts,
    so the ticks are not read again.
    """
    keys = ["session_id", "entity_id", "label"]
    have = set(features.columns)

    def share(c: Column) -> Column:
        return F.avg(c.cast("int"))

    snap = F.col("speed_at_kill") > K.SNAP_THRESHOLD_DPS
    sniper = is_sniper(F.col("weapon")) if "weapon" in have else F.lit(False)
    aggs = [
        F.count(F.lit(1)).alias("n_kills"),
        share(F.col("straightness") >= K.STRAIGHT_EPS).alias("straight_share"),
        F.avg("corrections").alias("corrections_mean"),
        F.max("speed_at_kill").alias("snap_max"),
        share(snap).alias("snap_share"),
        F.count_if(snap & ~sniper).alias("snap_kills"),
        F.try_divide(F.sum("still_ticks"), F.sum("speed_ticks")).alias(
            "zero_motion_share"
        ),
    ]
    if "weapon" in have:
        aggs.append(share(F.col("weapon").isin(*K.SNIPERS)).alias("sniper_share"))
    medians = {
        "corrections_median": ("corrections", 0.5),
        "snap_p90": ("speed_at_kill", 0.9),
        "peak_speed_p90": ("peak_speed_engage", 0.9),
        "peak_speed_median": ("peak_speed_engage", 0.5),
        "settle_ratio_median": ("settle_ratio", 0.5),
        "t_peak_ms_median": ("t_peak_ms", 0.5),
        "pitch_peak_median": ("peak_pitch_speed_engage", 0.5),
        "idle_speed_median": ("mean_speed_idle", 0.5),
    }
    if "visible_share_engage" in have:
        aggs += [
            F.avg("visible_share_engage").alias("visible_share"),
            F.avg("aim_through_wall_share").alias("wall_aim_share"),
            F.max("aim_through_wall_share").alias("wall_aim_max"),
            F.min("reaction_ms").alias("reaction_ms_min"),
            F.count_if(F.col("reaction_ms") < K.FAST_REACTION_MS).alias("fast_kills"),
            share(~F.col("visible_before_kill")).alias("never_visible_share"),
        ]
        medians |= {
            "reaction_ms_median": ("reaction_ms", 0.5),
            "angle_at_first_visible_median": ("angle_at_first_visible", 0.5),
        }
    if "arrival_shot" in have:
        arrivals = F.count("arrival_shot")
        aggs += [
            arrivals.alias("arrival_kills"),
            F.when(arrivals >= min_arrivals, share(F.col("arrival_shot"))).alias(
                "arrival_shot_share"
            ),
        ]
    wide = features.groupBy(*keys).agg(*aggs).filter(F.col("n_kills") >= min_kills)
    return wide.join(
        feature_quantiles(features, keys, medians, method=quantile_method),
        keys,
        "left",
    )


def visibility_agreement(window_ticks: DataFrame, kind: Column) -> DataFrame:
    """How often two visibility instruments agree at the anchor, per label and kind."""
    both = F.col("target_visible") == F.col("flag_visible")
    return (
        window_ticks.filter(F.col("tick_offset") == 0)
        .groupBy("label", kind.alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("anchors"),
            F.avg(F.col("target_visible").cast("int")).alias("visible_share"),
            F.avg(F.col("flag_visible").cast("int")).alias("flag_share"),
            F.avg(both.cast("int")).alias("agreement"),
        )
    )
