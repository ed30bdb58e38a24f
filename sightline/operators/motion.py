"""Per-entity derivatives, play intervals and side changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.angles import planar_speed, rate, wrap_degrees
from sightline.operators.ordered import (
    CHUNK_TICKS,
    neighbours,
    number_rows,
    tick_chunk,
    with_halo,
)
from sightline.session import staged

ENTITY = ("session_id", "entity_id")


def number_samples(
    samples: DataFrame, *, keys: Sequence[str] = ENTITY, order: str = "tick"
) -> DataFrame:
    """``seq``: a dense row number per entity, which the halo operators need."""
    return number_rows(samples, keys, tick_chunk(order), [order], "seq")


def entity_deltas(
    samples: DataFrame,
    *,
    seq: str = "seq",
    require_alive: bool = True,
    width: int = CHUNK_TICKS,
) -> DataFrame:
    """Wrapped angle changes and angular speeds against the entity's previous row.

    Adds d_tick, d_yaw, d_pitch, yaw_speed, pitch_speed. Speeds are NULL on the
    first row and (with ``require_alive``) next to a dead or frozen row.
    """
    halo = with_halo(samples, seq, back=1, width=width)
    w = W.partitionBy(*ENTITY, "_chunk").orderBy(seq)
    yaw, pitch = F.col("yaw").cast("double"), F.col("pitch").cast("double")
    moved = halo.withColumns(
        {
            "d_tick": F.col("tick") - F.lag("tick").over(w),
            "d_yaw": wrap_degrees(yaw - F.lag(yaw).over(w)),
            "d_pitch": pitch - F.lag(pitch).over(w),
            "_live": F.col("is_alive")
            & F.lag("is_alive").over(w)
            & ~F.col("is_freeze")
            & ~F.lag("is_freeze").over(w),
        }
    ).filter("_own")
    valid = F.col("_live") if require_alive else F.lit(True)
    return moved.withColumns(
        {
            "yaw_speed": rate(F.col("d_yaw"), F.col("d_tick"), valid),
            "pitch_speed": rate(F.col("d_pitch"), F.col("d_tick"), valid),
        }
    ).drop("_own", "_chunk", "_live")


def movement(
    samples: DataFrame, *, seq: str = "seq", per_gap: bool = False, width: int = CHUNK_TICKS
) -> DataFrame:
    """``speed`` in the plane. ``per_gap`` divides by the ticks a gap spans."""
    halo = with_halo(samples, seq, back=1, width=width)
    w = W.partitionBy(*ENTITY, "_chunk").orderBy(seq)
    speed = planar_speed(
        F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    )
    if per_gap:
        speed = F.try_divide(speed, F.col("tick") - F.lag("tick").over(w))
    return halo.withColumn("speed", speed).filter("_own").drop("_own", "_chunk")


def play_intervals(samples: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """Play time of each round: number (1-based), start, end (exclusive) per session.

    From the end of a round's freeze to the next round's freeze. Time after the
    final round is dropped when it is all freeze, else it joins the final round.
    """
    per = (
        samples.filter(F.col("round").isNotNull())
        .groupBy("session_id", "round")
        .agg(
            F.min("tick").alias("first"),
            F.max("tick").alias("last"),
            F.min(F.when(F.col("is_freeze"), F.col("tick"))).alias("freeze_first"),
            F.max(F.when(F.col("is_freeze"), F.col("tick"))).alias("freeze_last"),
        )
    )
    # one row per round, read three times below: the samples are scanned once
    per = staged(per)
    final = per.groupBy("session_id").agg(
        F.max("round").alias("_final"),
        F.count(F.lit(1)).alias("_rounds"),
        F.max_by(F.struct("freeze_first", "last"), "round").alias("_end"),
    )
    ahead = neighbours(
        per,
        ["session_id"],
        tick_chunk("round", chunk),
        ["round"],
        ahead={
            "_next": "round",
            "_next_first": "first",
            "_next_freeze": "freeze_first",
        },
    ).join(final, "session_id")
    # the counter moved on after the final round, but no freeze followed
    tail = (F.col("_rounds") > 1) & F.col("_end")["freeze_first"].isNull()
    end = F.greatest(
        F.coalesce("_next_freeze", "_next_first", F.col("last") + 1),
        F.col("_next_first") + 1,
    )
    final_round = F.col("_next") == F.col("_final")
    return (
        ahead.filter(~(tail & (F.col("round") == F.col("_final"))))
        .select(
            "session_id",
            (F.col("round") + 1).cast("int").alias("number"),
            F.coalesce(F.col("freeze_last") + 1, F.col("first")).alias("start"),
            F.when(tail & final_round, F.col("_end")["last"] + 1)
            .otherwise(end)
            .alias("end"),
        )
        .filter(F.col("end") > F.col("start"))
    )


def side_switches(samples: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """Rounds that begin with at least half of a session's entities on a new side."""
    sides = (
        samples.filter(F.col("round").isNotNull() & F.col("team").isNotNull())
        .groupBy(*ENTITY, "round")
        .agg(F.mode("team", deterministic=True).alias("team"))
    )
    sides = staged(sides)
    changed = neighbours(
        sides, ENTITY, tick_chunk("round", chunk), ["round"], back={"_prev": "team"}
    ).filter(F.col("team") != F.col("_prev"))
    roster = samples.groupBy("session_id").agg(
        F.countDistinct("entity_id").alias("_entities")
    )
    return (
        changed.groupBy("session_id", "round")
        .agg(F.count(F.lit(1)).alias("switched"))
        .join(roster, "session_id")
        .filter(
            F.col("switched")
            >= F.greatest(F.lit(2), F.floor(F.col("_entities") / 2))
        )
        .select("session_id", "round", "switched")
    )


def first_and_last(samples: DataFrame) -> DataFrame:
    """Starting side and last known name per entity; NULLs are skipped."""
    def edge(pick, column):
        return pick(column, F.when(F.col(column).isNotNull(), F.col("tick")))

    return samples.groupBy(*ENTITY).agg(
        edge(F.min_by, "team").alias("first_team"),
        edge(F.max_by, "name").alias("last_name"),
    )
