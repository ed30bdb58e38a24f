"""Whole sessions at once: windows with geometry, sight and context, and labelled sets.

``session_windows`` is what both a training set and a live report read, so that a session
is cut, measured and tested for sight in one way. Nothing is staged here but what
``anchor_windows`` and ``line_of_sight`` stage; callers who read both results store them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.labels import three_valued_label
from sightline.operators import context as C
from sightline.operators.features import Segments, arrival_table, mark_shots, window_features
from sightline.operators.joins import anchor_windows
from sightline.operators.motion import entity_deltas
from sightline.operators.ordered import attach_row
from sightline.operators.spatial import Cells, line_of_sight, meshed_maps, packed_cells, stored_cells
from sightline.sources.manifest import finished, pending
from sightline.sources.sinks import write_windows

RAYS, FLAG = "raycast", "spotting_flag"


def with_sight(ticks: DataFrame, triangles: DataFrame | Cells | None, **sight: float) -> DataFrame:
    """``target_visible`` by rays where the tick's map has a mesh, else by the flag.

    ``ticks``: window_uid, tick_offset, map, both positions and ``flag_visible``. The two
    instruments differ, so ``visibility_source`` says which one answered. On a map with a
    mesh an unknown position leaves ``target_visible`` NULL.
    """
    if triangles is None:
        return ticks.withColumns(
            {"target_visible": F.col("flag_visible"), "visibility_source": F.lit(FLAG)}
        )
    tested = line_of_sight(
        ticks, triangles, ["window_uid", "tick_offset"], name="_clear", **sight
    )
    # maps are told by one row, as in the ray test
    meshes = meshed_maps(triangles)
    by_rays = F.coalesce(F.array_contains("_meshes", F.col("map")), F.lit(False))
    return (
        attach_row(tested, meshes)
        .withColumns(
            {
                "target_visible": F.when(by_rays, F.col("_clear")).otherwise(
                    F.col("flag_visible")
                ),
                "visibility_source": F.when(by_rays, RAYS).otherwise(FLAG),
            }
        )
        .drop("_clear", "_meshes")
    )


def session_windows(
    samples: DataFrame,
    anchors: DataFrame,
    sessions: DataFrame,
    triangles: DataFrame | Cells | None = None,
    *,
    pre: int = 128,
    post: int = 32,
    look_back: Mapping[str, int] | None = None,
    span: int = 2 * K.TICK_RATE,
    audible_speed: float = K.AUDIBLE_SPEED,
    earshot: float = K.FOOTSTEP_RANGE,
    **sight: float,
) -> tuple[DataFrame, DataFrame]:
    """(windows, ticks) of every anchor: aim, geometry, sight and shots per tick, context per window.

    ``samples`` carry spotted_by and shot, and may carry their deltas; ``sessions``: session_id, map and whatever else
    windows shall carry. Context is what the entity could know: ``last_seen_ms`` (NULL if
    never, or where ``sight_checked`` is false), ``victim_fired_ms_ago``,
    ``victim_was_running``, ``allies_alive``, ``enemies_alive``. ``look_back`` are first,
    last and stride of the ticks before an anchor that are tested for sight.
    """
    if triangles is not None and not isinstance(triangles, Cells):
        # two ray tests read it
        triangles = stored_cells(packed_cells(triangles, voxel=sight.get("voxel", 64.0)))
    windows, ticks = anchor_windows(
        samples if "yaw_speed" in samples.columns else entity_deltas(samples), anchors, pre=pre, post=post, carry=("weapon",)
    )
    windows = windows.join(sessions, "session_id", "left")
    # shots first: the ticks still lie by the keys they were found by
    ticks = mark_shots(ticks, samples.filter("shot"))
    ticks = C.add_target_geometry(ticks, samples).join(
        sessions.select("session_id", "map"), "session_id", "left"
    )
    ticks = with_sight(ticks, triangles, **sight)
    parts = [
        C.alive_counts(windows, samples),
        C.fired_recently(windows, samples.filter("shot"), span=span),
        C.ran_nearby(windows, samples, span=span, speed=audible_speed, reach=earshot),
    ]
    if triangles is None:
        blind = windows.select("window_uid").withColumns(
            {"last_seen_ms": F.lit(None).cast("double"), "sight_checked": F.lit(False)}
        )
        return C.add_context(windows, *parts, blind), ticks
    pairs = C.lookback_pairs(windows, samples, **(look_back or {})).join(
        sessions.select("session_id", "map"), "session_id", "left"
    )
    seen = line_of_sight(pairs, triangles, ["window_uid", "tick_offset"], **sight)
    checked = (
        ticks.groupBy("window_uid")
        .agg(F.max(F.col("visibility_source") == RAYS).alias("sight_checked"))
    )
    return C.add_context(windows, *parts, C.last_seen(windows, seen, F.col("visible")), checked), ticks


def labelled(rows: DataFrame, listed: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` with the three-valued label of their entity.

    ``listed``: session_id, entity_id of known offenders. In a session without any listed
    entity everyone is clean; in others only the listed are told.
    """
    known = listed.select("session_id", "entity_id", F.lit(True).alias("_listed")).distinct()
    return (
        rows.join(known, ["session_id", "entity_id"], "left")
        .join(sessions.select("session_id", "has_listed"), "session_id", "left")
        .withColumn("label", three_valued_label(F.col("_listed"), F.col("has_listed")))
        .drop("_listed", "has_listed")
    )


def window_dataset(
    windows: DataFrame, ticks: DataFrame, listed: DataFrame, sessions: DataFrame, root: str
) -> tuple[DataFrame, DataFrame]:
    """The labelled set of many sessions, stored under ``root`` and read back from there."""
    write_windows(
        labelled(windows, listed, sessions), labelled(ticks, listed, sessions), root
    )
    spark = windows.sparkSession
    return spark.read.parquet(f"{root}/windows"), spark.read.parquet(f"{root}/window_ticks")


def rebuild_features(
    spark: SparkSession, root: str, seg: Segments = Segments(), **options: float
) -> DataFrame:
    """Window features made anew from the ticks stored under ``root``, stored beside them.

    No session is cut or tested for sight again; ``options`` go to ``window_features``.
    """
    ticks = spark.read.parquet(f"{root}/window_ticks")
    window_features(ticks, seg, **options).write.mode("overwrite").parquet(f"{root}/window_features")
    return spark.read.parquet(f"{root}/window_features")


def arrival_sessions(
    samples: DataFrame,
    anchors: DataFrame,
    root: str,
    *,
    pre: int = 128,
    post: int = 32,
    burst_gap: int = K.BURST_GAP,
    radius: float = K.HEAD_RADIUS,
) -> DataFrame:
    """Every arrival of an outside population's windows: one folder per session under ``root``.

    Sessions that have a folder are not cut again, so a stopped run goes on where it was; all
    that is stored is returned. A session without windows leaves no folder and is looked at
    in the next run too.
    """

    def arrivals(part: DataFrame, kills: DataFrame) -> DataFrame:
        turned = part if "yaw_speed" in part.columns else entity_deltas(part)
        _, ticks = anchor_windows(turned, kills, pre=pre, post=post, carry=("weapon",))
        ticks = C.add_target_geometry(mark_shots(ticks, part.filter("shot")), part)
        return arrival_table(ticks, burst_gap, radius)

    # for the columns alone: windows are stored where they are cut, so no row is cut here
    like = arrivals(samples.filter(F.lit(False)), anchors.filter(F.lit(False)))
    done = finished(like, root)
    left = arrivals(pending(samples, done, "session_id"), pending(anchors, done, "session_id"))
    # few files a session, and a crowded session in several tasks
    left.hint("rebalance", "session_id").write.mode("append").partitionBy("session_id").parquet(root)
    return samples.sparkSession.read.schema(like.schema).parquet(root)
