"""The given tables seen as sessions, samples, anchors, labels and meshes.

An ``events`` row becomes one sample of one entity: ten entities share a session,
five to a side, and an entity's n-th event is its tick n.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.labels import three_valued_label
from sightline.operators.features import Segments
from sightline.operators.joins import anchor_windows
from sightline.operators.motion import entity_deltas
from sightline.operators.ordered import CHUNK_SECONDS, number_rows, time_chunk
from sightline.operators.spatial import Cells, packed_cells, stored_cells
from sightline.session import as_utc, ensure_checkpoint_dir
from sightline.sources.stored import read_bucketed, write_bucketed

PRE, POST = 8, 4
SEGMENTS = Segments(idle=(-8, -5), engage=(-4, 0), after=(1, 4))
BURST_GAP = 2
RADIUS = 200.0
ROUND_TICKS = 16
FREEZE_TICKS = 3
SPAN = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, as_utc(F.col(field.name)))
    return df


def _session(user: Column) -> Column:
    return F.floor(user / 10).cast("long")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as given, with their place in their entity's series as ``tick``."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props"
    )
    return number_rows(
        events, ["user_id"], time_chunk("ts", CHUNK_SECONDS), ["ts", "event_id"], "tick"
    ).withColumn("seq", F.col("tick"))


def _motion(numbered: DataFrame) -> DataFrame:
    """What angle changes are made from."""
    user, value = F.col("user_id"), F.col("value")
    return numbered.withColumns(
        {
            "session_id": _session(user),
            "entity_id": user,
            "yaw": F.pmod(value * 7, F.lit(360.0)) - 180,
            "pitch": F.pmod(value * 3, F.lit(178.0)) - 89,
            "is_alive": F.col("event_type") != "error",
            "is_freeze": F.col("event_type") == "signup",
        }
    )


_DELTAS = ("d_tick", "d_yaw", "d_pitch", "yaw_speed", "pitch_speed")


def _as_samples(numbered: DataFrame) -> DataFrame:
    """Numbered events as samples; what has been added to them stays behind."""
    user, value = F.col("user_id"), F.col("value")
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    weapons = F.array(*[F.lit(w) for w in ("awp", "ak47", "knife", "m4a1", "deagle")])
    return _motion(numbered).select(
        "session_id",
        "entity_id",
        "ts",
        "event_id",
        "yaw",
        "pitch",
        value.alias("x"),
        (F.col("event_id") % 1000).cast("double").alias("y"),
        ((F.col("event_id") % 7) * 10).cast("double").alias("z"),
        F.when(user % 10 >= 5, 3).otherwise(2).alias("team"),
        "is_alive",
        "is_freeze",
        (F.col("event_type") == "click").alias("shot"),
        (F.col("event_type") == "purchase").alias("anchor"),
        "event_type",
        (_session(user) * 10 + (user + 5) % 10).alias("target_id"),
        F.when(
            F.col("event_id") % 3 != 0,
            F.array(_session(user) * 10 + (user + 5) % 10),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("spotted_by"),
        k.alias("health"),
        F.element_at(weapons, k % 5 + 1).alias("weapon"),
        F.concat(F.lit("name"), (user * 7 + k % 2).cast("string")).alias("name"),
        "tick",
        "seq",
        F.floor(F.col("tick") / ROUND_TICKS).cast("int").alias("round"),
        *[c for c in _DELTAS if c in numbered.columns],
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_samples(_numbered(spark, sf_dir))


#: (application, table folder, table, files as they were) to what was made of that table.
_MADE: dict[tuple, object] = {}


def _made_once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives for a table: once per application and version of the table's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        f"{sf_dir}/{name}.parquet"
    )
    seen = files.select("path", "modificationTime", "length").orderBy("path").collect()
    version = tuple((r.path, r.modificationTime, r.length) for r in seen)
    key = (spark.sparkContext.applicationId, sf_dir, name, version)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table as ingest leaves it: with angle changes and speeds, bucketed by its keys.

    Readers share it and read only their columns and rows; joins on exact ticks read it
    bucket by bucket.
    """

    def make() -> str:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
        # an event is narrower than its sample, which is made of it where it is written
        turned = entity_deltas(_motion(_numbered(spark, sf_dir)))
        given = ["event_id", "ts", "user_id", "event_type", "value", "props", "tick", "seq"]
        write_bucketed(
            turned.select("session_id", "entity_id", *given, *_DELTAS), path, finish=_as_samples
        )
        return path

    return read_bucketed(spark, _made_once(spark, sf_dir, "events", make))


def deltas(s: DataFrame) -> DataFrame:
    """Samples with their angle changes: stored ones have them."""
    return s if "yaw_speed" in s.columns else entity_deltas(s)


def anchors(s: DataFrame) -> DataFrame:
    return s.filter("anchor").select(
        "session_id", "entity_id", "target_id", "tick", "weapon"
    )


def windows(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return anchor_windows(deltas(s), anchors(s), pre=PRE, post=POST, carry=("weapon",))


def label_of(entity: Column, session: Column) -> Column:
    """Every seventh entity is listed; odd sessions are known to hold a listed one."""
    return three_valued_label(entity % 7 == 0, session % 2 == 1)


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", label_of(F.col("entity_id"), F.col("session_id")))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(
        _session(F.col("user_id")).alias("session_id"),
        F.col("user_id").alias("entity_id"),
    )
    return with_label(users.distinct())


#: The same samples for DuckDB; every oracle below starts from it.
SAMPLES_SQL = """
raw AS (
  SELECT CAST(user_id // 10 AS BIGINT) AS session_id, user_id AS entity_id, ts, event_id,
    (value * 7) % 360 - 180 AS yaw, (value * 3) % 178 - 89 AS pitch,
    value AS x, CAST(event_id % 1000 AS DOUBLE) AS y,
    CAST((event_id % 7) * 10 AS DOUBLE) AS z,
    CASE WHEN user_id % 10 >= 5 THEN 3 ELSE 2 END AS team,
    event_type <> 'error' AS is_alive, event_type = 'signup' AS is_freeze,
    event_type = 'click' AS shot, event_type = 'purchase' AS anchor, event_type,
    (user_id // 10) * 10 + (user_id + 5) % 10 AS target_id,
    event_id % 3 <> 0 AS spotted_by_target,
    CAST(regexp_extract(props, '\\d+') AS INTEGER) AS health,
    list_extract(['awp','ak47','knife','m4a1','deagle'],
      CAST(regexp_extract(props, '\\d+') AS INTEGER) % 5 + 1) AS weapon,
    'name' || (user_id * 7 + CAST(regexp_extract(props, '\\d+') AS INTEGER) % 2) AS name,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick
  FROM events),
samples AS (
  SELECT *, CAST(tick // 16 AS INTEGER) AS round,
    CASE WHEN entity_id % 7 = 0 THEN 'cheater'
         WHEN session_id % 2 = 1 THEN 'unknown' ELSE 'clean' END AS label
  FROM raw)"""

DELTAS_SQL = (
    SAMPLES_SQL
    + """,
lagged AS (
  SELECT *,
    tick - lag(tick) OVER w AS d_tick,
    CASE WHEN (yaw - lag(yaw) OVER w + 180) % 360 < 0
      THEN ((yaw - lag(yaw) OVER w + 180) % 360 + 360) % 360
      ELSE (yaw - lag(yaw) OVER w + 180) % 360 END - 180 AS d_yaw,
    pitch - lag(pitch) OVER w AS d_pitch,
    is_alive AND lag(is_alive) OVER w AND NOT is_freeze
      AND NOT lag(is_freeze) OVER w AS live
  FROM samples WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
deltas AS (
  SELECT *,
    CASE WHEN live AND d_tick > 0 THEN abs(d_yaw) / d_tick * 64 END AS yaw_speed,
    CASE WHEN live AND d_tick > 0 THEN abs(d_pitch) / d_tick * 64 END AS pitch_speed
  FROM lagged)"""
)

WINDOWS_SQL = (
    DELTAS_SQL
    + """,
kills AS (
  SELECT session_id, entity_id, target_id, tick, weapon,
    session_id || '#' || (row_number() OVER (
      PARTITION BY session_id ORDER BY tick, entity_id, target_id) - 1) AS window_uid
  FROM samples WHERE anchor AND entity_id <> target_id),
cut AS (
  SELECT k.window_uid, k.tick AS anchor_tick, d.tick - k.tick AS tick_offset,
    (d.tick - k.tick) / 64.0 * 1000 AS t_ms, k.weapon AS anchor_weapon, d.*,
    count(*) OVER (PARTITION BY k.window_uid) AS n_rows
  FROM kills k JOIN deltas d ON d.session_id = k.session_id
   AND d.entity_id = k.entity_id AND d.tick BETWEEN k.tick - 8 AND k.tick + 4),
wt AS (SELECT * FROM cut WHERE n_rows = 13),
win AS (SELECT k.* FROM kills k WHERE window_uid IN (SELECT window_uid FROM wt))"""
)


# --- meshes -----------------------------------------------------------------------


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangle per embedding, spread over the samples' positions at eye height."""
    e = table(spark, sf_dir, "embeddings")

    def dim(i: int) -> Column:
        return F.element_at("embedding", i).cast("double")

    centre = [250 + dim(1) * 1500, 500 + dim(2) * 3000, 94 + dim(3) * 150]
    corners = {}
    for a, c, p, q in zip("xyz", centre, (4, 5, 6), (7, 8, 9), strict=True):
        corners[f"a{a}"] = c
        corners[f"b{a}"] = c + dim(p) * 150
        corners[f"c{a}"] = c + dim(q) * 150
    return e.select(
        (F.col("vec_id") % 2).alias("map"),
        F.col("vec_id").alias("tri_id"),
        *[c.alias(n) for n, c in corners.items()],
    )


def mesh_cells(spark: SparkSession, sf_dir: str) -> Cells:
    """The mesh packed by its cells, as it is stored once per version of its table."""
    make = lambda: stored_cells(packed_cells(mesh(spark, sf_dir), voxel=VOXEL))
    return _made_once(spark, sf_dir, "embeddings", make)


def with_map(df: DataFrame) -> DataFrame:
    return df.withColumn("map", F.col("session_id") % 2)


VOXEL = 60.0

MESH_SQL = """
ev AS (SELECT vec_id, vec_id % 2 AS map, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
tri AS (SELECT map, vec_id AS tri_id,
    250 + e[1] * 1500 AS ax, 500 + e[2] * 3000 AS ay, 94 + e[3] * 150 AS az,
    250 + e[1] * 1500 + e[4] * 150 AS bx, 500 + e[2] * 3000 + e[5] * 150 AS by_, 94 + e[3] * 150 + e[6] * 150 AS bz,
    250 + e[1] * 1500 + e[7] * 150 AS cx, 500 + e[2] * 3000 + e[8] * 150 AS cy, 94 + e[3] * 150 + e[9] * 150 AS cz
  FROM ev),
tedge AS (SELECT *, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM tri)"""


def blocked_sql(source: str, keys: str, near: float = 8.0) -> str:
    """CTEs ``hit`` and ``blocked`` by brute force over ``source`` (map, o*, d*, dist)."""
    return f"""
crossed AS (SELECT s.*, t.tri_id, t.ux, t.uy, t.uz, t.vx, t.vy, t.vz,
    s.dy * t.vz - s.dz * t.vy AS hx, s.dz * t.vx - s.dx * t.vz AS hy, s.dx * t.vy - s.dy * t.vx AS hz,
    s.ox - t.ax AS sx, s.oy - t.ay AS sy, s.oz - t.az AS sz
  FROM {source} s JOIN tedge t ON s.map = t.map),
det AS (SELECT *, ux * hx + uy * hy + uz * hz AS a,
    sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM crossed),
hit AS (SELECT *, (sx * hx + sy * hy + sz * hz) / a AS u, (dx * qx + dy * qy + dz * qz) / a AS v,
    (vx * qx + vy * qy + vz * qz) / a AS t FROM det WHERE abs(a) > 1e-12),
blocked AS (SELECT DISTINCT {keys} FROM hit
  WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 0 AND t * dist < dist - {near})"""
