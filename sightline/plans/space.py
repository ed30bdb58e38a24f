"""Queries over positions: line of sight, marks, grids, floors, reachability."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.operators import context as C
from sightline.operators import evaluate as E
from sightline.operators import sessions as W
from sightline.operators import spatial as S
from sightline.operators.joins import state_of
from sightline.plans import adapters as A
from sightline.plans import windows as Q
from sightline.plans.registry import query
from sightline.session import ensure_checkpoint_dir, staged
from sightline.sources.sinks import write_windows

_SHOTS_SQL = f"""
seg AS (SELECT w.window_uid, w.session_id % 2 AS map, a.x AS ox, a.y AS oy, a.z + 64 AS oz,
    t.x - a.x AS dx, t.y - a.y AS dy, t.z - a.z AS dz,
    sqrt(power(t.x - a.x, 2) + power(t.y - a.y, 2) + power(t.z - a.z, 2)) AS dist
  FROM win w JOIN samples a USING (session_id, entity_id, tick)
  JOIN samples t ON t.session_id = w.session_id AND t.entity_id = w.target_id AND t.tick = w.tick),
{A.MESH_SQL}, {A.blocked_sql("seg", "window_uid")}"""


def anchor_segments(s):
    windows = A.windows(s)[0]
    here = state_of(windows, s, "entity_id", {c: c for c in "xyz"}, how="inner")
    there = {c: f"target_{c}" for c in "xyz"}
    return A.with_map(state_of(here, s, "target_id", there, how="inner"))


@query(
    "window_uid:s visible:b",
    f"""WITH {A.WINDOWS_SQL}, {_SHOTS_SQL}
SELECT window_uid, dist <= 8 OR window_uid NOT IN (SELECT window_uid FROM blocked) AS visible FROM seg""",
)
def line_of_sight(spark, d):
    return S.line_of_sight(
        anchor_segments(A.stored_samples(spark, d)), A.mesh_cells(spark, d), ["window_uid"], voxel=A.VOXEL
    )


_SIGHT_SQL = f"""
live AS (SELECT *, session_id % 2 AS map FROM samples WHERE tick % 4 = 0 AND is_alive AND NOT is_freeze),
pr AS (SELECT a.session_id, a.map, a.tick, a.round, a.team, a.entity_id, b.entity_id AS enemy_id,
    a.x, a.y, a.yaw, a.pitch, b.x AS target_x, b.y AS target_y,
    a.x AS ox, a.y AS oy, a.z + 64 AS oz, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
    sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2)) AS dist
  FROM live a JOIN live b ON a.session_id = b.session_id AND a.tick = b.tick AND a.team <> b.team),
{A.MESH_SQL}, {A.blocked_sql("pr", "session_id, tick, entity_id, enemy_id")},
sight AS (SELECT pr.*, CASE WHEN dist > 0 THEN degrees(acos(greatest(-1.0, least(1.0,
      (cos(radians(yaw)) * cos(radians(pitch)) * dx + sin(radians(yaw)) * cos(radians(pitch)) * dy
       - sin(radians(pitch)) * dz) / dist)))) END AS target_angle,
    dist <= 8 OR b.tick IS NULL AS clear
  FROM pr LEFT JOIN blocked b ON b.session_id = pr.session_id AND b.tick = pr.tick
   AND b.entity_id = least(pr.entity_id, pr.enemy_id) AND b.enemy_id = greatest(pr.entity_id, pr.enemy_id)),
sees AS (SELECT *, clear AND coalesce(target_angle <= 53, false) AS sees FROM sight)"""


def sightings(spark, d, s):
    live = S.live_samples(A.with_map(s))
    return S.sightings(live, A.mesh_cells(spark, d), voxel=A.VOXEL)


@query(
    "session_id:l tick:l entity_id:l sees:l",
    f"""WITH {A.SAMPLES_SQL}, {_SIGHT_SQL},
ro AS (SELECT session_id, entity_id, row_number() OVER (PARTITION BY session_id ORDER BY entity_id) - 1 AS i
  FROM (SELECT DISTINCT session_id, entity_id FROM samples))
SELECT s.session_id, s.tick, s.entity_id, sum(1 << ro.i) AS sees FROM sees s
JOIN ro ON ro.session_id = s.session_id AND ro.entity_id = s.enemy_id WHERE s.sees GROUP BY 1, 2, 3""",
)
def mutual_visibility_mask(spark, d):
    s = A.stored_samples(spark, d)
    return S.visibility_mask(sightings(spark, d, s), S.roster_index(s))


_MARK_SQL = """
team AS (SELECT session_id, tick, team, enemy_id, bool_or(sees) AS team_sees FROM sees GROUP BY 1, 2, 3, 4),
hid AS (SELECT s.*, degrees(atan2(target_y - y, target_x - x)) AS bearing FROM sees s
  JOIN team t USING (session_id, tick, team, enemy_id) WHERE NOT team_sees AND target_angle < 90),
st AS (SELECT *, CASE WHEN tick - lag(tick) OVER w = 4 THEN 0 ELSE 1 END AS st FROM hid
  WINDOW w AS (PARTITION BY session_id, entity_id, enemy_id ORDER BY tick)),
rn AS (SELECT *, sum(st) OVER (PARTITION BY session_id, entity_id, enemy_id ORDER BY tick) AS run FROM st),
fb AS (SELECT *, first_value(bearing) OVER (PARTITION BY session_id, entity_id, enemy_id, run ORDER BY tick) AS fb FROM rn),
ex AS (SELECT *, ((bearing - fb + 180) % 360 + 360) % 360 - 180 AS off FROM fb),
marks AS (SELECT session_id, entity_id, enemy_id, min(tick) AS start_tick, max(tick) AS end_tick,
    arg_min(round, tick) AS round, max(off) - min(off) AS turn FROM ex
  GROUP BY session_id, entity_id, enemy_id, run HAVING max(tick) - min(tick) + 4 >= 8 AND max(off) - min(off) >= 10)"""


def marks(spark, d):
    return S.hidden_marks(
        sightings(spark, d, A.stored_samples(spark, d)),
        angle=90.0,
        min_ticks=8,
    )


@query(
    "session_id:l entity_id:l enemy_id:l round:l start_tick:l end_tick:l turn:d4",
    f"WITH {A.SAMPLES_SQL}, {_SIGHT_SQL}, {_MARK_SQL} SELECT * FROM marks",
)
def consecutive_pair_runs(spark, d):
    return marks(spark, d)


@query(
    "label:s entities:l with_mark:d median:d p90:d passes:b",
    f"""WITH {A.SAMPLES_SQL}, {_SIGHT_SQL}, {_MARK_SQL},
ro AS (SELECT DISTINCT session_id, entity_id, label FROM samples),
m AS (SELECT ro.*, count(k.enemy_id) AS marks FROM ro LEFT JOIN marks k USING (session_id, entity_id) GROUP BY 1, 2, 3),
g AS (SELECT label, count(*) AS entities, avg((marks > 0)::INT) AS with_mark, quantile_cont(marks, 0.5) AS median,
   quantile_cont(marks, 0.9) AS p90 FROM m GROUP BY 1)
SELECT *, CASE WHEN label = 'clean' THEN with_mark <= 0.1
  ELSE with_mark >= 2 * (SELECT with_mark FROM g WHERE label = 'clean') END AS passes FROM g""",
)
def marks_gate(spark, d):
    found = (
        marks(spark, d)
        .groupBy("session_id", "entity_id")
        .agg(F.count(F.lit(1)).alias("marks"))
    )
    per_entity = (
        A.roster(spark, d)
        .join(found, ["session_id", "entity_id"], "left")
        .withColumn("marks", F.coalesce("marks", F.lit(0)))
    )
    return E.marks_gate(per_entity)


@query(
    "window_uid:s last_seen_ms:d",
    f"""WITH {A.WINDOWS_SQL},
offs AS (SELECT unnest(range(-40, -7, 4)) AS tick_offset),
seg AS (SELECT w.window_uid, o.tick_offset, w.session_id % 2 AS map, a.x AS ox, a.y AS oy, a.z + 64 AS oz,
    t.x - a.x AS dx, t.y - a.y AS dy, t.z - a.z AS dz,
    sqrt(power(t.x - a.x, 2) + power(t.y - a.y, 2) + power(t.z - a.z, 2)) AS dist
  FROM win w CROSS JOIN offs o
  JOIN samples a ON a.session_id = w.session_id AND a.entity_id = w.entity_id AND a.tick = w.tick + o.tick_offset
  JOIN samples t ON t.session_id = w.session_id AND t.entity_id = w.target_id AND t.tick = w.tick + o.tick_offset),
{A.MESH_SQL}, {A.blocked_sql("seg", "window_uid, tick_offset")},
f AS (SELECT s.window_uid, max(s.tick_offset) AS off FROM seg s LEFT JOIN blocked b
    ON b.window_uid = s.window_uid AND b.tick_offset = s.tick_offset
  WHERE s.dist <= 8 OR b.tick_offset IS NULL GROUP BY 1)
SELECT w.window_uid, -f.off / 64.0 * 1000 AS last_seen_ms FROM win w LEFT JOIN f USING (window_uid)""",
)
def last_seen(spark, d):
    s = A.stored_samples(spark, d)
    windows = A.windows(s)[0]
    pairs = C.lookback_pairs(windows, s, first=-40, last=-8, stride=4)
    seen = S.line_of_sight(
        A.with_map(pairs),
        A.mesh_cells(spark, d),
        ["window_uid", "tick_offset"],
        voxel=A.VOXEL,
    )
    return C.last_seen(windows, seen, F.col("visible"))


_SESSION_SQL = f"""
offs AS (SELECT unnest(range(-40, -7, 4)) AS tick_offset),
spots AS (SELECT window_uid, session_id, entity_id, target_id, tick + tick_offset AS at, tick_offset, 'back' AS kind FROM win CROSS JOIN offs
  UNION ALL SELECT window_uid, session_id, entity_id, target_id, tick, tick_offset, 'tick' FROM wt),
seg AS (SELECT w.window_uid, w.kind, w.tick_offset, w.session_id % 2 AS map, a.x AS ox, a.y AS oy, a.z + 64 AS oz,
    t.x - a.x AS dx, t.y - a.y AS dy, t.z - a.z AS dz,
    sqrt(power(t.x - a.x, 2) + power(t.y - a.y, 2) + power(t.z - a.z, 2)) AS dist
  FROM spots w
  JOIN samples a ON a.session_id = w.session_id AND a.entity_id = w.entity_id AND a.tick = w.at
  JOIN samples t ON t.session_id = w.session_id AND t.entity_id = w.target_id AND t.tick = w.at
  WHERE w.session_id % 2 = 0),
{A.MESH_SQL}, {A.blocked_sql("seg", "window_uid, kind, tick_offset")},
clear AS (SELECT s.window_uid, s.kind, s.tick_offset FROM seg s
  ANTI JOIN (SELECT b.* FROM blocked b JOIN seg USING (window_uid, kind, tick_offset) WHERE dist > 8) USING (window_uid, kind, tick_offset)),
rays AS (SELECT window_uid, -max(tick_offset) FILTER (kind = 'back') / 64.0 * 1000 AS last_seen_ms,
  count(*) FILTER (kind = 'tick') AS seen FROM clear GROUP BY 1),
flags AS (SELECT w.window_uid, count(*) FILTER (t.spotted_by_target) AS seen
  FROM wt w JOIN samples t ON t.session_id = w.session_id AND t.entity_id = w.target_id AND t.tick = w.tick GROUP BY 1),
shots AS (SELECT window_uid, count(*) FILTER (shot AND weapon <> 'knife') AS shots FROM wt GROUP BY 1),
al AS (SELECT session_id, tick, team, count(*) AS alive FROM samples WHERE is_alive GROUP BY 1, 2, 3),
ac AS (SELECT w.window_uid, a.alive AS allies_alive, e.alive AS enemies_alive
  FROM win w JOIN samples s USING (session_id, entity_id, tick)
  LEFT JOIN al a ON a.session_id = w.session_id AND a.tick = w.tick AND a.team = s.team
  JOIN al e ON e.session_id = w.session_id AND e.tick = w.tick AND e.team <> s.team),
fr AS (SELECT w.window_uid, (max(w.tick) - max(s.tick)) / 64.0 * 1000 AS victim_fired_ms_ago FROM win w JOIN samples s
   ON s.session_id = w.session_id AND s.entity_id = w.target_id AND s.shot AND s.tick BETWEEN w.tick - 12 AND w.tick GROUP BY 1),
mv AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) * 64 AS speed
  FROM samples WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
rn AS (SELECT DISTINCT w.window_uid FROM win w
  JOIN mv v ON v.session_id = w.session_id AND v.entity_id = w.target_id AND v.tick BETWEEN w.tick - 12 AND w.tick
  JOIN samples a ON a.session_id = w.session_id AND a.entity_id = w.entity_id AND a.tick = v.tick
  WHERE v.speed > 20000 AND sqrt(power(v.x - a.x, 2) + power(v.y - a.y, 2) + power(v.z - a.z, 2)) < 150)"""


def _session_windows(spark, d):
    """Windows and ticks with sight by rays on even sessions and by the flag on odd ones."""
    s = A.stored_samples(spark, d)
    sessions = A.with_map(s.select("session_id").distinct())
    return W.session_windows(
        s,
        A.anchors(s),
        sessions,
        S.Cells(A.mesh_cells(spark, d).rows.filter("_map = 0"), A.VOXEL),
        pre=A.PRE,
        post=A.POST,
        look_back={"first": -40, "last": -8, "stride": 4},
        span=A.SPAN,
        audible_speed=20000.0,
        earshot=150.0,
        voxel=A.VOXEL,
    )


@query(
    "window_uid:s map:l sight_checked:b last_seen_ms:d victim_fired_ms_ago:d "
    "victim_was_running:b allies_alive:l enemies_alive:l",
    f"""WITH {A.WINDOWS_SQL}, {_SESSION_SQL}
SELECT w.window_uid, w.session_id % 2 AS map, w.session_id % 2 = 0 AS sight_checked, r.last_seen_ms,
  fr.victim_fired_ms_ago, rn.window_uid IS NOT NULL AS victim_was_running, ac.allies_alive, ac.enemies_alive
FROM win w LEFT JOIN rays r USING (window_uid) LEFT JOIN fr USING (window_uid) LEFT JOIN rn USING (window_uid)
LEFT JOIN ac USING (window_uid)""",
)
def session_windows(spark, d):
    return _session_windows(spark, d)[0]


@query(
    "window_uid:s label:s visibility_source:s seen:l shots:l",
    f"""WITH {A.WINDOWS_SQL}, {_SESSION_SQL},
lab AS (SELECT DISTINCT window_uid, label FROM wt)
SELECT window_uid, label, CASE WHEN w.session_id % 2 = 0 THEN 'raycast' ELSE 'spotting_flag' END AS visibility_source,
  coalesce(CASE WHEN w.session_id % 2 = 0 THEN r.seen ELSE f.seen END, 0) AS seen, shots
FROM win w LEFT JOIN rays r USING (window_uid) LEFT JOIN flags f USING (window_uid)
JOIN shots USING (window_uid) JOIN lab USING (window_uid)""",
)
def window_dataset(spark, d):
    """The labelled set, stored and read back, summed per window."""
    windows, ticks = _session_windows(spark, d)
    roster = windows.select("session_id", "entity_id").distinct()
    listed = roster.filter("entity_id % 7 = 0")
    sessions = roster.select(
        "session_id", (F.col("session_id") % 2 == 1).alias("has_listed")
    ).distinct()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dataset-{uuid.uuid4().hex}"
    _, stored = W.window_dataset(windows, ticks, listed, sessions, root)
    return stored.groupBy("window_uid", "label", "visibility_source").agg(
        F.count_if("target_visible").alias("seen"), F.count_if("shot").alias("shots")
    )


@query(
    "window_uid:s session_id:l entity_id:l weapon:s arrived:l opening:l dps:d4 closure:d4 speed_at_kill:d",
    f"""WITH {A.WINDOWS_SQL}, {Q.GEO_SQL}, {Q.ARRIVAL_SQL}
SELECT k.window_uid, k.session_id, k.entity_id, k.anchor_weapon AS weapon, a.tick_offset AS arrived, a.opening, a.sweep AS dps,
  a.closure, k.yaw_speed AS speed_at_kill
FROM (SELECT * FROM ar2 WHERE tick_offset = 0) k
LEFT JOIN (SELECT * FROM ar2 WHERE enters AND tick_offset <= opening) a USING (window_uid)""",
)
def arrival_sessions(spark, d):
    """Arrivals by session in two runs: even sessions first, then all, of which these are skipped."""
    s = A.stored_samples(spark, d)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    options = {"pre": A.PRE, "post": A.POST, "burst_gap": A.BURST_GAP, "radius": A.RADIUS}
    W.arrival_sessions(s.filter("session_id % 2 = 0"), A.anchors(s), root, **options)
    return W.arrival_sessions(s, A.anchors(s), root, **options)


@query(
    "window_uid:s arrival_shot:b arrival_delay_ms:d straightness:d speed_at_kill:d",
    f"""WITH {A.WINDOWS_SQL}, {Q.GEO_SQL}, {Q.ARRIVAL_SQL}, {Q.AIM_SQL}
SELECT window_uid, opening = arrived AS arrival_shot, (opening - arrived) / 64.0 * 1000 AS arrival_delay_ms,
  straightness, speed_at_kill FROM arr JOIN aim USING (window_uid)""",
)
def rebuilt_features(spark, d):
    """Features made from the stored ticks of a window set."""
    windows, _ = A.windows(A.stored_samples(spark, d))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    write_windows(windows, Q.shot_ticks(A.stored_samples(spark, d)), root)
    return W.rebuild_features(spark, root, A.SEGMENTS, burst_gap=A.BURST_GAP, radius=A.RADIUS)


_BOX_SQL = """
pl AS (SELECT session_id % 2 AS map, x, y, z FROM samples WHERE is_alive),
bx0 AS (SELECT map, quantile_cont(x, 0.001) AS x0, quantile_cont(x, 0.999) AS x1,
    quantile_cont(y, 0.001) AS y0, quantile_cont(y, 0.999) AS y1 FROM pl GROUP BY 1),
bx AS (SELECT map, (x0 + x1) / 2 - side / 2 AS x_min, (y0 + y1) / 2 + side / 2 AS y_max, side
  FROM (SELECT *, greatest(x1 - x0, y1 - y0) * 1.1 AS side FROM bx0)),
cells AS (SELECT pl.map,
    greatest(0, least(31, CAST(trunc((y_max - y) / side * 32) AS BIGINT))) AS "row",
    greatest(0, least(31, CAST(trunc((x - x_min) / side * 32) AS BIGINT))) AS col,
    count(*) AS n, avg(z) AS height FROM pl JOIN bx USING (map) GROUP BY 1, 2, 3)"""


def _places(spark, d):
    return A.with_map(A.samples(spark, d)).filter("is_alive").select("map", "x", "y", "z")


@query(
    "map:l row:l col:l n:l height:d",
    f"WITH {A.SAMPLES_SQL}, {_BOX_SQL} SELECT * FROM cells WHERE n >= 2",
)
def occupancy_grid(spark, d):
    places = staged(_places(spark, d))
    return S.occupancy_grid(places, S.bounding_square(places), cells=32, min_samples=2)


@query(
    "map:l iou:d a_covered:d b_covered:d",
    f"""WITH {A.SAMPLES_SQL}, {_BOX_SQL}, {A.MESH_SQL},
a AS (SELECT map, "row", col FROM cells WHERE n >= 2),
b AS (SELECT DISTINCT map, greatest(0, least(31, CAST(trunc((y_max - ay) / side * 32) AS BIGINT))) AS "row",
    greatest(0, least(31, CAST(trunc((ax - x_min) / side * 32) AS BIGINT))) AS col FROM tri JOIN bx USING (map)),
j AS (SELECT coalesce(a.map, b.map) AS map, a.map IS NOT NULL AS ina, b.map IS NOT NULL AS inb
  FROM a FULL JOIN b ON a.map = b.map AND a."row" = b."row" AND a.col = b.col)
SELECT map, count(*) FILTER (ina AND inb) / count(*) AS iou,
  count(*) FILTER (ina AND inb) / count(*) FILTER (ina) AS a_covered,
  count(*) FILTER (ina AND inb) / count(*) FILTER (inb) AS b_covered FROM j GROUP BY 1""",
)
def grid_overlap(spark, d):
    places = staged(_places(spark, d))
    box = S.bounding_square(places)
    walked = S.occupancy_grid(places, box, cells=32, min_samples=2)
    corners = A.mesh(spark, d).select(
        "map", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")
    )
    meshed = S.occupancy_grid(corners, box, cells=32)
    return S.grid_overlap(walked, meshed)


@query(
    "map:l split:d share:d",
    f"""WITH {A.SAMPLES_SQL},
pl AS (SELECT session_id % 2 AS map, CAST(floor(x / 64) AS BIGINT) AS gx, CAST(floor(y / 64) AS BIGINT) AS gy, z * 5 AS z
  FROM samples WHERE is_alive),
sp AS (SELECT map, gx, gy, quantile_cont(z, 0.9) - quantile_cont(z, 0.1) > 230 AS stacked
  FROM pl GROUP BY 1, 2, 3 HAVING count(*) >= 10),
sh AS (SELECT map, avg(stacked::INT) AS share FROM sp GROUP BY 1),
h AS (SELECT pl.* FROM pl JOIN sp USING (map, gx, gy) WHERE stacked),
e AS (SELECT map, min(z) AS z0, max(z) AS z1, (max(z) - min(z)) / 256 AS w FROM h GROUP BY 1),
b AS (SELECT h.map, z0, w, least(255, CAST(floor((z - z0) / w) AS INTEGER)) AS bin, count(*) AS n FROM h JOIN e USING (map) GROUP BY ALL),
f AS (SELECT e.map, g.bin, e.z0 + (g.bin + 0.5) * e.w AS c, coalesce(b.n, 0) AS n
  FROM e CROSS JOIN (SELECT unnest(range(256)) AS bin) g LEFT JOIN b ON b.map = e.map AND b.bin = g.bin),
c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS below, sum(n * c) OVER w AS bs,
    CAST(sum(n) OVER (PARTITION BY map) AS DOUBLE) AS total, sum(n * c) OVER (PARTITION BY map) AS ts
  FROM f WINDOW w AS (PARTITION BY map ORDER BY bin)),
s AS (SELECT *, power(ts * below / total - bs, 2) / nullif(below * (total - below), 0) AS spread FROM c),
m AS (SELECT *, max(spread) OVER (PARTITION BY map) AS best FROM s),
o AS (SELECT map, (arg_min(c, bin) + arg_max(c, bin)) / 2 AS split FROM m WHERE spread >= best * 0.999 GROUP BY 1)
SELECT sh.map, CASE WHEN share >= 0.1 THEN split END AS split, share FROM sh LEFT JOIN o USING (map)""",
)
def storey_split(spark, d):
    places = staged(_places(spark, d).withColumn("z", F.col("z") * 5))
    return S.storey_split(places, min_samples=10, storey=230.0)


FLOOR_CELL = 8.0
_FLOOR_SQL = f"""{A.MESH_SQL},
nrm AS (SELECT *, ux * vy - uy * vx AS nz, sqrt(power(uy * vz - uz * vy, 2) + power(uz * vx - ux * vz, 2)
    + power(ux * vy - uy * vx, 2)) AS nl FROM tedge),
rg AS (SELECT *, unnest(range(CAST(ceil(least(ax, bx, cx) / 8 - 0.5) AS BIGINT),
      CAST(floor(greatest(ax, bx, cx) / 8 - 0.5) AS BIGINT) + 1)) AS col FROM nrm),
rg2 AS (SELECT *, unnest(range(CAST(ceil(least(ay, by_, cy) / 8 - 0.5) AS BIGINT),
      CAST(floor(greatest(ay, by_, cy) / 8 - 0.5) AS BIGINT) + 1)) AS "row" FROM rg),
pt AS (SELECT *, (col + 0.5) * 8 - ax AS px, ("row" + 0.5) * 8 - ay AS py FROM rg2 WHERE nz <> 0),
bc AS (SELECT *, (px * vy - py * vx) / nz AS s, (ux * py - uy * px) / nz AS t FROM pt),
ht AS (SELECT map, "row", col, tri_id, az + s * uz + t * vz AS z, nz / nl AS up FROM bc WHERE s >= 0 AND t >= 0 AND s + t <= 1),
ab AS (SELECT *, lead(z) OVER (PARTITION BY map, "row", col ORDER BY z, tri_id) AS above FROM ht),
floors AS (SELECT map, "row", col, z FROM ab WHERE up > 0.3 AND (above IS NULL OR above - z >= 20))"""


def _floors(spark, d):
    return S.surface_floors(
        A.mesh(spark, d), cell=FLOOR_CELL, headroom=20.0, normal_z=0.3
    )


@query("map:l row:l col:l z:d", f"WITH {_FLOOR_SQL} SELECT * FROM floors")
def surface_floors(spark, d):
    return _floors(spark, d)


def _moves(spark, d, floors):
    return S.floor_moves(
        floors, A.mesh(spark, d), cell=FLOOR_CELL, waist=6.0, voxel=A.VOXEL
    )


_MOVES_SQL = f"""{_FLOOR_SQL},
dirs AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dr, dc)),
cand AS (SELECT f.map, f."row", f.col, f.z, dr, dc, g.z AS z2, row_number() OVER (
    PARTITION BY f.map, f."row", f.col, f.z, dr, dc ORDER BY abs(g.z - f.z), g.z) AS rn
  FROM floors f CROSS JOIN dirs JOIN floors g ON g.map = f.map AND g."row" = f."row" + dr AND g.col = f.col + dc),
mv AS (SELECT *, "row" + dr AS row2, col + dc AS col2, (col + 0.5) * 8 AS ox, ("row" + 0.5) * 8 AS oy, z + 6 AS oz,
    CAST(dc * 8 AS DOUBLE) AS dx, CAST(dr * 8 AS DOUBLE) AS dy, z2 - z AS dz, sqrt(64 + power(z2 - z, 2)) AS dist
  FROM cand WHERE rn = 1 AND z2 - z <= 18),
{A.blocked_sql("mv", "map, row, col, z, row2, col2, z2", 0.0).replace("map, row, col", 'map, "row", col')},
moves AS (SELECT mv.* FROM mv ANTI JOIN blocked b ON b.map = mv.map AND b."row" = mv."row" AND b.col = mv.col
    AND b.z = mv.z AND b.row2 = mv.row2 AND b.col2 = mv.col2 AND b.z2 = mv.z2)"""


@query(
    "map:l row:l col:l z:d row2:l col2:l z2:d",
    f"WITH {_MOVES_SQL} SELECT * FROM moves",
)
def floor_moves(spark, d):
    moves = _moves(spark, d, staged(_floors(spark, d)))
    return moves.select(
        "src.*",
        F.col("dst.row").alias("row2"),
        F.col("dst.col").alias("col2"),
        F.col("dst.z").alias("z2"),
    )


@query(
    "map:l row:l col:l z:d",
    f"""WITH RECURSIVE {_MOVES_SQL},
sd AS (SELECT DISTINCT map, CAST(floor(ay / 8) AS BIGINT) AS "row", CAST(floor(ax / 8) AS BIGINT) AS col, az AS sz
  FROM tri WHERE az > 100),
sf AS (SELECT DISTINCT map, "row", col, z FROM (SELECT f.*, row_number() OVER (
    PARTITION BY f.map, f."row", f.col, sd.sz ORDER BY abs(f.z - sd.sz), f.z) AS rn, abs(f.z - sd.sz) AS gap
  FROM sd JOIN floors f USING (map, "row", col)) WHERE rn = 1 AND gap < 72),
reach AS (SELECT map, "row", col, z FROM sf UNION
  SELECT m.map, m.row2, m.col2, m.z2 FROM reach r JOIN moves m
    ON m.map = r.map AND m."row" = r."row" AND m.col = r.col AND m.z = r.z)
SELECT * FROM reach""",
)
def reachability(spark, d):
    floors = staged(_floors(spark, d))
    seeds = (
        A.mesh(spark, d)
        .filter(F.col("az") > 100)
        .select(
            "map",
            F.col("ax").alias("x"),
            F.col("ay").alias("y"),
            F.col("az").alias("z"),
        )
    )
    starts = S.seed_floors(floors, seeds, cell=FLOOR_CELL)
    return S.reachable_by_tiles(_moves(spark, d, floors), starts).select("node.*")


@query(
    "candidate:s map:l sighted_visible:d pairs_blocked:d place:l",
    f"""WITH {A.WINDOWS_SQL}, {A.MESH_SQL.replace("tedge AS", "tedge0 AS")},
tedge AS (SELECT map * 10 AS map, * EXCLUDE (map) FROM tedge0
  UNION ALL SELECT map * 10 + 1 AS map, tri_id, ay AS ax, ax AS ay, az, by_ AS bx, bx AS by_, bz, cy AS cx, cx AS cy, cz,
    uy, ux, uz, vy, vx, vz FROM tedge0),
segs AS (SELECT 'sighted' AS kind, window_uid AS segment, w.session_id % 2 AS m, a.x AS ox, a.y AS oy, a.z + 64 AS oz,
    t.x - a.x AS dx, t.y - a.y AS dy, t.z - a.z AS dz
  FROM win w JOIN samples a USING (session_id, entity_id, tick) JOIN samples t
    ON t.session_id = w.session_id AND t.entity_id = w.target_id AND t.tick = w.tick AND t.spotted_by_target
  UNION ALL SELECT 'pair', a.session_id || '/' || a.tick || '/' || a.entity_id || '/' || b.entity_id, a.session_id % 2,
    a.x, a.y, a.z + 64, b.x - a.x, b.y - a.y, b.z - a.z
  FROM samples a JOIN samples b ON a.session_id = b.session_id AND a.tick = b.tick AND a.team <> b.team
    AND a.entity_id < b.entity_id WHERE a.tick % 16 = 0 AND b.tick % 16 = 0 AND a.is_alive AND b.is_alive
    AND NOT a.is_freeze AND NOT b.is_freeze),
seg AS (SELECT *, m * 10 + c AS map, c, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM segs CROSS JOIN (VALUES (0), (1)) v(c)),
{A.blocked_sql("seg", "kind, segment, map")},
r AS (SELECT CASE WHEN s.c = 0 THEN 'as given' ELSE 'axes swapped' END AS candidate, s.m AS map, s.kind,
    s.dist <= 8 OR b.segment IS NULL AS visible
  FROM seg s LEFT JOIN blocked b ON b.kind = s.kind AND b.segment = s.segment AND b.map = s.map),
g AS (SELECT candidate, map, avg(visible::INT) FILTER (kind = 'sighted') AS sighted_visible,
    avg((NOT visible)::INT) FILTER (kind = 'pair') AS pairs_blocked FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY map ORDER BY sighted_visible + pairs_blocked DESC, candidate) AS place FROM g""",
)
def mesh_acceptance(spark, d):
    mesh = A.mesh(spark, d)
    swapped = mesh.select(
        "map",
        "tri_id",
        *[
            F.col(f"{p}{b}").alias(f"{p}{a}")
            for p in "abc"
            for a, b in (("x", "y"), ("y", "x"), ("z", "z"))
        ],
    )
    candidates = mesh.withColumn("candidate", F.lit("as given")).unionByName(
        swapped.withColumn("candidate", F.lit("axes swapped"))
    )
    ends = [f"target_{a}" for a in "xyz"]
    s = A.stored_samples(spark, d)
    windows = A.windows(s)[0]
    here = state_of(windows, s, "entity_id", {c: c for c in "xyz"}, how="inner")
    there = {**{c: f"target_{c}" for c in "xyz"}, "spotted_by": "spotted_by"}
    sighted = A.with_map(state_of(here, s, "target_id", there, how="inner")).filter(
        F.array_contains("spotted_by", F.col("entity_id"))
    )
    live = S.live_samples(A.with_map(s), 16)
    other = live.select(
        "session_id",
        "tick",
        F.col("entity_id").alias("enemy_id"),
        F.col("team").alias("enemy_team"),
        *[F.col(c).alias(f"target_{c}") for c in "xyz"],
    )
    pairs = live.join(other, ["session_id", "tick"]).filter(
        (F.col("team") != F.col("enemy_team"))
        & (F.col("entity_id") < F.col("enemy_id"))
    )
    keep = ["map", "segment", "x", "y", "z", *ends]
    return S.mesh_acceptance(
        sighted.withColumn("segment", F.col("window_uid")).select(*keep),
        pairs.withColumn(
            "segment", F.concat_ws("/", "session_id", "tick", "entity_id", "enemy_id")
        ).select(*keep),
        candidates,
        voxel=A.VOXEL,
    )
