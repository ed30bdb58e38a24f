"""Queries over single series: deltas, runs, bursts, as-of joins, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import joins as J
from sightline.operators import motion as M
from sightline.operators import rules as R
from sightline.operators.ordered import (
    in_ranges,
    neighbours,
    number_by_range,
    runs,
    segments,
)
from sightline.operators.quantiles import METHODS, cumulative_counts, quantiles
from sightline.plans import adapters as A
from sightline.plans.registry import query


@query(
    "session_id:l entity_id:l tick:l d_tick:l d_yaw:d d_pitch:d yaw_speed:d pitch_speed:d",
    f"WITH {A.DELTAS_SQL} SELECT * FROM deltas",
)
def entity_deltas(spark, d):
    return A.deltas(A.samples(spark, d))


@query(
    "session_id:l entity_id:l run_start:l run_end:l length:l peak:d",
    f"""WITH {A.DELTAS_SQL},
f AS (SELECT *, coalesce(yaw_speed > 4000, false) AS hit FROM deltas),
c AS (SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER w THEN 1 ELSE 0 END AS ch
      FROM f WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id, entity_id ORDER BY tick) AS run FROM c)
SELECT session_id, entity_id, min(tick) AS run_start, max(tick) AS run_end,
  count(*) AS length, max(yaw_speed) AS peak
FROM r WHERE hit GROUP BY session_id, entity_id, run HAVING count(*) >= 2""",
)
def runs_above(spark, d):
    speed = F.col("yaw_speed")
    return runs(
        A.deltas(A.samples(spark, d)),
        M.ENTITY,
        "seq",
        speed > 4000,
        {"peak": ("max", speed)},
        min_length=2,
    )


_ROLLING_SQL = f"""WITH {A.DELTAS_SQL},
m AS (SELECT *, CASE WHEN count(*) OVER w = 4
        THEN median(coalesce(yaw_speed, 0)) OVER w END AS rolling
      FROM deltas WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick
        ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, coalesce(rolling > 2000, false) AS hit FROM m),
c AS (SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER w THEN 1 ELSE 0 END AS ch
      FROM f WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id, entity_id ORDER BY tick) AS run FROM c)
SELECT session_id, entity_id, min(tick) AS tick_start, max(tick) AS tick_end,
  count(*) AS length, max(rolling) AS peak
FROM r WHERE hit GROUP BY session_id, entity_id, run HAVING count(*) >= 4"""


@query(
    "session_id:l entity_id:l tick_start:l tick_end:l length:l peak:d", _ROLLING_SQL
)
def rolling_median_runs(spark, d):
    return R.sustained_runs(A.deltas(A.samples(spark, d)), 2000.0, 4)


_FLIP_SQL = f"""{A.DELTAS_SQL},
fl AS (SELECT *, coalesce(abs(d_yaw) > 60 AND sign(d_yaw) <> lag(sign(d_yaw)) OVER w, false) AS hit
      FROM deltas WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
flc AS (SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER w THEN 1 ELSE 0 END AS ch
      FROM fl WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
flr AS (SELECT *, sum(ch) OVER (PARTITION BY session_id, entity_id ORDER BY tick) AS run FROM flc)"""


@query(
    "session_id:l entity_id:l tick_start:l tick_end:l length:l peak:d",
    f"""WITH {_FLIP_SQL}
SELECT session_id, entity_id, min(tick) AS tick_start, max(tick) AS tick_end,
  count(*) AS length, max(abs(d_yaw)) AS peak
FROM flr WHERE hit GROUP BY session_id, entity_id, run HAVING count(*) >= 2""",
)
def alternating_runs(spark, d):
    return R.alternating_runs(A.deltas(A.samples(spark, d)), 60.0, 2)


@query(
    "session_id:l entity_id:l tick:l yaw_speed:d",
    f"""WITH {A.DELTAS_SQL}
SELECT session_id, entity_id, tick, yaw_speed FROM deltas
WHERE anchor AND yaw_speed > 2210""",
)
def anchor_spike(spark, d):
    s = A.stored_samples(spark, d)
    found = R.anchor_speeds(A.deltas(s), A.anchors(s))
    return found.filter(F.col("yaw_speed") > 2210)


@query(
    "session_id:l entity_id:l tick_start:l tick_end:l length:l peak:d",
    f"""WITH {A.SAMPLES_SQL},
f AS (SELECT *, abs(pitch) > 60 AS hit FROM samples),
c AS (SELECT *, CASE WHEN hit IS DISTINCT FROM lag(hit) OVER w THEN 1 ELSE 0 END AS ch
      FROM f WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id, entity_id ORDER BY tick) AS run FROM c)
SELECT session_id, entity_id, min(tick) AS tick_start, max(tick) AS tick_end,
  count(*) AS length, max(abs(pitch)) AS peak
FROM r WHERE hit GROUP BY session_id, entity_id, run""",
)
def out_of_range(spark, d):
    return R.out_of_range_runs(A.samples(spark, d), 60.0)


@query(
    "user_id:l started:d ended:d events:l total:d first_type:s",
    """WITH e AS (SELECT *, epoch(ts) AS s FROM events),
b AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 21600 THEN 1 ELSE 0 END AS st
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s, event_id) AS burst FROM b)
SELECT user_id, min(s) AS started, max(s) AS ended, count(*) AS events,
  sum(value) AS total, arg_min(event_type, event_id) AS first_type
FROM g GROUP BY user_id, burst""",
)
def bursts(spark, d):
    events = A.table(spark, d, "events").withColumn("s", F.col("ts").cast("double"))
    # any number of events may crowd into a moment: cut by rows, not by time
    chunk = F.col("_range")
    events = events.select("user_id", "event_id", "s", "value", "event_type")
    linked = neighbours(
        in_ranges(events, ["user_id"], ["s", "event_id"]),
        ["user_id"],
        chunk,
        ["s", "event_id"],
        back={"before": "s"},
    )
    starts = F.col("before").isNull() | (F.col("s") - F.col("before") > 21600)
    return segments(
        linked,
        ["user_id"],
        chunk,
        ["s", "event_id"],
        starts,
        {
            "started": ("min", F.col("s")),
            "ended": ("max", F.col("s")),
            "events": ("sum", F.lit(1)),
            "total": ("sum", F.col("value")),
            "first_type": ("first", F.col("event_type")),
        },
    )


@query(
    "session_id:l number:l start:l end:l",
    f"""WITH {A.SAMPLES_SQL},
tk AS (SELECT session_id, tick, round, tick % 16 < 3 AS is_freeze FROM samples),
per AS (SELECT session_id, round, min(tick) AS f, max(tick) AS l,
    min(tick) FILTER (is_freeze) AS ff, max(tick) FILTER (is_freeze) AS fl
  FROM tk GROUP BY session_id, round),
n AS (SELECT *, lead(f) OVER w AS nf, lead(ff) OVER w AS nff,
    row_number() OVER (PARTITION BY session_id ORDER BY round DESC) AS back,
    count(*) OVER (PARTITION BY session_id) AS rounds,
    last_value(ff) OVER (PARTITION BY session_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS eff,
    last_value(l) OVER (PARTITION BY session_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS el
  FROM per WINDOW w AS (PARTITION BY session_id ORDER BY round)),
b AS (SELECT session_id, round + 1 AS number, coalesce(fl + 1, f) AS start,
    CASE WHEN rounds > 1 AND eff IS NULL AND back = 2 THEN el + 1
      ELSE greatest(coalesce(nff, nf, l + 1), nf + 1) END AS "end"
  FROM n WHERE NOT (rounds > 1 AND eff IS NULL AND back = 1))
SELECT * FROM b WHERE "end" > start""",
)
def play_intervals(spark, d):
    frozen = A.samples(spark, d).withColumn(
        "is_freeze", F.col("tick") % A.ROUND_TICKS < A.FREEZE_TICKS
    )
    return M.play_intervals(frozen)


def _orders(spark, d):
    orders = A.table(spark, d, "orders")
    return orders.select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.col("o_orderdate").cast("long").alias("t"),
    )


_DAY = 86400


@query(
    "o_orderkey:l event_id:l",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, epoch(o_orderdate) AS t FROM orders),
b AS (SELECT o_custkey, t, max(o_orderkey) AS event_id FROM o WHERE o_totalprice > 250000 GROUP BY 1, 2)
SELECT o.o_orderkey, b.event_id FROM o ASOF LEFT JOIN b
  ON o.o_custkey = b.o_custkey AND o.t >= b.t""",
)
def asof_backward(spark, d):
    o = _orders(spark, d)
    large = o.filter(F.col("o_totalprice") > 250000)
    return J.asof_join(
        o,
        large.withColumnRenamed("o_orderkey", "event_id"),
        on="t",
        by=("o_custkey",),
        take=("event_id",),
        tie=("event_id",),
        width=None,
    )


@query(
    "o_orderkey:l next_key:l",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, epoch(o_orderdate) AS t FROM orders),
b AS (SELECT o_custkey, t, min(o_orderkey) AS next_key FROM o GROUP BY 1, 2)
SELECT o.o_orderkey, b.next_key FROM o ASOF LEFT JOIN b
  ON o.o_custkey = b.o_custkey AND o.t < b.t""",
)
def asof_forward_strict(spark, d):
    o = _orders(spark, d)
    return J.asof_join(
        o,
        o.withColumnRenamed("o_orderkey", "next_key"),
        on="t",
        by=("o_custkey",),
        take=("next_key",),
        tie=("next_key",),
        direction="forward",
        allow_exact=False,
        width=None,
    )


@query(
    "session_id:l entity_id:l tick:l place_x:d place_y:d",
    f"""WITH {A.SAMPLES_SQL},
rows_ AS (SELECT session_id, target_id AS entity_id, tick + 1 AS tick FROM samples WHERE anchor),
places AS (SELECT session_id, entity_id, tick, x, y FROM samples WHERE is_alive)
SELECT r.session_id, r.entity_id, r.tick, p.x AS place_x, p.y AS place_y
FROM rows_ r ASOF LEFT JOIN places p
  ON r.session_id = p.session_id AND r.entity_id = p.entity_id AND r.tick >= p.tick""",
)
def asof_by_key(spark, d):
    s = A.stored_samples(spark, d)
    rows = s.filter("anchor").select(
        "session_id",
        F.col("target_id").alias("entity_id"),
        (F.col("tick") + 1).alias("tick"),
    )
    places = s.filter("is_alive").select(
        "session_id",
        "entity_id",
        "tick",
        F.col("x").alias("place_x"),
        F.col("y").alias("place_y"),
    )
    return J.asof_join(
        rows, places, on="tick", by=M.ENTITY, take=("place_x", "place_y")
    )


_INTERVALS_SQL = """iv AS (
  SELECT session_id, round + 1 AS number, min(tick) + 3 AS start, max(tick) + 1 AS "end"
  FROM samples GROUP BY session_id, round HAVING max(tick) + 1 > min(tick) + 3)"""


def _intervals(s):
    """Rounds as intervals with a gap of three ticks before each."""
    return (
        s.groupBy("session_id", "round")
        .agg(
            (F.min("tick") + 3).alias("start"), (F.max("tick") + 1).alias("end")
        )
        .select("session_id", (F.col("round") + 1).alias("number"), "start", "end")
        .filter(F.col("end") > F.col("start"))
    )


@query(
    "session_id:l entity_id:l tick:l number:l",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL}
SELECT s.session_id, s.entity_id, s.tick, iv.number FROM samples s JOIN iv
  ON s.session_id = iv.session_id AND s.tick >= iv.start AND s.tick < iv."end"
WHERE s.shot""",
)
def interval_of_event(spark, d):
    s = A.stored_samples(spark, d)
    return J.in_interval(s.filter("shot"), _intervals(s))


@query(
    "session_id:l entity_id:l tick:l number:l",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL}
SELECT s.session_id, s.entity_id, s.tick, min(iv.number) AS number FROM samples s JOIN iv
  ON s.session_id = iv.session_id AND iv."end" > s.tick
WHERE s.shot GROUP BY 1, 2, 3""",
)
def interval_before_end(spark, d):
    s = A.stored_samples(spark, d)
    return J.before_interval_end(s.filter("shot"), _intervals(s))


@query(
    "session_id:l entity_id:l tick:l number:l",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL}
SELECT s.session_id, s.entity_id, s.tick,
  coalesce(max(CASE WHEN iv.start <= s.tick THEN iv.number END), min(iv.number)) AS number
FROM samples s JOIN iv ON s.session_id = iv.session_id
WHERE s.anchor GROUP BY 1, 2, 3""",
)
def interval_clamped(spark, d):
    s = A.stored_samples(spark, d)
    return J.clamped_interval(s.filter("anchor"), _intervals(s))


@query(
    "event_id:l until:d",
    """WITH e AS (SELECT event_id, user_id % 50 AS id, epoch(ts) AS t, event_type FROM events)
SELECT s.event_id, least(coalesce(
    (SELECT min(x.t) FROM e x WHERE x.event_type = 'purchase' AND x.id = s.id AND x.t >= s.t),
    s.t + 86400), s.t + 172800) AS until
FROM e s WHERE s.event_type = 'view'""",
)
def pair_start_end(spark, d):
    e = A.table(spark, d, "events").select(
        "event_id",
        (F.col("user_id") % 50).alias("id"),
        F.col("ts").cast("double").alias("t"),
        "event_type",
    )
    return J.pair_start_end(
        e.filter("event_type = 'view'").drop("event_type"),
        e.filter("event_type = 'purchase'"),
        by=("id",),
        on="t",
        limit=F.col("t") + _DAY,
        bound=F.col("t") + 2 * _DAY,
        width=None,
    )


@query(
    "session_id:l round:l switched:l",
    f"""WITH {A.SAMPLES_SQL},
t2 AS (SELECT session_id, entity_id, round, 2 + (health + round) % 2 AS team FROM samples),
c AS (SELECT session_id, entity_id, round, team, count(*) AS n FROM t2 GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entity_id, round
        ORDER BY n DESC, team) AS rn FROM c) WHERE rn = 1),
p AS (SELECT *, lag(team) OVER (PARTITION BY session_id, entity_id ORDER BY round) AS prev FROM m),
k AS (SELECT session_id, round, count(*) AS switched FROM p WHERE prev IS NOT NULL AND team <> prev GROUP BY 1, 2),
r AS (SELECT session_id, count(DISTINCT entity_id) AS e FROM samples GROUP BY 1)
SELECT k.* FROM k JOIN r USING (session_id) WHERE switched >= greatest(2, e // 2)""",
)
def side_switches(spark, d):
    s = A.samples(spark, d).withColumn(
        "team", 2 + (F.col("health") + F.col("round")) % 2
    )
    return M.side_switches(s)


@query(
    "session_id:l entity_id:l first_team:l last_name:s",
    f"""WITH {A.SAMPLES_SQL}
SELECT session_id, entity_id, arg_min(team, tick) AS first_team, arg_max(name, tick) AS last_name
FROM samples GROUP BY 1, 2""",
)
def first_last_state(spark, d):
    return M.first_and_last(A.samples(spark, d))


_METHOD_SQL = """
WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rn,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT flag, quantile_cont(v, 0.9) AS linear,
  max(CASE WHEN rn = floor(0.9 * (n - 1) + 0.5) THEN v END) AS nearest,
  max(CASE WHEN rn = floor(0.9 * (n - 1)) THEN v END) AS lower,
  max(CASE WHEN rn = ceil(0.9 * (n - 1)) THEN v END) AS higher
FROM s GROUP BY flag"""


@query("flag:s linear:d nearest:d lower:d higher:d", _METHOD_SQL)
def quantile_methods(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v")
    )
    out = None
    for m in METHODS:
        part = quantiles(rows, ["flag"], "v", {m: 0.9}, method=m)
        out = part if out is None else out.join(part, "flag")
    return out


@query(
    "session_id:l entity_id:l tick:l speed:d gap_speed:d",
    f"""WITH {A.SAMPLES_SQL}
SELECT session_id, entity_id, tick,
  sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) * 64 AS speed,
  sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) * 64 / (tick - lag(tick) OVER w) AS gap_speed
FROM samples WINDOW w AS (PARTITION BY session_id, entity_id ORDER BY tick)""",
)
def planar_movement(spark, d):
    moved = M.movement(A.samples(spark, d)).withColumnRenamed("speed", "plain")
    return (
        M.movement(moved, per_gap=True)
        .withColumnRenamed("speed", "gap_speed")
        .withColumnRenamed("plain", "speed")
    )


@query(
    "n_chars:l docs:l avg_rank:d normal:d",
    """WITH r AS (SELECT doc_id, n_chars,
    rank() OVER (ORDER BY n_chars) AS rk, count(*) OVER (PARTITION BY n_chars) AS same,
    count(*) OVER () AS n FROM documents)
SELECT n_chars, max(same) AS docs, max(rk + (same - 1) / 2.0) AS avg_rank,
  max((rk - 1.0) / (n - 1)) AS normal FROM r GROUP BY n_chars""",
)
def tie_ranks(spark, d):
    """Tie-averaged and 0..1 ranks of a column, by its value histogram."""
    docs = A.table(spark, d, "documents")
    hist = docs.groupBy("n_chars").agg(F.count(F.lit(1)).alias("docs"))
    below = cumulative_counts(hist, [], "n_chars", ["docs"])
    return below.select(
        "n_chars",
        "docs",
        (F.col("docs_below") + 1 + (F.col("docs") - 1) / 2).alias("avg_rank"),
        (F.col("docs_below") / (F.col("docs_total") - 1)).alias("normal"),
    )


@query(
    "doc_id:l rank_normal:d",
    """SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1.0)
  / (count(*) OVER () - 1) AS rank_normal FROM documents""",
)
def rank_normalise(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    placed = number_by_range(docs, [], ["n_chars", "doc_id"], "rn", count="n")
    return placed.withColumn(
        "rank_normal", (F.col("rn") - 1) / (F.col("n") - 1)
    )

