"""Queries that replay the events table through the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.operators.motion import ENTITY
from sightline.plans import adapters as A
from sightline.plans.registry import query
from sightline.session import ensure_checkpoint_dir
from sightline.streaming import jobs
from sightline.streaming.carried import CarriedLookback, CarriedRuns


def _events(spark, d):
    # one file or a folder of parts
    table = f"{d}/events.parquet"
    return jobs.file_stream(spark, table, spark.read.parquet(table).schema)


def _places(spark):
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"


@query(
    "user_id:l started:d events:l total:d",
    """WITH e AS (SELECT *, epoch(ts) AS s FROM events),
b AS (SELECT *, CASE WHEN s - lag(s) OVER w < 21600 THEN 0 ELSE 1 END AS st FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s, event_id) AS burst FROM b)
SELECT user_id, min(s) AS started, count(*) AS events, sum(value) AS total
FROM g GROUP BY user_id, burst""",
)
def stream_bursts(spark, d):
    found = jobs.burst_stream(
        _events(spark, d),
        ["user_id"],
        "ts",
        gap="6 hours",
        aggs=[F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")],
    )
    return jobs.run_complete(found, *_places(spark)).withColumn(
        "started", F.col("burst.start").cast("double")
    )


@query(
    "event_type:s slot:l events:l mean:d",
    """SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, count(*) AS events, avg(value) AS mean
FROM events GROUP BY 1, 2""",
)
def stream_rates(spark, d):
    found = jobs.rate_stream(
        _events(spark, d),
        ["event_type"],
        "ts",
        size="1 day",
        aggs=[F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean")],
    )
    return jobs.run_complete(found, *_places(spark)).withColumn(
        "slot", (F.col("slot.start").cast("long") / 86400).cast("long")
    )


@query("path:s bytes:l sha256:s", None)
def stream_ingest(spark, d):
    return jobs.ingest(jobs.file_rows(spark, d, pattern="*.parquet"), *_places(spark))


def _sample_stream(spark, d):
    """The stored samples file by file; a file holds rows of all entities and ticks."""
    s = A.stored_samples(spark, d)
    folder = s.inputFiles()[0].rsplit("/", 1)[0]
    files = len(s.inputFiles())
    return jobs.file_stream(spark, folder, s.schema, files_per_batch=-(-files // 3))


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
def stream_runs(spark, d):
    """The runs of ``runs_above`` from a stream of three batches."""
    speed = F.col("yaw_speed")
    carried = CarriedRuns(ENTITY, "seq", speed > 4000, {"peak": ("max", speed)})
    found, _ = carried.drain(_sample_stream(spark, d), *_places(spark))
    length = F.col("end") - F.col("start") + 1
    return found.where(length >= 2).select(
        *ENTITY, F.col("start").alias("run_start"), F.col("end").alias("run_end"), length.alias("length"), "peak"
    )


@query(
    "session_id:l entity_id:l target_id:l tick:l target_fired_ms_ago:d",
    f"""WITH {A.SAMPLES_SQL},
k AS (SELECT session_id, entity_id, target_id, tick FROM samples WHERE anchor),
f AS (SELECT k.session_id, k.entity_id, k.tick, max(s.tick) AS t FROM k JOIN samples s
   ON s.session_id = k.session_id AND s.entity_id = k.target_id AND s.shot
  AND s.tick BETWEEN k.tick - 12 AND k.tick GROUP BY 1, 2, 3)
SELECT k.session_id, k.entity_id, k.target_id, k.tick, (k.tick - f.t) / 64.0 * 1000 AS target_fired_ms_ago
FROM k LEFT JOIN f USING (session_id, entity_id, tick)""",
)
def stream_lookback(spark, d):
    """The look-back of ``lookback_last_event`` for all anchors, from a stream of three batches."""
    carried = CarriedLookback(
        ("session_id", "target_id"), "tick", ("session_id", "entity_id", "tick"), span=A.SPAN
    )
    found = carried.drain(
        _sample_stream(spark, d),
        A.anchors,
        lambda s: s.filter("shot").select("session_id", F.col("entity_id").alias("target_id"), "tick"),
        *_places(spark),
    )
    ago = (F.col("tick") - F.col("event_tick")) / 64.0 * 1000
    return found.select("session_id", "entity_id", "target_id", "tick", ago.alias("target_fired_ms_ago"))
