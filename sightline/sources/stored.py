"""Stored tables that meet joins on their keys without a shuffle.

Samples are looked up by exact (session, entity, tick): windows around anchors, another entity's
state at a tick. Stored in buckets of session and tick, the sample side of such a join is read where
it lies, and only the other side (anchors, wanted ticks) travels: once for all entities it asks for, as
a tick's roster lies together (``joins.at_tick``). The tick is a bucket column because one session or
entity may hold a third of all rows.

A bucketed table is known to Spark through its catalog, which ends with the application, so the
keys and number of buckets lie beside the data and ``read_bucketed`` registers the folder again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

SAMPLE_KEYS = ("session_id", "tick")


def _name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def _prepare(spark: SparkSession) -> None:
    # a union of bucketed tables is taken for one that is bucketed, though its scans are not
    # read by buckets: what is grouped above it would then fall apart
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def write_bucketed(
    rows: DataFrame,
    path: str,
    *,
    keys: Sequence[str] = SAMPLE_KEYS,
    buckets: int | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Writes ``rows`` to a folder in one sorted file per bucket, and gives the stored table.

    ``buckets`` is by default the number of shuffle partitions, so that what is joined to the table
    is dealt out as any other shuffle. ``finish`` makes the stored columns out of rows that are
    dealt out already; it leaves the keys as they are.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys)
    dealt = finish(dealt) if finish else dealt
    (
        dealt.write.mode("overwrite")
        .bucketBy(n, *keys)
        .sortBy(*keys)
        .option("path", f"{path}/rows")
        .saveAsTable(_name(path))
    )
    layout = spark.createDataFrame([(n, list(keys), dealt.schema.json())], "buckets int, keys array<string>, columns string")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return read_bucketed(spark, path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at a folder, in this application and any later one."""
    _prepare(spark)
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("buckets int, keys array<string>, columns string").json(f"{path}/layout").first()
        keys = ", ".join(f"`{k}`" for k in layout["keys"])
        columns = spark.read.parquet(f"{path}/rows").schema
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        spark.sql(
            f"CREATE TABLE {name} ({listed}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
        )
    return spark.table(name)
