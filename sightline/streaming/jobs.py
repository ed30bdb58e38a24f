"""Incremental forms of batch operators: ingest, bursts, rates.

What a drain puts out does not depend on how files fall into batches. ``run_complete`` keeps
every group in the state and loses no row, however late; ``run_once`` bounds the state by a
watermark and fails if that would drop a row. A restart goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sightline.session import as_utc, staged
from sightline.sources.manifest import with_content_hash

#: A file's age says nothing about whether it was taken in.
MAX_FILE_AGE = "36500d"
#: Progress of every batch of a drain is kept; by default that of the last 100.
RETENTION = ("spark.sql.streaming.numRecentProgressUpdates", str(2**31 - 1))


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """New Parquet files at any depth of a folder; timestamps without zone are read as UTC."""
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", MAX_FILE_AGE)
        .parquet(folder)
    )
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            raw = raw.withColumn(field.name, as_utc(F.col(field.name)))
    return raw


def file_rows(
    spark: SparkSession, folder: str, *, pattern: str = "*", files_per_batch: int = 1000
) -> DataFrame:
    """Manifest rows (path, modified, bytes, sha256) of files at any depth of a folder."""
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()),
            T.StructField("content", T.BinaryType()),
        ]
    )
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", MAX_FILE_AGE)
        .load(folder)
    )
    return with_content_hash(files).select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "sha256"
    )


#: Hex digits of a hash that name a manifest's partition.
MANIFEST_DIGITS = 2


def ingest(files: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain ``file_rows`` into a manifest at ``out``: one row per content, the first path.

    What was seen is the manifest itself, without a time limit. It is partitioned by the first
    hex digits of the hash and then by batch, and a batch reads the partitions of its own
    hashes only. A batch that is repeated after a failure writes its partitions over,
    and reads none of its own rows, so the manifest is the same.
    """
    spark = files.sparkSession
    schema = files.schema
    stored = T.StructType([*schema.fields, T.StructField("part", T.StringType()), T.StructField("batch", T.LongType())])

    def take(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("sha256").agg(
            F.min(F.struct("path", "modified", "bytes")).alias("f")
        ).select(
            "f.path",
            "f.modified",
            "f.bytes",
            "sha256",
            F.substring("sha256", 1, MANIFEST_DIGITS).alias("part"),
            F.lit(number).cast("long").alias("batch"),
        )
        spark_ = batch.sparkSession
        if number > 0:
            first = staged(first)  # read for its partitions, and again to be joined
            parts = [r.part for r in first.select("part").distinct().collect()]
            known = manifest_rows(spark_, out, stored).where(F.col("part").isin(parts) & (F.col("batch") < number))
            first = first.join(known.select("sha256"), "sha256", "left_anti").select(stored.names)
        writer = first.repartition("part").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(out)

    _drain(files.writeStream.foreachBatch(take), checkpoint)
    return manifest_rows(spark, out, stored).select(schema.names)


def manifest_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """A manifest with its partition columns, ``part`` and ``batch``."""
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def burst_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    gap: str,
    aggs: Sequence[Column],
    delay: str | None = None,
) -> DataFrame:
    """Bursts per key that end after ``gap`` without an event.

    With ``delay`` closed bursts leave the state (``run_once``); without, all stay and
    open ones are put out too (``run_complete``). Set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` when single
    keys are busy: rows of a batch are then merged before they are shuffled.
    """
    late = events.withWatermark(ts, delay) if delay else events
    return late.groupBy(*keys, F.session_window(ts, gap).alias("burst")).agg(*aggs)


def rate_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    size: str,
    aggs: Sequence[Column],
    slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Aggregates per key and time window; ``delay`` as in ``burst_stream``."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    late = events.withWatermark(ts, delay) if delay else events
    return late.groupBy(*keys, window.alias("slot")).agg(*aggs)


def _drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append everything available to a Parquet table and stop.

    Fails if the watermark dropped rows: the table then lacks them, and is to be made
    anew with a longer delay, or by ``run_complete``.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out)
    conf = stream.sparkSession.conf
    name, every = RETENTION
    before = conf.get(name)
    conf.set(name, every)
    try:
        query = _drain(writer, checkpoint)
    finally:
        conf.set(name, before)
    dropped = sum(
        int(state.numRowsDroppedByWatermark)
        for progress in query.recentProgress
        for state in progress.stateOperators
    )
    if dropped:
        raise ValueError(f"{dropped} rows came later than the watermark allows")


def last_committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The number of the last batch that a checkpoint knows to be whole."""
    try:
        commits = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select("path").collect()
    except AnalysisException:  # nothing was ever drained
        return None
    return max((int(r.path.rsplit("/", 1)[1]) for r in commits if r.path.rsplit("/", 1)[1].isdigit()), default=None)


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything available, aggregated whole; the table after the last batch.

    Batches write the whole result in turn to one of two folders, so a drain holds two
    tables at most and a reader of the last one never sees half of the next. A drain that
    finds nothing new gives the table of the last batch before it.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/turn={number % 2}")

    _drain(stream.writeStream.outputMode("complete").foreachBatch(put), checkpoint)
    last = last_committed(spark, checkpoint)
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/turn={last % 2}")
