"""File manifests: discovery, content hashes, versioned caches, resumable batches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.sampling import stratified_sample
from sightline.session import staged


#: Bytes of a file up to which its content is one value; larger ones are read in pieces.
WHOLE = 256 << 20
PIECE = 1 << 20


def _opened(path: str):
    """A file as a binary stream: local, or in a store that Arrow knows."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    store, inner = FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"]
        )


def with_content_hash(files: DataFrame, whole: int = WHOLE) -> DataFrame:
    """binaryFile rows without their content, with its ``sha256``; files of any size.

    Files of at most ``whole`` bytes are hashed as values. Larger ones (a value holds 2 GiB at most)
    are read by their task piece by piece, so a task needs memory for one piece. Spark lists no
    empty files, so none are here.
    """
    columns = [c for c in files.columns if c != "content"]
    small = files.where(F.col("length") <= whole).select(*columns, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(*columns)
    schema = T.StructType([*large.schema.fields, T.StructField("sha256", T.StringType())])
    return small.unionByName(large.mapInArrow(_hashed, schema))


def file_manifest(
    spark: SparkSession, root: str, pattern: str = "*.parquet", *, content: bool = False
) -> DataFrame:
    """path, name, folder, modified, bytes of every file below ``root``.

    ``content`` adds its SHA-256; without it no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    columns = [
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    ]
    if content:
        files = with_content_hash(files)
        columns.append("sha256")
    return files.select(*columns)


def newest(manifest: DataFrame, limit: int) -> DataFrame:
    return manifest.orderBy(F.desc("modified"), "path").limit(limit)


def listed_first(manifest: DataFrame, folder: str) -> DataFrame:
    return manifest.orderBy(F.col("folder") != folder, "path")


def unique_contents(manifest: DataFrame) -> DataFrame:
    """One path per content hash: the first by path."""
    others = [c for c in manifest.columns if c not in ("sha256", "path")]
    return (
        manifest.groupBy("sha256")
        .agg(F.min(F.struct("path", *others)).alias("_first"))
        .select("sha256", "_first.*")
    )


def schema_version(columns: Sequence[str]) -> str:
    """Short hash of a column list: part of a cache's path."""
    return hashlib.sha256("|".join(columns).encode()).hexdigest()[:12]


def cache_root(root: str, columns: Sequence[str]) -> str:
    return f"{root}/v={schema_version(columns)}"


def stale_sources(sources: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources with no cached result of this very version of the file."""
    return sources.join(
        cached.select("path", "modified"), ["path", "modified"], "left_anti"
    )


def read_through_cache(
    sources: DataFrame,
    root: str,
    columns: Sequence[str],
    make: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """What ``make`` gives for the files of ``sources``, made anew only for stale ones.

    ``make`` takes manifest rows and returns rows with ``path``, ``modified`` and
    ``columns``. A cache belongs to one list of columns. Rows are written before the
    list of files they are of, and only listed files count, so a stopped run leaves
    nothing half-read; a file without rows is remembered as well.
    """
    spark = sources.sparkSession
    home = cache_root(root, columns)
    keys = sources.select("path", "modified").distinct()
    listing = keys.withColumn("_batch", F.lit(""))
    listing.limit(0).write.mode("append").parquet(f"{home}/files")
    files = spark.read.schema(listing.schema).parquet(f"{home}/files")
    stale = staged(stale_sources(sources, files))
    batch = F.lit(uuid.uuid4().hex)
    made = make(stale).select("path", "modified", *columns).withColumn("_batch", batch)
    made.write.mode("append").parquet(f"{home}/rows")
    stale.select("path", "modified").distinct().withColumn("_batch", batch).write.mode(
        "append"
    ).parquet(f"{home}/files")
    rows = spark.read.schema(made.schema).parquet(f"{home}/rows")
    listed = spark.read.schema(listing.schema).parquet(f"{home}/files")
    return (
        rows.join(listed, ["path", "modified", "_batch"])
        .join(keys, ["path", "modified"], "left_semi")
        .select("path", "modified", *columns)
    )


def finished(like: DataFrame, root: str, key: str = "session_id") -> DataFrame:
    """Keys that have an output folder under ``root``, whose rows have the schema of ``like``."""
    schema = T.StructType([*(f for f in like.schema if f.name != key), like.schema[key]])
    empty = like.select(*[F.col(f.name) for f in schema if f.name != key]).limit(0)
    # the folder of NULL, which a key of any type can be read from
    empty.write.mode("append").parquet(f"{root}/{key}=__HIVE_DEFAULT_PARTITION__")
    return staged(like.sparkSession.read.schema(schema).parquet(root).select(key).distinct())


def write_pending(rows: DataFrame, root: str, key: str = "session_id") -> None:
    """One output folder per ``key`` under ``root``; keys that have one are left alone.

    A folder appears when its rows are committed, so a stopped batch goes on where it was.
    """
    left = pending(rows, finished(rows, root, key), key)
    left.write.mode("append").partitionBy(key).parquet(root)


def pending(sources: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Sources that have no output yet: a batch that was stopped goes on here."""
    return sources.join(done.select(key), key, "left_anti")


def with_review_flag(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """``reviewed``: a report with the same stem exists."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    known = reports.select("stem").distinct().withColumn("_r", F.lit(True))
    return (
        sources.withColumn("stem", stem)
        .join(known, "stem", "left")
        .withColumn("reviewed", F.coalesce("_r", F.lit(False)))
        .drop("_r")
    )


def sample_per_map(
    manifest: DataFrame, per_map: int, *, seed: int = 0, pattern: str = r"_(de_[a-z0-9]+)"
) -> DataFrame:
    """A repeatable stratified sample: the map is read from the file name."""
    named = manifest.withColumn("map", F.regexp_extract("name", pattern, 1)).filter(
        F.col("map") != ""
    )
    return stratified_sample(named, ["map"], "name", per_map, seed=seed)
