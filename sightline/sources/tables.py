"""Session inputs: sample Parquet, event JSON, normalisation and the stored layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import constants as K
from sightline.functions.labels import three_valued_label
from sightline.operators.motion import number_samples
from sightline.schema import (
    DEATH_ALIASES,
    DEATHS,
    EVENT_ALIASES,
    EVENTS,
    SAMPLE_ALIASES,
    SAMPLES,
    conform,
)
from sightline.sources.stored import read_bucketed, write_bucketed

LISTED_FOLDER = "with_cheater_present"


def session_of(path: Column) -> Column:
    """``folder/stem`` of a source file: the session's id."""
    return F.regexp_extract(path, r"([^/]+/[^/]+)\.[^./]+$", 1)


def read_samples(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sample files as one canonical table with session_id.

    Only columns the schema knows are read of the sources' hundreds, and files with
    more or fewer of them are merged. ``spark.read`` prunes the rest.
    """
    raw = spark.read.option("mergeSchema", "true").parquet(
        *([paths] if isinstance(paths, str) else paths)
    )
    tagged = raw.withColumn("session_id", session_of(F.col("_metadata.file_path")))
    return conform(tagged, SAMPLES, SAMPLE_ALIASES, keep=["session_id"])


def canonical(samples: DataFrame) -> DataFrame:
    """Generic names, and ``seq``: the dense row number per entity."""
    renamed = samples.withColumnsRenamed({"player_id": "entity_id", "player_name": "name"})
    known = renamed.filter(
        F.col("entity_id").isNotNull() & F.col("tick").isNotNull()
    ).withColumn("tick", F.col("tick").cast("long"))
    return number_samples(known)


_EVENT_ROW = T.MapType(T.StringType(), T.StringType())


def _event_file(row: T.DataType) -> T.StructType:
    return T.StructType(
        [
            *[
                T.StructField(kind, T.ArrayType(row))
                for kind in (*K.REQUIRED_EVENTS, *K.OPTIONAL_EVENTS)
            ],
            T.StructField(
                "cheaters",
                T.ArrayType(T.StructType([T.StructField("steamid", T.StringType())])),
            ),
            T.StructField("CSstats_info", T.ArrayType(_EVENT_ROW)),
            T.StructField("_corrupt_record", T.StringType()),
        ]
    )


def read_event_files(
    spark: SparkSession, paths: str | Sequence[str], *, typed: bool = False
) -> DataFrame:
    """One row per session JSON; a file that does not parse keeps its raw text.

    Events are string maps or, ``typed``, VARIANT values in which numbers, booleans and
    nested values stay what they are in the file.
    """
    raw = (
        spark.read.schema(_event_file(T.VariantType() if typed else _EVENT_ROW))
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(paths if isinstance(paths, str) else list(paths))
    )
    return raw.withColumn("session_id", session_of(F.col("_metadata.file_path")))


def rejected_sessions(files: DataFrame) -> DataFrame:
    """Sessions whose file did not parse, with its text and what was read before."""
    deaths = F.coalesce(F.size("player_death"), F.lit(0))
    # Spark refuses to read the corrupt column alone, so the filter names another
    return files.filter(F.col("_corrupt_record").isNotNull() & (deaths >= 0)).select(
        "session_id", "_corrupt_record", deaths.alias("deaths_read")
    )


def event_rows(files: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """All events in one long table: session_id, kind, row (string map or VARIANT)."""
    wanted = kinds or (*K.REQUIRED_EVENTS, *K.OPTIONAL_EVENTS)
    packed = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("rows"))
            for k in wanted
            if k in files.columns
        ]
    )
    return (
        files.select("session_id", F.inline(packed))
        .filter(F.col("rows").isNotNull())
        .select("session_id", "kind", F.explode("rows").alias("row"))
    )


def _spread(
    events: DataFrame, schema: T.StructType, aliases: Mapping[str, Sequence[str]]
) -> DataFrame:
    """The schema's values as columns; ``extras`` keeps every value, by its source's name.

    Of a VARIANT a value is read as its column's type, whatever its file wrote it as; one that
    is not of that type is NULL.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    for name, group in aliases.items():
        for alias in group:
            kinds.setdefault(alias, kinds[name])
    row = F.col("row")
    if isinstance(events.schema["row"].dataType, T.VariantType):
        values = [F.try_variant_get(row, f"$.{n}", k).alias(n) for n, k in sorted(kinds.items())]
    else:
        values = [row[n].alias(n) for n in sorted(kinds)]
    return events.select("session_id", "kind", *values, row.alias("extras"))


def normalise_deaths(events: DataFrame) -> DataFrame:
    wide = _spread(events.filter(F.col("kind") == "player_death"), DEATHS, DEATH_ALIASES)
    return conform(wide, DEATHS, DEATH_ALIASES, keep=["session_id", "extras"])


def normalise_events(events: DataFrame) -> DataFrame:
    wide = _spread(events.filter(F.col("kind") != "player_death"), EVENTS, EVENT_ALIASES)
    return conform(wide, EVENTS, EVENT_ALIASES, keep=["session_id", "kind", "extras"])


def with_death_details(windows: DataFrame, deaths: DataFrame) -> DataFrame:
    """Windows with what the death at their anchor says: distance, walls, smoke.

    ``windows``: session_id, entity_id, target_id, anchor_tick. Several deaths of one
    pair on one tick give the farthest-reaching of each value, so rows stay single.
    """
    details = deaths.groupBy(
        "session_id",
        F.col("attacker_id").alias("entity_id"),
        F.col("victim_id").alias("target_id"),
        F.col("tick").alias("anchor_tick"),
    ).agg(
        F.max("distance").alias("distance"),
        F.max("penetrated").alias("walls_penetrated"),
        F.max("thrusmoke").alias("through_smoke"),
    )
    keys = ["session_id", "entity_id", "target_id", "anchor_tick"]
    return windows.join(details, keys, "left")


def read_labels(files: DataFrame) -> DataFrame:
    """Listed entities per session."""
    ids = F.transform(F.coalesce("cheaters", F.array()), lambda c: c["steamid"])
    return files.select("session_id", F.explode(ids).alias("entity_id")).distinct()


def read_sessions(files: DataFrame) -> DataFrame:
    """The session dimension: map, rank, whether a listed entity is present."""
    info = F.get(F.col("CSstats_info"), F.lit(0))
    return files.select(
        "session_id",
        info["map"].alias("map"),
        info["avg_rank"].alias("rank"),
        F.col("session_id").startswith(LISTED_FOLDER).alias("has_listed"),
    )


def with_labels(rows: DataFrame, labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Three-valued ``label`` for rows with session_id and entity_id."""
    listed = labels.withColumn("_listed", F.lit(True))
    return (
        rows.join(listed, ["session_id", "entity_id"], "left")
        .join(sessions.select("session_id", "has_listed"), "session_id", "left")
        .withColumn(
            "label", three_valued_label(F.col("_listed"), F.col("has_listed"))
        )
        .drop("_listed", "has_listed")
    )


def missing_kinds(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Required event kinds a session lacks."""
    needed = sessions.select(
        "session_id",
        F.explode(F.array(*[F.lit(k) for k in K.REQUIRED_EVENTS])).alias("kind"),
    )
    return needed.join(
        events.select("session_id", "kind").distinct(), ["session_id", "kind"], "left_anti"
    )


def write_sessions(
    samples: DataFrame, events: DataFrame, sessions: DataFrame, root: str
) -> None:
    """Store a table set: samples in buckets of their keys, events by kind, sessions."""
    write_bucketed(samples, f"{root}/samples")
    events.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/events")
    sessions.write.mode("overwrite").parquet(f"{root}/sessions")


def read_stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    found = {n: spark.read.parquet(f"{root}/{n}") for n in ("events", "sessions")}
    return {"samples": read_bucketed(spark, f"{root}/samples")} | found


def without_listed(files: DataFrame, listings: DataFrame) -> DataFrame:
    """Source rows minus those named in other samples' listings (``names`` arrays)."""
    named = listings.select(F.explode("names").alias("name")).distinct()
    return files.join(named, "name", "left_anti")
