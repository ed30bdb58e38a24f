"""Result sinks and their catalogues: cases, chat rows, replays, reports, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_windows(windows: DataFrame, ticks: DataFrame, root: str) -> None:
    """The labelled window dataset."""
    windows.write.mode("overwrite").parquet(f"{root}/windows")
    ticks.write.mode("overwrite").parquet(f"{root}/window_ticks")


def write_json(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    """Nested rows, one JSON document per line."""
    writer = df.write.mode("overwrite")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.json(path)


def write_chat(rows: DataFrame, root: str) -> None:
    """Conversations by split, as JSON lines and as Parquet; nothing else goes along."""
    plain = rows.select("split", "messages")
    plain.write.mode("overwrite").partitionBy("split").json(f"{root}/jsonl")
    plain.write.mode("overwrite").partitionBy("split").parquet(f"{root}/parquet")


REPORT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("map_name", T.StringType()),
        T.StructField(
            "players",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("player_id", T.StringType()),
                        T.StructField("flagged", T.BooleanType()),
                        T.StructField("score", T.DoubleType()),
                        T.StructField("judge_evidence", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def report_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Stored reports, unreadable ones left out: players, flagged, file time."""
    rows = spark.read.schema(REPORT).option("mode", "DROPMALFORMED").json(root)
    tagged = rows.select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).filter(F.col("players").isNotNull())
    return tagged.select(
        "session_id",
        "map_name",
        "file",
        "modified",
        F.size("players").alias("players"),
        F.size(F.filter("players", lambda p: p["flagged"])).alias("flagged"),
    ).orderBy(F.desc("modified"), "session_id")


ANNOTATION = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("evidence_sha", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("probability", T.IntegerType()),
        T.StructField("answer", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Stored chat rows as cases: what the target says, and the score that was shown.

    Each line holds session_id, entity_id, label and messages of a system, a user and an
    assistant turn, the last a JSON answer. Lines without such an answer have NULLs.
    """
    message = "struct<role:string,content:string>"
    rows = spark.read.schema(
        f"session_id string, entity_id string, label string, messages array<{message}>"
    ).json(path)
    answer = F.from_json(
        F.get("messages", F.lit(2))["content"], "verdict string, probability int"
    )
    shown = F.regexp_extract(
        F.get("messages", F.lit(1))["content"], r"Behaviour model score: ([0-9.]+)", 1
    )
    return rows.select(
        "session_id",
        "entity_id",
        "label",
        answer["verdict"].alias("target_verdict"),
        answer["probability"].alias("target_probability"),
        F.when(shown != "", shown.cast("double")).alias("score"),
    )


def append_annotations(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(path)


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key of an append-only log.

    ``max_by`` keeps one row per key and task, so a much-edited key stays cheap.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*")
