"""Fixed schemas and the helper that brings tolerant input into them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("player_id", T.StringType()),
        T.StructField("player_name", T.StringType()),
        T.StructField("tick", T.IntegerType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("team", T.IntegerType()),
        T.StructField("x", T.FloatType()),
        T.StructField("y", T.FloatType()),
        T.StructField("z", T.FloatType()),
        T.StructField("pitch", T.FloatType()),
        T.StructField("yaw", T.FloatType()),
        T.StructField("health", T.IntegerType()),
        T.StructField("is_alive", T.BooleanType()),
        T.StructField("is_freeze", T.BooleanType()),
        T.StructField("spotted", T.BooleanType()),
        T.StructField("spotted_by", T.ArrayType(T.StringType())),
        T.StructField("flash_duration", T.FloatType()),
    ]
)

#: Names the sources use for the columns above, first present one wins.
SAMPLE_ALIASES = {
    "player_id": ("player_id", "steamid", "player_steamid"),
    "player_name": ("player_name", "name"),
    "round": ("round", "total_rounds_played"),
    "team": ("team", "team_num"),
    "x": ("x", "X"),
    "y": ("y", "Y"),
    "z": ("z", "Z"),
    "is_freeze": ("is_freeze", "is_freeze_period"),
    "spotted_by": ("spotted_by", "approximate_spotted_by"),
}

DEATHS = T.StructType(
    [
        T.StructField("tick", T.IntegerType()),
        T.StructField("attacker_id", T.StringType()),
        T.StructField("victim_id", T.StringType()),
        T.StructField("weapon", T.StringType()),
        T.StructField("headshot", T.BooleanType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("penetrated", T.IntegerType()),
        T.StructField("noscope", T.BooleanType()),
        T.StructField("thrusmoke", T.BooleanType()),
    ]
)
DEATH_ALIASES = {
    "penetrated": ("penetrated", "num_penetrations"),
    "attacker_id": ("attacker_id", "attacker_steamid", "attacker"),
    "victim_id": ("victim_id", "user_steamid", "user"),
}
EVENTS = T.StructType(
    [
        T.StructField("tick", T.IntegerType()),
        T.StructField("player_id", T.StringType()),
        T.StructField("weapon", T.StringType()),
        T.StructField("entityid", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
EVENT_ALIASES = {"player_id": ("player_id", "user_steamid", "attacker_id")}


def conform(
    df: DataFrame,
    schema: T.StructType,
    aliases: Mapping[str, Sequence[str]] | None = None,
    *,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Known renames, missing columns as typed NULLs, fixed order and types.

    NaN in a number column becomes NULL: both mean "unknown" and only one of them is
    skipped by aggregates.
    """
    have = set(df.columns)
    out = []
    for field in schema.fields:
        names = (aliases or {}).get(field.name, (field.name,))
        found = [n for n in names if n in have]
        kind = field.dataType
        if not found:
            c = F.lit(None).cast(kind)
        else:
            c = F.coalesce(*[F.col(f"`{n}`") for n in found])
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                c = F.nanvl(c.cast(kind), F.lit(None).cast(kind))
            else:
                c = c.cast(kind)
        out.append(c.alias(field.name))
    return df.select(*keep, *out)
