"""Round replays: every entity's state on a regular grid, events tagged with rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.labels import aimed_weapon
from sightline.operators.joins import (
    asof_join,
    before_interval_end,
    in_interval,
    pair_start_end,
)
from sightline.session import staged

FIELDS = ("x", "y", "z", "yaw", "hp", "blind", "sees")
SIDES = {2: "T", 3: "CT"}


def _field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


def in_play(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows inside play time with their round's ``number``, ``start`` and ``end``.

    Rows that :func:`played` has tagged are not looked up again.
    """
    if {"number", "start", "end"} <= set(rows.columns):
        return rows.filter(F.col("number").isNotNull())
    return in_interval(rows, intervals)


def played(
    samples: DataFrame, intervals: DataFrame, *, stride: int = K.REPLAY_SAMPLE_TICKS
) -> DataFrame:
    """The samples a replay shows, tagged with their rounds once for all that read them:
    every ``stride``-th tick, and all with ``shot`` or ``anchor``. Outside of play time
    ``number``, ``start`` and ``end`` are NULL. Stage it: each list of a replay reads it.
    """
    shown = (F.col("tick") % stride == 0) | F.col("shot") | F.col("anchor")
    return in_interval(samples.filter(shown), intervals, how="left")


def replay_values(
    samples: DataFrame,
    intervals: DataFrame,
    mask: DataFrame | None = None,
    *,
    stride: int = K.REPLAY_SAMPLE_TICKS,
) -> DataFrame:
    """Sampled state inside play time; positions are NULL and hp 0 for the dead."""
    kept = in_play(samples.filter(F.col("tick") % stride == 0), intervals)
    if mask is not None:
        kept = kept.join(mask, ["session_id", "tick", "entity_id"], "left")
    else:
        kept = kept.withColumn("sees", F.lit(None).cast("long"))
    alive = F.coalesce("is_alive", F.lit(False))

    def whole(c: str) -> Column:
        return F.when(alive, F.round(c).cast("int"))

    flash = (
        F.coalesce("flash_duration", F.lit(0.0))
        if "flash_duration" in samples.columns
        else F.lit(0.0)
    )
    return kept.select(
        "session_id",
        "number",
        "entity_id",
        "tick",
        "team",
        *[whole(c).alias(c) for c in ("x", "y", "z", "yaw")],
        F.when(alive, F.col("health")).otherwise(0).alias("hp"),
        F.when(alive, (flash > 0).cast("int")).alias("blind"),
        F.when(
            alive, F.coalesce("sees", F.lit(0)) if mask is not None else F.col("sees")
        ).alias("sees"),
    )


def replay_grid(
    values: DataFrame, intervals: DataFrame, *, stride: int = K.REPLAY_SAMPLE_TICKS
) -> DataFrame:
    """One row per (session, round, entity present): aligned arrays per field.

    A round is cut into the same ticks for everyone; a missing tick is a NULL and
    not a shift. An array is as long as its round. The round's ticks are merged into an
    entity's values within its row, so that only the values are shuffled.
    """
    t0 = F.ceil(F.col("start") / stride).cast("long") * stride
    last = F.col("end") - 1
    rounds = intervals.select("session_id", "number", t0.alias("t0"), last.alias("_last"))
    keys = ["session_id", "number", "entity_id"]
    # a round's values come together for its entities' rows and again for its document
    together = values.select(*keys, "team", "tick", *FIELDS).join(
        rounds.filter(F.col("t0") <= F.col("_last")), ["session_id", "number"]
    )
    side = F.when(F.col("team").isin(*SIDES), F.col("team"))
    found = together.groupBy(*keys).agg(
        F.mode(side, deterministic=True).alias("team"),
        F.first("t0").alias("t0"),
        F.first("_last").alias("_last"),
        F.collect_list(
            F.struct(F.col("tick").cast("long").alias("tick"), F.lit(False).alias("_empty"), *FIELDS)
        ).alias("_known"),
    )
    nothing = [F.lit(None).cast(values.schema[c].dataType).alias(c) for c in FIELDS]
    ticks = F.sequence(F.col("t0"), F.col("_last").cast("long"), F.lit(stride).cast("long"))
    empty = F.transform(
        ticks, lambda tick: F.struct(tick.alias("tick"), F.lit(True).alias("_empty"), *nothing)
    )
    merged = found.filter(F.col("team").isNotNull()).withColumn(
        "_all", F.sort_array(F.concat("_known", empty))
    )

    def wanted(row: Column, i: Column) -> Column:
        before = F.get(F.col("_all"), i - 1)["tick"]
        return ~row["_empty"] | before.isNull() | (before != row["tick"])

    packed = merged.withColumn("_rows", F.filter("_all", wanted))
    return packed.select(
        *keys,
        "t0",
        F.when(F.col("team") == 2, "T").when(F.col("team") == 3, "CT").alias("side"),
        *[F.transform("_rows", _field(c)).alias(c) for c in FIELDS],
    )


def last_place(rows: DataFrame, samples: DataFrame, who: str) -> DataFrame:
    """Where an entity last stood at each row's tick: place_x, place_y."""
    places = samples.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "session_id",
        F.col("entity_id").alias(who),
        "tick",
        F.col("x").alias("place_x"),
        F.col("y").alias("place_y"),
    )
    return asof_join(
        rows, places, on="tick", by=("session_id", who), take=("place_x", "place_y")
    )


def replay_shots(shots: DataFrame, intervals: DataFrame) -> DataFrame:
    return in_play(shots.filter(aimed_weapon(F.col("weapon"))), intervals).select(
        "session_id", "number", "tick", "entity_id"
    )


def replay_deaths(
    deaths: DataFrame, samples: DataFrame, intervals: DataFrame
) -> DataFrame:
    """Deaths in play time at the target's last place; a fall has no killer."""
    tagged = last_place(in_play(deaths, intervals), samples, "target_id")
    killer = F.when(
        ~F.col("entity_id").eqNullSafe(F.col("target_id")), F.col("entity_id")
    )
    return tagged.select(
        "session_id",
        "number",
        "tick",
        "target_id",
        killer.alias("killer_id"),
        "weapon",
        F.round("place_x").cast("int").alias("x"),
        F.round("place_y").cast("int").alias("y"),
    )


def replay_spans(
    starts: DataFrame, ends: DataFrame, intervals: DataFrame, *, cap: int | None = None
) -> DataFrame:
    """Smokes and fires as [tick, until): paired by reused id, ended by the round."""
    begun = in_play(starts, intervals)
    limit = F.col("end") if cap is None else F.least(F.col("end"), F.col("tick") + cap)
    return pair_start_end(
        begun, ends, by=("session_id", "entityid"), limit=limit, bound=F.col("end")
    )


def replay_objectives(
    events: DataFrame, samples: DataFrame, intervals: DataFrame
) -> DataFrame:
    """Objective events; one in a freeze belongs to the round after it."""
    tagged = before_interval_end(events, intervals)
    return last_place(tagged, samples, "entity_id")


def replay_places(
    deaths: DataFrame, objectives: DataFrame, samples: DataFrame, intervals: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Deaths and objective events as lists of a document want them, at the last place of
    their entity (of deaths the target). One look-up among the samples serves both.
    """
    shape = ["session_id", "number", "kind", "tick", "entity_id"]
    died = in_play(deaths, intervals).select(
        "session_id", "number", F.lit("death").alias("kind"), "tick",
        F.col("target_id").alias("entity_id"), F.lit(True).alias("_died"),
    )
    happened = before_interval_end(objectives, intervals)
    both = died.unionByName(happened.select(*shape, F.lit(False).alias("_died")))
    # read by the lists of two kinds
    found = staged(
        last_place(both, samples, "entity_id").select(
            "_died", *shape, *[F.round(f"place_{c}").cast("int").alias(c) for c in "xy"]
        )
    )
    columns = [*shape, "x", "y"]
    return found.filter("_died").select(*columns), found.filter("not _died").select(*columns)


def replay_documents(
    grid: DataFrame,
    intervals: DataFrame,
    events: DataFrame,
    spans: DataFrame | None = None,
    objectives: DataFrame | None = None,
) -> DataFrame:
    """One nested document per (session, round).

    ``events``: session_id, number, kind, tick, entity_id, x, y (the tables above in
    one shape). ``spans`` (smokes and fires): session_id, number, kind, tick, until, x,
    y. ``objectives`` are shaped like events. A round holds one roster and one round's
    events; each list is in order of tick.
    """
    players = grid.groupBy("session_id", "number").agg(
        F.min("t0").alias("t0"),
        F.sort_array(
            F.collect_list(F.struct("entity_id", "side", *FIELDS))
        ).alias("players"),
    )
    lists = {
        "events": (events, ("tick", "kind", "entity_id", "x", "y")),
        "spans": (spans, ("tick", "until", "kind", "x", "y")),
        "objectives": (objectives, ("tick", "kind", "entity_id", "x", "y")),
    }
    lists = {n: (table, columns) for n, (table, columns) in lists.items() if table is not None}
    # all lists travel together, a column each
    rows = None
    for name, (table, columns) in lists.items():
        part = table.select("session_id", "number", F.struct(*columns).alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    gathered = {name: F.collect_list(name) for name in lists}
    nested = rows.groupBy("session_id", "number").agg(
        *[F.when(F.size(c) > 0, F.sort_array(c)).alias(n) for n, c in gathered.items()]
    )
    out = intervals.join(players, ["session_id", "number"]).join(
        nested, ["session_id", "number"], "left"
    )
    parts = ["players", *lists]
    return out.select("session_id", "number", "start", "end", "t0", *parts)
