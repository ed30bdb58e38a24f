"""Time joins: as-of, bounded look-back, anchor windows, pairs, interval pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.angles import ticks_to_ms
from sightline.operators.ordered import (
    CHUNK_TICKS,
    attach_row,
    in_ranges,
    last_known,
    number_rows,
    tick_chunk,
    with_halo,
)
from sightline.session import staged


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str,
    right_on: str | None = None,
    by: Sequence[str] = (),
    take: Sequence[str],
    tie: Sequence[str] = (),
    direction: str = "backward",
    allow_exact: bool = True,
    within: float | None = None,
    width: float | None = 1 << 16,
    how: str = "left",
) -> DataFrame:
    """Each left row with the nearest right row before (``backward``) or after it.

    Both sides are unioned and the newest right row is carried along the series, so
    a key's rows may spread over many tasks. ``tie`` orders right rows at equal
    time, ``within`` limits the distance, ``width`` is the chunk size in units of
    ``on``; without it chunks are cut by rows, for times of any density. Adds ``take`` (and, for ``inner``, drops rows without a match).
    """
    right_on = right_on or on
    forward = direction == "forward"
    by = list(by)
    # Where right rows sort among left rows of the same time
    first_side = allow_exact != forward
    right_side = 0 if first_side else 2
    packed_right = F.struct(
        F.col(right_on).alias("_rt"), *[F.col(c) for c in take]
    )
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
    empty_ties = [
        F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}")
        for i, c in enumerate(tie)
    ]
    r = right.filter(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("_t"),
        F.lit(right_side).alias("_side"),
        *ties,
        packed_right.alias("_right"),
    )
    rtype = r.schema["_right"].dataType
    l = left.select(
        *by,
        F.col(on).alias("_t"),
        F.lit(1).alias("_side"),
        *empty_ties,
        F.lit(None).cast(rtype).alias("_right"),
        F.struct(*left.columns).alias("_left"),
    )
    r = r.withColumn("_left", F.lit(None).cast(l.schema["_left"].dataType))
    both = r.unionByName(l)
    tie_names = [f"_tie{i}" for i in range(len(tie))]
    if width is None:
        # left rows of one time are apart by their content; their order does not matter
        plain = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
        apart = F.xxhash64(*[F.col("_left")[c] for c in plain])
        both = in_ranges(both, by, ["_t", "_side", *tie_names, apart])
        chunk = F.col("_range")
    else:
        chunk = F.floor(F.col("_t").cast("double") / F.lit(float(width))).cast("long")
    filled = last_known(
        both,
        by,
        chunk,
        ["_t", "_side", *tie_names],
        {"_near": F.col("_right")},
        forward=forward,
        asked=F.col("_side") == 1,
        newest=["_t", *tie_names],
    )
    near = F.col("_near")
    if within is not None:
        gap = F.abs(F.col("_t").cast("double") - near["_rt"].cast("double"))
        near = F.when(gap <= within, near)
    out = filled.withColumn("_near", near)
    if how == "inner":
        out = out.filter(F.col("_near").isNotNull())
    return out.select("_left.*", *[F.col("_near")[c].alias(c) for c in take])


def in_interval(
    rows: DataFrame,
    intervals: DataFrame,
    *,
    on: str = "tick",
    by: Sequence[str] = ("session_id",),
    take: Sequence[str] = ("number", "start", "end"),
    how: str = "inner",
) -> DataFrame:
    """Tag rows with the interval holding their time; rows in a gap are dropped, or
    with ``how="left"`` kept with NULLs.

    Overlapping intervals: the latest start wins and its end decides.
    """
    tagged = asof_join(
        rows,
        intervals,
        on=on,
        right_on="start",
        by=by,
        take=take,
        tie=("number",),
        how=how,
    )
    inside = F.col(on) < F.col("end")
    if how == "inner":
        return tagged.filter(inside)
    return tagged.select(
        *rows.columns, *[F.when(inside, F.col(c)).alias(c) for c in take]
    )


def before_interval_end(
    rows: DataFrame,
    intervals: DataFrame,
    *,
    on: str = "tick",
    by: Sequence[str] = ("session_id",),
    take: Sequence[str] = ("number",),
) -> DataFrame:
    """Like ``in_interval``, but a row in a gap belongs to the interval after it."""
    return asof_join(
        rows,
        intervals,
        on=on,
        right_on="end",
        by=by,
        take=take,
        tie=("number",),
        direction="forward",
        allow_exact=False,
        how="inner",
    )


def clamped_interval(
    rows: DataFrame,
    intervals: DataFrame,
    *,
    on: str = "tick",
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """The interval started last; rows before the first one get the first."""
    tagged = asof_join(
        rows,
        intervals,
        on=on,
        right_on="start",
        by=by,
        take=("number",),
        tie=("number",),
    )
    first = intervals.groupBy(*by).agg(F.min_by("number", "start").alias("_first"))
    return (
        tagged.join(first, list(by), "left")
        .withColumn("number", F.coalesce("number", "_first"))
        .drop("_first")
    )


def anchor_windows(
    samples: DataFrame,
    anchors: DataFrame,
    *,
    pre: int = 128,
    post: int = 32,
    drop_incomplete: bool = True,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Fixed-length windows of an entity's samples around its anchor events.

    ``anchors``: session_id, entity_id, target_id, tick and any further columns.
    Returns ``(windows, window_ticks)``; both carry ``window_uid``. Exactly the
    wanted (session, entity, tick) keys are joined, never entity by entity, and only
    those of windows known to be complete.
    """
    kept = anchors.filter(
        F.col("entity_id").isNotNull()
        & ~F.col("entity_id").eqNullSafe(F.col("target_id"))
    )
    numbered = number_rows(
        kept,
        ["session_id"],
        tick_chunk("tick"),
        ["tick", "entity_id", "target_id"],
        "window_id",
    )
    windows = numbered.withColumn("window_id", F.col("window_id") - 1).withColumn(
        "window_uid",
        F.concat_ws("#", F.col("session_id").cast("string"), F.col("window_id")),
    )
    if drop_incomplete:
        # a row per window, read for the ticks and again by all that looks at windows
        windows = staged(complete_windows(windows, samples, pre, post))
    wanted = windows.select(
        "session_id",
        "entity_id",
        "window_uid",
        "target_id",
        F.col("tick").alias("anchor_tick"),
        *carry,
        F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("tick_offset"),
    ).withColumn("tick", F.col("anchor_tick") + F.col("tick_offset"))
    clash = [c for c in ("target_id", *carry) if c in samples.columns]
    ticks = at_tick(wanted, samples.drop(*clash)).withColumn(
        "t_ms", ticks_to_ms(F.col("tick_offset"))
    )
    return windows, ticks


def complete_windows(
    windows: DataFrame, samples: DataFrame, pre: int, post: int
) -> DataFrame:
    """Only windows that find a sample on each of their ticks.

    The samples around an anchor are counted along its entity's ticks, in chunks, so that no
    tick of a window is written out to learn whether the window is whole.
    """
    keys = ["session_id", "entity_id", "tick"]
    known = windows.filter(" and ".join(f"{k} is not null" for k in keys))
    rest = [c for c in windows.columns if c != "window_uid"]
    packed = known.select(*keys, F.lit(0).alias("_n"), F.struct("window_uid", *rest).alias("_window"))
    empty = F.lit(None).cast(packed.schema["_window"].dataType)
    both = samples.select(*keys, F.lit(1).alias("_n"), empty.alias("_window")).unionByName(packed)
    chunked = with_halo(both, "tick", back=pre, ahead=post, width=max(CHUNK_TICKS, pre, post))
    near = W.partitionBy("session_id", "entity_id", "_chunk").orderBy("tick").rangeBetween(-pre, post)
    return (
        chunked.withColumn("_rows", F.sum("_n").over(near))
        .filter(F.col("_window").isNotNull() & F.col("_own") & (F.col("_rows") == pre + post + 1))
        .select("_window.*")
    )


def complete_groups(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Only groups with exactly ``size`` rows (groups are small by construction)."""
    rows = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("_rows", rows).filter(F.col("_rows") == size).drop("_rows")


def state_of(
    rows: DataFrame,
    samples: DataFrame,
    who: str,
    columns: dict[str, str],
    *,
    how: str = "left",
    tick: str = "tick",
) -> DataFrame:
    """Another entity's columns at the same tick: ``{sample column: new name}``."""
    state = samples.select(
        "session_id",
        "entity_id",
        "tick",
        *[F.col(c).alias(n) for c, n in columns.items()],
    )
    return at_tick(rows, state, who, how=how, tick=tick)


def at_tick(
    rows: DataFrame,
    samples: DataFrame,
    who: str = "entity_id",
    *,
    how: str = "inner",
    tick: str = "tick",
) -> DataFrame:
    """Rows with the columns of the sample that entity ``who`` has at their tick.

    Both sides are dealt by session and tick alone, as samples are stored, and the entity is
    compared within a tick's roster. So rows that have found their own sample stay where they are
    to find their target's.

    An inner join is merged: the rows are often written out of far fewer (a window's ticks), which
    the planner takes for the size of those, and would broadcast them through the driver.
    """
    place = {"session_id": "_session", "entity_id": "_entity", "tick": "_tick"}
    state = samples.withColumnsRenamed(place)
    same_tick = (F.col("session_id") == F.col("_session")) & (F.col(tick) == F.col("_tick"))
    # not an equality: those would be dealt by too
    same_entity = F.col(who).between(F.col("_entity"), F.col("_entity"))
    rows = rows.hint("merge") if how == "inner" else rows
    return rows.join(state, same_tick & same_entity, how).drop(*place.values())


def opposing_pairs(live: DataFrame) -> DataFrame:
    """Every (viewer, enemy) pair of one session tick; both orders of each pair.

    A tick holds a session's roster (ten rows in the source data), so the join key
    is as fine as the data gets.
    """
    viewers = live.select(
        "session_id", "tick", "entity_id", "team", "x", "y", "z", "yaw", "pitch"
    )
    enemies = live.select(
        "session_id",
        "tick",
        F.col("entity_id").alias("enemy_id"),
        F.col("team").alias("enemy_team"),
        F.col("x").alias("target_x"),
        F.col("y").alias("target_y"),
        F.col("z").alias("target_z"),
    )
    return viewers.join(enemies, ["session_id", "tick"]).filter(
        F.col("team") != F.col("enemy_team")
    )


def pair_start_end(
    starts: DataFrame,
    ends: DataFrame,
    *,
    by: Sequence[str],
    on: str = "tick",
    limit: Column | None = None,
    bound: Column | None = None,
    width: float | None = 1 << 16,
) -> DataFrame:
    """Each start with the earliest end at or after it that reuses its id.

    Ids are reused, so an end before the start belongs to an older one. Without an
    end, ``limit`` (an expression over the start row) closes the span; nothing lasts
    past ``bound``. As an as-of join forward this reads every start and end once.
    """
    paired = asof_join(
        starts,
        ends.select(*by, F.col(on).alias("until")),
        on=on,
        right_on="until",
        by=by,
        take=("until",),
        direction="forward",
        width=width,
    )
    if limit is not None:
        paired = paired.withColumn("until", F.coalesce(F.col("until"), limit))
    if bound is not None:
        paired = paired.withColumn("until", F.least(F.col("until"), bound))
    return paired


def step_lookup(
    rows: DataFrame,
    cuts: DataFrame,
    *,
    value: str,
    cut: str = "cut",
    level: str = "level",
    name: str = "percentile",
    by: Sequence[str] = (),
) -> DataFrame:
    """Share of the reference below a value: the level of the last cut <= value, else 0.

    ``cuts`` is a quantile grid: a fixed number of rows per reference group. It is
    folded into one array per group, so the lookup is a plain equi-join.
    """
    steps = cuts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cut), F.col(level)))).alias("_steps")
    )
    under = F.filter("_steps", lambda s: s[cut] <= F.col(value))
    found = F.array_max(F.transform(under, lambda s: s[level]))
    # without groups the grid is one row, and only that row is broadcast
    placed = rows.join(steps, list(by), "left") if by else attach_row(rows, steps)
    return placed.withColumn(
        name, F.when(F.col(value).isNotNull(), F.coalesce(found, F.lit(0.0)))
    ).drop("_steps")


def compare_tables(
    stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Rows that differ or are missing on one side, with ``status``."""
    a = stored.select(*keys, F.struct(*columns).alias("_a"))
    b = fresh.select(*keys, F.struct(*columns).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "only_fresh")
        .when(F.col("_b").isNull(), "only_stored")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "equal")
        .otherwise("differs")
    )
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))
