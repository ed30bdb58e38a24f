"""Ordered operators that never put one whole key into one task.

A window over ``(session, entity)`` sorts everything an entity ever did in a
single task. Here every series is cut into chunks (a span of ticks, of time or of
values), ordered work runs inside ``keys + chunk``, and what has to cross a chunk
border travels through a small table with one row per chunk:

``number_rows``, ``running_total``  counts and sums before the chunk
``neighbours``                      the row before / after the chunk
``last_known``                      the newest value seen before the chunk
``segments``                        runs and bursts that continue over a border
``with_halo``                       border rows copied into the next chunk, for
                                    dense sequences with a bounded look-back

The per-chunk tables are partial aggregates, so a key with a third of all rows
shrinks on the map side before anything is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import staged

#: Ticks per chunk. A series has one row per tick, so this bounds rows per task key.
CHUNK_TICKS = 1 << 16
#: Seconds per chunk for event time.
CHUNK_SECONDS = 600

_ALL = "_everything"


def tick_chunk(tick: str | Column, width: int = CHUNK_TICKS) -> Column:
    """Chunk of an integer time."""
    return F.floor(_col(tick) / F.lit(width)).cast("long")


def time_chunk(ts: str | Column, seconds: int = CHUNK_SECONDS) -> Column:
    """Chunk of a timestamp."""
    return F.floor(_col(ts).cast("double") / F.lit(seconds)).cast("long")


def value_chunk(value: str | Column, resolution: int = 1 << 14) -> Column:
    """A chunk that grows with the value: logarithmic, 0.006% of the value wide.

    Narrow, because one crowded stretch of values may hold much of a column.
    """
    v = _col(value).cast("double")
    size = F.floor(F.log1p(F.abs(v) * 1e6) * resolution)
    return (F.signum(v) * size).cast("long")


def hash_chunk(digest: str | Column, digits: int = 5) -> Column:
    """Chunk of a hex digest: its first digits, which order like the digest itself."""
    return F.conv(F.substring(_col(digest), 1, digits), 16, 10).cast("long")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [_col(c) for c in order]


def _prepare(
    df: DataFrame, keys: Sequence[str], chunk: Column
) -> tuple[DataFrame, list[str]]:
    """Add the chunk column; an empty key list becomes one constant key."""
    out = df.withColumn("_chunk", chunk)
    if not keys:
        return out.withColumn(_ALL, F.lit(0)), [_ALL]
    return out, list(keys)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a table that has exactly one row."""
    key = "_row_key"
    single = F.broadcast(one_row.withColumn(key, F.lit(0)))
    return df.withColumn(key, F.lit(0)).join(single, key).drop(key)


#: Rows that ``attach_small`` takes from a table at most.
SMALL_ROWS = 1000


def attach_small(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of one row per key and few keys, without a shuffle by key.

    The table travels as one row, so a handful of keys never gathers ``df`` in as many
    tasks. More than SMALL_ROWS keys fail the job rather than be broadcast.
    """
    others = [c for c in table.columns if c != key]
    entries = F.collect_list(F.struct(F.col(key), F.struct(*others)))
    count = F.count(F.lit(1))
    few = F.when(count <= SMALL_ROWS, entries).otherwise(
        F.raise_error(F.lit(f"more than {SMALL_ROWS} keys of {key}"))
    )
    row = table.filter(F.col(key).isNotNull()).agg(F.map_from_entries(few).alias("_table"))
    found = attach_row(df, row).withColumn("_found", F.col("_table")[F.col(key)])
    return found.filter(F.col("_found").isNotNull()).select(
        *df.columns, *[F.col("_found")[c].alias(c) for c in others]
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    *,
    inclusive: bool = True,
    grand: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cumulative sums per key. ``order`` must be a total order within a key.

    ``grand`` adds columns with the key's overall sum: ``{"n": "cum_n"}`` puts the
    total behind ``cum_n`` into ``n``.
    """
    tagged, keys = _prepare(df, keys, chunk)
    by = [*keys, "_chunk"]
    sums = tagged.groupBy(*by).agg(
        *[F.sum(e).alias(f"_sum_{n}") for n, e in totals.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    carry = sums.select(
        *by,
        *[
            F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_pre_{n}")
            for n in totals
        ],
        *[
            F.sum(f"_sum_{src}").over(everything).alias(out)
            for out, src in (grand or {}).items()
        ],
    )
    inside = W.partitionBy(*by).orderBy(*_order(order))
    inside = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = tagged.join(carry, by)
    for name, expr in totals.items():
        here = F.coalesce(F.sum(expr).over(inside), F.lit(0))
        out = out.withColumn(name, F.col(f"_pre_{name}") + here)
    return out.drop("_chunk", _ALL, *[f"_pre_{n}" for n in totals])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    name: str = "rn",
    *,
    count: str | None = None,
) -> DataFrame:
    """1-based row number per key (and optionally the key's row count)."""
    tagged, keys = _prepare(df, keys, chunk)
    by = [*keys, "_chunk"]
    sizes = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_chunk")
    earlier = earlier.rowsBetween(W.unboundedPreceding, -1)
    extra = [F.sum("_size").over(W.partitionBy(*keys)).alias(count)] if count else []
    carry = sizes.select(
        *by, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_pre"), *extra
    )
    inside = W.partitionBy(*by).orderBy(*_order(order))
    out = tagged.join(carry, by)
    out = out.withColumn(name, F.col("_pre") + F.row_number().over(inside))
    return out.drop("_chunk", "_pre", _ALL)


def number_by_range(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rn",
    *,
    count: str | None = None,
) -> DataFrame:
    """``number_rows`` with chunks cut by the whole order instead of by a value.

    ``order`` ends in columns that tell tied values apart, so rows of one value spread
    over tasks like any others: Spark samples the order and cuts it into even ranges.
    The ranges are written down, since numbering reads them twice.
    """
    ranged = in_ranges(df, keys, order)
    return number_rows(ranged, keys, F.col("_range"), order, name, count=count).drop(
        "_range"
    )


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """``df`` with ``_range``, a chunk that grows along keys and order and holds an even
    share of the rows, whatever their density. Written down, for chunks to stay as cut."""
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *_order(order))
    return staged(cut.withColumn("_range", F.spark_partition_id()))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    *,
    back: Mapping[str, str] | None = None,
    ahead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Values of the previous (``back``) and next (``ahead``) row, however far it is."""
    tagged, keys = _prepare(df, keys, chunk)
    by = [*keys, "_chunk"]
    position = F.struct(*order)
    sides = []
    if back:
        packed = F.struct(*[F.col(src).alias(dst) for dst, src in back.items()])
        sides.append(("_back", packed, F.max_by, F.lag, back))
    if ahead:
        packed = F.struct(*[F.col(src).alias(dst) for dst, src in ahead.items()])
        sides.append(("_ahead", packed, F.min_by, F.lead, ahead))
    edges = tagged.groupBy(*by).agg(
        *[pick(packed, position).alias(name) for name, packed, pick, _, _ in sides]
    )
    along = W.partitionBy(*keys).orderBy("_chunk")
    carry = edges.select(
        *by, *[shift(name).over(along).alias(name) for name, _, _, shift, _ in sides]
    )
    inside = W.partitionBy(*by).orderBy(*_order(order))
    out = tagged.join(carry, by)
    for name, packed, _, shift, columns in sides:
        near = F.coalesce(shift(packed).over(inside), F.col(name))
        out = out.withColumn(name, near)
        for dst in columns:
            out = out.withColumn(dst, F.col(name)[dst])
        out = out.drop(name)
    return out.drop("_chunk", _ALL)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    forward: bool = False,
    asked: Column | None = None,
    newest: Sequence[str] | None = None,
) -> DataFrame:
    """The newest non-null value at or before each row (``forward``: at or after).

    Forward reads the order backwards: Spark evaluates a frame that ends with the partition
    anew for every row, one that starts with it only once. ``asked`` tells the rows that want
    a value, and only those come back; ``newest`` is the order among rows with a value, where
    it takes fewer columns. What was known before a chunk enters it as a row of its own ahead
    of the others, so rows are sorted once and meet no join.
    """
    tagged, keys = _prepare(df, keys, chunk)
    by = [*keys, "_chunk"]
    for name, expr in values.items():
        tagged = tagged.withColumn(f"_v_{name}", expr)
    # a row without a key has no neighbours
    tagged = tagged.filter(" and ".join(f"`{c}` is not null" for c in by))
    wanted = tagged if asked is None else tagged.filter(asked)
    at = [F.col(c) for c in (newest or order)]
    position = at[0] if len(at) == 1 else F.struct(*at)
    pick = F.min_by if forward else F.max_by
    turned = F.desc if forward else F.asc
    edges = wanted.select(*by).distinct()
    for n in values:
        known = tagged.filter(F.col(f"_v_{n}").isNotNull())
        kind = tagged.schema[f"_v_{n}"].dataType
        # field by field, as buffers of plain numbers are aggregated without a sort
        if isinstance(kind, T.StructType):
            parts = [pick(F.col(f"_v_{n}")[f], position).alias(f) for f in kind.names]
            last = F.struct(*parts)
        else:
            last = pick(f"_v_{n}", position)
        newest_of = known.groupBy(*by).agg(last.alias(f"_e_{n}"))
        edges = edges.unionByName(newest_of, allowMissingColumns=True)
    along = W.partitionBy(*keys).orderBy(turned("_chunk"))
    along = along.rangeBetween(W.unboundedPreceding, -1)
    carried = [F.last(f"_e_{n}", ignorenulls=True).over(along).alias(f"_v_{n}") for n in values]
    any_known = " or ".join(f"`_v_{n}` is not null" for n in values)
    seeds = edges.select(*by, *carried).filter(any_known)
    seeds = seeds.dropDuplicates(by).withColumn("_seed", F.lit(True))
    inside = W.partitionBy(*by).orderBy(F.desc("_seed"), *[turned(c) for c in order])
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    out = tagged.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    for n in values:
        out = out.withColumn(n, F.last(f"_v_{n}", ignorenulls=True).over(inside))
    out = out.filter(~F.col("_seed") if asked is None else ~F.col("_seed") & asked)
    return out.drop("_chunk", _ALL, "_seed", *[f"_v_{n}" for n in values])


def with_halo(
    df: DataFrame,
    seq: str,
    *,
    back: int = 0,
    ahead: int = 0,
    width: int = CHUNK_TICKS,
) -> DataFrame:
    """Copy rows near a chunk border into the neighbouring chunk.

    For a dense sequence number. Adds ``_chunk`` and ``_own`` (false for copies).
    Windows over ``keys + _chunk`` may then look ``back`` / ``ahead`` rows; filter
    on ``_own`` afterwards. Costs one shuffle and ``(back + ahead) / width`` rows.
    """
    if max(back, ahead) > width:
        raise ValueError("the look-back must fit into one chunk")
    own = tick_chunk(seq, width)
    place = F.pmod(F.col(seq), F.lit(width))
    homes = F.array_compact(
        F.array(
            own,
            F.when(place >= width - back, own + 1) if back else F.lit(None),
            F.when(place < ahead, own - 1) if ahead else F.lit(None),
        )
    )
    return df.withColumn("_chunk", F.explode(homes)).withColumn(
        "_own", F.col("_chunk") == own
    )


def segments(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    starts: Column,
    aggs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """One row per segment; a segment begins wherever ``starts`` is true.

    ``aggs`` maps an output name to ``(how, column)`` with how one of ``min``,
    ``max``, ``sum``, ``first`` and ``last`` (by ``order``). Segments are first
    aggregated inside their chunk; only the two pieces at a chunk's ends can
    continue elsewhere, and only those are merged per key.
    """
    tagged, keys = _prepare(df, keys, chunk)
    by = [*keys, "_chunk"]
    position = [_col(c).alias(f"p{i}") for i, c in enumerate(order)]
    inside = W.partitionBy(*by).orderBy(*_order(order))
    numbered = tagged.withColumn("_start", starts.cast("int")).withColumn(
        "_no", F.sum("_start").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    fold = {
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "first": F.min,
        "last": F.max,
    }
    placed = ("first", "last")

    def value(how: str, column: Column) -> Column:
        if how in placed:
            return F.struct(*position, column.alias("v"))
        return column

    pieces = numbered.groupBy(*by, "_no").agg(
        *[fold[how](value(how, c)).alias(n) for n, (how, c) in aggs.items()]
    )
    pieces = pieces.withColumn("_last", F.max("_no").over(W.partitionBy(*by)))
    open_end = (F.col("_no") == 0) | (F.col("_no") == F.col("_last"))
    closed = pieces.filter(~open_end).select(*keys, *aggs)
    along = W.partitionBy(*keys).orderBy("_chunk", "_no")
    along = along.rowsBetween(W.unboundedPreceding, 0)
    joined = (
        pieces.filter(open_end)
        .withColumn("_seg", F.sum((F.col("_no") > 0).cast("int")).over(along))
        .groupBy(*keys, "_seg")
        .agg(*[fold[how](n).alias(n) for n, (how, _) in aggs.items()])
        .select(*keys, *aggs)
    )
    out = closed.unionByName(joined)
    for n, (how, _) in aggs.items():
        if how in placed:
            out = out.withColumn(n, F.col(n)["v"])
    return out.drop(_ALL)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    flag: Column,
    aggs: Mapping[str, tuple[str, Column]] | None = None,
    *,
    min_length: int = 1,
    width: int = CHUNK_TICKS,
) -> DataFrame:
    """Maximal stretches of rows where ``flag`` holds: start, end, length.

    The first row of an entity opens a run like any other row would.
    """
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    halo = with_halo(flagged, seq, back=1, width=width)
    return runs_in_chunks(halo, keys, seq, F.col("_flag"), aggs, min_length=min_length)


def runs_in_chunks(
    halo: DataFrame,
    keys: Sequence[str],
    seq: str,
    flag: Column,
    aggs: Mapping[str, tuple[str, Column]] | None = None,
    *,
    min_length: int = 1,
) -> DataFrame:
    """``runs`` of rows that :func:`with_halo` has cut, with at least one row to look back on.

    ``flag`` must be right on the row before a chunk too: what it looks back on itself
    comes on top.
    """
    flagged = halo.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    inside = W.partitionBy(*keys, "_chunk").orderBy(seq)
    changed = F.coalesce(F.lag("_flag").over(inside) != F.col("_flag"), F.lit(True))
    owned = flagged.withColumn("_changed", changed).filter("_own")
    found = segments(
        owned,
        keys,
        F.col("_chunk"),
        [seq],
        F.col("_changed"),
        {
            "_hit": ("max", F.col("_flag")),
            "run_start": ("min", F.col(seq)),
            "run_end": ("max", F.col(seq)),
            "length": ("sum", F.lit(1)),
            **(aggs or {}),
        },
    )
    return found.filter(F.col("_hit") & (F.col("length") >= min_length)).drop("_hit")
