"""Ordered operators give one answer for every chunk width and partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.motion import entity_deltas
from sightline.operators.ordered import (
    last_known,
    neighbours,
    number_rows,
    running_total,
    runs,
    segments,
    tick_chunk,
    value_chunk,
)
from sightline.operators.rules import rolling_median
from tests.conftest import rows

WIDTHS = [4, 7, 1 << 16]


@pytest.fixture(scope="module")
def series(spark):
    """Two entities; one holds most rows, ticks have gaps, seq is dense."""
    rng = random.Random(3)
    data = []
    for entity, n in ((1, 60), (2, 5)):
        tick = 0
        for seq in range(1, n + 1):
            tick += rng.choice([1, 1, 1, 2, 9])
            data.append((entity, tick, seq, rng.random() < 0.6, rng.randrange(10)))
    df = spark.createDataFrame(
        data, "entity_id long, tick long, seq long, flag boolean, v long"
    ).withColumn("session_id", F.lit(0).cast("long"))
    return data, df.repartition(3)


def by_entity(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", WIDTHS)
def test_running_total_and_numbers(series, width):
    data, df = series
    chunk = tick_chunk("tick", width)
    got = running_total(
        df, ["entity_id"], chunk, ["tick"], {"upto": F.col("v")}, grand={"all": "upto"}
    )
    want = []
    for entity, rs in by_entity(data).items():
        total = 0
        for r in rs:
            total += r[4]
            want.append((entity, r[1], total, sum(x[4] for x in rs)))
    assert rows(got, "entity_id", "tick", "upto", "all") == sorted(want)
    numbered = number_rows(df, ["entity_id"], chunk, ["tick"], "rn", count="n")
    assert all(r.rn == r.seq for r in numbered.collect())
    assert {(r.entity_id, r.n) for r in numbered.collect()} == {(1, 60), (2, 5)}


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours_cross_any_gap(series, width):
    data, df = series
    got = neighbours(
        df,
        ["entity_id"],
        tick_chunk("tick", width),
        ["tick"],
        back={"before": "v"},
        ahead={"after": "tick"},
    )
    want = []
    for entity, rs in by_entity(data).items():
        for i, r in enumerate(rs):
            before = rs[i - 1][4] if i else None
            after = rs[i + 1][1] if i + 1 < len(rs) else None
            want.append((entity, r[1], before, after))
    key = lambda t: tuple((v is None, v) for v in t)
    assert rows(got, "entity_id", "tick", "before", "after") == sorted(want, key=key)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("forward", [False, True])
def test_last_known(series, width, forward):
    data, df = series
    got = last_known(
        df,
        ["entity_id"],
        tick_chunk("tick", width),
        ["tick"],
        {"near": F.when(F.col("v") > 7, F.col("tick"))},
        forward=forward,
    )
    for entity, rs in by_entity(data).items():
        marks = [r[1] for r in rs if r[4] > 7]
        mine = {r.tick: r.near for r in got.filter(F.col("entity_id") == entity).collect()}
        for r in rs:
            if forward:
                want = min((m for m in marks if m >= r[1]), default=None)
            else:
                want = max((m for m in marks if m <= r[1]), default=None)
            assert mine[r[1]] == want


def test_forward_fill_takes_time_by_row(series):
    """A frame that ends with its partition is evaluated anew for every row."""
    _, df = series
    got = last_known(
        df, ["entity_id"], tick_chunk("tick"), ["tick"], {"near": F.col("v")}, forward=True
    )
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("width", WIDTHS)
def test_runs_over_chunk_borders(series, width):
    data, df = series
    got = runs(
        df, ["session_id", "entity_id"], "seq", F.col("flag"), {"peak": ("max", F.col("v"))}, width=width
    )
    want = []
    for entity, rs in by_entity(data).items():
        current = []
        for r in [*rs, (entity, None, None, False, None)]:
            if r[3]:
                current.append(r)
            elif current:
                want.append(
                    (entity, current[0][2], current[-1][2], len(current), max(x[4] for x in current))
                )
                current = []
    assert rows(got, "entity_id", "run_start", "run_end", "length", "peak") == sorted(want)


def test_a_run_on_the_first_row_is_not_split(spark):
    df = spark.createDataFrame(
        [(0, 1, i, i <= 3) for i in range(1, 6)],
        "session_id long, entity_id long, seq long, flag boolean",
    )
    got = runs(df, ["session_id", "entity_id"], "seq", F.col("flag"), min_length=3)
    assert rows(got, "run_start", "run_end", "length") == [(1, 3, 3)]


@pytest.mark.parametrize("width", WIDTHS)
def test_segments_keep_first_and_last(series, width):
    data, df = series
    got = segments(
        df,
        ["entity_id"],
        tick_chunk("tick", width),
        ["tick"],
        F.col("v") >= 8,
        {
            "n": ("sum", F.lit(1)),
            "first_v": ("first", F.col("v")),
            "last_v": ("last", F.col("v")),
            "start": ("min", F.col("tick")),
        },
    )
    want = []
    for entity, rs in by_entity(data).items():
        parts = []
        for r in rs:
            if r[4] >= 8 or not parts:
                parts.append([])
            parts[-1].append(r)
        want += [(entity, p[0][1], len(p), p[0][4], p[-1][4]) for p in parts]
    assert rows(got, "entity_id", "start", "n", "first_v", "last_v") == sorted(want)


@pytest.mark.parametrize("width", [20, 1 << 16])
def test_rolling_median_needs_a_full_frame(series, width):
    import statistics

    data, df = series
    got = rolling_median(df, F.col("v").cast("double"), 16, width=width)
    for entity, rs in by_entity(data).items():
        mine = {r.seq: r.rolling for r in got.filter(F.col("entity_id") == entity).collect()}
        for i, r in enumerate(rs):
            if i < 15:
                assert mine[r[2]] is None
            else:
                assert mine[r[2]] == statistics.median(x[4] for x in rs[i - 15 : i + 1])


def test_value_chunks_grow_with_the_value(spark):
    rng = random.Random(1)
    values = [rng.uniform(-5, 5) * 10 ** rng.randint(-8, 6) for _ in range(500)] + [0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted(rows(df.withColumn("c", value_chunk("v")), "v", "c"))
    chunks = [c for _, c in got]
    assert chunks == sorted(chunks)


def test_deltas_are_the_same_for_every_width(spark):
    rng = random.Random(5)
    data = [
        (0, e, t, t, rng.uniform(-180, 180), rng.uniform(-80, 80), rng.random() > 0.1, False)
        for e in (1, 2)
        for t in range(1, 40)
    ]
    df = spark.createDataFrame(
        data,
        "session_id long, entity_id long, tick long, seq long, yaw double, pitch double,"
        " is_alive boolean, is_freeze boolean",
    )
    columns = ("entity_id", "tick", "d_tick", "d_yaw", "yaw_speed")
    wide = rows(entity_deltas(df), *columns)
    assert rows(entity_deltas(df.repartition(5), width=3), *columns) == wide


def test_one_tied_value_spreads_over_tasks(spark):
    """A value that holds all rows is numbered right, and no range holds them all."""
    from sightline.operators import ordered

    df = spark.range(0, 40_000, numPartitions=8).select(
        F.lit("k").alias("key"), F.lit(1.0).alias("v"), F.xxhash64("id").alias("tie")
    )
    found = ordered.number_by_range(df, ["key"], ["v", "tie"], "rn", count="n")
    assert found.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn"), F.max("n")).first()[:] == (1, 40_000, 40_000, 40_000)
    out_of_order = found.alias("a").join(found.alias("b"), F.col("a.rn") == F.col("b.rn") - 1).filter("a.tie >= b.tie")
    assert out_of_order.count() == 0
    cut = df.repartitionByRange("key", "v", "tie").groupBy(F.spark_partition_id()).count()
    assert cut.agg(F.max("count")).first()[0] < 40_000 or cut.count() == 1


def test_one_moment_may_hold_all_rows(spark):
    """As-of joins and runs cut by rows: all rows at one time, and crowded ones."""
    from sightline.operators import joins

    rng = random.Random(3)
    left = [(k, rng.choice([5.0, 5.0, 5.0, 1.0, 9.0]), i) for i in range(600) for k in "ab"]
    right = [(k, t, f"{k}{t}") for k in "ab" for t in (0.0, 5.0, 8.0)]
    lf = spark.createDataFrame(left, "k string, t double, i long")
    rf = spark.createDataFrame(right, "k string, u double, name string")
    found = joins.asof_join(lf, rf, on="t", right_on="u", by=("k",), take=("name",), width=None)
    near = lambda t: max(u for u in (0.0, 5.0, 8.0) if u <= t)
    assert sorted((r.k, r.i, r.t, r.name) for r in found.collect()) == sorted((k, i, t, f"{k}{near(t)}") for k, t, i in left)
