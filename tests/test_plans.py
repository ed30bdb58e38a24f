"""Plan shapes the scale claims rest on."""

import re

import pytest
from pyspark.sql import functions as F

from sightline.operators import replay
from sightline.operators.cases import moments_in_context, top_moments
from sightline.operators.joins import asof_join
from sightline.operators.motion import entity_deltas
from sightline.operators.ordered import with_halo
from sightline.operators.quantiles import quantiles
from sightline.operators.sampling import stratified_sample
from sightline.plans import adapters as A
from sightline.plans import catalog
from sightline.plans import windows as Q
from sightline.session import staged
from tests.conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark):
    """One entity owns two thirds of the rows."""
    ids = spark.range(1, 30_001)
    hot = ids.select(F.lit(1).cast("long").alias("entity_id"), F.col("id").alias("tick"))
    others = F.explode(F.sequence(F.lit(2).cast("long"), F.lit(151).cast("long")))
    rest = ids.filter("id <= 100").withColumn("entity_id", others)
    both = hot.unionByName(rest.select("entity_id", F.col("id").alias("tick")))
    return both.select(
        F.lit(0).cast("long").alias("session_id"),
        "entity_id",
        "tick",
        F.col("tick").alias("seq"),
        (F.col("tick") * 1.5).alias("yaw"),
        F.lit(0.0).alias("pitch"),
        F.lit(True).alias("is_alive"),
        F.lit(False).alias("is_freeze"),
    )


def test_deltas_take_one_shuffle_on_chunks(samples):
    text = plan(entity_deltas(samples))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", text)
    assert len(exchanges) == 1 and "_chunk" in exchanges[0]


def test_a_hot_entity_is_cut_into_bounded_chunks(samples):
    sizes = (
        with_halo(samples, "seq", back=1, width=1000)
        .groupBy("entity_id", "_chunk")
        .count()
    )
    top = sizes.agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert top.m <= 1001 and top.n > 30


def test_deltas_of_a_hot_entity_do_not_depend_on_chunks(samples):
    a = entity_deltas(samples, width=1000).agg(F.sum("yaw_speed"), F.count("d_yaw")).first()
    b = entity_deltas(samples).agg(F.sum("yaw_speed"), F.count("d_yaw")).first()
    assert a == b


def test_top_k_limits_before_the_shuffle(spark):
    schema = "session_id long, entity_id long, window_uid string, aim_through_wall_share double, angle_at_first_visible double"
    assert plan(top_moments(spark.createDataFrame([], schema))).count("WindowGroupLimit") == 2
    docs = spark.createDataFrame([], "id long, g string")
    assert plan(stratified_sample(docs, ["g"], "id", 3)).count("WindowGroupLimit") == 2


def test_windows_are_not_broadcast_to_moments(spark):
    """A row per window: its file is small, its table in the driver's memory is not."""
    features = spark.createDataFrame(
        [(1, 2, f"1#{i}", 0.1 * i, 5.0) for i in range(5)],
        "session_id long, entity_id long, window_uid string, aim_through_wall_share double, angle_at_first_visible double",
    )
    windows = staged(spark.createDataFrame([(f"1#{i}", 100 + i) for i in range(5)], "window_uid string, tick long"))
    shown = moments_in_context(features, windows, k=2)
    assert rows(shown, "window_uid", "tick", "place") == [("1#3", 103, 2), ("1#4", 104, 1)]
    assert "Broadcast" not in plan(shown)


def test_joins_are_equi_joins(spark, samples):
    right = samples.select("session_id", "entity_id", "tick", F.col("yaw").alias("near"))
    near = asof_join(samples, right, on="tick", by=("session_id", "entity_id"), take=("near",))
    mids = quantiles(samples, ["entity_id"], "yaw", {"m": 0.5})
    for df in (near, mids):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "SinglePartition" not in text


def exchanges_above(plan, scan="Bucketed: true"):
    """For every bucketed scan in a plan's text, what shuffles its rows before the first join."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    found = []
    for at, line in enumerate(lines):
        if scan not in line:
            continue
        here, path = depth(line), []
        for above in reversed(lines[:at]):
            if depth(above) < here:
                here = depth(above)
                path.append(above)
                if "Join" in above:
                    break
        found.append([p for p in path if "Exchange" in p])
    return found


@pytest.mark.parametrize("name", ["anchor_windows", "target_geometry"])
def test_stored_samples_are_joined_where_they_lie(spark, name):
    from sightline.operators.joins import anchor_windows, state_of
    from sightline.plans import adapters as A

    s = A.stored_samples(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.createDataFrame(
            A.anchors(s).collect(), A.anchors(s).schema
        )
        if name == "anchor_windows":
            found = anchor_windows(s, wanted, pre=2, post=1)[1]
        else:
            found = state_of(wanted, s, "target_id", {"x": "target_x"})
        text = found._jdf.queryExecution().executedPlan().toString()
        n = found.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = exchanges_above(text)
    assert above and not any(above), text
    assert n > 0


def test_samples_are_made_after_the_last_shuffle(spark, tmp_path):
    """What is dealt out is the event and its deltas; the stored table is that of whole samples."""
    from sightline.operators.motion import entity_deltas
    from sightline.plans import adapters as A
    from sightline.sources import stored

    d = "/root/testdata/sf0.001"
    text = plan(A._as_samples(A._numbered(spark, d)))
    shuffled = text[text.index("Exchange hash"):]
    assert not any(f"AS {c}#" in shuffled for c in ("weapon", "name", "yaw", "spotted_by", "target_id"))
    whole, made = entity_deltas(A.samples(spark, d)), A.stored_samples(spark, d)
    assert whole.columns == made.columns and whole.schema.simpleString() == made.schema.simpleString()
    assert whole.exceptAll(made).isEmpty() and made.exceptAll(whole).isEmpty()
    dealt = stored.write_bucketed(
        spark.range(50).selectExpr("id % 3 as session_id", "id % 7 as entity_id", "id as tick"),
        str(tmp_path / "t"), buckets=3, finish=lambda rows_: rows_.withColumn("x", F.col("tick") * 2),
    )
    assert dealt.filter("x = 2 * tick").count() == 50


def test_a_stored_table_is_registered_again_and_unions_of_it_group_whole(spark, tmp_path):
    from sightline.sources import stored

    rows_ = spark.range(1000).selectExpr("id % 3 as session_id", "id % 7 as entity_id", "id as tick", "id * 1.5 as x")
    path = str(tmp_path / "t")
    first = stored.write_bucketed(rows_, path, buckets=3)
    spark.sql(f"DROP TABLE {stored._name(path)}")
    again = stored.read_bucketed(spark, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows_.collect())) and first.columns == again.columns
    twice = again.unionByName(again).groupBy(*stored.SAMPLE_KEYS).count()
    assert twice.count() == 1000 and twice.where("count <> 2").isEmpty()


def test_targets_are_found_where_own_ticks_lie(spark):
    """The wanted ticks travel once: own sample, shot and target are found in the same place."""
    from sightline.operators.joins import at_tick
    from sightline.plans import adapters as A
    from sightline.plans import windows as Q

    s = A.stored_samples(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Q.shot_ticks(s))
        pairs = at_tick(A.anchors(s), s.select("session_id", "entity_id", "tick", "x"), "target_id")
        told = A.anchors(s).join(
            s.selectExpr("session_id", "entity_id as target_id", "tick", "x"), ["session_id", "target_id", "tick"]
        ).select(*pairs.columns)
        assert pairs.exceptAll(told).isEmpty() and told.exceptAll(pairs).isEmpty() and not pairs.isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1, text
    assert text.count("SortMergeJoin") == 2 and "NestedLoop" not in text


def test_a_rule_deals_its_rows_once(samples):
    """The look-back of a median or a turn and that of the run share one shuffle by chunk."""
    from sightline.operators import rules as R

    moved = entity_deltas(samples)
    for found in (R.sustained_runs(moved, 1.0, 4), R.alternating_runs(moved, 1.0, 2)):
        text = plan(found)
        closed = text[: text.rindex("Union") + 1] if "Union" in text else text
        whole = len(re.findall(r"Exchange hashpartitioning\([^)]*_chunk", text))
        # two branches (closed runs, open ones), each with the shuffle of the deltas below
        assert whole <= 4, (whole, closed)


def test_channels_are_made_before_rows_are_dealt(spark):
    from sightline.operators import tensors as N

    ticks = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0)], "window_uid string, tick_offset int, yaw_speed double, d_yaw double, d_pitch double")
    text = plan(N.sequence_channels(ticks, size=1))
    assert "as float)" in text[text.index("Exchange hashpartitioning(window_uid"):]


def test_the_approach_comes_with_the_features(spark):
    """The same points as ticks read again give, so no ticks are stored for them."""
    from sightline.operators import cases as Z
    from sightline.operators import features as X
    from sightline.plans import adapters as A
    from sightline.plans import windows as Q

    ticks = Q.shot_ticks(A.stored_samples(spark, "/root/testdata/sf0.001"))
    made = X.window_features(ticks, A.SEGMENTS, stride=2).select("window_uid", "trajectory")
    read = Z.trajectories(ticks.select("window_uid").distinct(), ticks, stride=2)
    as_rows = lambda df: sorted((r.window_uid, r.trajectory) for r in df.collect())
    assert as_rows(made) == as_rows(read) and not read.isEmpty()


def test_asof_meets_no_join_and_sorts_its_rows_once(spark):
    left = spark.createDataFrame([(1, 5), (1, 70_000), (None, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 4, 0.5, 1), (1, 6, 0.25, 2), (None, 1, 9.0, 3)], "k long, t long, v double, w long")
    found = asof_join(left, right, on="t", by=["k"], take=["v", "w"])
    assert sorted(map(tuple, found.collect())) == [(1, 5, 0.5, 1), (1, 70_000, 0.25, 2)]
    text = plan(found)
    assert "Join" not in text and "SortAggregate [k" not in text and "max_by(_right" not in text


def test_replay_grid_shuffles_values_once(spark):
    names = "session_id long, number int, entity_id long, tick long, team int, x int, y int, z int, yaw int, hp int, blind int, sees long"
    values = spark.createDataFrame(
        [(0, 1, e, t, team, t, 0, 0, 0, 9, 0, None) for e, team, t in ((1, 2, 4), (1, 2, 12), (2, 3, 8), (3, None, 4))], names
    )
    rounds = spark.createDataFrame([(0, 1, 1, 14)], "session_id long, number int, start long, end long")
    grid = replay.replay_grid(values, rounds)
    got = {r.entity_id: (r.side, r.t0, r.x) for r in grid.collect()}
    assert got == {1: ("T", 4, [4, None, 12]), 2: ("CT", 4, [None, 8, None])}
    text = plan(replay.replay_grid(values, rounds))
    assert "Generate" not in text and text.count("Join") == 1


def test_played_samples_are_tagged_once(spark):
    s = spark.createDataFrame(
        [(0, 1, t, t % 3 == 0, t == 5, 2) for t in range(1, 12)],
        "session_id long, entity_id long, tick long, shot boolean, anchor boolean, target_id long",
    ).withColumn("weapon", F.lit("ak47"))
    rounds = spark.createDataFrame([(0, 1, 4, 9)], "session_id long, number int, start long, end long")
    tagged = replay.played(s, rounds)
    assert rows(tagged, "tick", "number") == [(3, None), (4, 1), (5, 1), (6, 1), (8, 1), (9, None)]
    assert rows(replay.in_play(tagged, rounds), "tick") == [(4,), (5,), (6,), (8,)]
    again = replay.replay_shots(tagged.filter("shot"), rounds)
    assert rows(again, "tick") == [(6,)] and plan(again).count("Window") == plan(tagged).count("Window")


def test_replay_scenes_read_no_sample_twice(spark):
    """What the lists share is stored: the last plan reads no samples, and looks up no round."""
    found = catalog.QUERIES["replay_scenes"].run(spark, "/root/testdata/sf0.001")
    assert "bucketed_" not in plan(found) and plan(found).count("Generate") == 0


def test_one_measurement_makes_no_other(spark):
    s = A.stored_samples(spark, "/root/testdata/sf0.001")
    names = ("session_id", "entity_id", "label", "wall_aim_share")
    one, found = Q.measured(s, *names[2:]), Q.measured(s, *names)
    assert rows(found, *names) == rows(Q.entities(s), *names) != []
    text = plan(one)
    # no quantiles, no ordered helpers, and a window's features go from their ticks to the entity
    assert "Expand" not in text and "Window" not in text and "yaw_speed" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 3
