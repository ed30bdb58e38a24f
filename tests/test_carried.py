"""Runs and look-back over streams do not depend on files, batches or restarts."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.ordered import runs
from sightline.streaming import jobs
from sightline.streaming.carried import CarriedLookback, CarriedRuns
from tests.conftest import rows

SCHEMA = "k long, seq long, v double"


def put(spark, folder, data, schema=SCHEMA):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(folder))


def stream(spark, source, schema=SCHEMA, n=1):
    return jobs.file_stream(spark, str(source), spark.createDataFrame([], schema).schema, files_per_batch=n)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_any_file_split_and_after_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(k, i, float(rng.random() < 0.7) * rng.randrange(1, 9)) for k in range(3) for i in range(40 + k)]
    shuffled = data[:]
    if seed > 1:  # rows in any order; else files follow the sequence
        rng.shuffle(shuffled)
    else:
        shuffled.sort(key=lambda r: r[1])
    carried = CarriedRuns(["k"], "seq", F.col("v") > 0, {"peak": ("max", F.col("v"))}, width=7)
    out, state, source = str(tmp_path / "out"), str(tmp_path / "state"), tmp_path / "in"
    cuts = [0, 30, 31, 90, len(shuffled)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        put(spark, source / str(i), shuffled[a:b])
        if i in (1, 3):  # two drains of two batches
            found, refused = carried.drain(stream(spark, source), out, state)
    want = runs(spark.createDataFrame(data, SCHEMA), ["k"], "seq", F.col("v") > 0, {"peak": ("max", F.col("v"))})
    assert rows(found, "k", "start", "end", "peak") == rows(want, "k", "run_start", "run_end", "peak")
    assert refused == 0
    # in order, what is kept of a key is one region and the runs at its ends
    last = jobs.last_committed(spark, state)
    kept = spark.read.parquet(f"{out}/regions/turn={last % 2}")
    assert kept.count() == 3 and spark.read.parquet(f"{out}/open/turn={last % 2}").count() <= 6
    # rows that were taken in once are refused, and change nothing
    put(spark, source / "again", [(0, 3, 99.0), (1, 5, 0.0), (2, None, 1.0)])
    again, refused = carried.drain(stream(spark, source), out, state)
    assert refused == 2 and rows(again, "k", "start", "end", "peak") == rows(found, "k", "start", "end", "peak")


def test_lookback_finds_what_comes_later_in_other_files(spark, tmp_path):
    rng = random.Random(5)
    schema = "kind string, id long, k long, tick long"
    data = [("a", i, rng.randrange(3), rng.randrange(200)) for i in range(60)]
    data += [("e", i, rng.randrange(3), rng.randrange(200)) for i in range(90)]
    rng.shuffle(data)
    out, state, source = str(tmp_path / "out"), str(tmp_path / "state"), tmp_path / "in"
    carried = CarriedLookback(["k"], "tick", ["id"], span=9, part=16)
    kind = lambda name: lambda df: df.where(F.col("kind") == name)
    for i in range(4):
        put(spark, source / str(i), data[i::4], schema)
        if i % 2:
            found = carried.drain(stream(spark, source, schema), kind("a"), kind("e"), out, state)
    events = [(k, t) for name, _, k, t in data if name == "e"]
    want = [
        (i, k, t, max((e for q, e in events if q == k and t - 9 <= e <= t), default=None))
        for name, i, k, t in data
        if name == "a"
    ]
    assert sorted(map(tuple, found.select("id", "k", "tick", "event_tick").collect())) == sorted(want)
    assert {w[3] is None for w in want} == {True, False}
