"""Text and label helpers, stored layouts, and checks on broadcast tables."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import labels as L
from sightline.functions import text as T
from sightline.functions.angles import grid_cell
from sightline.operators import replay
from sightline.operators.ordered import attach_small
from sightline.sources import manifest, sinks
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_percentile_text(spark):
    said = {None: "-", 0.995: "top 1%", 0.99: "top 1%", 0.75: "top 25%", 0.0: "top 100%", 0.989: "top 1%"}
    for p, text in said.items():
        assert one(spark, T.percentile_text(F.lit(p).cast("double"))) == text


def test_header_and_alias_text(spark):
    assert len(one(spark, T.header_text(F.lit("x" * 500)))) == 128
    assert one(spark, L.alias_ids(F.lit(3))) == "Player_2"


def test_line_band(spark):
    band = lambda v, n, s, h: one(spark, L.line_band(F.lit(v).cast("double"), F.lit(n).cast("double"), F.lit(s).cast("double"), F.lit(h)))
    assert band(2, 2, 3, True) == "past 95% line" and band(3, 2, 3, True) == "past 99% line"
    assert band(1, 2, 3, True) == "inside clean range" and band(1, 2, 1, False) == "past 99% line"
    assert band(None, 2, 3, True) == band(1, None, 3, True) == "no measurement"


def test_a_small_table_is_attached_and_a_large_one_fails(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], "map string, n int, s string")
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 4.0), ("a", 5.0)], "map string, v double")
    assert rows(attach_small(left, table, "map"), "map", "v", "n", "s") == [
        ("a", 1.0, 1, "x"), ("a", 5.0, 1, "x"), ("b", 2.0, 2, None),
    ]
    many = spark.range(1001).select(F.col("id").cast("string").alias("map"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="more than 1000 keys"):
        attach_small(left, many, "map").collect()
    plan = attach_small(left, table, "map")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(map" not in plan


def test_window_dataset_is_written_by_parts(spark, tmp_path):
    windows = spark.createDataFrame([("w", "clean")], "window_uid string, label string")
    ticks = spark.createDataFrame([("w", 0)], "window_uid string, tick_offset int")
    sinks.write_windows(windows, ticks, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/windows").collect() == windows.collect()
    assert spark.read.parquet(f"{tmp_path}/window_ticks").collect() == ticks.collect()


def test_listed_sessions_come_first(spark):
    listing = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x")], "path string, folder string")
    assert [r.path for r in manifest.listed_first(listing, "x").collect()] == ["b", "c", "a"]


def test_grid_cells(spark):
    got = spark.createDataFrame([(-0.5,), (0.0,), (9.9,), (10.0,)], "v double").select(grid_cell(F.col("v"), 10.0).alias("c"))
    assert [r.c for r in got.collect()] == [-1, 0, 0, 1]


def test_documents_hold_spans_and_objectives_in_order(spark):
    rounds = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 100, 200)], "session_id string, number int, start int, end int")
    players = ", ".join(f"{f} array<double>" for f in replay.FIELDS)
    grid = spark.createDataFrame(
        [("s", n, 0, 7, 2, *([[1.0]] * len(replay.FIELDS))) for n in (1, 2)],
        f"session_id string, number int, t0 int, entity_id int, side int, {players}",
    )
    shape = "session_id string, number int, kind string, tick int, entity_id int, x int, y int"
    events = spark.createDataFrame([("s", 1, "shot", 9, 7, 0, 0), ("s", 1, "death", 5, 7, 0, 0)], shape)
    spans = spark.createDataFrame([("s", 1, "smoke", 30, 60, 1, 2), ("s", 1, "fire", 20, 25, 3, 4)], "session_id string, number int, kind string, tick int, until int, x int, y int")
    goals = spark.createDataFrame([("s", 2, "planted", 150, 7, 5, 6)], shape)
    found = {r.number: r for r in replay.replay_documents(grid, rounds, events, spans, goals).collect()}
    assert [e.kind for e in found[1].events] == ["death", "shot"] and found[2].events is None
    assert [(p.kind, p.tick, p.until) for p in found[1].spans] == [("fire", 20, 25), ("smoke", 30, 60)]
    assert [g.kind for g in found[2].objectives] == ["planted"] and found[1].objectives is None


def test_cache_makes_only_stale_files(spark, tmp_path):
    asked = []

    def make(stale):
        asked.append(sorted(r.path for r in stale.collect()))
        return stale.filter("path <> 'empty'").select("path", "modified", F.length("path").alias("n"))

    def found(*files):
        sources = spark.createDataFrame(files, "path string, modified long")
        return rows(manifest.read_through_cache(sources, str(tmp_path), ["n"], make), "path", "modified", "n")

    assert found(("a", 1), ("bb", 1), ("empty", 1)) == [("a", 1, 1), ("bb", 1, 2)]
    assert found(("a", 1), ("bb", 2), ("empty", 1)) == [("a", 1, 1), ("bb", 2, 2)]
    assert found(("a", 1)) == [("a", 1, 1)]
    assert asked == [["a", "bb", "empty"], ["bb"], []]
    # another list of columns is another cache
    assert manifest.cache_root(str(tmp_path), ["n"]) != manifest.cache_root(str(tmp_path), ["n", "m"])


def test_finished_outputs_are_left_alone(spark, tmp_path):
    first = spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, v int")
    more = spark.createDataFrame([("s1", 9), ("s3", 3)], "session_id string, v int")
    manifest.write_pending(first, str(tmp_path / "out"))
    manifest.write_pending(more, str(tmp_path / "out"))
    got = spark.read.schema("v int, session_id string").parquet(str(tmp_path / "out"))
    assert rows(got, "session_id", "v") == [("s1", 1), ("s2", 2), ("s3", 3)]


def test_stored_chat_rows_are_read_as_cases(spark, tmp_path):
    import json

    turn = lambda role, content: {"role": role, "content": content}
    lines = [
        {"session_id": "s", "entity_id": "e", "label": "clean", "messages": [
            turn("system", "x"), turn("user", "a\nBehaviour model score: 0.25\nb"),
            turn("assistant", json.dumps({"verdict": "clean", "probability": 10})),
        ]},
        {"session_id": "s", "entity_id": "f", "label": None, "messages": [turn("system", "x")]},
    ]
    (tmp_path / "rows.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = sinks.read_cases(spark, str(tmp_path / "rows.jsonl"))
    assert rows(got, "entity_id", "target_verdict", "target_probability", "score") == [
        ("e", "clean", 10, 0.25), ("f", None, None, None),
    ]


def test_case_keys_split_back(spark):
    from sightline.operators.cases import case_key, split_case_key

    df = spark.createDataFrame([("a/b", "p"), ("a", "p q"), ("a/b/c", ""), ("", "x")], "session_id string, entity_id string")
    got = df.withColumn("back", split_case_key(case_key()))
    assert all((r.session_id, r.entity_id) == tuple(r.back) for r in got.collect())


def test_arrivals_by_session_skip_finished_ones(spark, tmp_path, monkeypatch):
    """Sessions with a folder are kept as they are; what another run adds is what one run gives."""
    from sightline.operators import sessions as W

    ticks = range(20)
    data = [
        (s, e, t, 3.0 * t * (1 if e == "a" else -1), 0.0, 10.0 * t, 0.0 if e == "a" else 300.0, 0.0, True, False, e == "a" and t in (8, 10), "ak47")
        for s in ("s1", "s2") for e in ("a", "b") for t in ticks
    ]
    samples = spark.createDataFrame(
        data,
        "session_id string, entity_id string, tick long, yaw double, pitch double, x double, y double, z double, "
        "is_alive boolean, is_freeze boolean, shot boolean, weapon string",
    )
    from sightline.operators.motion import number_samples

    samples = number_samples(samples)
    kills = spark.createDataFrame(
        [(s, "a", "b", 10, "ak47") for s in ("s1", "s2")], "session_id string, entity_id string, target_id string, tick long, weapon string"
    )
    size = {"pre": 8, "post": 4, "burst_gap": 2, "radius": 200.0}
    whole = W.arrival_sessions(samples, kills, str(tmp_path / "whole"), **size)
    first = W.arrival_sessions(samples.filter("session_id = 's1'"), kills, str(tmp_path / "two"), **size)
    assert {r.session_id for r in first.collect()} == {"s1"}
    # samples that changed since do not touch a finished session
    changed = samples.withColumn("yaw", F.when(F.col("session_id") == "s1", 0.0).otherwise(F.col("yaw")))
    both = W.arrival_sessions(changed, kills, str(tmp_path / "two"), **size)
    names = whole.columns
    assert rows(both, *names) == rows(whole, *names) and {r.session_id for r in both.collect()} == {"s1", "s2"}
