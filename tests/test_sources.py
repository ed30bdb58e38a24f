import json
import struct

import pytest
from pyspark.sql import functions as F

from sightline.operators.replay import replay_grid, replay_values
from sightline.schema import SAMPLE_ALIASES, SAMPLES, conform
from sightline.sources import manifest, mesh, sinks, tables
from tests.conftest import rows


def test_conform_is_tolerant(spark):
    df = spark.createDataFrame([("7", 1.5, float("nan"), 2)], "steamid string, X double, yaw double, extra int")
    got = conform(df, SAMPLES, SAMPLE_ALIASES)
    assert got.schema == SAMPLES
    row = got.first()
    assert (row.player_id, row.x, row.yaw, row.tick) == ("7", 1.5, None, None)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for where, name, listed in (("with_cheater_present", "1", ["Player_1"]), ("no_cheater_present", "2", [])):
        (root / where).mkdir()
        body = {
            "player_death": [{"tick": 5, "attacker_steamid": "Player_1", "user_steamid": "Player_2", "weapon": "ak47", "headshot": True,
                              "distance": 12.5, "num_penetrations": 2, "thrusmoke": True, "assister": "Player_9"}],
            "weapon_fire": [{"tick": 4, "user_steamid": "Player_1", "weapon": "ak47"}],
            "cheaters": [{"steamid": s} for s in listed],
            "CSstats_info": [{"map": "de_nuke", "avg_rank": "Gold"}],
        }
        (root / where / f"{name}.json").write_text(json.dumps(body))
        (
            spark.createDataFrame([("Player_1", t, 0.0) for t in (1, 2, 5)], "steamid string, tick int, yaw float")
            .coalesce(1).write.parquet(str(root / where / f"p{name}"))
        )
    (root / "with_cheater_present" / "3.json").write_text("{not json")
    return root


def test_event_files(spark, folder):
    files = tables.read_event_files(spark, str(folder / "*" / "*.json"))
    assert rows(tables.rejected_sessions(files), "session_id") == [("with_cheater_present/3",)]
    events = tables.event_rows(files)
    deaths = tables.normalise_deaths(events)
    assert rows(deaths, "attacker_id", "victim_id", "tick", "headshot") == [("Player_1", "Player_2", 5, True)] * 2
    kept = deaths.select("distance", "penetrated", "thrusmoke", "noscope", F.col("extras")["assister"].alias("a"))
    assert [tuple(r) for r in kept.collect()] == [(12.5, 2, True, None, "Player_9")] * 2
    windows = deaths.filter("session_id = 'no_cheater_present/2'").select(
        "session_id", F.col("attacker_id").alias("entity_id"), F.col("victim_id").alias("target_id"), F.col("tick").alias("anchor_tick")
    )
    detailed = tables.with_death_details(windows.unionByName(windows.withColumn("anchor_tick", F.lit(9))), deaths)
    assert rows(detailed, "anchor_tick", "walls_penetrated", "through_smoke") == [(5, 2, True), (9, None, None)]
    fired = tables.normalise_events(events)
    assert rows(fired, "kind", "player_id", "tick") == [("weapon_fire", "Player_1", 4)] * 2
    sessions = tables.read_sessions(files).filter("map is not null")
    assert rows(sessions, "session_id", "map", "has_listed") == [
        ("no_cheater_present/2", "de_nuke", False), ("with_cheater_present/1", "de_nuke", True),
    ]
    people = spark.createDataFrame(
        [("with_cheater_present/1", "Player_1"), ("with_cheater_present/1", "Player_2"), ("no_cheater_present/2", "Player_1")],
        "session_id string, entity_id string",
    )
    labelled = tables.with_labels(people, tables.read_labels(files), sessions)
    assert rows(labelled, "session_id", "entity_id", "label") == [
        ("no_cheater_present/2", "Player_1", "clean"),
        ("with_cheater_present/1", "Player_1", "cheater"),
        ("with_cheater_present/1", "Player_2", "unknown"),
    ]
    lacking = tables.missing_kinds(events, sessions)
    assert {r.kind for r in lacking.collect()} == {"player_hurt", "round_freeze_end", "round_start"}


def test_typed_events_keep_their_types(spark, folder, tmp_path):
    """Typed and untyped tables agree; a VARIANT keeps numbers, booleans, lists and a changing type."""
    one = {"tick": 7, "attacker_steamid": "P1", "user_steamid": "P2", "headshot": True, "distance": 2.5, "seen": [1, 2], "mark": 3}
    two = {"tick": "8", "attacker_steamid": 76561198, "user_steamid": None, "headshot": "no", "distance": "far", "mark": "x", "place": {"x": 1.5}}
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a.json").write_text(json.dumps({"player_death": [one, two], "weapon_fire": [{"tick": 1, "user_steamid": "P1"}]}))
    (tmp_path / "set" / "bad.json").write_text("{oops")
    files = tables.read_event_files(spark, str(tmp_path / "set"), typed=True)
    assert rows(tables.rejected_sessions(files), "session_id") == [("set/bad",)]
    events = tables.event_rows(files)
    deaths = tables.normalise_deaths(events)
    assert rows(deaths, "tick", "attacker_id", "victim_id", "headshot", "distance") == [
        (7, "P1", "P2", True, 2.5), (8, "76561198", None, False, None),
    ]
    deaths.write.parquet(str(tmp_path / "deaths"))
    back = spark.read.parquet(str(tmp_path / "deaths"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("extras", p, "variant"))
    got = back.select("tick", *[kind(f"$.{n}").alias(n) for n in ("mark", "headshot", "distance", "seen")])
    assert rows(got, "tick", "mark", "headshot", "distance", "seen") == [
        (7, "BIGINT", "BOOLEAN", "DECIMAL(2,1)", "ARRAY<BIGINT>"), (8, "STRING", "STRING", "STRING", None),
    ]
    place = back.select("tick", F.try_variant_get("extras", "$.place.x", "double").alias("x"))
    assert rows(place, "tick", "x") == [(7, None), (8, 1.5)]
    assert rows(tables.normalise_events(events), "kind", "player_id", "tick") == [("weapon_fire", "P1", 1)]
    plain, typed = (
        tables.normalise_deaths(tables.event_rows(tables.read_event_files(spark, str(folder / "*" / "*.json"), typed=t))).drop("extras")
        for t in (False, True)
    )
    assert plain.schema == typed.schema and rows(plain, *plain.columns) == rows(typed, *typed.columns)


def test_sample_files_and_stored_layout(spark, folder, tmp_path):
    samples = tables.read_samples(spark, [str(folder / "no_cheater_present" / "p2")])
    assert samples.columns[0] == "session_id" and samples.count() == 3
    canon = tables.canonical(samples)
    assert rows(canon, "entity_id", "tick", "seq") == [("Player_1", 1, 1), ("Player_1", 2, 2), ("Player_1", 5, 3)]
    events = tables.normalise_events(tables.event_rows(tables.read_event_files(spark, str(folder / "no*" / "*.json"))))
    tables.write_sessions(canon, events, canon.select("session_id").distinct(), str(tmp_path / "t"))
    back = tables.read_stored(spark, str(tmp_path / "t"))
    assert back["samples"].count() == 3 and back["events"].filter("kind = 'weapon_fire'").count() == 1


def test_meshes_raw_and_hex(spark, tmp_path):
    raw = struct.pack("<18f", *range(18))
    (tmp_path / "de_a.tri").write_bytes(raw)
    (tmp_path / "de_b.tri").write_bytes(raw.hex().encode())
    got = mesh.read_triangles(spark, str(tmp_path))
    assert rows(got, "map", "tri_id", "ax", "cz") == [
        (m, i, 9.0 * i, 9.0 * i + 8) for m in ("de_a", "de_b") for i in (0, 1)
    ]


def test_manifests(spark, tmp_path):
    for name, body in (("a_de_nuke.dem", "x"), ("b_de_nuke.dem", "x"), ("c_de_mirage.dem", "y")):
        (tmp_path / name).write_text(body)
    files = manifest.file_manifest(spark, str(tmp_path), "*.dem", content=True)
    assert files.count() == 3 and manifest.unique_contents(files).count() == 2
    assert manifest.newest(files, 2).count() == 2
    assert rows(manifest.sample_per_map(files, 1), "map") == [("de_mirage",), ("de_nuke",)]
    done = files.filter("name like 'a%'")
    assert rows(manifest.pending(files, done), "name") == [("b_de_nuke.dem",), ("c_de_mirage.dem",)]
    assert manifest.stale_sources(files, done).count() == 2
    reports = spark.createDataFrame([("c_de_mirage",)], "stem string")
    assert rows(manifest.with_review_flag(files, reports), "reviewed") == [(False,), (False,), (True,)]
    assert manifest.cache_root("r", ["a"]) != manifest.cache_root("r", ["a", "b"])
    listings = spark.createDataFrame([(["a_de_nuke.dem"],)], "names array<string>")
    assert tables.without_listed(files, listings).count() == 2


def test_annotation_log_and_reports(spark, tmp_path):
    schema = sinks.ANNOTATION
    path = str(tmp_path / "log")
    for n, word in enumerate(("clean", "unclear")):
        row = spark.createDataFrame([("s", "e", "h", word, n, "{}")], "session_id string, entity_id string, evidence_sha string, verdict string, probability int, answer string")
        sinks.append_annotations(row.withColumn("created_at", F.timestamp_seconds(F.lit(1000 + n))), path)
    log = sinks.read_annotations(spark, path)
    assert log.schema == schema and log.count() == 2
    latest = sinks.latest_rows(log, ["session_id", "entity_id"], ["created_at"])
    assert rows(latest, "verdict") == [("unclear",)]
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "ok.json").write_text('{"session_id": "s", "players": [{"player_id": "1", "flagged": true}, {"player_id": "2", "flagged": false}]}')
    (tmp_path / "reports" / "bad.json").write_text("{broken")
    got = sinks.report_catalogue(spark, str(tmp_path / "reports"))
    assert rows(got, "session_id", "players", "flagged") == [("s", 2, 1)]


def test_chat_export_holds_conversations_only(spark, tmp_path):
    df = spark.sql("select 'val' split, array(named_struct('role', 'user', 'content', 'x')) messages, 'cheater' label")
    sinks.write_chat(df, str(tmp_path / "chat"))
    back = spark.read.parquet(str(tmp_path / "chat" / "parquet"))
    assert back.columns == ["messages", "split"]


def test_replay_arrays_line_up(spark):
    data = [
        (0, e, t, 2 if e == 1 else 3, 1.6 * t, 0.0, 0.0, 0.0, 100, t < 20)
        for e in (1, 2) for t in range(30) if not (e == 2 and t == 8)
    ]
    samples = spark.createDataFrame(
        data, "session_id long, entity_id long, tick long, team int, x double, y double, z double, yaw double, health int, is_alive boolean"
    )
    rounds = spark.createDataFrame([(0, 1, 5, 26)], "session_id long, number int, start long, end long")
    got = {r.entity_id: r for r in replay_grid(replay_values(samples, rounds), rounds).collect()}
    assert (got[1].t0, got[1].side, got[2].side) == (8, "T", "CT")
    assert got[1].x == [13, 19, 26, None, None] and got[1].hp == [100, 100, 100, 0, 0]
    assert got[2].x == [None, 19, 26, None, None] and got[2].hp == [None, 100, 100, 0, 0]


def test_files_of_any_size_are_hashed(spark, tmp_path):
    import hashlib

    from sightline.sources import manifest

    (tmp_path / "small.dem").write_bytes(b"small")
    with open(tmp_path / "large one.dem", "wb") as f:  # sparse: above what one value holds
        f.seek(3 << 30)
        f.write(b"end")
    files = {r.name: (r.bytes, r.sha256) for r in manifest.file_manifest(spark, str(tmp_path), "*.dem", content=True).collect()}
    digest = hashlib.sha256()
    for _ in range(3 << 10):
        digest.update(bytes(1 << 20))
    digest.update(b"end")
    assert files == {
        "small.dem": (5, hashlib.sha256(b"small").hexdigest()),
        "large one.dem": ((3 << 30) + 3, digest.hexdigest()),
    }


def test_pieces_and_values_hash_alike(spark, tmp_path):
    from sightline.sources import manifest

    for i in range(5):
        (tmp_path / f"{i}.dem").write_bytes(bytes([i]) * (i + 1 << 18))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    value, piece = (rows(manifest.with_content_hash(files, whole), "path", "sha256") for whole in (1 << 30, -1))
    assert value == piece and len(value) == 5
