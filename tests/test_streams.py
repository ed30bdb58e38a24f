"""Streams lose nothing, however files fall into batches."""

import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sightline.streaming import jobs
from tests.conftest import rows

DAY = 86_400
SCHEMA = "user long, ts timestamp, v double"


def events(spark, folder, days):
    """One file per day, each with two events a minute apart, in this order of arrival."""
    for n, day in enumerate(days):
        data = [(1, day * DAY, 1.0), (1, day * DAY + 60, 2.0)]
        df = spark.createDataFrame(data, "user long, s long, v double")
        out = f"{folder}/sub{n % 2}/f{n}"
        df.select("user", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(out)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("size", [1, 2, 4])
def test_bursts_and_rates_of_days_out_of_order(spark, tmp_path, size):
    events(spark, tmp_path / "in", [10, 20, 0, 30])
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema(spark), files_per_batch=size)
    found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", aggs=[F.sum("v").alias("v")])
    got = jobs.run_complete(found, str(tmp_path / "a"), str(tmp_path / "b"))
    got = got.withColumn("day", (F.col("burst.start").cast("long") / DAY).cast("long"))
    assert rows(got, "day", "v") == [(0, 3.0), (10, 3.0), (20, 3.0), (30, 3.0)]
    slots = jobs.rate_stream(stream, ["user"], "ts", size="1 day", aggs=[F.count("v").alias("n")])
    got = jobs.run_complete(slots, str(tmp_path / "c"), str(tmp_path / "d"))
    assert rows(got, "n") == [(2,)] * 4


def test_a_drain_goes_on_from_its_checkpoint(spark, tmp_path):
    source = str(tmp_path / "in")
    for days, bursts in (([1, 5], 2), ([9], 3)):
        events(spark, f"{source}/{days[0]}", days)
        stream = jobs.file_stream(spark, source, schema(spark))
        found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", aggs=[F.count("v").alias("n")])
        got = jobs.run_complete(found, str(tmp_path / "a"), str(tmp_path / "b"))
        assert rows(got, "n") == [(2,)] * bursts


def test_dropped_rows_fail_the_bounded_form(spark, tmp_path):
    events(spark, tmp_path / "in", [10, 20, 30, 0])
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema(spark), files_per_batch=1)
    found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", delay="1 hour", aggs=[F.count("v").alias("n")])
    with pytest.raises(ValueError, match="later than the watermark"):
        jobs.run_once(found, str(tmp_path / "a"), str(tmp_path / "b"))


def test_ingest_takes_every_content_once_whatever_its_age(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def put(name, data, age=0):
        (source / name).write_bytes(data)
        then = (source / name).stat().st_mtime - age * DAY
        os.utime(source / name, (then, then))

    def drain():
        files = jobs.file_rows(spark, str(source), files_per_batch=1)
        return sorted(os.path.basename(r.path) for r in jobs.ingest(files, out, state).collect())

    put("a", b"one")
    put("b", b"two")
    assert drain() == ["a", "b"]
    put("deep/old", b"three", age=30)
    put("copy", b"one", age=300)
    assert drain() == ["a", "b", "old"]
    put("very_old", b"four", age=3000)
    assert drain() == ["a", "b", "old", "very_old"]
    assert drain() == ["a", "b", "old", "very_old"]


def test_a_table_may_be_a_folder_or_a_file(spark, tmp_path):
    from sightline.plans.streams import stream_rates

    table = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "one").mkdir()
    shutil.copy(table, tmp_path / "one" / "events.parquet")
    spark.read.parquet(table).repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    one, many = (stream_rates(spark, str(tmp_path / n)) for n in ("one", "many"))
    assert rows(one, "event_type", "slot", "events") == rows(
        many, "event_type", "slot", "events"
    )
    assert one.count() > 0


def test_a_resumed_drain_reads_old_files(spark, tmp_path):
    source = tmp_path / "in"

    def drain():
        stream = jobs.file_stream(spark, str(source), schema(spark))
        found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", aggs=[F.count("v").alias("n")])
        return rows(jobs.run_complete(found, str(tmp_path / "a"), str(tmp_path / "b")), "n")

    events(spark, source / "new", [1])
    assert drain() == [(2,)]
    events(spark, source / "old", [5])
    for file in (source / "old").rglob("*.parquet"):
        then = file.stat().st_mtime - 30 * DAY
        os.utime(file, (then, then))
    assert drain() == [(2,)] * 2


def test_early_drops_are_seen_whatever_the_retention(spark, tmp_path):
    events(spark, tmp_path / "in", [10, 20, 0, 30, 31, 32, 33])
    name = jobs.RETENTION[0]
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema(spark), files_per_batch=1)
        found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", delay="1 hour", aggs=[F.count("v").alias("n")])
        with pytest.raises(ValueError, match="later than the watermark"):
            jobs.run_once(found, str(tmp_path / "a"), str(tmp_path / "b"))
        assert spark.conf.get(name) == "1"
    finally:
        spark.conf.set(name, before)


def test_a_drain_without_new_files_gives_the_last_table(spark, tmp_path):
    source = tmp_path / "in"

    def drain():
        stream = jobs.file_stream(spark, str(source), schema(spark), files_per_batch=1)
        found = jobs.burst_stream(stream, ["user"], "ts", gap="1 hour", aggs=[F.count("v").alias("n")])
        return rows(jobs.run_complete(found, str(tmp_path / "a"), str(tmp_path / "b")), "n")

    (source).mkdir()
    assert drain() == []
    events(spark, source / "first", [1, 5, 9, 13, 17])
    first = drain()
    assert first and drain() == first == drain()
    # however many batches, two tables lie there at most
    assert {p.name for p in (tmp_path / "a").iterdir() if p.is_dir()} <= {"turn=0", "turn=1"}


def test_a_batch_reads_the_manifest_partitions_of_its_own_hashes(spark, tmp_path, monkeypatch):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    read = []

    def recorded(*a, own=jobs.manifest_rows):
        found = own(*a)
        read.append(found)
        return found

    for i in range(40):
        (source / f"f{i}").write_bytes(b"%d" % i)
    jobs.ingest(jobs.file_rows(spark, str(source)), out, state)
    monkeypatch.setattr(jobs, "manifest_rows", recorded)
    (source / "again").write_bytes(b"7")
    (source / "new").write_bytes(b"new")
    whole = jobs.ingest(jobs.file_rows(spark, str(source)), out, state)
    assert whole.count() == 41
    parts = {hashlib.sha256(x).hexdigest()[:2] for x in (b"7", b"new")}
    known = read[0].where(F.col("part").isin(*parts) & (F.col("batch") < 1))
    files = spark.read.schema(read[0].schema).option("basePath", out).parquet(out).inputFiles()
    touched = [f for f in files if any(f"part={p}/" in f for p in parts)]
    assert known.count() >= 1 and len(touched) < len(files) / 3
    plan = known._jdf.queryExecution().executedPlan().toString()
    # both conditions choose folders, none is left to be tested on rows
    assert "PushedFilters: []" in plan and "Filter (" not in plan
