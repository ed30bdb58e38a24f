"""The driver contract, and a stream that goes on after a restart."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sightline.plans import catalog
from sightline.streaming import jobs
from tests.conftest import rows
from tools.check_oracle import TABLES, compare

SMALL = contract.SMOKE_DIR


def test_names_and_columns():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert len(queries) >= 90 and set(oracles) <= set(queries)
    own = {k for k in queries if k in catalog.QUERIES}
    assert {k for k in own if k not in oracles} == {
        "case_documents", "oof_scores", "source_manifest", "stream_ingest",
    }


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["anchor_window_features", "entity_features", "line_of_sight", "asof_backward", "roc_auc", "targets"]
)
def test_oracle_on_the_smallest_tables(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    _, verdict = compare(spark, con, name, SMALL)
    assert verdict.startswith("ok"), verdict


def test_bursts_survive_a_restart(spark, tmp_path):
    """Two files arriving one after the other give what one batch over both gives."""
    schema = "user long, ts timestamp, v double"
    base = 1_700_000_000
    first = [(1, base, 1.0), (1, base + 60, 1.0), (2, base + 30, 1.0)]
    later = [(1, base + 90, 1.0), (1, base + 5000, 1.0), (2, base + 9000, 1.0), (3, base + 90000, 1.0)]
    source = tmp_path / "in"
    for n, part in enumerate((first, later)):
        df = spark.createDataFrame([(u, t, v) for u, t, v in part], "user long, s long, v double")
        df.select("user", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.burst_stream(
            spark.readStream.schema(schema).parquet(str(source)), ["user"], "ts", gap="10 minutes", delay="1 hour",
            aggs=[F.count(F.lit(1)).alias("n")],
        )
        jobs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.col("burst.start").cast("long") - base)
    assert rows(got, "user", "s", "n") == [(1, 0, 3), (1, 5000, 1), (2, 30, 1), (2, 9000, 1)]
