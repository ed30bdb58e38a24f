import duckdb
import pytest

from sightline.llm import queries
from tools.check_oracle import TABLES, compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    _, verdict = compare(spark, con, name, SMALL)
    assert verdict.startswith("ok"), verdict
