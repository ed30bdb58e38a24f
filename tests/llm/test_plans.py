"""What the plans of the registered queries must and must not hold."""

import re

import pytest

from sightline.llm import queries

SMALL = "/root/testdata/sf0.001"
NATIVE = [n for n in queries.QUERIES if re.match(r"op(3|4|7|9|10)_", n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    assert not re.search(r"Python|Pandas|Arrow(?!Columnar)", plan(queries.QUERIES[name](spark, SMALL)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_pairs_of_everything(spark, name):
    if name == "pipeline":
        pytest.skip("reads back what its stages wrote")
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(queries.QUERIES[name](spark, SMALL)))


@pytest.mark.parametrize("name,columns", [("op8_bpe_coding", {"doc_id", "text"}), ("op1_html_extraction", {"page_id", "url", "html"})])
def test_one_pass_reads_its_columns_and_shuffles_nothing(spark, name, columns):
    text = plan(queries.QUERIES[name](spark, SMALL))
    assert "Exchange" not in text
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_statistics_are_computed_once_under_a_filter(spark):
    """A filter on what the quality rules say must not be pushed below the statistics."""
    import corpus_pipeline
    from sightline.llm.common import table

    kept = corpus_pipeline.quality_rules(spark, table(spark, SMALL, "documents"), SMALL)
    # pushed down, the words would be cut anew for every use
    assert plan(kept).count("split(") <= 12
