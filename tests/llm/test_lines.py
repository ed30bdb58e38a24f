import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.llm import lines
from sightline.llm.common import shared_folder
from tests.llm.conftest import CLASHING

WHITE = " \t\n\x0b\x0c\r"


def fold(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least):
    found = Counter()
    for _, text in rows:
        found.update({fold(line) for line in (text or "").split("\n")} - {""})
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [line for line in split if not fold(line) or found[fold(line)] < least]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(split), len(split) - len(kept), digest))
    return sorted(out, key=str)


def corpus(n=200):
    rng = random.Random(8)
    pool = ["Cookies", " cookies\t", "COOKIES", "É b", "é b", "", " ", "menu | home", "x" * 5000]
    rows = []
    for i in range(n):
        own = [rng.choice(pool) if rng.random() < 0.3 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("least,batches", [(3, 1), (10, 7), (5, 4)])
def test_equal_to_brute_force_however_the_batches_fall(spark, documents, least, batches):
    rows = corpus()
    index = lines.Runs(spark, shared_folder(spark, "runs"), least)
    found = lines.digest(lines.deduplicated(documents(rows, CLASHING), index, batches))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, least)
    ((_, name),) = index.runs
    assert index.run(name).groupBy("h1", "h2").count().where("count > 1").isEmpty()


def test_an_index_goes_on_where_it_was_left(spark, documents):
    folder = shared_folder(spark, "runs")
    rows = [(i, f"common\nrare {i}\nearly" if i < 6 else f"Common\nrare {i}\nlate") for i in range(12)]
    keys = lambda own: lines.lines(documents(own)).where("first").select("h1", "h2")
    first = lines.Runs(spark, folder, 5, buckets=3)
    first.add(keys(rows[:4]))
    first.add(keys(rows[4:6]))
    again = lines.Runs.reopened(spark, folder, least=5)
    assert (again.version, again.runs, again.buckets) == (2, first.runs, 3)
    # what is frequent already is not counted again
    assert again.unsettled(keys(rows[6:])).count() == 6 + 1
    again.add(keys(rows[6:]))
    assert [level for level, _ in again.runs] == [1, 0]
    assert again.frequent().count() == 3
    cleaned = lines.deduplicated(documents(rows[:1]), lines.Runs.reopened(spark, folder, least=5))
    assert [r.text for r in cleaned.collect()] == ["rare 0"]


def test_runs_are_not_shuffled(spark, documents):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = lines.Runs(spark, shared_folder(spark, "runs"), 2)
        keys = lines.lines(documents(corpus(20))).where("first").select("h1", "h2")
        index.add(keys)
        index.add(keys)
        plan = index.unsettled(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own, run = plan.split("LeftAnti")[1].split("Bucketed: true")[0], plan
    assert "Bucketed: true" in run and plan.count("Exchange hashpartitioning") == 1, own


def test_odd_rows(spark, documents, odd_rows):
    rows = odd_rows + [(None, "\n".join(["a"] * 50_000 + ["b"]))] + [(20 + i, "a\r\n B ") for i in range(9)]
    index = lines.Runs(spark, shared_folder(spark, "runs"))
    found = lines.deduplicated(documents(rows, ("n_lines", *CLASHING)), index)
    assert re.fullmatch("doc_id text lang source n_chars .* n_lines n_dropped", " ".join(found.columns))
    assert sorted(map(tuple, lines.digest(found).collect()), key=str) == brute(rows, 10)
    assert found.where(F.col("doc_id").isNull() & (F.col("n_lines") == 50_001)).select("text", "n_dropped").collect() == [("", 50_001)]


def test_no_documents(spark, documents):
    index = lines.Runs(spark, shared_folder(spark, "runs"))
    assert lines.deduplicated(documents([]), index, 2).count() == 0
