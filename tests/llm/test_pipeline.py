import random

import corpus_pipeline
from sightline.llm import queries
from sightline.session import ensure_checkpoint_dir
from tests.llm.conftest import CLASHING


def world(spark, documents, folder, rows, labels, items, extra=()):
    documents(rows, extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    """Clean texts, and of each kind of fault some, by doc_id."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("etaoinshrdlucm", k=rng.randrange(2, 9)))
    text = lambda n=120: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        junk = i % 6 == 0
        rows.append((i, " ".join(w + "%%%" for w in text().split()) if junk else text()))
        labels.append((i, int(not junk), 0))
    phrase = text(26)
    copy = text(400)
    rows += [(1000, copy), (1001, copy), (1002, copy.upper())]
    near = copy.split()
    near[200] = "changed"
    rows.append((1003, " ".join(near)))
    rows += [(1010, phrase + " " + text(80)), (1011, phrase + " " + text(700))]
    rows.append((1020, text() + " password=hunter2hunter2 " + text(20)))
    rows.append((1030, "too short"))
    return rows, labels, [(1, phrase), (2, None)]


def test_each_stage_takes_effect(spark, documents, tmp_path):
    rows, labels, items = corpus()
    sf = world(spark, documents, tmp_path / "w", rows, labels, items, CLASHING[:-1])
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    clean = {i for i in range(240) if i % 6}
    junk = {i for i in range(240) if i % 6 == 0}
    # fewer junk texts than a rule must cover may stay
    assert clean <= set(found) and len(set(found) & junk) < 8
    assert set(found) - clean - junk == {1000, 1011, 1020}
    texts = dict(rows)
    assert "hunter2" not in found[1020].text and "[SECRET]" in found[1020].text
    assert found[1020].n_chars == len(found[1020].text)
    assert all(found[i].text == texts[i] for i in found if i != 1020)
    assert all(r.n_tokens == len(r.token_ids) > 0 and r.words == "x" for r in found.values())


def test_stages_return_the_columns_of_documents(spark, documents, odd_rows, tmp_path):
    sf = world(spark, documents, tmp_path / "w", odd_rows, [], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names, name
        for rows in ([], odd_rows):
            own = documents(rows, ("a.b", *CLASHING))
            assert stage(spark, own, sf).select(*[f"`{c}`" for c in own.columns]).count() <= len(rows), name


def test_near_dedup_of_repeated_and_missing_ids(spark, documents):
    long = " ".join(f"word{i}" for i in range(50))
    data = [(2, long), (2, long), (1, long), (None, long), (None, long), (3, "other text entirely"), (4, None), (5, "")]
    kept = corpus_pipeline.near_dedup(spark, documents(data), "").collect()
    ids = sorted(str(r.doc_id) for r in kept)
    # rows without an id are copies like any other
    assert ids == ["1", "3", "4"]


def test_empty_tables(spark, documents, tmp_path):
    sf = world(spark, documents, tmp_path / "w", [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_files_go_to_the_folder_of_the_session(spark):
    from sightline.llm.common import shared_folder

    assert shared_folder(spark, "x").startswith(ensure_checkpoint_dir(spark))
