import hashlib
import random
import re

import pytest

from sightline.llm import decontaminate
from tests.llm.conftest import CLASHING

ITEMS = "item_id long, text string, term string, need string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own = words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        theirs = words(item)
        size = min(window, len(theirs))
        wanted = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if theirs else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                ids.add(item_id)
    listed = sorted(str(i) for i in ids if i is not None)
    sha = hashlib.sha256(",".join(listed).encode()).hexdigest()
    return (len(own), len(hit), len(listed), sha, bool(hit) and 20 * len(hit) >= len(own))


def items_frame(spark, items):
    return spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_equal_to_brute_force(spark, documents, odd_rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(14)
    vocabulary = ["The", "of", "and", *(f"w{i}" for i in range(12)), "é1", "Über"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(14)]
    items += [(3, items[3][1]), (None, make(20)), (40, None), (41, "the the the the the the the the the the the the the the")]
    if block > 1000:
        items = [i for i in items if len(words(i[1])) != 1]
    data = []
    for i in range(60):
        parts = [make(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            theirs = words(rng.choice(items)[1])
            a = rng.randrange(len(theirs) + 1)
            parts += [", ".join(theirs[a : a + rng.randrange(1, 25)]).upper(), make(rng.randrange(6))]
        data.append((100 + i, " - ".join(parts)))
    data += odd_rows
    found = decontaminate.digest(
        decontaminate.contamination(documents(data, CLASHING), items_frame(spark, items))
    ).collect()
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found}
    assert got == {(i, *brute(t, items)) for i, t in data}
    assert len(found) == len({d for d in data})


def test_share_of_a_twentieth(spark, documents):
    phrase = " ".join(f"p{i}" for i in range(13))
    data = [(1, phrase + " x" * 247), (2, phrase + " x" * 248), (3, " ".join(phrase.split()[:12]))]
    found = decontaminate.contamination(documents(data), items_frame(spark, [(7, phrase)]))
    assert {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in found.collect()} == {
        1: (13, ["7"], True), 2: (13, ["7"], False), 3: (0, [], False),
    }


def test_near_matches(spark, documents):
    phrase = [f"p{i}" for i in range(13)]
    data = [(1, " ".join(phrase)), (2, " ".join(phrase[:6] + phrase[7:] + [phrase[6]])), (3, " ".join(phrase[:7]))]
    found = decontaminate.matches(documents(data), items_frame(spark, [(7, " ".join(phrase))]), near=True)
    assert {(r.doc_id, r.kind) for r in found.collect() if r.kind} == {(1, "phrase"), (2, "near")}


def test_empty_tables(spark, documents):
    assert decontaminate.contamination(documents([]), items_frame(spark, [(1, "a b")])).count() == 0
    none = decontaminate.contamination(documents([(1, "a b")]), items_frame(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
