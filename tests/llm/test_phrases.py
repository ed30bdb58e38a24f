import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import phrases
from tests.llm.conftest import CLASHING


def brute(rows, limit, least, covered):
    """Every phrase of every text counted in dictionaries."""
    found = []
    for lang in {r[2] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, text, own in rows:
            if (own or "und") != lang:
                continue
            folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        candidates = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in f.items() if len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])]
            if not any(100 * b >= covered * a for b in longer):
                candidates.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(candidates)[:limit], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


def corpus(n=120):
    rng = random.Random(21)
    words = [*"a b c d e f g h i j".split(), "É", "New", "York", "x" * 300]
    rows = []
    for i in range(n):
        parts = rng.choices(words, k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", " , "]) for w in parts)
        rows.append((i, text + "new york city!" * (i % 3), ["aa", "bb", None][i % 3]))
    return rows


@pytest.mark.parametrize("limit,least,covered,ahead", [(5, 3, 50, 2), (12, 4, 30, 3), (2000, 10, 50, 4000)])
def test_equal_to_brute_force_over_several_rounds(spark, documents, limit, least, covered, ahead):
    rows = corpus()
    found = phrases.collocations(documents(rows, CLASHING), limit, least, covered, ahead)
    assert sorted(map(tuple, found.collect())) == brute(rows, limit, least, covered)


def test_slices_end_anywhere_and_count_each_token_once(spark, documents, monkeypatch):
    data = "one two, three four one two three. one".encode().translate(phrases._FOLD)
    for size in range(1, len(data) + 2):
        tokens = [t for own, lead in phrases.cut(data, size) for t in own[lead:]]
        assert tokens == data.replace(b"\xff", b" \xff ").split(), size
        counted = Counter()
        for own, lead in phrases.cut(data, size):
            slice_ = phrases.Coded("aa", own, lead)
            found, n = phrases._pairs(np.full(phrases.BITS // 8, 255, np.uint8))(slice_)
            counted.update(dict(zip(found, n.tolist(), strict=True)))
        assert counted == {b"one two": 2, b"three four": 1, b"four one": 1, b"two three": 1}, size


def test_odd_rows(spark, documents, odd_rows):
    rows = [(i, t, None) for i, t in odd_rows]
    found = phrases.collocations(documents(rows, CLASHING)).collect()
    assert sorted(map(tuple, found)) == brute(rows, 2000, 10, 50)


def test_no_phrases(spark, documents):
    assert phrases.collocations(documents([])).count() == 0
    assert phrases.collocations(documents([(1, None, "aa"), (2, "too few words", None)])).count() == 0


def test_hashes_are_those_of_spark(spark, documents):
    row = spark.createDataFrame([("aa", "wörd", "two")], "lang string, x string, y string").select(
        F.xxhash64("lang", "x").alias("h"), phrases._pair_key().alias("p")
    ).first()
    seed = xxhash.xxh64_intdigest(b"aa", 42)
    a, b = (np.array([xxhash.xxh64_intdigest(w.encode(), seed)], np.uint64) for w in ("wörd", "two"))
    assert a.view(np.int64)[0] == row.h and phrases.pair_hash(a, b).view(np.int64)[0] == row.p


def test_scores_are_exact_past_64_bits(spark):
    a, b = 10**14 + 7, 10**14 + 9
    row = spark.createDataFrame([(a, b)], "a long, b long").select(
        phrases.ratio(F.col("a"), F.col("a"), F.col("b"), F.col("b")).alias("s")
    ).first()
    assert row.s == 10**6 * a * a // (b * b)
