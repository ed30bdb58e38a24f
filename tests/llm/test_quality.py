import random
import re

from sightline.llm import quality
from tests.llm.conftest import CLASHING


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = {}
    for i in range(len(words) - 4):
        spans.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in spans.values() if len(at) > 1 for i in at for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_brute_force(documents, odd_rows):
    rng = random.Random(9)
    texts = []
    for _ in range(80):
        lines = [" ".join(rng.choices(["a", "bb", "ccc", "é#", "x|y", "\U0001f600"], k=rng.randrange(9))) for _ in range(rng.randrange(12))]
        texts.append("\n".join(lines))
    texts += ["a a a a a a a", "a b c d e a b c d e", "a b c d e x a b c d e", "\n\n a\n a\n  a\n a", "w"]
    data = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows
    found = quality.judged(documents(data, CLASHING), []).collect()
    got = sorted((str(r.row.doc_id), *(r[s] for s in STATS), r.base_failed, r.kept) for r in found)
    failed = lambda b: b[0] < 10 or 100 * b[4] > 20 * b[0]
    expected = sorted((str(i), *brute(t), failed(brute(t)), not failed(brute(t))) for i, t in data)
    assert got == expected


def test_learned_list_finds_junk_and_keeps_clean(spark, documents):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    data, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(20, 90))]
        bad = i % 6 == 0
        if bad:
            words = [w + "%%%" for w in words] if i % 12 else [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    rules = quality.learn(documents(data), known)
    assert rules and all(len(r) <= 3 for r in rules)
    kept = {r.row.doc_id: r.kept for r in quality.judged(documents(data), rules).collect()}
    assert [kept[i] for i in range(400, 600)] == [bool(q) for _, q, _ in labels[400:]]
    # the order of rows does not matter
    assert quality.learn(documents(data[::-1]).repartition(7), known.repartition(3)) == rules


def test_rules_are_pruned_and_noise_is_left(documents):
    rng = random.Random(11)
    rows = [{f: rng.random() for f in quality.FEATURES} | {"bad": rng.random() < 0.15} for _ in range(600)]
    assert quality.covering(rows) == []
    rows = [r | {"bad": r["symbol_rate"] > 0.8} for r in rows]
    rules = quality.covering(rows)
    assert len(rules) == 1 and {c.feature for c in rules[0]} == {"symbol_rate"}


def test_odd_labels(spark, documents):
    docs = documents([(1, "a b"), (None, "c"), (2, None)])
    for rows in ([], [(1, 1, 0)], [(None, 0, 0), (1, None, 0)], [(9, 0, 0), (9, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert quality.learn(docs, labels) == []
    assert quality.judged(documents([]), []).count() == 0
