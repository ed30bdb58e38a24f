import collections
import math
import random
import resource
import zlib
from pathlib import Path

import numpy as np
import pytest

from sightline.llm import ngrams
from tests.llm.conftest import CLASHING

END, START = 0, 1


def brute(data):
    """Per (doc_id, text): n_tokens, n_known, N, base and model score, by the formulas."""
    cut = lambda t: [*(t or "").encode().lower().split(), END]
    words, pairs = collections.Counter(), collections.Counter()
    for i, t in data:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            words.update(cut(t))
            pairs.update(zip([START, *cut(t)], cut(t)))
    total, size = sum(words.values()), len(words)
    kinds = collections.Counter(w for _, w in pairs)
    of = lambda c: ngrams.discounts([collections.Counter(c.values())[k] for k in (1, 2, 3, 4)])
    d, dw = of(pairs), of(kinds)
    context, left = collections.Counter(), collections.Counter()
    for (v, _), c in pairs.items():
        context[v] += c
        left[v] += d[min(c, 3)]
    every = sum(kinds.values())
    rest = sum(dw[min(a, 3)] for a in kinds.values())

    def lower(w):
        if not every:
            return 1 / (size + 1)
        return max(kinds[w] - dw[min(kinds[w], 3)], 0) / every + rest / every / (size + 1)

    def p(v, w):
        if not context[v]:
            return lower(w)
        c = pairs[v, w]
        return (max(c - d[min(c, 3)], 0) + left[v] * lower(w)) / context[v]

    out = []
    for i, t in data:
        ts = cut(t)
        base = sum(math.log10((words[w] + 1) / (total + size + 1)) for w in ts)
        score = sum(math.log10(p(v, w)) for v, w in zip([START, *ts], ts))
        out.append((i, len(ts), sum(words[w] > 0 for w in ts), total, base, score))
    if total:  # the model is a distribution
        for v in list(context)[:5]:
            assert abs(sum(p(v, w) for w in words) + p(v, "unseen") - 1) < 1e-9
    return out


def compared(found, data):
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()), key=key)
    expected = sorted(brute(data), key=key)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    np.testing.assert_allclose([g[4:] for g in got], [e[4:] for e in expected], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("share", [0.002, 0.2, 9.0])
def test_scores_equal_brute_force(documents, odd_rows, monkeypatch, share):
    monkeypatch.setattr(ngrams, "HOT_SHARE", share)
    monkeypatch.setattr(ngrams, "FLUSH", 700)
    monkeypatch.setattr(ngrams, "SCORED", 500)
    rng = random.Random(7)
    vocabulary = [f"Wort{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    data = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(60)))) for i in range(120)]
    data += [(500 + i, "the the the the end") for i in range(30)] + odd_rows
    compared(ngrams.scored(documents(data, CLASHING).repartition(5)), data)


def test_held_out_texts_are_better_foretold_than_by_the_base(documents):
    rng = random.Random(8)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}

    def text():
        w, out = rng.randrange(40), []
        for _ in range(40):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    found = ngrams.scored(documents([(i, text()) for i in range(200)])).where("held_out").collect()
    assert sum(r.score for r in found) > 0.7 * sum(r.base_score for r in found)


def test_nothing_learned(documents):
    assert ngrams.scored(documents([])).count() == 0
    data = [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r.held_out, r.score, r.base_score) for r in ngrams.scored(documents(data)).collect()} == {(True, 0.0, 0.0)}


def test_files_by_another_store(tmp_path):
    data = ngrams.packed(np.arange(5, dtype=np.uint64), np.arange(3, dtype=np.uint32))
    ngrams.put_file(f"file://{tmp_path}/d/x", data)
    ngrams.put_file(f"{tmp_path}/d/x", data)
    a, b = ngrams.unpacked(ngrams.mapped(f"file://{tmp_path}/d/x"))
    assert a.tolist() == [0, 1, 2, 3, 4] and b.tolist() == [0, 1, 2]
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x"]


def test_more_files_are_mapped_than_may_be_open(tmp_path):
    for i in range(200):
        ngrams.put_file(f"file://{tmp_path}/d/{i}", ngrams.packed(np.arange(i + 1, dtype=np.uint64)))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    used = len(list(Path("/proc/self/fd").iterdir()))
    resource.setrlimit(resource.RLIMIT_NOFILE, (used + 64, hard))
    try:
        held = [ngrams.unpacked(ngrams.mapped(f"file://{tmp_path}/d/{i}"))[0] for i in range(200)]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert [int(a[-1]) for a in held] == list(range(200))
