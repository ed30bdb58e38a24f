import random
import re

import numpy as np
import pytest
import xxhash

from sightline.llm import simhash
from tests.llm.conftest import CLASHING


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius=3):
    ids = list(range(len(marks)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def near_points(n, seed):
    """Points in chains and balls around a few centres, some shared parts, and lone ones."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        p = rng.choice(centres + out[-3:])
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 20])):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return sorted(set(out))


@pytest.mark.parametrize("shard_rows,n", [(20_000, 400), (10, 400), (3, 150)])
def test_components_equal_brute_force(spark, shard_rows, n):
    points = near_points(n, n)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "point long")
    found = simhash.components(simhash.links(df, shard_rows=shard_rows))
    got = {r.point: r.root for r in found.collect()}
    group = {}
    for p, root in zip(signed, brute_groups(points), strict=True):
        group.setdefault(root, []).append(p)
    expected = {p: min(ps) for ps in group.values() if len(ps) > 1 for p in ps}
    assert got == expected


def test_forest_reaches_every_spread_of_differences():
    for n in (10, 10**9, 10**12):
        trees = simhash.forest(n)
        parts = sorted({p for t in trees for p in t})
        assert sum(w for _, w in parts) == 64
        # whichever three parts differ, a tree searches only others
        for a in parts:
            for b in parts:
                for c in parts:
                    assert any({a, b, c}.isdisjoint(t) for t in trees)


def test_large_shards_are_compared_in_blocks():
    points = np.array(near_points(700, 5), np.uint64)
    shard = np.zeros(len(points), np.int64)
    root = simhash.shard_groups(shard, points, 3, block=64)
    assert root.tolist() == brute_groups([int(p) for p in points])
    assert len(simhash.shard_groups(shard[:0], points[:0], 3)) == 0


def test_groups_of_texts(spark, documents, odd_rows):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        words = b.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = "other"
            texts.append(" ".join(words).upper())
    data = [(100 + i, t) for i, t in enumerate(texts)] + odd_rows
    found = simhash.groups(documents(data, CLASHING)).collect()
    marks = [brute_fingerprint(t) for _, t in data]
    least = {}
    for (doc_id, _), root in zip(data, brute_groups(marks), strict=True):
        least.setdefault(root, []).append(doc_id)
    expected = sorted(
        (str(i), f"{m:016x}", min((x for x in least[root] if x is not None), default=None))
        for (i, _), m, root in zip(data, marks, brute_groups(marks), strict=True)
    )
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected


def test_empty_table(documents):
    assert simhash.groups(documents([])).count() == 0
