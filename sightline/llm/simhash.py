"""SimHash near-duplicate groups, exact, through a forest of vantage-point trees.

Fingerprints are made in Arrow batches from whole texts (XXH64 of every word shingle, majority
per bit). Equal fingerprints are one point, however many documents share it.

Points are linked at ``radius`` or fewer differing bits. All 64 bits at once prune little:
distances to a vantage point gather around 32, and most shells lie within the radius of each
other. So the bits are cut into parts. The distance is the sum of the distances within parts,
and linked points differ in at most ``radius`` parts: there is a tree for each choice of parts
that can all agree, and it may search them with radius 0. Such a tree keys a point by its
distances to vantage points within its parts: by the triangle bound at radius 0 only points of
equal distances can be linked through it. With a vantage point per bit the distances are told
by the parts' values, which serve as the shard's key. ``forest`` takes more and finer trees as
points grow, so that an even shard stays small.

A shard above ``SHARD_ROWS`` is split again by Hamming distance of the whole fingerprint to a
vantage point. A point has its home in the shell of its distance; by the triangle bound its
partners lie within ``radius``, so points near a shell's inner border are copied into the shell
below, and border-crossing pairs meet there. Further levels, each with its own vantage point,
follow while shards stay too large. Whatever a shard's size, it is compared by blocks of a
bounded number of rows.

Within a shard only a star of links per group is put out, never its pairs. Groups that meet in
points are joined by rounds of min-label propagation over distinct points, each written to the
checkpoint folder, until nothing changes.

Edge cases: a null or empty text, or one without words, has fingerprint zero and is linked like
any other. Texts with fewer words than a shingle are one shingle. Repeated doc_ids are judged
row by row and take the smallest doc_id of their group. A null doc_id is kept; it is never the
smallest unless all are null. Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import written

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Points of one shard above which it is split by a further vantage point.
SHARD_ROWS = 20_000
#: Shingle hashes whose bits are spread at once.
SPREAD = 1 << 14
#: Points of an even shard above which the forest takes finer trees.
EVEN_ROWS = 256
#: Rows of shards that one task compares, about.
TASK_ROWS = 100_000
#: Most levels of vantage points below the parts.
LEVELS = 6


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A to Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    hashed = xxhash.xxh64_intdigest
    found = [
        hashed(joined[a:b], SEED)
        for a, b in zip(starts[: 1 - size].tolist(), stops[size - 1 :].tolist(), strict=True)
    ]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SPREAD):
        octets = hashes[at : at + SPREAD].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(size: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            signed = np.array(marks, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed)], names=["doc_id", "point"]
            )

    return mark


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, point): the fingerprint of every row as a signed 64-bit integer."""
    kept = documents.select("doc_id", "text")
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, point long")


def forest(n_points: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The parts, as (shift, width), that each tree searches with radius 0.

    The fewest parts at which an even shard holds at most EVEN_ROWS points.
    """
    m = radius + 1
    while True:
        cuts = [BITS * i // m for i in range(m + 1)]
        parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        trees = [list(c) for c in combinations(parts, m - radius)]
        if n_points >> min(sum(w for _, w in t) for t in trees) <= EVEN_ROWS or m == 2 * radius + 2:
            return trees
        m += 1


def vantage(level: int) -> int:
    """The vantage point of a level as a signed integer; fixed."""
    value = xxhash.xxh64_intdigest(f"vantage {level}".encode(), SEED)
    return value - (1 << 64) if value >> 63 else value


def shards(
    points: DataFrame, trees: list[list[tuple[int, int]]], radius: int, shard_rows: int
) -> DataFrame:
    """(shard, point): all shards with their points; all linked pairs meet in one.

    Shards are told apart by a hash; two that share one are compared together, which finds
    the same links.
    """
    value = lambda a, w: F.shiftrightunsigned("point", a).bitwiseAND(F.lit((1 << w) - 1))
    keys = [F.xxhash64(F.lit(t), *[value(*p) for p in parts]) for t, parts in enumerate(trees)]
    now = written(points.select(F.explode(F.array(*keys)).alias("shard"), "point"), "shards")
    for level in range(LEVELS):
        large = now.groupBy("shard").count().where(F.col("count") > shard_rows)
        large = written(large.select("shard", F.lit(True).alias("split")), "large-shards")
        if large.isEmpty():
            break
        apart = F.bit_count(F.col("point").bitwiseXOR(F.lit(vantage(level)))).cast("int")
        width = 2 * radius + 1
        home = F.floor(apart / width)
        inner = F.floor(F.greatest(apart - radius, F.lit(0)) / width)
        homes = F.array_distinct(
            F.array(F.xxhash64("shard", home), F.xxhash64("shard", inner))
        )
        now = written(
            now.join(large, "shard", "left").select(
                F.explode(F.when(F.col("split"), homes).otherwise(F.array("shard"))).alias("shard"),
                "point",
            ),
            "shards",
        )
    return now


def _join_groups(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``root`` after the groups of both ends of every link are one; roots are least indices."""
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right = left[apart], right[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def shard_groups(shard: np.ndarray, points: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """For each row the least index of its group; rows sorted by shard, points unsigned.

    Small shards are compared together, each row with the k-th after it; large ones by
    blocks. Memory is bounded by the rows plus the square of a block.
    """
    n = len(points)
    root = np.arange(n)
    heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[heads, n])
    ends = np.repeat(heads + sizes, sizes)
    small = np.repeat(sizes <= block // 2, sizes)
    rows = np.flatnonzero(small)
    k = 1
    while len(rows := rows[rows + k < ends[rows]]):
        near = rows[np.bitwise_count(points[rows] ^ points[rows + k]) <= radius]
        root = _join_groups(root, near, near + k)
        k += 1
    for head, size in zip(heads[sizes > block // 2], sizes[sizes > block // 2], strict=True):
        for a in range(head, head + size, block):
            for b in range(a, head + size, block):
                stop = head + size
                ours, theirs = points[a : min(a + block, stop)], points[b : min(b + block, stop)]
                i, j = np.nonzero(np.bitwise_count(ours[:, None] ^ theirs[None]) <= radius)
                root = _join_groups(root, i + a, j + b)
    return root


def _stars(radius: int):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", kind="stable")
        points = rows["point"].to_numpy()
        root = shard_groups(rows["shard"].to_numpy(), points.view(np.uint64), radius)
        far = points[root] != points
        return pd.DataFrame({"a": points[root[far]], "b": points[far]})

    return link


def links(points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): a star of links for each group within a shard; points must be distinct."""
    spread = shards(points, forest(points.count(), radius), radius, shard_rows)
    tasks = spread.count() // TASK_ROWS + 1
    return (
        spread.withColumn("task", F.pmod("shard", F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(_stars(radius), "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """(point, root): the least point of each group of linked points.

    Every point keeps the least label seen; a round hands labels along links and then takes
    the label's own label, so a chain of length n needs about log n rounds.
    """
    both = written(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = written(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "point"),
        "labels",
    )
    turn = 0
    while True:
        told = both.join(labels.withColumnRenamed("point", "b"), "b").select(
            F.col("a").alias("point"), "root"
        )
        # the root a point had is told what the point has heard
        heard = told.groupBy("point").agg(F.min("root").alias("heard"))
        near = labels.join(heard, "point", "left").select(
            "point", "root", F.least("root", F.coalesce("heard", "root")).alias("new")
        )
        hooks = near.where("new < root").select(F.col("root").alias("point"), F.col("new"))
        best = (
            near.select("point", "new")
            .unionByName(hooks)
            .groupBy("point")
            .agg(F.min("new").alias("new"))
        )
        jumped = best.alias("x").join(
            best.select(F.col("point").alias("p2"), F.col("new").alias("new2")),
            F.col("x.new") == F.col("p2"),
            "left",
        )
        after = jumped.select("point", F.least("new", F.coalesce("new2", "new")).alias("root"))
        after = written(after, f"labels-{turn}")
        moved = after.join(labels.withColumnRenamed("root", "old"), "point").where("root < old")
        done = moved.isEmpty()
        labels, turn = after, turn + 1
        if done:
            return labels


def groups(
    documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``documents``."""
    marked = written(fingerprints(documents, shingle), "fingerprints")
    points = written(
        marked.groupBy("point").agg(F.min("doc_id").alias("least")), "points"
    )
    rooted = components(links(points.select("point"), radius, shard_rows))
    # points without links are their own group
    held = points.join(rooted, "point", "left").select(
        "point", "least", F.coalesce("root", "point").alias("root")
    )
    named = held.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = held.join(named, "root").select("point", "component_id")
    hexed = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return marked.join(of_point, "point").select(
        "doc_id", hexed.alias("fingerprint"), "component_id"
    )
