"""Repeatable samples, splits, queues, bags and unions.

Order comes from a digest of the key, so a sample is the same on every run and for
every partitioning. Per-group limits keep k rows per task before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.operators.ordered import hash_chunk, number_by_range, number_rows


def digest(*key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("/", *[k.cast("string") for k in key], F.lit(str(seed))))


def hash_number(d: Column) -> Column:
    return F.conv(F.substring(d, 1, 8), 16, 10).cast("long")


def floor_share(count: Column, share: float) -> Column:
    """floor(count * share) with the share as it is written: as doubles 90 000 * 0.7 is below 63 000."""
    return F.floor(count.cast("decimal(20,0)") * F.lit(Decimal(str(share)))).cast("long")


def stratified_sample(
    df: DataFrame, strata: Sequence[str], key: str, n: int, *, seed: int = 0
) -> DataFrame:
    """Exactly ``n`` rows per stratum (or all it has)."""
    order = W.partitionBy(*strata).orderBy(digest(F.col(key), seed=seed), key)
    return (
        df.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


def group_split(
    df: DataFrame,
    group: str,
    *,
    shares: Sequence[tuple[str, float]] = (
        ("train", 0.7),
        ("val", 0.85),
        ("test", 1.0),
    ),
    seed: int = 0,
) -> DataFrame:
    """Add ``split`` so that whole groups land together; shares are cumulative."""
    groups = df.select(group).distinct().withColumn("_d", digest(F.col(group), seed=seed))
    placed = number_rows(groups, [], hash_chunk("_d"), ["_d", group], "_rn", count="_n")
    split = F.lit(shares[-1][0])
    for name, share in reversed(shares[:-1]):
        cut = floor_share(F.col("_n"), share)
        split = F.when(F.col("_rn") <= cut, name).otherwise(split)
    return df.join(placed.select(group, split.alias("split")), group)


def stopping_split(df: DataFrame, group: str, *, parts: int = 6, seed: int = 0) -> DataFrame:
    """Add ``split``: of the groups, one in ``parts`` is ``val``, to tell when to stop."""
    groups = df.select(group).distinct().withColumn("_d", digest(F.col(group), seed=seed))
    placed = number_rows(groups, [], hash_chunk("_d"), ["_d", group], "_rn", count="_n")
    held = F.col("_rn") <= F.floor(F.col("_n") / parts)
    split = F.when(held, "val").otherwise("train")
    return df.join(placed.select(group, split.alias("split")), group)


def group_folds(df: DataFrame, group: str, k: int = 5, *, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0..k-1, a function of the group alone: no join, no shuffle."""
    return df.withColumn("fold", hash_number(digest(F.col(group), seed=seed)) % k)


def balanced_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Add ``fold`` 0..k-1, whole groups together and folds alike in rows.

    Groups are ranked by size and dealt to the folds there and back: 0..k-1, k-1..0, and so on.
    Whatever the sizes, the largest and smallest fold differ by one largest group at most. Rows
    without a group are a group.
    """
    sizes = df.groupBy(group).agg((-F.count(F.lit(1))).alias("_less")).withColumn("_none", F.col(group).isNull())
    ranked = number_by_range(sizes, [], ["_less", "_none", group], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(2 * k))
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")
    dealt = ranked.select(F.col(group).alias("_group"), fold.alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def interleave(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    first: Column,
    *,
    seed: int = 0,
) -> DataFrame:
    """A queue that takes one row per stratum in turn, ``first`` rows before others.

    Adds ``half`` (0 before 1) and ``turn``; the queue's order is half, turn, strata.
    """
    tagged = df.withColumns(
        {
            "half": F.when(first, 0).otherwise(1),
            "_d": digest(F.col(key), seed=seed),
        }
    )
    return number_rows(
        tagged, ["half", *strata], hash_chunk("_d"), ["_d", key], "turn"
    ).drop("_d")


def priority_union(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union keeping, per key, the row of the first table that has it."""
    out: DataFrame | None = None
    for n, t in enumerate(tables):
        tagged = t.withColumn("_priority", F.lit(n))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "_priority")]
    picked = out.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "_priority").alias("_row"),
        F.min("_priority").alias("priority"),
    )
    return picked.select(*keys, "priority", "_row.*")


def schema_union(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of differing schemas: missing columns are NULL, numbers widen to double."""
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    out: DataFrame | None = None
    for t in tables:
        relaxed = t
        for name, found in kinds.items():
            if len(found) > 1 and name in t.columns:
                whole = found <= {"tinyint", "smallint", "int", "bigint"}
                numeric = found <= {
                    "tinyint",
                    "smallint",
                    "int",
                    "bigint",
                    "float",
                    "double",
                }
                to = "bigint" if whole else "double" if numeric else "string"
                relaxed = relaxed.withColumn(name, F.col(name).cast(to))
        out = (
            relaxed
            if out is None
            else out.unionByName(relaxed, allowMissingColumns=True)
        )
    return out


def hard_negatives(
    rows: DataFrame, score: str, n: int, *, key: str, label: str = "clean"
) -> DataFrame:
    """The ``n`` highest-scored reference rows; NULL scores last."""
    return (
        rows.filter(F.col("label") == label)
        .orderBy(F.desc_nulls_last(score), key)
        .limit(n)
    )


def case_selection(
    rows: DataFrame,
    key: str,
    score: str,
    *,
    per_label: int,
    hard: int,
    seed: int = 0,
) -> DataFrame:
    """n positives, n clean and the hardest clean rows, each once."""
    usable = rows.filter(F.col("label").isin("cheater", "clean"))
    drawn = stratified_sample(usable, ["label"], key, per_label, seed=seed)
    return priority_union(
        [drawn, hard_negatives(rows, score, hard, key=key)], [key]
    )


def bags(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    chunk: Column,
    size: int = K.BAG_SIZE,
    min_rows: int = 5,
) -> DataFrame:
    """At most ``size`` rows per entity, evenly spread, as padded arrays with a mask.

    Rows are picked by position before anything is collected, so a bag never holds
    more than ``size`` of them.
    """
    placed = number_rows(rows, keys, chunk, [order], "_rn", count="n_rows")
    place = F.col("_rn") - 1
    # floor(i * (n - 1) / (size - 1)) for i in 0..size-1
    steps = F.greatest(F.col("n_rows") - 1, F.lit(1))
    nearest = F.ceil(place * (size - 1) / steps).cast("long")
    hit = F.floor(nearest * steps / F.lit(size - 1)) == place
    picked = placed.filter(
        (F.col("n_rows") >= min_rows) & ((F.col("n_rows") <= size) | hit)
    )
    grouped = picked.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.sort_array(
            F.collect_list(F.struct("_rn", *[F.col(v).cast("double").alias(v) for v in values]))
        ).alias("_bag"),
    )
    pad = F.array_repeat(F.lit(0.0), (F.lit(size) - F.size("_bag")).cast("int"))

    def column(v: str) -> Column:
        return F.concat(F.transform("_bag", lambda b: b[v]), pad).alias(v)

    mask = F.concat(F.transform("_bag", lambda b: F.lit(1.0)), pad)
    return grouped.select(
        *keys, "n_rows", *[column(v) for v in values], mask.alias("mask")
    )
