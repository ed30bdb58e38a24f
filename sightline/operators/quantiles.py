"""Exact quantiles and ranks of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a
group becomes a value histogram (partial aggregation), the histogram is cut into
value chunks, and only the chunks holding a wanted rank are looked into.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.ordered import running_total, value_chunk

METHODS = ("linear", "nearest", "lower", "higher")


def unpivot(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature"
) -> DataFrame:
    """Wide to long, as doubles: keys, ``feature``, ``value``."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, "value")


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values per key with their counts; NULL and NaN left out."""
    v = F.col(value).cast("double")
    kept = df.filter(v.isNotNull() & ~F.isnan(v))
    # -0.0 and 0.0 are one value
    return kept.groupBy(*keys, (v + F.lit(0.0)).alias(value)).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ranks(total: Column, q: float, method: str) -> Column:
    """The 0-based ranks a quantile reads and their weights."""
    at = F.lit(float(q)) * (total - 1)
    low = F.floor(at).cast("long")
    if method == "linear":
        frac = at - low
        return F.array(
            F.struct(low.alias("rank"), (1 - frac).alias("w")),
            F.struct(F.ceil(at).cast("long").alias("rank"), frac.alias("w")),
        )
    rank = {
        "lower": low,
        "higher": F.ceil(at).cast("long"),
        "nearest": F.floor(at + F.lit(0.5)).cast("long"),
    }[method]
    return F.array(F.struct(rank.alias("rank"), F.lit(1.0).alias("w")))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    *,
    method: str = "linear",
    counts: bool = False,
) -> DataFrame:
    """Exact quantiles per key, one output column per entry of ``wanted``.

    Groups without a value do not appear. ``counts`` also returns ``n``.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    keys = list(keys)
    work = df
    if not keys:
        work, keys = df.withColumn("_everything", F.lit(0)), ["_everything"]
    hist = histogram(work, keys, value).withColumn("_chunk", value_chunk(value))
    sizes = hist.groupBy(*keys, "_chunk").agg(F.sum("n").alias("_size"))
    along = W.partitionBy(*keys).orderBy("_chunk")
    placed = sizes.select(
        *keys,
        "_chunk",
        "_size",
        F.coalesce(
            F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_pre"),
        F.sum("_size").over(W.partitionBy(*keys)).alias("_total"),
    )
    asks = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                _ranks(F.col("_total"), q, method).alias("ranks"),
            )
            for name, q in wanted.items()
        ]
    )
    flat = F.flatten(
        F.transform(
            asks,
            lambda a: F.transform(
                a["ranks"],
                lambda r: F.struct(
                    a["name"].alias("name"), r["rank"].alias("rank"), r["w"].alias("w")
                ),
            ),
        )
    )
    inside_chunk = F.filter(
        flat,
        lambda r: (r["rank"] >= F.col("_pre"))
        & (r["rank"] < F.col("_pre") + F.col("_size")),
    )
    needed = placed.select(
        *keys, "_chunk", "_pre", "_total", inside_chunk.alias("_asks")
    ).filter(F.size("_asks") > 0)
    inside = W.partitionBy(*keys, "_chunk").orderBy(value)
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        hist.join(needed, [*keys, "_chunk"])
        .withColumn("_upto", F.col("_pre") + F.sum("n").over(inside))
        .withColumn(
            "_asks",
            F.filter(
                "_asks",
                lambda r: (r["rank"] < F.col("_upto"))
                & (r["rank"] >= F.col("_upto") - F.col("n")),
            ),
        )
        .filter(F.size("_asks") > 0)
        .select(*keys, "_total", F.col(value).alias("_v"), F.inline("_asks"))
    )
    out = ranked.groupBy(*keys).agg(
        F.first("_total").alias("n"),
        *[
            F.sum(F.when(F.col("name") == q, F.col("_v") * F.col("w"))).alias(q)
            for q in wanted
        ],
    )
    if not counts:
        out = out.drop("n")
    return out.drop("_everything")


def feature_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    *,
    method: str = "linear",
) -> DataFrame:
    """Quantiles of several columns in one pass: output -> (column, q), wide per key."""
    columns = sorted({c for c, _ in wanted.values()})
    points = sorted({q for _, q in wanted.values()})
    names = {q: f"q{i}" for i, q in enumerate(points)}
    tall = quantiles(
        unpivot(df, keys, columns),
        [*keys, "feature"],
        "value",
        {n: q for q, n in names.items()},
        method=method,
    )
    return tall.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col(names[q]))).alias(out)
            for out, (c, q) in wanted.items()
        ]
    )


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    percentiles: Mapping[str, float],
    *,
    method: str = "nearest",
) -> DataFrame:
    """Per key and column: n, nulls, mean, std, min, max and the chosen percentiles.

    Columns become rows first, so all of them take one pass; a column without a value
    has NULLs and n = 0.
    """
    by = [*keys, "column"]
    tall = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("_c"),
    ).select(*keys, "_c.*")
    moments = tall.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cuts = quantiles(tall.filter("value is not null"), by, "value", percentiles, method=method)
    return moments.join(cuts, by, "left")


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str]
) -> DataFrame:
    """For a histogram: ``<count>_below`` and ``<count>_total`` next to each value."""
    out = running_total(
        df,
        keys,
        value_chunk(value),
        [value],
        {f"{c}_upto": F.col(c) for c in counts},
        grand={f"{c}_total": f"{c}_upto" for c in counts},
    )
    return out.withColumns(
        {f"{c}_below": F.col(f"{c}_upto") - F.col(c) for c in counts}
    )
