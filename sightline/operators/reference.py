"""The reference population: baselines, lines, score grids, and places on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.operators.joins import step_lookup
from sightline.operators.ordered import attach_row
from sightline.operators.quantiles import quantiles, unpivot

GRID = tuple(round(q / 100, 2) for q in range(1, 100)) + (0.995, 0.999)


def _clean(entities: DataFrame, features: Sequence[str]) -> DataFrame:
    return unpivot(entities.filter(F.col("label") == "clean"), [], features)


def clean_baselines(
    entities: DataFrame, features: Sequence[str], *, method: str = "linear"
) -> DataFrame:
    """The clean population's median per measurement: feature, baseline."""
    return quantiles(
        _clean(entities, features),
        ["feature"],
        "value",
        {"baseline": 0.5},
        method=method,
    )


def clean_lines(
    entities: DataFrame, features: Sequence[str], *, method: str = "linear"
) -> DataFrame:
    """Where 95% and 99% of the clean population stop: feature, notable, strong.

    Direction-aware; floors may only raise a line.
    """
    directed = [f for f in features if K.FEATURE_LABELS[f][1] in ("higher", "lower")]
    upper, top = K.NOTABLE_QUANTILE, K.STRONG_QUANTILE
    found = quantiles(
        _clean(entities, directed),
        ["feature"],
        "value",
        {"p95": upper, "p99": top, "p05": 1 - upper, "p01": 1 - top},
        method=method,
    )
    lower = F.col("feature").isin(
        [f for f in directed if K.FEATURE_LABELS[f][1] == "lower"]
    )
    notable = F.when(lower, F.col("p05")).otherwise(F.col("p95"))
    strong = F.when(lower, F.col("p01")).otherwise(F.col("p99"))
    for feature, (first, second) in K.LINE_FLOORS.items():
        here = F.col("feature") == feature
        notable = F.when(here, F.greatest(notable, F.lit(first))).otherwise(notable)
        strong = F.when(here, F.greatest(strong, F.lit(second))).otherwise(strong)
    return found.select("feature", notable.alias("notable"), strong.alias("strong"))


def entity_scores(window_scores: DataFrame) -> DataFrame:
    """Per entity the mean window score."""
    keys = [
        c for c in ("session_id", "entity_id", "label") if c in window_scores.columns
    ]
    return window_scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("score").alias("score")
    )


def topk_scores(window_scores: DataFrame, k: int = 5) -> DataFrame:
    """Mean, maximum and mean of the k highest window scores per entity."""
    keys = ["session_id", "entity_id"]
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "window_uid")
    # a rank filter right above the window: each task keeps k rows before shuffling
    top = (
        window_scores.select(*keys, "window_uid", "score")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.avg("score").alias("score_topk"))
    )
    return (
        window_scores.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.avg("score").alias("score_mean"),
            F.max("score").alias("score_max"),
        )
        .join(top, keys)
    )


def score_reference(
    scores: DataFrame, *, levels: Sequence[float] = GRID, method: str = "linear"
) -> DataFrame:
    """Quantile grid of the clean scores: level, cut, and the population's counts."""
    names = {f"g{i}": q for i, q in enumerate(levels)}
    grid = quantiles(
        scores.filter(F.col("label") == "clean"),
        [],
        "score",
        names,
        method=method,
        counts=True,
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(q)).alias("level"), F.col(n).alias("cut"))
            for n, q in names.items()
        ]
    )
    positive = quantiles(
        scores.filter(F.col("label") == "cheater"),
        [],
        "score",
        {"cheater_median": 0.5},
        method=method,
        counts=True,
    ).withColumnRenamed("n", "n_cheater")
    # without positives the aggregate still gives its one (NULL) row
    positive = positive.agg(
        F.max("cheater_median").alias("cheater_median"),
        F.max("n_cheater").alias("n_cheater"),
    )
    return attach_row(
        grid.withColumnRenamed("n", "n_clean").select("n_clean", F.inline(rows)),
        positive,
    )


def place_scores(
    scores: DataFrame, grid: DataFrame, *, min_windows: int = K.MIN_WINDOWS
) -> DataFrame:
    """Each score's place among the clean population, and whether it has support."""
    return step_lookup(
        scores, grid.select("level", "cut"), value="score"
    ).withColumn("enough", F.col("n_windows") >= min_windows)
